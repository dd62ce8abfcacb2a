"""Best-fit decreasing packing of tokenised documents into sequences of bounded length."""

from __future__ import annotations

import json
import re
import zlib
from array import array

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, lean, ranked

CAPACITY = 2048
#: Chunks of text whose ids a Python worker keeps; later ones are encoded each time.
CACHED = 200_000
#: Unicode white space, as the tokenizer's pattern has it.
_SPACES = tuple("\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")

#: Fixed value: the pattern that cuts texts for byte-level BPE of this kind.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class _Unsplit(Exception):
    """A part of a text that can't be encoded alone."""


class _Parts(dict):
    """Ids of the parts of texts between single spaces, each with the space before it."""

    def __init__(self, encode, lead: str):
        super().__init__()
        self.encode, self.lead = encode, lead

    def __missing__(self, part: str) -> bytes:
        if not part or part.startswith(_SPACES) or part.endswith(_SPACES):
            raise _Unsplit
        ids = self.encode(self.lead + part)
        if len(self) < CACHED:
            self[part] = ids
        return ids


def _added_tokens(path: str) -> dict[str, int] | None:
    """Ids of the file's added tokens, which stand for themselves wherever a text has them; None if any takes more than its own characters."""
    added = json.loads(open(path, encoding="utf8").read()).get("added_tokens", [])
    if any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in added):
        return None
    return {t["content"]: t["id"] for t in added}


def _byte_level_ranks(path: str) -> dict[bytes, int] | None:
    """Ranks of a byte-level BPE whose merges stand in the order of their ids; None for any other model."""
    spec = json.loads(open(path, encoding="utf8").read())
    model, split = spec["model"], spec.get("pre_tokenizer") or {}
    if model.get("type") != "BPE" or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or spec.get("normalizer"):
        return None
    printed = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printed]
    of = {chr(b): b for b in printed} | {chr(256 + k): b for k, b in enumerate(others)}
    special = {t["content"] for t in spec.get("added_tokens", [])}
    ids = [model["vocab"].get(m.replace(" ", "") if isinstance(m, str) else "".join(m)) for m in model["merges"]]
    if any(a is None for a in ids) or any(a >= b for a, b in zip(ids, ids[1:])):
        return None
    return {bytes(of[c] for c in token): i for token, i in model["vocab"].items() if token not in special}


class _Encoder:
    """Ids of texts as little-endian unsigned 32-bit bytes.

    A single space between two other characters always starts a new piece of the tokenizer's
    pattern, so a text is cut there and the ids of each part, with its space, are kept for later texts.
    Byte-level BPE files run on their merge ranks, all others by the tokenizers library. Text that spells an added token, such as
    the end of a text, is that token, as in a plain call of the library.
    """

    _kept: dict[str, _Encoder] = {}

    def __init__(self, path: str):
        ranks, added = _byte_level_ranks(path), _added_tokens(path)
        if added is None:
            ranks = None
        self.added, self.any_added = {t: array("I", [i]).tobytes() for t, i in (added or {}).items()}, None
        if ranks:
            if added:
                self.any_added = re.compile("(" + "|".join(re.escape(t) for t in sorted(added, key=len, reverse=True)) + ")")
            import tiktoken

            model = tiktoken.Encoding("own", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})
            self.plain = lambda text: array("I", model.encode_ordinary(text)).tobytes()
        else:
            from tokenizers import Tokenizer

            model = Tokenizer.from_file(path)
            self.plain = lambda text: array("I", model.encode(text, add_special_tokens=False).ids).tobytes()
        self.cuttable = bool(ranks)
        self.first, self.parts = _Parts(self.plain, ""), _Parts(self.plain, " ")

    @classmethod
    def of(cls, path: str) -> _Encoder:
        if path not in cls._kept:
            cls._kept[path] = cls(path)
        return cls._kept[path]

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if not self.cuttable:
            return self.plain(text)
        if self.any_added and self.any_added.search(text):
            return b"".join(self.added[x] if k % 2 else self.between(x) for k, x in enumerate(self.any_added.split(text)))
        return self.between(text)

    def between(self, text: str) -> bytes:
        """Ids of a text without added tokens."""
        if not text:
            return b""
        first, *parts = text.split(" ")
        try:
            return self.first[first] + b"".join(map(self.parts.__getitem__, parts))
        except _Unsplit:
            return self.plain(text)


def _pieces(path: str, capacity: int):
    def run(batches):
        encoder = _Encoder.of(path)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for at in range(0, len(ids), 256):
                out = [], [], [], [], []
                for doc, text in zip(ids[at : at + 256], texts.slice(at, 256).to_pylist()):
                    data = encoder.encode(text) + b"\0\0\0\0"
                    n = len(data) // 4
                    start = 0
                    for k in range(-(-n // capacity)):
                        length = (n % capacity or capacity) if k == 0 else capacity
                        for col, v in zip(out, (doc, k, start, length, zlib.crc32(data[4 * start : 4 * (start + length)]))):
                            col.append(v)
                        start += length
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), *[pa.array(c, pa.int64()) for c in out[2:]]],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return run


def token_pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): the ids of each row's text and a last id 0, cut where they are too many.

    A null or empty text has the id 0 alone. The first piece takes what is over, the others are full.
    """
    path = tokenizer or default_tokenizer()
    return docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(lean(_pieces(path, capacity)), _PIECES)


class SegmentTree:
    """Numbers of open bins by remaining capacity; finds the least capacity that holds a size in logarithmic time."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.sums = [0] * (2 * self.leaves)

    def add(self, capacity: int, n: int) -> None:
        i = self.leaves + capacity
        while i:
            self.sums[i] += n
            i >>= 1

    def tightest(self, size: int) -> int | None:
        """The least capacity of at least ``size`` that an open bin has."""
        i = self.leaves + size
        if self.sums[i]:
            return size
        while i > 1:
            if not i & 1 and self.sums[i + 1]:  # a left child whose right sibling has bins
                i += 1
                while i < self.leaves:
                    i *= 2
                    if not self.sums[i]:
                        i += 1
                return i - self.leaves
            i >>= 1
        return None


def best_fit_runs(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing of ``counts[size]`` items of each size, whole runs of equal bins at a time.

    Returns rows (size, first, items, each, bin, offset): the items of that size ranked first to first + items - 1
    fill bins bin, bin + 1, ..., ``each`` a bin, at that offset. The packing is that of the sequential method: while
    items of one size come, the tightest bin that fits takes as many as it holds before the next is opened.
    """
    tree = SegmentTree(capacity)
    open_bins: dict[int, list[tuple[int, int]]] = {}  # remaining capacity: runs (first bin, bins)
    bins, out = 0, []
    for size in sorted((s for s in counts if counts[s] > 0), reverse=True):
        left, rank = counts[size], 0
        while left:
            room = tree.tightest(size)
            if room is None:
                room, many = capacity, max(1, left // (capacity // size))
                runs, bins = [(bins, many)], bins + many
                open_bins.setdefault(capacity, []).extend(runs)
                tree.add(capacity, many)
            first, many = open_bins[room].pop()
            tree.add(room, -many)
            each = room // size
            used = min(many, left // each)
            if not used:  # fewer items than one bin holds
                each, used = left, 1
            out.append((size, rank, used * each, each, first, capacity - room))
            rank, left = rank + used * each, left - used * each
            if many > used:
                open_bins[room].append((first + used, many - used))
                tree.add(room, many - used)
            rest = room - each * size
            if rest:
                open_bins.setdefault(rest, []).append((first, used))
                tree.add(rest, used)
    return out


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Pack the token ids of all rows into as few sequences of ``capacity`` as best-fit decreasing makes.

    Returns (doc_id, piece, start, length, ids_crc32, sequence_id, offset), one row per piece; see ``token_pieces``.
    Full pieces are sequences of their own. For the others only the number of pieces of each length goes to the
    driver (``capacity`` numbers at most); there the method runs with a segment tree over remaining capacities and
    gives runs of equal bins, and each piece finds its bin by its rank among those of its length. Repeated rows are
    packed each; ties of length in any order; an empty table gives no rows; other columns are ignored.
    """
    pieces = cut(token_pieces(docs, tokenizer, capacity), "pieces")
    spark = docs.sparkSession
    counts = {int(r[0]): int(r[1]) for r in pieces.groupBy("length").agg(F.count(F.lit(1))).collect()}
    runs = best_fit_runs(counts, capacity)
    total = sum(counts.values())
    plan = spark.createDataFrame(runs or [(0, 0, 0, 1, 0, 0)], "size long, first long, items long, each long, bin long, at long")
    # an id of its own for equal rows: their order within a length does not matter
    place = ranked(pieces, ["length"], ["doc_id", "piece", "ids_crc32"], total)
    # proven size: as many rows as the method made runs on the driver
    x = place.join(F.broadcast(plan), (F.col("length") == F.col("size")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("first") + F.col("items")))
    inside = F.col("rank") - F.col("first")
    return x.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("bin") + F.floor(inside / F.col("each"))).cast("long").alias("sequence_id"),
        (F.col("at") + (inside % F.col("each")) * F.col("length")).cast("long").alias("offset"),
    )
