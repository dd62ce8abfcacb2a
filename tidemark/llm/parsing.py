"""Document fingerprints by locally consistent parsing with deterministic coin tossing."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import corpus_size, lean
from .hashing import mix

#: Phrase names of these levels are the signature; a phrase of level n has about 3^n code points.
LEVELS = (2, 3, 4)
#: Least names that a fingerprint holds.
KEPT = 64
#: Bytes of text of one part of the order, parsed by one task.
PART_BYTES = 8 << 20
#: Parts at most, what bounds the cuts on the driver; tasks stream their parts, so parts may grow beyond.
MOST_PARTS = 1 << 15
_PARSED_AT_ONCE = 400_000
_MULT = np.uint64(0x9E3779B97F4A7C15 | 1)
_DEBRUIJN = np.uint64(0x03F79D71B4CB0A89)
_PLACE = np.zeros(64, np.uint8)
_PLACE[((np.uint64(1) << np.arange(64, dtype=np.uint64)) * _DEBRUIJN >> np.uint64(58)).astype(np.int64)] = np.arange(64)
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _coin_table() -> np.ndarray:
    """Coins of small labels: 2 * (lowest place where a label differs from the one before) + its bit there."""
    a, b = np.meshgrid(np.arange(128), np.arange(128), indexing="ij")  # before, own
    d = a ^ b
    low = np.where(d > 0, np.log2(np.maximum(d & -d, 1)).astype(np.int64), 0)
    return (2 * low + ((b >> low) & 1)).astype(np.uint8).ravel()


_COINS = _coin_table()


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        n = max(n, 1 << 19)
        for k, base in enumerate((_MULT, np.uint64(pow(int(_MULT), -1, 1 << 64)))):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            _POWERS[k] = np.multiply.accumulate(p)
    return _POWERS[0], _POWERS[1]


def _named(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Names of the phrases of x that begin at starts: hashes of their symbols and lengths."""
    up, down = _powers(len(x) + 1)
    sums = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(mix(x) * up[: len(x)], out=sums[1:])
    stops = np.append(starts[1:], len(x))
    return mix((sums[stops] - sums[starts]) * down[starts] + (stops - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def phrase_level(x: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of the next level's phrases of each text, and their bounds.

    Equal neighbours become one symbol with their number. Then three rounds of coins leave labels under eight that
    differ from their neighbours, and phrases begin at the texts' starts and at local maxima: whether a place begins a phrase
    depends on a few symbols around it alone.
    """
    n = len(x)
    if not n:
        return x, bounds
    begins = bounds[:-1][bounds[:-1] < bounds[1:]]
    new = np.ones(n, bool)
    new[1:] = x[1:] != x[:-1]
    new[begins] = True
    runs = np.flatnonzero(new)
    long = np.diff(np.append(runs, n))
    y = x[runs]
    y = np.where(long > 1, mix(y + long.astype(np.uint64) * np.uint64(0xA0761D6478BD642F)), y)
    bounds = np.searchsorted(runs, bounds)
    begins = bounds[:-1][bounds[:-1] < bounds[1:]]
    prev = np.empty_like(y)
    prev[1:] = y[:-1]
    prev[begins] = ~y[begins]
    d = y ^ prev
    low = _PLACE[((d & (~d + np.uint64(1))) * _DEBRUIJN >> np.uint64(58)).astype(np.uint8)]
    label = (2 * low + ((y >> low.astype(np.uint64)) & np.uint64(1)).astype(np.uint8)).astype(np.uint8)
    for _ in range(2):
        before = np.empty(len(label), np.int64)
        before[1:] = label[:-1]
        before[begins] = label[begins] ^ 1
        label = _COINS[before * 128 + label]
    peak = np.zeros(len(label), bool)
    if len(label) > 2:
        peak[1:-1] = (label[1:-1] > label[:-2]) & (label[1:-1] > label[2:])
    last = bounds[1:][bounds[:-1] < bounds[1:]] - 1
    peak[last] = False
    peak[begins] = True
    starts = np.flatnonzero(peak)
    return _named(y, starts), np.searchsorted(starts, bounds)


def fingerprints(texts: list[str], levels=LEVELS, kept: int = KEPT) -> list[np.ndarray]:
    """The least ``kept`` distinct phrase names of each text, sorted, as 32-bit numbers; none for an empty text.

    Texts too short for a phrase of the last levels have their single names there.
    """
    out: list[np.ndarray] = []
    at = 0
    while at < len(texts):
        stop, size = at, 0
        while stop < len(texts) and (stop == at or size + len(texts[stop]) <= _PARSED_AT_ONCE):
            size += len(texts[stop])
            stop += 1
        some = texts[at:stop]
        x = np.frombuffer("".join(some).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        bounds = np.concatenate([[0], np.cumsum([len(t) for t in some])])
        names = [[] for _ in some]
        for level in range(1, max(levels) + 1):
            x, bounds = phrase_level(x, bounds)
            if level in levels:
                salted = mix(x + np.uint64(level)) >> np.uint64(32)
                for k in range(len(some)):
                    names[k].append(salted[bounds[k] : bounds[k + 1]])
        for parts in names:
            out.append(np.unique(np.concatenate(parts))[:kept].astype(np.uint32))
        at = stop
    return out


def likeness(a: np.ndarray, b: np.ndarray, kept: int = KEPT) -> float:
    """Share of common names among the least of both, an estimate of the likeness of all names; two empty texts: 1."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    least = np.union1d(a, b)[:kept]
    return float(len(np.intersect1d(np.intersect1d(least, a), b)) / len(least))


def _hex(x: np.ndarray) -> str:
    return x.astype(">u4").tobytes().hex()


def _in_order(batches):
    """Rows sorted by (part, order): each with the row after it in its part."""

    def done(rows):
        texts = [t for _, t, *_ in rows]
        edited = []
        for t, after in zip(texts, texts[1:]):
            k = len(t) // 2
            edited.append(t[: len(t) - k] + after[:k])
        prints = fingerprints(texts)
        other = fingerprints(edited)
        n = len(edited)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([r[0] for r in rows[:n]], pa.int64()), pa.array([len(t) for t in texts[:n]], pa.int64()),
                pa.array([hashlib.sha256(t.encode("utf8", "surrogatepass")).hexdigest() for t in edited]),
                pa.array([_hex(p) for p in prints[:n]], pa.string()), pa.array([_hex(p) for p in other], pa.string()),
                pa.array([likeness(a, b) for a, b in zip(prints, other)], pa.float64()), pa.array([likeness(a, b) for a, b in zip(prints, prints[1:])], pa.float64()),
            ],
            names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    held: list[tuple] = []
    size = 0
    for batch in batches:
        for row in zip(*(batch.column(k).to_pylist() for k in range(3))):
            if held and held[-1][2] != row[2]:  # a new part; the row held last belongs to the part before, as what follows it
                if len(held) > 1:
                    yield done(held)
                held, size = [], 0
            held.append((row[0], row[1] or "", row[2]))
            size += len(held[-1][1])
            if size > 2_000_000:
                yield done(held)
                held, size = held[-1:], len(held[-1][1])
    if len(held) > 1:
        yield done(held)


def parse_documents(docs: DataFrame) -> DataFrame:
    """Fingerprint each text and its edited text, whose last half comes from the next document by descending doc_id.

    Returns (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next), a row for each
    row; other columns are ignored. Null texts are empty; an empty text's fingerprint is empty. Rows of
    one doc_id follow in the order of their texts' hashes; null doc_ids come last; the first row follows the last one, a
    single row follows itself. Equal texts have equal fingerprints. An empty table gives no rows.

    The order is cut in parts of about PART_BYTES at quantiles of doc_id, rows without doc_id by their texts' hashes; each part also
    gets the first row of the next, so no task sees more than its part and one row, and none holds more than a run of rows.
    """
    from pyspark.ml.feature import Bucketizer

    rows, size = corpus_size(docs)
    if not rows:
        return docs.select(F.col("doc_id").cast("long")).mapInArrow(lambda b: iter(()), _SCHEMA)
    parts = min(MOST_PARTS, max(1, -(-size // PART_BYTES)))
    d = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    # doubles order ids as longs do, but for ids that share one, and those share a part too
    d = d.withColumn("at", F.col("doc_id").cast("double"))
    cuts, without = [], 0
    if parts > 1:
        found = d.agg(F.percentile_approx("at", [k / parts for k in range(1, parts)], 10 * parts), F.count_if(F.col("doc_id").isNull())).first()
        cuts, without = sorted({float(x) for x in found[0] or []}), int(found[1])
    n = len(cuts)
    tail = max(1, round(parts * without / rows))  # parts of the rows without doc_id
    share = (F.col("tie").cast("double") / float(1 << 63) + 1) / 2
    last = n + 1 + F.least(F.floor(share * tail), F.lit(tail - 1))
    if cuts:
        split = Bucketizer(splits=[-float("inf"), *cuts, float("inf")], inputCol="at", outputCol="bucket", handleInvalid="keep")
        d = split.transform(d)
        d = d.withColumn("part", F.when(F.col("doc_id").isNull(), last).otherwise(n - F.col("bucket")).cast("int"))  # descending doc_id
    else:
        d = d.withColumn("part", F.when(F.col("doc_id").isNull(), last).otherwise(F.lit(0)).cast("int"))
    # descending order of all longs: the complement of each
    down = F.struct(F.col("doc_id").isNull().alias("none"), F.bitwise_not("doc_id").alias("id"), F.col("tie").alias("tie"))
    first = d.groupBy("part").agg(F.min(down).alias("f")).select("part", "f.*").orderBy("part").collect()  # a row for each part
    ahead = [(first[k - 1]["part"], x["part"], None if x["none"] else ~x["id"], x["tie"]) for k, x in enumerate(first)]
    plan = docs.sparkSession.createDataFrame(ahead, "to int, part int, doc_id long, tie long")
    same = (F.col("d.part") == F.col("p.part")) & F.col("d.doc_id").eqNullSafe(F.col("p.doc_id")) & (F.col("d.tie") == F.col("p.tie"))
    # at most MOST_PARTS rows and as many for rows without doc_id; rows that are equal in all of this have equal texts
    shown = d.alias("d").join(F.broadcast(plan).alias("p"), same).select(F.col("d.doc_id"), F.col("d.text"), F.col("p.to").alias("part"), F.col("d.tie")).dropDuplicates(["part"])
    both = d.select("doc_id", "text", "part", "tie", F.lit(0).alias("after")).union(shown.select("doc_id", "text", "part", "tie", F.lit(1)))
    dealt = both.repartitionById(n + 1 + tail, F.col("part")).sortWithinPartitions("part", "after", F.col("doc_id").desc_nulls_last(), "tie")
    return dealt.select("doc_id", "text", "part").mapInArrow(lean(_in_order), _SCHEMA)


_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
