"""Removal of line runs that occur earlier: winnowing over line hashes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, lean
from .filters import bit_filter, mark_partners, passes
from .hashing import mix

#: Runs of at least so many words are found and removed.
RUN_WORDS = 50
_MULT = np.uint64(0x9E3779B97F4A7C15 | 1)


def _lines(batches):
    """Hashes and word counts of the lines of each row, packed."""
    for batch in batches:
        uid, doc, texts = batch.column(0), batch.column(1), batch.column(2)
        hashes, words = [], []
        for text in texts:
            lines = [x.strip() for x in text.as_py().split("\n")]
            hashes.append(np.array([xxhash.xxh3_64_intdigest(x) for x in lines], np.uint64).tobytes())
            words.append(np.array([len(x.split()) for x in lines], np.int32).tobytes())
        yield pa.RecordBatch.from_arrays([uid, doc, pa.array(hashes, pa.binary()), pa.array(words, pa.binary())], names=["uid", "doc_id", "hashes", "words"])


def run_windows(hashes: np.ndarray, words: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, stop, minimum) of each window: the fewest lines from a line on, and up to a line, that hold ``least`` words.

    The minimum is the place of its least line hash among the lines with words, the first of equal ones. Windows of both kinds
    cover every line of a run of ``least`` words: a line up to which the run has that many ends one, any other stands in the run's first.
    """
    n = len(hashes)
    total = np.concatenate([[0], np.cumsum(words, dtype=np.int64)])
    if total[-1] < least:
        none = np.zeros(0, np.int64)
        return none, none, none
    places = np.arange(n)
    stops = np.searchsorted(total, total[:-1] + least)  # the first bound with enough words from each line on
    starts = np.searchsorted(total, total[1:] - least, side="right") - 1  # the last line from which enough words lead up to each bound
    ahead, behind = stops <= n, starts >= 0
    both = np.stack([np.concatenate([places[ahead], starts[behind]]), np.concatenate([stops[ahead], places[behind] + 1])])
    lo, hi = np.unique(both, axis=1)
    value = mix(hashes)
    value[words == 0] = np.uint64(0xFFFFFFFFFFFFFFFF)
    return lo, hi, np.fromiter((i + int(value[i:j].argmin()) for i, j in zip(lo, hi)), np.int64, len(lo))


def _names(hashes: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Hashes of the windows' lines and their numbers."""
    up = np.full(len(hashes) + 1, _MULT)
    up[0] = 1
    up = np.multiply.accumulate(up)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(hashes + np.uint64(1)) * up[:-1], dtype=np.uint64)])
    down = np.full(len(hashes) + 1, np.uint64(pow(int(_MULT), -1, 1 << 64)))
    down[0] = 1
    down = np.multiply.accumulate(down)
    return mix((sums[hi] - sums[lo]) * down[lo] + (hi - lo).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)).view(np.int64)


def _fingerprints(least: int):
    """The fingerprints of a batch, the line hashes at the minima of its windows, with the number of their places."""

    def run(batches):
        with np.errstate(over="ignore"):
            for batch in batches:
                found = [np.zeros(0, np.uint64)]
                for h, w in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    h = np.frombuffer(h, np.uint64)
                    found.append(h[np.unique(run_windows(h, np.frombuffer(w, np.int32), least)[2])])
                prints, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(prints.view(np.int64)), pa.array(n.astype(np.int64))], names=["fingerprint", "n"])

    return run


def _windows(least: int, repeated):
    """The windows whose fingerprint occurs in more than one place."""

    def run(batches):
        bits = repeated.value
        with np.errstate(over="ignore"):
            for batch in batches:
                out = [[np.zeros(0, np.int64)] for _ in range(5)]
                for uid, doc, h, w in zip(*(batch.column(i).to_pylist() for i in range(4))):
                    h = np.frombuffer(h, np.uint64)
                    lo, hi, low = run_windows(h, np.frombuffer(w, np.int32), least)
                    some = passes(bits, h[low].view(np.int64))
                    lo, hi, low = lo[some], hi[some], low[some]
                    for col, v in zip(out, (_names(h, lo, hi), np.full(len(lo), doc, np.int64), np.full(len(lo), uid, np.int64), lo, low)):
                        col.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], names=["name", "doc_id", "uid", "start", "low"])

    return run


def extend(own: np.ndarray, source: np.ndarray, at: int, there: int) -> tuple[int, int]:
    """Bounds of the longest match of lines around own[at] == source[there]."""
    lo = 0
    most = min(at, there)
    while lo < most and own[at - lo - 1] == source[there - lo - 1]:
        lo += 1
    hi = 0
    most = min(len(own) - at, len(source) - there)
    while hi < most and own[at + hi] == source[there + hi]:
        hi += 1
    return at - lo, at + hi


def _extended(batches):
    for batch in batches:
        uids, los, his = [], [], []
        for uid, own, source, anchors in zip(*(batch.column(i).to_pylist() for i in range(4))):
            own, source = np.frombuffer(own, np.uint64), np.frombuffer(source, np.uint64)
            done: dict[int, int] = {}  # shift: end of the last match
            for a in sorted(anchors, key=lambda a: a["start"]):
                at, there = a["start"], a["there"]
                if at < done.get(at - there, -1):
                    continue
                lo, hi = extend(own, source, at, there)
                done[at - there] = hi
                uids.append(uid)
                los.append(lo)
                his.append(hi)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (uids, los, his)], names=["uid", "lo", "hi"])


def repeated_runs(docs: DataFrame, run_words: int = RUN_WORDS) -> DataFrame:
    """(uid, lo, hi): bounds of line runs that occur earlier. ``docs`` has uid, doc_id and text without nulls."""
    lines = docs.select("uid", "doc_id", "text").mapInArrow(lean(_lines), "uid long, doc_id long, hashes binary, words binary")
    lines = cut(lines.dropDuplicates(["uid"]), "lines")
    # a run that occurs twice has its windows' minima in both places: windows with a fingerprint of one place have no partner
    prints = lines.select("hashes", "words").mapInArrow(_fingerprints(run_words), "fingerprint long, n long")
    prints = cut(prints.groupBy("fingerprint").agg(F.sum("n").alias("n")).where("n > 1").select("fingerprint"), "fingerprints")
    repeated = docs.sparkSession.sparkContext.broadcast(bit_filter(prints, prints.count()))
    windows = lines.mapInArrow(_windows(run_words, repeated), "name long, doc_id long, uid long, start long, low long")
    windows = cut(windows, "windows")
    first = windows.groupBy("name").agg(F.min(F.struct("doc_id", "uid", "start")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    first = cut(first.select("name", F.col("first.uid").alias("source"), F.col("first.start").alias("there")), "first")
    later = windows.join(first, "name").where("uid <> source or start <> there")
    # windows that have their minimum in one place are one fingerprint, extended once
    prints = later.groupBy("uid", "source", "low", (F.col("start") - F.col("there")).alias("shift")).agg(F.min(F.struct("start", "there")).alias("a"))
    pairs = cut(prints.groupBy("uid", "source").agg(F.collect_list("a").alias("anchors")), "pairs")
    source = lines.select(F.col("uid").alias("source"), F.col("hashes").alias("theirs"))
    both = pairs.join(source, "source").join(lines.select("uid", "hashes"), "uid")
    return both.select("uid", F.col("hashes"), F.col("theirs"), "anchors").mapInArrow(_extended, "uid long, lo long, hi long")


def dedup_lines(docs: DataFrame, run_words: int = RUN_WORDS) -> DataFrame:
    """Remove the lines of every run of at least ``run_words`` words that occurs earlier, in the order of (doc_id, place).

    Returns the columns of ``docs`` with the text that stays, and n_lines, n_removed (lines before, lines removed). Lines
    are compared without outer white space. Every window of lines that just reaches ``run_words`` words, from a line on or up to one, is
    represented by its least line hash, its fingerprint. Windows with a fingerprint of several places are named by their content and
    joined to the first occurrence of that content, and the match is extended over equal lines both ways. So a line goes if any
    run around it occurs in any earlier place. The first occurrence stays; in overlapping repeats within a text the first lines
    stay. A null text stays null and has no lines; an empty text has one empty line. Rows that are equal in doc_id and text are one document
    and get one result. Null doc_ids come first. Extra columns are kept, whatever their names, but for n_lines and n_removed; an empty table gives no rows.
    """
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    uid = F.xxhash64(F.col("doc_id"), F.col("text"))
    known = docs.where(F.col("text").isNotNull()).select(uid.alias("uid"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("doc_id"), "text")
    runs = repeated_runs(known, run_words).groupBy("uid").agg(F.collect_set(F.struct("lo", "hi")).alias("cuts"))
    runs = cut(runs, "runs")
    boxed = docs.select(uid.alias("uid"), F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"))  # columns of any name keep to themselves
    # only texts that can have something to lose are shuffled
    marked = mark_partners(boxed, "uid", runs.select(F.col("uid").alias("with_cuts")), runs.count())
    some = marked.where("_maybe").join(runs, "uid", "left")
    rest = marked.where("not _maybe").withColumn("cuts", F.lit(None).cast(runs.schema["cuts"].dataType))
    whole = F.col("row.text")
    lines = F.split(whole, "\n", -1)
    kept = F.filter(lines, lambda x, i: ~F.exists("cuts", lambda c: (i >= c["lo"]) & (i < c["hi"])))
    text = F.when(F.col("cuts").isNull(), whole).otherwise(F.array_join(kept, "\n"))
    gone = F.when(F.col("cuts").isNull(), F.lit(0)).otherwise(F.size(lines) - F.size(kept))
    n_lines = F.when(whole.isNull(), F.lit(0)).otherwise(F.size(lines))
    x = some.unionByName(rest).select("row", text.alias("kept"), n_lines.cast("long").alias("before"), gone.cast("long").alias("gone"))
    own = [F.col("kept").alias("text") if c == "text" else F.col("row").getField(c).alias(c) for c in names]
    return x.select(*own, F.col("before").alias("n_lines"), F.col("gone").alias("n_removed"))
