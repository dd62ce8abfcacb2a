"""Mixing of sources to target weights by systematic sampling. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import WORD, cut, ranked

#: Cycle of weights over the sources in code-point order, null last.
WEIGHTS = (3, 1, 2)
#: Words to take, as a share of all words; largest multiple of a source's own words.
SHARE, MOST = 1.5, 2.0
#: Rows of a chunk whose places are counted in one window.
CHUNK = 2000


def _size():
    """Words of the text."""
    return F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, rows, target) from (source, source_size, rows), one row a source.

    Targets split ``share`` of all words by weight; none is above ``most`` times its source, what is
    over goes to the others by weight. That is one level for all: target = least(level * weight, cap).
    With the sources in the order of cap / weight, the capped ones come first.
    """
    place = W.orderBy(F.col("source").asc_nulls_last())
    by_ratio = W.orderBy("ratio", F.col("source").asc_nulls_last())
    every = W.orderBy("ratio").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    cycle = F.array(*[F.lit(float(x)) for x in weights])
    s = sizes.withColumn("w", F.element_at(cycle, ((F.row_number().over(place) - 1) % len(weights) + 1).cast("int")))
    s = s.withColumn("cap", F.col("source_size") * F.lit(float(most))).withColumn("ratio", F.col("cap") / F.col("w"))
    upto = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    s = (
        s.withColumn("total", F.sum("source_size").over(every) * F.lit(float(share)))
        .withColumn("all_w", F.sum("w").over(every))
        .withColumn("caps", F.coalesce(F.sum("cap").over(upto), F.lit(0.0)))
        .withColumn("ws", F.coalesce(F.sum("w").over(upto), F.lit(0.0)))
        .withColumn("level", (F.col("total") - F.col("caps")) / (F.col("all_w") - F.col("ws")))
    )
    # the level is that of the first source in this order which it does not cap
    s = s.withColumn("level", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "source", "level"))).over(every)["level"])
    return s.select("source", "source_size", "rows", F.least(F.coalesce(F.col("level") * F.col("w"), F.col("cap")), "cap").alias("target"))


def mix_sources(docs: DataFrame, seed: int = 7, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """How many copies of each row a mix with the wanted share of each source takes.

    Returns doc_id, source, size (words; null or empty text: 0), source_size, target, copies, taken
    (copies * size), one row for each row of ``docs``; other columns are ignored. The rows of a source stand in
    the order of (size class, chunk, size, doc_id, hash of the text); each expects target / source_size copies, the
    expectations are prefix-summed, one offset per source made from ``seed`` is added, and a row is taken once for
    each integer that its step crosses. Order by size keeps the words taken close to the target.
    No row is taken more than ceil(``most``) times. A source of no words has target 0 and takes nothing. Repeated rows
    count as rows of their own, equal ones in any order; an empty table gives no rows; a null source is a source.

    Sources may be of any size: places are counted in chunks of about CHUNK rows, dealt by
    (source, size class, hash), and carried over by the chunks' counts. The hash tells rows without a doc_id, or of one, apart by their texts.
    """
    d = cut(
        docs.select("doc_id", "source", _size().alias("size"), F.xxhash64("text").alias("tie"))
        .withColumn("band", F.floor(F.log2(F.col("size") + 1) * 4).cast("int")), "sizes",
    )
    spread = d.groupBy("source", "band").agg(F.count(F.lit(1)).alias("n"))
    # (source, band) is split in as many chunks as its rows need
    d = d.alias("a").join(spread.where(f"n > {CHUNK}").alias("b"), F.col("a.source").eqNullSafe(F.col("b.source")) & (F.col("a.band") == F.col("b.band")), "left")
    parts = F.coalesce(F.ceil(F.col("b.n") / CHUNK), F.lit(1))
    d = d.select("a.*", F.pmod(F.xxhash64("a.doc_id", "a.size", "a.tie"), parts).alias("chunk"))
    keys = ["source", "band", "chunk"]
    chunks = cut(d.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("words")), "chunks")
    sources = chunks.groupBy("source").agg(F.sum("words").alias("source_size"), F.sum("n").alias("rows"))
    targets = source_targets(sources, weights, share, most)
    # what stands before a chunk: the source's smaller size classes, few rows, and the chunks before it in its own
    ahead = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    bands = chunks.groupBy("source", "band").agg(F.sum("n").alias("n")).withColumn("lower", ahead(W.partitionBy("source").orderBy("band")))
    chunks = chunks.withColumn("own", ahead(W.partitionBy("source", "band").orderBy("chunk"))).alias("x")
    chunks = chunks.join(bands.alias("y"), F.col("x.source").eqNullSafe(F.col("y.source")) & (F.col("x.band") == F.col("y.band")))
    chunks = chunks.select("x.source", "x.band", "x.chunk", (F.col("own") + F.col("lower")).alias("ahead"))
    c = chunks.alias("c").join(targets.alias("t"), F.col("c.source").eqNullSafe(F.col("t.source"))).select(
        F.col("c.source").alias("c_source"), F.col("c.band").alias("c_band"), F.col("c.chunk").alias("c_chunk"), "c.ahead", "t.source_size", "t.target",
    )
    d = d.withColumn("inside", F.row_number().over(W.partitionBy(*keys).orderBy("size", "doc_id", "tie")))
    x = d.join(c, d.source.eqNullSafe(c.c_source) & (d.band == c.c_band) & (d.chunk == c.c_chunk))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    offset = F.pmod(F.xxhash64(F.coalesce(F.col("source"), F.lit("")), F.lit(seed)), F.lit(1 << 20)) / float(1 << 20)
    place = F.col("ahead") + F.col("inside")
    copies = F.floor(place * rate + offset) - F.floor((place - 1) * rate + offset)
    return x.select("doc_id", "source", "size", "source_size", "target", copies.cast("long").alias("copies"), (copies * F.col("size")).cast("long").alias("taken"))


def take_mix(docs: DataFrame, seed: int = 7) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it; rows of equal doc_id, source and size share their copies evenly.

    Columns of any name are kept as they are. Rows without doc_id, or of one, may be a third of all: only those that repeat are
    numbered, in chunks of bounded size. An empty table gives no rows.
    """
    names, keys = docs.columns, ["doc_id", "source", "size"]
    took = mix_sources(docs, seed).groupBy(*keys).agg(F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("n"))
    took = cut(took, "copies")
    boxed = docs.select("doc_id", "source", _size().alias("size"), F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.xxhash64("text").alias("tie"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    d = boxed.alias("a").join(took.where("copies > 0").alias("b"), same).select("a.*", "copies", "n")
    out = d.where("n = 1").select("row", F.col("copies").alias("each"))
    repeated = took.where("copies > 0 and n > 1").agg(F.sum("n")).first()[0]
    if repeated:
        own = ranked(d.where("n > 1"), keys, ["tie"], int(repeated))
        each = F.floor(F.col("copies") * (F.col("rank") + 1) / F.col("n")) - F.floor(F.col("copies") * F.col("rank") / F.col("n"))
        out = out.union(own.select("row", each.alias("each")))
    out = out.where("each > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("each").cast("int"))))
    return out.select(*[F.col("row").getField(c).alias(c) for c in names])
