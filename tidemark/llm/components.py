"""Connected components by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def connected_components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """(id, component): each vertex of ``edges`` with the smallest vertex that it reaches.

    Large stars hang every larger neighbour on the smallest one, small stars do the same for the
    smaller ones; both keep the components, and the number of rounds is logarithmic in the
    longest path. Edges are written to the shared folder each round. Self loops and
    repeated edges are allowed; null ends are ignored; no edges give no rows.
    """
    pairs = edges.select(F.col(left).cast("long").alias("u"), F.col(right).cast("long").alias("v")).dropna()
    loops = pairs.select("u").union(pairs.select("v")).distinct()
    e = cut(pairs.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    loops = cut(loops, "vertices")
    before = None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        m = _least(both)
        large = (
            both.join(m, "u").where("v > u")
            .select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()
        )
        large = cut(large, "large")
        m = _least(large)
        small = (
            large.join(m, "u")
            .select(F.explode(F.array(
                F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                F.struct(F.col("u").alias("u"), F.col("m").alias("v")),
            )).alias("x")).select("x.u", "x.v").where("u <> v").distinct()
        )
        e = cut(small, "small")
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.hash("u", "v").cast("long")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before or now[0] == 0:
            break
        before = now
    # in the end every vertex but the least of its component has one edge, to that least one
    return loops.alias("a").join(e.alias("b"), F.col("a.u") == F.col("b.u"), "left").select(
        F.col("a.u").alias("id"), F.coalesce("b.v", "a.u").alias("component")
    )
