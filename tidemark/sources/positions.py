"""Position feeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FIELDS = ("net_position", "position_limit", "pnl", "pnl_limit")
#: Position before the first snapshot.
DEFAULT = (0.0, 1.0, 0.0, -10.0)


def mock_positions(spark: SparkSession, states: list[tuple[float, float, float, float]], t0_us: int, interval_us: int) -> DataFrame:
    """(seq, ts, fields): a list of states in order, one per interval."""
    rows = [(k, *map(float, s)) for k, s in enumerate(states)]
    df = spark.createDataFrame(rows, "seq long, " + ", ".join(f"{f} double" for f in FIELDS))
    return df.select("seq", F.timestamp_micros(F.lit(t0_us) + F.col("seq") * interval_us).alias("ts"), *FIELDS)


def replay_positions(states: DataFrame, key: str, order: str, t0_us: int, interval_us: int) -> DataFrame:
    """(key, seq, t_us, fields): each key's states in order, one per interval."""
    from pyspark.sql import Window as W

    seq = (F.row_number().over(W.partitionBy(key).orderBy(order)) - 1).cast("long")
    x = states.select(key, seq.alias("seq"), *FIELDS)
    return x.select(key, "seq", (F.lit(t0_us) + F.col("seq") * interval_us).alias("t_us"), *FIELDS)


def parse_position(body: Column) -> Column:
    """A struct of the four numbers and ``ok``: all are there. HTTP headers before a blank line are skipped."""
    text = F.when(F.instr(body, "\r\n\r\n") > 0, F.substring(body, F.instr(body, "\r\n\r\n") + 4, F.length(body))).otherwise(body)
    numbers = [F.get_json_object(text, f"$.{f}").try_cast("double") for f in FIELDS]
    ok = F.lit(True)
    for x in numbers:
        ok = ok & x.isNotNull()
    return F.struct(*[x.alias(f) for x, f in zip(numbers, FIELDS)], ok.alias("ok"))


def position_asof(rows: DataFrame, positions: DataFrame, key: str, order: str) -> DataFrame:
    """``rows`` with the last position of the key at or before each row's order; the default before the first.

    One shuffle: both sides are put in one order per key, and the last position seen is carried along.
    """
    from pyspark.sql import Window as W

    from ..operators.fold import unused

    side, p = unused(rows, "_side"), unused(rows, "_p")
    mark = F.struct(*[F.col(f).cast("double").alias(f) for f in FIELDS])
    left = rows.select("*", F.lit(1).alias(side), F.lit(None).cast("struct<" + ", ".join(f"{f}: double" for f in FIELDS) + ">").alias(p))
    right = positions.select(key, order, F.lit(0).alias(side), mark.alias(p))
    w = W.partitionBy(key).orderBy(order, side).rowsBetween(W.unboundedPreceding, W.currentRow)
    both = left.unionByName(right, allowMissingColumns=True).withColumn(p, F.last(p, ignorenulls=True).over(w)).where(F.col(side) == 1)
    own = [c for c in rows.columns if c not in FIELDS]
    return both.select(*own, *[F.coalesce(F.col(p).getField(f), F.lit(d)).alias(f) for f, d in zip(FIELDS, DEFAULT)])
