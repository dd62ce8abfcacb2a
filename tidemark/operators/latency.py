"""Latency statistics, pressure and back-off."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import clamp01, saturation
from ..params import LatencyParams, PressureParams
from .fold import fold, unused
from .steps import UNITS, LatencyWindow


def latency_stats(df: DataFrame, latency: str, keys: list[str] = []) -> DataFrame:
    """count, truncated mean, least and greatest latency, all-time."""
    n, total = F.count(F.lit(1)), F.coalesce(F.sum(latency), F.lit(0))
    mean = F.when(n > 0, F.floor(total / F.greatest(n, F.lit(1)))).otherwise(0).cast("long")
    least, most = (F.coalesce(f(latency), F.lit(0)).alias(a) for f, a in ((F.min, "min_us"), (F.max, "max_us")))
    return df.groupBy(*keys).agg(n.alias("measurements"), mean.alias("avg_us"), least, most)


def last_samples(df: DataFrame, order: str, keys: list[str], n: int) -> DataFrame:
    """The last ``n`` rows of each key; without keys a top-n that every task takes part in."""
    if not keys:
        return df.orderBy(F.desc(order)).limit(n)
    r = unused(df, "_r")
    return df.withColumn(r, F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(order)))).where(F.col(r) <= n).drop(r)


def latency_percentiles(df: DataFrame, latency: str, order: str, p: LatencyParams, keys: list[str] = []) -> DataFrame:
    """p95 and p99 of the last samples: the sorted sample at floor(n * q), counted from 0."""
    s, n = F.sort_array(F.collect_list(latency)), F.count(F.lit(1))
    at = lambda q: F.coalesce(F.try_element_at(s, F.greatest(F.least(F.floor(n * F.lit(q)).cast("int") + 1, n.cast("int")), F.lit(1))), F.lit(0))
    if not p.profiling:
        at = lambda q: F.lit(0).cast("long")
    return last_samples(df, order, keys, p.sample_window).groupBy(*keys).agg(at(0.95).alias("p95_us"), at(0.99).alias("p99_us"))


def latency_jitter(df: DataFrame, latency: str, order: str, p: LatencyParams, digits: int = 6) -> DataFrame:
    """Root mean square distance of the last samples from the all-time truncated mean, in milliseconds."""
    mean = latency_stats(df, latency).select("avg_us")
    x = last_samples(df, order, [], p.sample_window).crossJoin(F.broadcast(mean))  # one row
    return x.agg(F.round(F.sqrt(F.avg(F.pow(F.col(latency) - F.col("avg_us"), 2.0))) / 1000, digits).alias("jitter_ms"))


def running_latency(df: DataFrame, latency: str, keys: list[str], order: list[str], p: LatencyParams = LatencyParams(), reset: str | None = None) -> DataFrame:
    """``df`` with the statistics after every sample: measurements, avg_us, min_us, max_us all-time; p95_us, p99_us and jitter_ms of the last samples.

    The last samples of a key are kept sorted, so each sample costs two searches whatever the window. Rows where the column ``reset``
    is true start the statistics anew and are left out.
    """
    def step(state, x, control=False):
        if control:
            state.reset()
            return (None,) * 7
        state.add(x)
        return state.stats()

    out = fold(df, keys, order, [latency, *([reset] if reset else [])], lambda: LatencyWindow(p.sample_window, p.profiling), step, "measurements long, avg_us long, min_us long, max_us long, p95_us long, p99_us long, jitter_ms double")
    return out.where("measurements is not null")


def running_variance(value: Column, keys: list[str], order: str) -> Column:
    w = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return F.coalesce(F.var_samp(value).over(w), F.lit(0.0))


def exact_variance(value: Column, w: W) -> Column:
    """Sample variance over the window of values in whole billionths: sums without rounding, so it depends on no order of summing,
    and one that is a short decimal, such as a tie of a later rounding, is that decimal."""
    n, x = F.count(value).over(w), F.round(value * UNITS).cast("decimal(14,0)")
    apart = n.cast("decimal(10,0)") * F.sum(x * x).over(w).cast("decimal(28,0)") - F.sum(x).over(w).cast("decimal(19,0)") * F.sum(x).over(w).cast("decimal(19,0)")
    return F.when(n > 1, F.round(apart.cast("double") / (n * (n - 1)).cast("double") / UNITS**2, 15)).otherwise(F.lit(0.0))


def alert_level(p99: Column, target_us: int) -> list[Column]:
    """Traffic light of a p99 and whether it is over the target."""
    light = F.when(p99 < target_us, "green").when(p99 < 5 * target_us, "yellow").otherwise("red")
    return [light.alias("light"), (p99 > target_us).alias("over_target")]


def pressure(rate: Column, variance: Column, depth: Column, p: PressureParams) -> list[Column]:
    """Ingestion, semantic, queue and composite pressure, each in [0, 1]."""
    ingestion = saturation(rate, F.lit(p.max_tps))
    semantic = clamp01(variance / F.lit(p.variance_saturation))
    queue = saturation(depth, F.lit(float(p.queue_capacity)))
    parts = [ingestion, semantic, queue]
    return [x.alias(n) for x, n in zip([*parts, F.greatest(*parts)], ("ingestion", "semantic", "queue", "composite"))]


def backoff(df: DataFrame, composite: str, keys: list[str], order: str, p: PressureParams = PressureParams()) -> DataFrame:
    """``df`` with multiplier: raised by each high composite, capped, one again at a low one, held between."""
    upto = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    seg = unused(df, "_seg")
    x = df.withColumn(seg, F.sum((F.col(composite) < p.reset_below).cast("int")).over(upto))
    within = W.partitionBy(*keys, seg).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    high = F.sum((F.col(composite) >= p.raise_at).cast("int")).over(within)
    return x.withColumn("multiplier", F.least(F.lit(p.most), F.pow(F.lit(p.factor), F.least(high, F.lit(10))))).drop(seg)


def since_reset(df: DataFrame, keys: list[str], order: str, reset: str) -> DataFrame:
    """The rows of each key after its last control row, where the column ``reset`` is true; all rows of a key without one."""
    after = W.partitionBy(*keys).orderBy(order).rowsBetween(W.currentRow, W.unboundedFollowing)
    later = unused(df, "_later")
    return df.withColumn(later, F.max(F.col(reset).cast("int")).over(after)).where(F.col(later) == 0).drop(later)


def pressure_monitor(rows: DataFrame, key: str, order: str, tick_us: int, t0_us: int, p: PressureParams = PressureParams()) -> DataFrame:
    """State of each key's pressure at the end of every tick in which it has rows.

    ``rows``: key, order, t_us, outcome, sentiment. Duplicates count for nothing. Ingestion is the tick's tokens against the rate
    allowed; semantic the running variance of sentiment over all tokens so far; queue the signals suppressed so far. Every token
    updates the semantic part and every tick's end the two others, one after the other; each update steps the back-off. Ticks
    without rows have no tokens: the two updates of each are one row of that weight, so gaps of any length cost one row.
    """
    along = W.partitionBy("key").orderBy("order")
    upto, before = along.rowsBetween(W.unboundedPreceding, W.currentRow), along.rowsBetween(W.unboundedPreceding, -1)
    x = rows.where("outcome <> 'duplicate'").select(
        F.col(key).alias("key"), F.col(order).alias("order"), F.floor((F.col("t_us") - t0_us) / tick_us).cast("long").alias("tick"), "sentiment", (F.col("outcome") == "cooldown").cast("long").alias("held"),
    )
    x = x.select(
        "key", "order", "tick", exact_variance(F.col("sentiment"), upto).alias("variance"), F.sum("held").over(upto).alias("suppressed"),
        F.row_number().over(along).cast("long").alias("n"), (~F.lead("tick").over(along).eqNullSafe(F.col("tick"))).alias("ends"),
    )
    # what the last tick left behind, and what this one has so far
    x = x.withColumn("was", F.last(F.when(F.col("ends"), F.struct("tick", "n", "variance", "suppressed")), ignorenulls=True).over(before))
    x = x.withColumn("prior", F.last(F.when(F.col("ends"), F.coalesce("was.n", F.lit(0))), ignorenulls=True).over(before))
    none = lambda c: F.coalesce(c, F.lit(0))
    x = x.withColumn("tokens", F.col("n") - none(F.col("was.n"))).withColumn("idle", none(F.col("tick") - F.col("was.tick") - 1))
    parts = pressure(F.col("tokens").cast("double"), F.col("variance"), F.col("suppressed").cast("double"), p)
    old = pressure(none(F.col("was.n") - F.col("prior")).cast("double"), none(F.col("was.variance")).cast("double"), none(F.col("was.suppressed")).cast("double"), p)
    x = x.select("*", *parts, *[c.alias(f"was_{name}") for c, name in zip(old, ("ingestion", "semantic", "queue", "composite"))])
    ingestion = F.when(F.col("idle") == 0, F.col("was_ingestion")).otherwise(F.lit(0.0))
    one = F.lit(1).cast("long")
    update = lambda step, composite, weight, when: F.when(when, F.struct(F.lit(step).alias("step"), composite.alias("composite"), weight.alias("weight")))
    updates = F.array_compact(F.array(
        update(0, F.greatest("was_semantic", "was_queue"), 2 * F.col("idle"), (F.col("tokens") == 1) & (F.col("idle") > 0)),
        update(1, F.greatest("semantic", ingestion, "was_queue"), one, F.lit(True)),
        update(2, F.greatest("ingestion", "semantic", "was_queue"), one, F.col("ends")),
        update(3, F.col("composite"), one, F.col("ends")),
    ))
    kept = ["tick", "tokens", "suppressed", "ingestion", "semantic", "queue", "composite"]
    u = x.select("key", "order", *[F.col(c).alias(f"at_{c}") for c in kept], F.explode(updates).alias("u")).select("*", "u.*")
    steps = W.partitionBy("key").orderBy("order", "step").rowsBetween(W.unboundedPreceding, W.currentRow)
    u = u.withColumn("seg", F.sum((F.col("composite") < p.reset_below).cast("int")).over(steps))
    inside = W.partitionBy("key", "seg").orderBy("order", "step").rowsBetween(W.unboundedPreceding, W.currentRow)
    high = F.sum(F.when(F.col("composite") >= p.raise_at, F.col("weight")).otherwise(F.lit(0))).over(inside)
    u = u.withColumn("multiplier", F.least(F.lit(p.most), F.pow(F.lit(p.factor), F.least(high, F.lit(10))))).where("step = 3")
    return u.select(F.col("key").alias(key), *[F.col(f"at_{c}").alias(c) for c in kept], "multiplier")
