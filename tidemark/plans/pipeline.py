"""The whole dataflow: deduplicate, look up, fold to signals, gate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import steps
from ..operators.dedup import dedup
from ..operators.latency import latency_percentiles, latency_stats
from ..operators.lexicon import contribution, lookup
from ..operators.signals import gated_signals
from ..params import DedupParams, LatencyParams, RiskParams, SignalParams
from ..sources.positions import position_asof


def run_pipeline(tokens: DataFrame, lexicon: DataFrame, positions: DataFrame, key: str, order: str, signal: SignalParams, risk: RiskParams, ttl: DedupParams, keep: tuple[str, ...] = ()) -> DataFrame:
    """Every row of ``tokens`` (key, order, token, t_us and the columns of ``keep``) with its outcome.

    Outcomes are duplicate, cooldown, pass or the reason of the gate that blocked it. A position counts from its own row on. Rows are dealt by
    (key, token) to find repeats, then by key for positions and folds; repeats go along, so each row is made once.
    """
    seen = dedup(tokens, [key, "token"], [order], F.col("t_us"), F.lit(ttl.ttl_ms * 1000).cast("long"))
    placed = position_asof(seen, positions, key, order)
    weighted = lookup(placed, lexicon).select("*", *contribution(signal.bias_sensitivity, signal.volatility_sensitivity))
    gated = gated_signals(weighted, [key], [order], signal, risk, novel="is_novel")
    of_novel = lambda c: F.when(F.col("is_novel"), F.col(c)).alias(c)
    return gated.select(
        key, order, "token", "t_us", *keep, of_novel("sentiment"), "outcome", "signal_bias", "signal_volatility", of_novel("confidence"), "strategy_toggle", "strategy_weight", "spread_modifier", "oms_events", "cum_bias",
    )


def outcome_counts(outcomes: DataFrame) -> DataFrame:
    return outcomes.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


def event_summary(log: DataFrame) -> DataFrame:
    """Entries of a log by type, and of all types under ALL."""
    return log.rollup("event_type").agg(F.count(F.lit(1)).alias("entries")).select(F.coalesce("event_type", F.lit("ALL")).alias("event_type"), "entries")


def session_summary(outcomes: DataFrame, latencies: DataFrame, latency: str, order: str, p: LatencyParams) -> DataFrame:
    """One row of totals, with the mean, p99 and greatest latency."""
    count = lambda c: F.count_if(c)
    o = F.col("outcome")
    blocked = o.isin(*steps.REASONS)
    totals = outcomes.agg(
        F.count(F.lit(1)).alias("tokens"), count(o == steps.DUPLICATE).alias("duplicates"), count(o == steps.COOLDOWN).alias("suppressed"),
        count((o == steps.PASS) | blocked).alias("generated"), count(o == steps.PASS).alias("passed"), count(blocked).alias("blocked"),
    )
    # one row each
    stats = latency_stats(latencies, latency).select("avg_us", "max_us")
    return totals.join(stats).join(latency_percentiles(latencies, latency, order, p).select("p99_us"))
