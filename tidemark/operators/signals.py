"""Signals from ordered weights, and the gates behind them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..params import RiskParams, SignalParams
from ..sources.positions import FIELDS
from . import steps
from .fold import fold, unused

_SIGNAL = "emitted boolean, signal_bias double, signal_volatility double, strategy_toggle int, strategy_weight double, spread_modifier double, strength double"


def signals(df: DataFrame, keys: list[str], order: list[str], p: SignalParams) -> DataFrame:
    """``df`` (t_us, bias_in, volatility_in, confidence) with the accumulators and signal attributes at each row, and whether it emits."""

    def step(state, t, bias, volatility, confidence):
        emits, b, v = steps.signal_step(state, p, t, bias, volatility)
        return emits, b, v, *steps.attributes(b, confidence), state[3]

    return fold(df, keys, order, ["t_us", "bias_in", "volatility_in", "confidence"], lambda: steps.new_signal(p), step, _SIGNAL)


def gated_signals(df: DataFrame, keys: list[str], order: list[str], p: SignalParams, r: RiskParams, reset: str | None = None, novel: str | None = None) -> DataFrame:
    """``signals`` fused with the gate cascade in one pass: outcome, oms_events and cum_bias of each row.

    ``df`` also has the position as of each row. A row that does not emit has the outcome cooldown. Rows where the column
    ``reset`` is true are control rows: they start the gates' windows anew, leave the accumulators alone and have the outcome reset.
    Rows where the column ``novel`` is false change nothing and have the outcome duplicate.
    """

    def step(state, t, bias, volatility, confidence, net, limit, pnl, pnl_limit, *more):
        control, new = (more[0] if reset else False), (more[-1] if novel else True)
        if not new:
            return None, None, None, None, None, None, None, steps.DUPLICATE, None, None
        if control:
            steps.reset_risk(state[1], t)
            return False, None, None, None, None, None, state[0][3], steps.RESET, [], state[1][3]
        emits, b, v = steps.signal_step(state[0], p, t, bias, volatility)
        toggle, weight, spread = steps.attributes(b, confidence)
        outcome, events = steps.COOLDOWN, []
        if emits:
            outcome, events = steps.risk_step(state[1], r, t, b, v, spread, confidence, net, limit, pnl, pnl_limit)
        return emits, b, v, toggle, weight, spread, state[0][3], outcome, events, state[1][3]

    inputs = ["t_us", "bias_in", "volatility_in", "confidence", *FIELDS, *([reset] if reset else []), *([novel] if novel else [])]
    return fold(df, keys, order, inputs, lambda: [steps.new_signal(p), steps.new_risk(r)], step, f"{_SIGNAL}, outcome string, oms_events array<string>, cum_bias double")


def magnitude_ok(r: RiskParams) -> Column:
    within = lambda c, most: F.abs(c) <= F.lit(most)
    return within("signal_bias", r.max_bias) & within("signal_volatility", r.max_volatility) & within("spread_modifier", r.max_spread)


def confidence_ok(r: RiskParams) -> Column:
    return F.col("confidence") >= F.lit(r.min_confidence)


def position_gate(bias: Column, r: RiskParams) -> list[Column]:
    """position_ok and position_events of a bias against the position at its row."""
    after = F.abs(F.col("net_position") + bias)
    breached = after > F.col("position_limit")
    warned = after > F.col("position_limit") * F.lit(r.warn_fraction)
    loss = F.col("pnl") < F.col("pnl_limit")
    no = F.array().cast("array<string>")
    events = F.when(breached, F.array(F.lit(steps.BREACHED))).otherwise(
        F.concat(F.when(warned, F.array(F.lit(steps.APPROACHING))).otherwise(no), F.when(loss, F.array(F.lit(steps.PNL))).otherwise(no))
    )
    return [(~breached & ~loss).alias("position_ok"), events.alias("position_events")]


def rate_gate(df: DataFrame, keys: list[str], order: list[str], r: RiskParams, reset: str | None = None) -> DataFrame:
    """``df`` (t_us) with rate_ok: whether the window that the first check after its end opens still has room.

    Rows where the column ``reset`` is true are control rows: they start all windows anew and have no rate_ok.
    """

    def step(state, t, control=False):
        if control:
            steps.reset_risk(state, t)
            return (None,)
        ok = steps.rate_open(state, r, t)
        state[1] += ok
        return (ok,)

    return fold(df, keys, order, ["t_us", *([reset] if reset else [])], lambda: steps.new_risk(r), step, "rate_ok boolean")


def drawdown_gate(df: DataFrame, keys: list[str], order: list[str], bias: str, r: RiskParams, reset: str | None = None) -> DataFrame:
    """``df`` (t_us) with drawdown_ok and cum_bias; only rows that pass add to the cumulative bias.

    Rows where the column ``reset`` is true are control rows: they start all windows anew and have no drawdown_ok.
    """

    def step(state, t, b, control=False):
        if control:
            steps.reset_risk(state, t)
            return None, state[3]
        ok = steps.drawdown_open(state, r, t, b)
        if ok:
            state[3] += b
        return ok, state[3]

    return fold(df, keys, order, ["t_us", bias, *([reset] if reset else [])], lambda: steps.new_risk(r), step, "drawdown_ok boolean, cum_bias double")


def gate_labels(outcomes: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The blocked rows of ``outcomes`` with ``label``, the console's: the last position event since the last block, its own
    included, ``risk`` where there was none; 16 characters at most."""
    from pyspark.sql import Window as W

    w = W.partitionBy(*keys).orderBy(*order)
    blocked = F.col("outcome").isin(*steps.REASONS)
    event = F.try_element_at("oms_events", F.lit(-1))
    block = unused(outcomes, "_block")
    x = outcomes.withColumn(block, F.coalesce(F.sum(blocked.cast("int")).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    since = W.partitionBy(*keys, block).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    x = x.withColumn("label", F.substring(F.coalesce(F.last(event, ignorenulls=True).over(since), F.lit("risk")), 1, 16))
    return x.where(blocked).drop(block)
