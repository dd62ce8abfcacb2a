"""The dataflow as one stateful streaming operator; the same steps as the batch folds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import dedup_key
from ..operators import steps
from ..operators.backends import StateBacked, WholeSeconds
from ..operators.lexicon import contribution, lookup
from ..params import DedupParams, RiskParams, SignalParams
from ..sources.positions import DEFAULT, FIELDS
from .ordered import Machine, run_ordered

LATE = "late"
#: Kinds of control rows: forget a token's key, start the gates' windows anew.
EVICT, RESET = "evict", "reset"


def prepare(tokens: DataFrame, lexicon: DataFrame, signal: SignalParams) -> DataFrame:
    """Weights joined to a stream of (key, seq, token, t_us, position fields); the lexicon is static and small."""
    return lookup(tokens, lexicon).select("*", *contribution(signal.bias_sensitivity, signal.volatility_sensitivity))


class Dataflow(Machine):
    """Deduplicate, fold to signals, gate: all state of one stream. Dedup keys are state rows of their own."""

    state = "signal_bias double, signal_volatility double, signal_us long, strength double, rate_us long, rate_count long, drawdown_us long, cum_bias double, " + ", ".join(f"{f} double" for f in FIELDS)

    def __init__(self, key: str, order: str, kinds: tuple[str, str], signal: SignalParams, risk: RiskParams, ttl_us: int, whole_seconds: bool):
        self.key, self.order, self.signal_params, self.risk_params, self.ttl_us, self.whole_seconds = key, order, signal, risk, ttl_us, whole_seconds
        self.output = f"`{key}` {kinds[0]}, `{order}` {kinds[1]}, token string, outcome string, signal_bias double, signal_volatility double, cum_bias double, oms_events array<string>"

    def open(self, handle):
        self.store = StateBacked(handle.getMapState("seen", *StateBacked.SEEN), handle.getMapState("due", *StateBacked.DUE))
        self.backend = WholeSeconds(self.store) if self.whole_seconds else self.store

    def start(self):
        self.store.start()
        self.signal, self.risk, self.position, self.now = steps.new_signal(self.signal_params), steps.new_risk(self.risk_params), list(DEFAULT), None

    def load(self, values):
        self.store.start()
        self.signal, self.risk, self.position, self.now = list(values[:4]), list(values[4:8]), list(values[8:]), None

    def dump(self):
        return (*map(float, self.signal[:2]), self.signal[2], float(self.signal[3]), *self.risk[:3], float(self.risk[3]), *map(float, self.position))

    def late(self, row):
        yield row[self.key], row[self.order], row["token"], LATE, None, None, None, []

    def step(self, row):
        given = [row[f] for f in FIELDS]
        if not any(v is None for v in given):
            self.position = [float(v) for v in given]
        t, name = row["t_us"], row["_dedup_key"]
        if t is not None:
            self.now = t if self.now is None else max(self.now, t)
        if row["_control"] == EVICT and name is not None:
            self.backend.evict(name)
        if row["_control"] == RESET:
            steps.reset_risk(self.risk, t)
            yield row[self.key], row[self.order], row["token"], steps.RESET, None, None, self.risk[3], []
        if row["_control"] is not None or row["token"] is None:
            return
        head = row[self.key], row[self.order], row["token"]
        if not self.backend.check_and_register(name, t, self.ttl_us if row["_ttl_us"] is None else row["_ttl_us"]):
            yield *head, steps.DUPLICATE, None, None, None, []
            return
        emits, b, v = steps.signal_step(self.signal, self.signal_params, t, row["bias_in"], row["volatility_in"])
        outcome, events = steps.COOLDOWN, []
        if emits:
            _, _, spread = steps.attributes(b, row["confidence"])
            outcome, events = steps.risk_step(self.risk, self.risk_params, t, b, v, spread, row["confidence"], *self.position)
        yield *head, outcome, b, v, self.risk[3], events

    def wake(self, now_ms):
        self.backend.purge_expired(now_ms * 1000)
        return ()

    def due(self):
        ends = self.store.flush()
        if self.now is not None:
            self.backend.purge_expired(self.now)
        return ends


def pipeline_stream(prepared: DataFrame, key: str, order: str, signal: SignalParams, risk: RiskParams, ttl: DedupParams, expire_after: str | None = None, hold: bool = False, whole_seconds: bool = False) -> DataFrame:
    """Outcome of every row, as ``run_pipeline`` gives it on the whole.

    Rows of a micro-batch are taken in the order of ``order`` per key. A row whose order is not above the last one seen
    came too late: its outcome is ``late`` and it changes nothing. A row with a position sets it before it is judged; one
    without a token only sets it; so ``merge_positions`` makes one stream of tokens and positions. ``expire_after`` is a delay
    such as "10 minutes", by which the watermark is behind the latest row of all streams; rows behind it are dropped, as
    everywhere in Spark. With ``hold`` as well, rows wait for the watermark and are then taken in the order of time and
    ``order``, however they arrived.

    Optional columns: ``context`` (a key of its own per context), ``ttl_us`` (the row's own time to live), ``control``: rows that hold
    ``evict`` forget the key of their token and context and have no outcome, those that hold ``reset`` start the gates' windows anew.

    Each dedup key is a state row, written when it is registered or evicted and no more. Expired ones leave with each of
    their stream's micro-batches; with ``expire_after`` also without new rows of it, by timers of event time.
    ``whole_seconds``: times to live as an external store keeps them.
    """
    columns = prepared.columns
    context = F.coalesce(F.col("context").cast("string"), F.lit("")) if "context" in columns else F.lit("")
    name = F.when(F.length(context) > 0, dedup_key(F.col("token"), context)).otherwise(F.concat(F.lit("|"), F.col("token")))
    optional = lambda c, kind: (F.col(c) if c in columns else F.lit(None)).cast(kind)
    kinds = tuple(prepared.schema[c].dataType.simpleString() for c in (key, order))
    rows = prepared.select(
        key, order, "token", "t_us", "bias_in", "volatility_in", "confidence", *FIELDS, name.alias("_dedup_key"), optional("control", "string").alias("_control"), optional("ttl_us", "long").alias("_ttl_us"),
    )
    machine = Dataflow(key, order, kinds, signal, risk, ttl.ttl_ms * 1000, whole_seconds)
    return run_ordered(rows, machine, [key], [order], "t_us", expire_after, hold)


def with_no_positions(tokens: DataFrame) -> DataFrame:
    return tokens.select("*", *[F.lit(None).cast("double").alias(f) for f in FIELDS])


def merge_positions(tokens: DataFrame, positions: DataFrame, key: str, order: str, t_us: str = "t_us") -> DataFrame:
    """One stream of tokens (key, order, t_us, token and more) and positions (key, order, t_us, position fields) for ``prepare``.

    Orders of both are in one sequence; a position is a row without a token.
    """
    both = positions.select(key, order, t_us, *FIELDS)
    return with_no_positions(tokens).unionByName(both, allowMissingColumns=True)


def live_keys(spark, checkpoint: str, operator: int = 0) -> DataFrame:
    """(key, token, expires_us) that a stopped or running stream holds, from its checkpoint."""
    x = spark.read.format("statestore").option("path", checkpoint).option("operatorId", operator).option("stateVarName", "seen").load()
    return x.select("key", F.col("user_map_key.token").alias("token"), F.col("user_map_value.expires_us").alias("expires_us"))
