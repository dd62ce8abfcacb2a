"""Ordered operators over streams, each with the rows of its batch form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import steps
from ..operators.fold import unused
from ..params import LatencyParams, PressureParams, RiskParams
from ..sources.positions import DEFAULT, FIELDS
from .ordered import Carrying, Machine, run_ordered

_named = lambda df, c: f"`{c}` {df.schema[c].dataType.simpleString()}"


class _Dedup(Carrying):
    """One key's expiry, and nothing once it is over."""

    state, adds = "expires_us long", "is_novel boolean, expires_us long"

    def __init__(self, names: list[str], own: list[str]):
        self.names, self.inputs = names, own

    def start(self):
        self.expires = None

    def load(self, values):
        (self.expires,) = values

    def dump(self):
        return (self.expires,)

    def step(self, row):
        novel, (t, ttl, evict) = False, (row[c] for c in self.inputs)
        if evict:
            self.expires = None
        else:
            novel, self.expires = steps.dedup_step(self.expires, t, ttl)
        yield *self.head(row), novel, self.expires

    def wake(self, now_ms):
        if self.expires is not None and self.expires <= now_ms * 1000:
            self.expires = None
        return ()

    def due(self):
        return [] if self.expires is None else [-(-self.expires // 1000)]

    def gone(self):
        return self.expires is None


def dedup_stream(df: DataFrame, keys: list[str], order: str, t_us: Column, ttl_us: Column, delay: str, evict: Column | None = None) -> DataFrame:
    """``df`` with is_novel and expires_us, as ``dedup`` gives them: the first row of a key is novel, and later ones once it has expired.

    Rows wait until the watermark, ``delay`` behind the latest time of all rows, has passed them, so order of arrival doesn't matter.
    Rows are dealt by all of ``keys``, so a stream of any size is spread over its tokens; keys share state rows, which a key leaves by
    a timer when it expires. Rows where ``evict`` holds delete the key; they are not novel and have no expiry.
    """
    own = [unused(df, n) for n in ("_t", "_ttl", "_evict")]
    x = df.select("*", *[c.alias(n) for n, c in zip(own, (t_us, ttl_us, evict if evict is not None else F.lit(False)))])
    return run_ordered(x, _Dedup(df.columns, own), keys, [order], own[0], delay, True)


class _AsOf(Carrying):
    state = adds = ", ".join(f"{f} double" for f in FIELDS)

    def __init__(self, names: list[str], side: str, given: list[str]):
        self.names, self.side, self.given, self.inputs = names, side, given, [side, *given]

    def start(self):
        self.position = DEFAULT

    def load(self, values):
        self.position = values

    def dump(self):
        return tuple(self.position)

    def step(self, row):
        if row[self.side] == 0:
            self.position = tuple(row[c] for c in self.given)
        else:
            yield *self.head(row), *(d if p is None else p for p, d in zip(self.position, DEFAULT))


def position_asof_stream(rows: DataFrame, positions: DataFrame, key: str, order: str, delay: str, t_us: str = "t_us") -> DataFrame:
    """Two streams, rows and positions, joined as ``position_asof`` joins tables: each row has the last position at or before its order.

    Both have ``key``, ``order`` and ``t_us``; orders ascend with time. Both wait, per key, until the watermark has passed them; so
    a position that arrives after its rows, or a row before earlier ones, is still in its place.
    """
    side, given = unused(rows, "_side"), [unused(rows, f"_{f}") for f in FIELDS]
    left = rows.select("*", F.lit(1).alias(side), *[F.lit(None).cast("double").alias(c) for c in given])
    right = positions.select(key, order, t_us, F.lit(0).alias(side), *[F.col(f).cast("double").alias(c) for f, c in zip(FIELDS, given)])
    names = [c for c in rows.columns if c not in FIELDS]
    both = left.unionByName(right, allowMissingColumns=True)
    return run_ordered(both, _AsOf(names, side, given), [key], [order, side], t_us, delay, True)


class _Backoff(Carrying):
    state, adds = "high long", "multiplier double"

    def __init__(self, names: list[str], composite: str, p: PressureParams):
        self.names, self.inputs, self.composite, self.p = names, [composite], composite, p

    def start(self):
        self.high = 0

    def load(self, values):
        (self.high,) = values

    def dump(self):
        return (self.high,)

    def step(self, row):
        if row[self.composite] is not None:
            self.high = steps.backoff_step(self.high, row[self.composite], self.p)
        yield *self.head(row), steps.backoff_level(self.high, self.p)


def backoff_stream(df: DataFrame, composite: str, key: str, order: str, p: PressureParams = PressureParams(), t_us: str | None = None, delay: str | None = None) -> DataFrame:
    """``df`` with multiplier, as ``backoff`` gives it. With ``t_us`` and ``delay`` rows wait for the watermark, else they are taken
    micro-batch by micro-batch, and those not above the last order seen are left out."""
    return run_ordered(df, _Backoff(df.columns, composite, p), [key], [order], t_us, delay, delay is not None)


class _Pressure(Machine):
    state = "tick long, tokens long, suppressed long, high long, n long, total long, squares decimal(38,0), ingestion double, semantic double, queue double"

    def __init__(self, key: str, kind: str, tick_us: int, t0_us: int, p: PressureParams, empty: bool):
        self.key, self.tick_us, self.t0_us, self.p, self.empty = key, tick_us, t0_us, p, empty
        self.output = f"{kind}, tick long, tokens long, suppressed long, ingestion double, semantic double, queue double, composite double, multiplier double"

    def start(self):
        self.monitor, self.of = steps.Monitor(self.p), None

    def load(self, values):
        self.of, *values = values
        self.monitor = steps.Monitor(self.p)
        self.monitor.load(values)

    def dump(self):
        return self.of, *self.monitor.dump()

    def step(self, row):
        self.of = row[self.key]
        if row["outcome"] == steps.DUPLICATE:
            return
        tick = (row["t_us"] - self.t0_us) // self.tick_us
        for ended in self.monitor.token(tick, row["sentiment"], row["outcome"] == steps.COOLDOWN):
            yield self.of, *ended

    def wake(self, now_ms):
        # the watermark is behind all rows to come: ticks that end at it or before are over
        for ended in self.monitor.close((now_ms * 1000 - self.t0_us) // self.tick_us, self.empty):
            yield self.of, *ended

    def due(self):
        m = self.monitor
        if m.tick is None or not (m.tokens or self.empty):
            return []
        return [-(-(self.t0_us + (m.tick + 1) * self.tick_us) // 1000)]


def pressure_stream(rows: DataFrame, key: str, order: str, tick_us: int, t0_us: int, delay: str, p: PressureParams = PressureParams(), empty: bool = False) -> DataFrame:
    """Pressure and back-off at the end of every tick, as ``pressure_monitor`` gives them; ``rows``: key, order, t_us, outcome, sentiment.

    A tick's row comes when the watermark, ``delay`` behind the latest row of all keys, has passed its end, with or without new rows of its key.
    With ``empty`` ticks without tokens have rows too, as time goes on; without it they count for the back-off all the same.
    """
    x = rows.select(key, order, "t_us", "outcome", "sentiment")
    machine = _Pressure(key, _named(rows, key), tick_us, t0_us, p, empty)
    machine.state = f"of {rows.schema[key].dataType.simpleString()}, {machine.state}"
    return run_ordered(x, machine, [key], [order], "t_us", delay, True)


class _Latency(Machine):
    """All-time sums as values, the last samples as a ring of state rows of which a sample writes one."""

    state = "count long, total long, least long, greatest long"

    def __init__(self, names: list[str], output: str, latency: str, reset: str | None, p: LatencyParams):
        self.names, self.output, self.latency, self.reset, self.p = names, output, latency, reset, p

    def open(self, handle):
        self.ring = handle.getMapState("ring", "at long", "latency_us long")

    def start(self):
        self.window, self.touched = steps.LatencyWindow(self.p.sample_window, self.p.profiling), set()

    def load(self, values):
        self.start()
        w = self.window
        w.count, w.total, w.least, w.greatest = values
        found = {at: x for (at,), (x,) in self.ring.iterator()} if w.count and self.p.profiling else {}
        w.load_window([found[at] for at in range(len(found))])

    def dump(self):
        w = self.window
        for at in self.touched:
            self.ring.updateValue((at,), (w.ring[at],))
        self.touched = set()
        return w.count, w.total, w.least, w.greatest

    def step(self, row):
        if self.reset and row[self.reset]:
            self.window.reset()
            self.ring.clear()
            self.touched = set()
            return
        at = self.window.add(row[self.latency])
        if at is not None:
            self.touched.add(at)
        yield *(row[c] for c in self.names), *self.window.stats()


STATS = "measurements long, avg_us long, min_us long, max_us long, p95_us long, p99_us long, jitter_ms double"


def running_latency_stream(df: DataFrame, latency: str, key: str, order: str, p: LatencyParams = LatencyParams(), reset: str | None = None, t_us: str | None = None, delay: str | None = None) -> DataFrame:
    """``df`` with the statistics after every sample, as ``running_latency`` gives them; rows where ``reset`` is true start them anew
    and are left out. With ``t_us`` and ``delay`` rows wait for the watermark."""
    output = ", ".join(_named(df, c) for c in df.columns) + ", " + STATS
    return run_ordered(df, _Latency(df.columns, output, latency, reset, p), [key], [order], t_us, delay, delay is not None)


class _Gates(Carrying):
    state = "rate_us long, rate_count long, drawdown_us long, cum_bias double"

    def __init__(self, names: list[str], r: RiskParams, bias: str | None, reset: str | None):
        self.names, self.r, self.bias, self.reset = names, r, bias, reset
        self.adds, self.inputs = ("drawdown_ok boolean, cum_bias double" if bias else "rate_ok boolean"), ["t_us", *(c for c in (bias, reset) if c)]

    def start(self):
        self.risk = steps.new_risk(self.r)

    def load(self, values):
        self.risk = list(values)

    def dump(self):
        return (*self.risk[:3], float(self.risk[3]))

    def step(self, row):
        head, t = self.head(row), row["t_us"]
        if self.reset and row[self.reset]:
            steps.reset_risk(self.risk, t)
            ok = None
        elif self.bias:
            ok = steps.drawdown_open(self.risk, self.r, t, row[self.bias])
            self.risk[3] += row[self.bias] if ok else 0.0
        else:
            ok = steps.rate_open(self.risk, self.r, t)
            self.risk[1] += ok
        yield *head, ok, *((float(self.risk[3]),) if self.bias else ())


def rate_gate_stream(df: DataFrame, key: str, order: str, r: RiskParams, reset: str | None = None, delay: str | None = None) -> DataFrame:
    """``df`` (t_us) with rate_ok, as ``rate_gate`` gives it, control rows included."""
    return run_ordered(df, _Gates(df.columns, r, None, reset), [key], [order], "t_us", delay, delay is not None)


def drawdown_gate_stream(df: DataFrame, key: str, order: str, bias: str, r: RiskParams, reset: str | None = None, delay: str | None = None) -> DataFrame:
    """``df`` (t_us) with drawdown_ok and cum_bias, as ``drawdown_gate`` gives them, control rows included."""
    return run_ordered(df, _Gates(df.columns, r, bias, reset), [key], [order], "t_us", delay, delay is not None)
