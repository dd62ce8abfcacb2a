"""The step functions of the ordered operators: one row of one key at a time, all state in small lists.

Batch folds and streaming processors run the same functions.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from decimal import Decimal

from ..params import PressureParams, RiskParams, SignalParams

PASS, COOLDOWN, DUPLICATE, RESET = "pass", "cooldown", "duplicate", "reset"
MAGNITUDE, CONFIDENCE, RATE = "magnitude_exceeded", "confidence_below_minimum", "rate_limit_exceeded"
DRAWDOWN, POSITION = "drawdown_limit_exceeded", "position_limit"
REASONS = (MAGNITUDE, CONFIDENCE, RATE, DRAWDOWN, POSITION)
BREACHED, APPROACHING, PNL = "position_limit_breached", "position_limit_approaching", "pnl_limit_breached"

#: Units of exact sums in 1.
UNITS = 10**9


def new_signal(p: SignalParams) -> list:
    """bias, volatility, time of the last signal, mean strength."""
    return [0.0, 0.0, p.t0_us, 0.0]


def signal_step(state: list, p: SignalParams, t_us: int, bias: float, volatility: float) -> tuple[bool, float, float]:
    """Decay and add; then, if the row emits, the values it carries are those before the feedback reset."""
    b = p.decay * state[0] + bias
    v = p.decay * state[1] + volatility
    emits = p.backtest or t_us - state[2] >= p.cooldown_us
    state[0], state[1] = b, v
    if emits:
        state[2] = t_us
        state[3] = (state[3] + abs(b)) / 2
        if abs(b) > 0.8 or abs(v) > 0.8:
            state[0], state[1] = b * 0.5, v * 0.5
    return emits, b, v


def attributes(bias: float, confidence: float) -> tuple[int, float, float]:
    """Strategy toggle, strategy weight, spread modifier."""
    strong = abs(bias) > 0.5
    return (1 if bias > 0 else -1) if strong else 0, min(1.0, 2.0 * confidence), -0.1 * bias if strong else 0.0


def dedup_step(expires: int | None, t_us: int, ttl_us: int) -> tuple[bool, int]:
    """(novel, time at which the key expires). A repeat does not renew the key; at the very time of expiry a row is novel."""
    if expires is not None and expires > t_us:
        return False, expires
    return True, t_us + ttl_us


def new_risk(p: RiskParams) -> list:
    """rate window's start and count, drawdown window's start and cumulative bias."""
    return [p.t0_us, 0, p.t0_us, 0.0]


def reset_risk(state: list, t_us: int) -> None:
    """Both windows start anew at ``t_us``."""
    state[:] = [t_us, 0, t_us, 0.0]


def rate_open(state: list, p: RiskParams, t_us: int) -> bool:
    if (t_us - state[0]) // 1_000_000 >= p.rate_window_s:
        state[0], state[1] = t_us, 0
    return state[1] < p.rate_limit


def drawdown_open(state: list, p: RiskParams, t_us: int, bias: float) -> bool:
    if (t_us - state[2]) // 1_000_000 >= p.drawdown_window_s:
        state[2], state[3] = t_us, 0.0
    return abs(state[3] + bias) <= p.max_drawdown


def position_check(p: RiskParams, bias: float, net: float, limit: float, pnl: float, pnl_limit: float) -> tuple[bool, list[str]]:
    after = abs(net + bias)
    if after > limit:
        return False, [BREACHED]
    events = [APPROACHING] if after > limit * p.warn_fraction else []
    if pnl < pnl_limit:
        return False, [*events, PNL]
    return True, events


def risk_step(state: list, p: RiskParams, t_us: int, bias: float, volatility: float, spread: float, confidence: float, net: float, limit: float, pnl: float, pnl_limit: float) -> tuple[str, list[str]]:
    """The gates in order; the first that fails decides, windows move only when reached, counts only on a pass."""
    if not (abs(bias) <= p.max_bias and abs(volatility) <= p.max_volatility and abs(spread) <= p.max_spread):
        return MAGNITUDE, []
    if not confidence >= p.min_confidence:
        return CONFIDENCE, []
    if not rate_open(state, p, t_us):
        return RATE, []
    if not drawdown_open(state, p, t_us, bias):
        return DRAWDOWN, []
    ok, events = position_check(p, bias, net, limit, pnl, pnl_limit)
    if not ok:
        return POSITION, events
    state[3] += bias
    state[1] += 1
    return PASS, events


def backoff_step(high: int, composite: float, p: PressureParams, times: int = 1) -> int:
    """How often the back-off has been raised since it was last one: a high composite raises it, a low one resets it, others leave it."""
    if composite < p.reset_below:
        return 0
    return high + times if composite >= p.raise_at else high


def backoff_level(high: int, p: PressureParams) -> float:
    return min(p.most, p.factor ** min(high, 10))


class LatencyWindow:
    """Statistics after every sample: all-time count, mean, least and greatest; percentiles and jitter of the last ``n`` samples.

    The window is held twice: as a ring in order of arrival, and sorted, so a sample costs two binary searches. Sums are whole
    numbers, so the jitter about a mean that moves needs no pass over the window.
    """

    def __init__(self, n: int, profiling: bool = True):
        self.n, self.profiling = n, profiling
        self.reset()

    def reset(self) -> None:
        self.count, self.total, self.least, self.greatest = 0, 0, 0, 0
        self.load_window([])

    def load_window(self, ring: list[int]) -> None:
        """``ring``: the sample at place ``count % n``, and so on; shorter while it isn't full."""
        self.ring, self.sorted = list(ring), sorted(ring)
        self.sum, self.squares = sum(ring), sum(x * x for x in ring)

    def add(self, x: int) -> int | None:
        """The place in the ring that has changed."""
        at = self.count % self.n
        self.least = x if not self.count else min(self.least, x)
        self.greatest = x if not self.count else max(self.greatest, x)
        self.count += 1
        self.total += x
        if not self.profiling:
            return None
        if at < len(self.ring):
            old = self.ring[at]
            del self.sorted[bisect_left(self.sorted, old)]
            self.sum, self.squares = self.sum - old, self.squares - old * old
            self.ring[at] = x
        else:
            self.ring.append(x)
        insort(self.sorted, x)
        self.sum, self.squares = self.sum + x, self.squares + x * x
        return at

    def mean(self) -> int:
        return self.total // self.count if self.count else 0

    def stats(self) -> tuple[int, int, int, int, int, int, float]:
        """measurements, avg_us, min_us, max_us, p95_us, p99_us, jitter_ms."""
        k, m = len(self.sorted), self.mean()
        at = lambda q: self.sorted[min(int(k * q), k - 1)] if k else 0
        apart = self.squares - 2 * m * self.sum + k * m * m
        return self.count, m, self.least, self.greatest, at(0.95), at(0.99), math.sqrt(apart / k) / 1000 if k else 0.0


class Monitor:
    """Pressure and back-off of one key, tick by tick.

    Every token updates the semantic part, a tick's end the ingestion and the queue part, one after the other, and each update
    steps the back-off. A tick without tokens is two updates without ingestion.
    """

    def __init__(self, p: PressureParams):
        self.p = p
        self.tick, self.tokens, self.suppressed, self.high = None, 0, 0, 0
        self.n, self.total, self.squares = 0, 0, 0  # in whole billionths, without rounding
        self.ingestion = self.semantic = self.queue = 0.0

    def dump(self) -> tuple:
        return self.tick, self.tokens, self.suppressed, self.high, self.n, self.total, Decimal(self.squares), self.ingestion, self.semantic, self.queue

    def load(self, values) -> None:
        self.tick, self.tokens, self.suppressed, self.high, self.n, self.total, self.squares, self.ingestion, self.semantic, self.queue = values
        self.squares = int(self.squares)

    def _update(self, times: int = 1) -> float:
        composite = max(self.ingestion, self.semantic, self.queue)
        self.high = backoff_step(self.high, composite, self.p, times)
        return composite

    def token(self, tick: int, sentiment: float, suppressed: bool) -> list[tuple]:
        """The rows of ticks that end before this token's."""
        out = self.close(tick)
        self.tick = tick
        self.tokens += 1
        self.suppressed += suppressed
        self.n += 1
        units = sentiment * UNITS
        x = int(math.copysign(math.floor(abs(units) + 0.5), units))
        self.total += x
        self.squares += x * x
        variance = round((self.n * self.squares - self.total**2) / (self.n * (self.n - 1) * UNITS**2), 15) if self.n > 1 else 0.0
        self.semantic = min(1.0, max(0.0, variance / self.p.variance_saturation))
        self._update()
        return out

    def close(self, tick: int, empty: bool = False) -> list[tuple]:
        """End all ticks before ``tick``; a row for each with tokens, and with ``empty`` for each without: tick, tokens, suppressed,
        ingestion, semantic, queue, composite, multiplier."""
        out = []
        while self.tick is not None and self.tick < tick:
            if self.tokens or empty:
                self.ingestion = min(1.0, max(0.0, self.tokens / self.p.max_tps)) if self.p.max_tps > 0 else 0.0
                self._update()
                depth = self.p.queue_capacity
                self.queue = min(1.0, max(0.0, self.suppressed / depth)) if depth > 0 else 0.0
                composite = self._update()
                out.append((self.tick, self.tokens, self.suppressed, self.ingestion, self.semantic, self.queue, composite, backoff_level(self.high, self.p)))
                self.tick, self.tokens = self.tick + 1, 0
            else:
                # a gap of any length in one step
                self.ingestion = 0.0
                self._update(2 * (tick - self.tick))
                self.tick = tick
        return out
