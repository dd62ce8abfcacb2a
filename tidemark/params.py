"""Parameters of the engine; YAML load, save and watch."""

from __future__ import annotations

import os
from dataclasses import asdict, dataclass, field, fields, replace

import yaml

#: Stand-in for the time at which an engine was constructed: 2024-01-01 00:00:00 UTC in microseconds.
T0_US = 1_704_067_200_000_000


@dataclass(frozen=True)
class SignalParams:
    decay: float = 0.95
    bias_sensitivity: float = 1.0
    volatility_sensitivity: float = 1.0
    cooldown_us: int = 1_000
    backtest: bool = False
    t0_us: int = T0_US


@dataclass(frozen=True)
class RiskParams:
    max_bias: float = 1.0
    max_volatility: float = 1.0
    max_spread: float = 0.5
    min_confidence: float = 0.1
    rate_limit: int = 100
    rate_window_s: int = 1
    max_drawdown: float = 5.0
    drawdown_window_s: int = 60
    warn_fraction: float = 0.8
    t0_us: int = T0_US


@dataclass(frozen=True)
class DedupParams:
    ttl_ms: int = 5_000


@dataclass(frozen=True)
class LatencyParams:
    sample_window: int = 1_000
    target_us: int = 10
    profiling: bool = True


@dataclass(frozen=True)
class PressureParams:
    max_tps: float = 50.0
    variance_saturation: float = 0.25
    queue_capacity: int = 1_024
    raise_at: float = 0.8
    reset_below: float = 0.5
    factor: float = 1.5
    most: float = 5.0


@dataclass(frozen=True)
class Config:
    signal: SignalParams = field(default_factory=SignalParams)
    risk: RiskParams = field(default_factory=RiskParams)
    dedup: DedupParams = field(default_factory=DedupParams)
    latency: LatencyParams = field(default_factory=LatencyParams)
    pressure: PressureParams = field(default_factory=PressureParams)


#: Limits of the live program, wider than the defaults.
LIVE_RISK = RiskParams(max_bias=2.0, max_volatility=2.0, rate_limit=500, max_drawdown=10.0)
#: Settings under which every outcome occurs on the events table.
EVENTS_SIGNAL = SignalParams(cooldown_us=2 * 3_600_000_000)
EVENTS_BACKTEST = replace(EVENTS_SIGNAL, backtest=True)
EVENTS_RISK = RiskParams(max_bias=1.2, max_volatility=1.4, min_confidence=0.6, rate_limit=2, rate_window_s=86_400, max_drawdown=1.5, drawdown_window_s=259_200)
EVENTS_DEDUP = DedupParams(ttl_ms=6 * 3_600_000)


def load_config(source: str, base: Config = Config()) -> Config:
    """Read YAML text or a file; keys that are missing keep the values of ``base``, unknown ones are ignored."""
    text = open(source, encoding="utf8").read() if os.path.exists(source) else source
    data = yaml.safe_load(text) or {}
    if not isinstance(data, dict):
        raise ValueError("a configuration is a mapping of sections")
    parts = {}
    for f in fields(Config):
        own = getattr(base, f.name)
        given = data.get(f.name) or {}
        known = {x.name: x for x in fields(own)}
        values = {k: type(getattr(own, k))(v) for k, v in given.items() if k in known}
        parts[f.name] = replace(own, **values)
    return Config(**parts)


def save_config(config: Config, path: str) -> None:
    with open(path, "w", encoding="utf8") as f:
        yaml.safe_dump(asdict(config), f, sort_keys=False)


class ConfigWatcher:
    """Reloads a file when its time of change moves; asked once per micro-batch."""

    def __init__(self, path: str, base: Config = Config()):
        self.path, self.config, self.seen = path, base, None

    def current(self) -> Config:
        try:
            stamp = os.stat(self.path).st_mtime_ns
            if stamp != self.seen:
                self.config, self.seen = load_config(self.path, self.config), stamp
        except (OSError, ValueError, yaml.YAMLError):
            pass  # a broken or missing file keeps the last good configuration
        return self.config
