"""Parameters of a run, as frozen dataclasses that check their own ranges."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, replace

INTERVALS = {"1s": 1 / 60, "5s": 5 / 60, "10s": 1 / 6, "30s": 0.5, "1m": 1, "2m": 2, "5m": 5, "15m": 15, "30m": 30, "1h": 60}
ALL = "all"


def _between(name: str, value: float, low: float, high: float) -> None:
    if not low <= value <= high:
        raise ValueError(f"{name} must lie between {low} and {high}, not {value}")


@dataclass(frozen=True)
class Thresholds:
    """Shape limits of the detectors, as shares of a bar's range unless named otherwise."""

    doji_body: float = 0.10
    small_body: float = 0.30
    long_body: float = 0.60
    shadow_dominance: float = 2.0
    opposite_shadow_max: float = 0.25
    doji_shadow_min: float = 0.60
    marubozu_body: float = 0.90
    near_equal: float = 0.001
    gap_min: float = 0.0
    trend_lookback: int = 10
    trend_min_slope: float = 0.0

    def __post_init__(self) -> None:
        for name in ("doji_body", "small_body", "long_body", "opposite_shadow_max", "doji_shadow_min", "marubozu_body"):
            _between(name, getattr(self, name), 0, 1)
        _between("trend_lookback", self.trend_lookback, 2, 1000)


@dataclass(frozen=True)
class TradeRules:
    stop_buffer: float = 0.001
    reward_multiple: float = 2.0
    max_hold_bars: int = 20
    min_risk_pct: float = 0.0005
    risk_per_trade_usd: float = 100.0
    allow_overlapping_trades: bool = False
    matched_window: int = 5

    def __post_init__(self) -> None:
        _between("max_hold_bars", self.max_hold_bars, 1, 10_000)
        _between("stop_buffer", self.stop_buffer, 0, 0.5)
        if self.reward_multiple <= 0 or self.risk_per_trade_usd <= 0:
            raise ValueError("reward_multiple and risk_per_trade_usd must be positive")


@dataclass(frozen=True)
class Costs:
    slippage_bps: float = 1.0
    commission: float = 0.0
    #: An estimated round-trip spread above this share of the price counts as no estimate.
    ceiling: float = 0.02


@dataclass(frozen=True)
class Stats:
    min_trades: int = 30
    min_trades_per_trial: int = 3
    min_sessions: int = 10
    experiment_count: int = 1
    bootstrap_samples: int = 20_000
    rank_by: str = "ci_low"
    alpha: float = 0.05

    def __post_init__(self) -> None:
        if self.rank_by not in ("expectancy_r", "win_rate", "profit_factor", "total_return_pct", "ci_low"):
            raise ValueError(f"unknown rank_by {self.rank_by}")


@dataclass(frozen=True)
class Run:
    trials: int = 200
    seed: int = 42
    windows: int = 1
    holdout_fraction: float = 0.2
    #: Newest date that may be drawn, as YYYY-MM-DD.
    end_date: str | None = None

    def __post_init__(self) -> None:
        _between("holdout_fraction", self.holdout_fraction, 0, 0.9)
        _between("windows", self.windows, 1, 100)


@dataclass(frozen=True)
class Config:
    run: Run = field(default_factory=Run)
    trade: TradeRules = field(default_factory=TradeRules)
    costs: Costs = field(default_factory=Costs)
    thresholds: Thresholds = field(default_factory=Thresholds)
    stats: Stats = field(default_factory=Stats)


def load(values: dict[str, dict]) -> Config:
    """A config from nested dicts, as a TOML file gives them; unknown names are refused."""
    config = Config()
    for section, given in values.items():
        if section not in {f.name for f in fields(Config)}:
            raise ValueError(f"unknown section {section}")
        held = getattr(config, section)
        unknown = set(given) - {f.name for f in fields(held)}
        if unknown:
            raise ValueError(f"unknown keys in {section}: {', '.join(sorted(unknown))}")
        config = replace(config, **{section: replace(held, **given)})
    return config
