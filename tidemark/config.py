"""Constants and their environment overrides."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, field


def _env(name: str, default: str) -> str:
    return os.environ.get(name) or default


def _ints(name: str, default: str) -> tuple[int, ...]:
    return tuple(map(int, re.findall(r"-?\d+", _env(name, default))))


def _grid(name: str, default: str) -> tuple[tuple[int, int], ...]:
    flat = _ints(name, default)
    return tuple(zip(flat[::2], flat[1::2], strict=True))


# Instruments and their typical spreads in pips.
SPREAD_PIPS = {
    "EURUSD": 0.6,
    "GBPUSD": 0.8,
    "USDJPY": 0.7,
    "USDCHF": 1.0,
    "AUDUSD": 0.8,
    "USDCAD": 1.0,
    "NZDUSD": 1.4,
}
DEFAULT_PIP, DEFAULT_SPREAD = 0.0001, 1.0


def pip_size(pair: str) -> float:
    if pair not in SPREAD_PIPS:
        return DEFAULT_PIP
    return 0.01 if "JPY" in pair else 0.0001


@dataclass(frozen=True)
class Config:
    """One place for every number a stage may need.  Fixed values: the names of the
    environment variables and the defaults."""

    pairs: tuple[str, ...] = tuple(SPREAD_PIPS)
    days_per_year: int = field(default_factory=lambda: int(os.getenv("TRADING_DAYS_PER_YEAR", "252")))
    bars_per_day: int = field(default_factory=lambda: int(os.getenv("BARS_PER_TRADING_DAY", "390")))
    min_bars_per_day: int = field(default_factory=lambda: int(os.getenv("MIN_BARS_PER_DAY", "1200")))
    sharpe_window: int = field(default_factory=lambda: int(os.getenv("ROLLING_SHARPE_WINDOW", "390")))
    capital: float = field(default_factory=lambda: float(os.getenv("DEFAULT_CAPITAL", "10000")))
    n_folds: int = field(default_factory=lambda: int(os.getenv("DEFAULT_N_FOLDS", "5")))
    purge_rows: int = field(default_factory=lambda: int(os.getenv("PURGE_ROWS", "15")))
    horizons: tuple[int, int] = field(
        default_factory=lambda: (int(os.getenv("HORIZON_PRIMARY", "5")), int(os.getenv("HORIZON_SECONDARY", "15")))
    )
    flat_band: tuple[float, float] = (0.0005, 0.0010)
    regime_window: int = field(default_factory=lambda: int(os.getenv("VOL_REGIME_WINDOW", "30")))
    regime_quantile: float = field(default_factory=lambda: float(os.getenv("VOL_HIGH_REGIME_PERCENTILE", "0.80")))
    ret_windows: tuple[int, ...] = field(default_factory=lambda: _ints("RET_WINDOWS", "1,5,15"))
    vol_windows: tuple[int, ...] = field(default_factory=lambda: _ints("VOL_WINDOWS", "10,30,60"))
    ma_windows: tuple[int, ...] = field(default_factory=lambda: _ints("MA_WINDOWS", "10,30,60,120"))
    mom_windows: tuple[int, ...] = field(default_factory=lambda: _ints("MOM_WINDOWS", "5,15,30"))
    range_windows: tuple[int, ...] = field(default_factory=lambda: _ints("RANGE_MA_WINDOWS", "10,30"))
    tp_sl_grid: tuple[tuple[int, int], ...] = field(
        default_factory=lambda: _grid("TP_SL_GRID", "10,5;15,7;20,10;30,15;50,20;100,40")
    )
    train_end: str = "2021-12-31"
    val_end: str = "2023-12-31"
    test_end: str = "2025-12-31"
    first_fold_year: int = 2018

    def __post_init__(self) -> None:
        if self.purge_rows < max(self.horizons):
            raise ValueError("purge_rows must reach at least as far as the longest label horizon")

    @property
    def annualisation(self) -> int:
        return self.days_per_year * self.bars_per_day


PROFIT_FACTOR_CAP = 999.0
# Session names over label sessions.
SESSION_SETS = {"london": ["London", "Overlap"], "ny": ["New_York", "Overlap"], "asia": ["Asia"]}
# Hours [from, to) of the sessions that mask signals; asia wraps.
SESSION_HOURS = {"london": (7, 16), "ny": (13, 22), "asia": (23, 8), "overlap": (13, 16)}
# Model input columns, in order.
LR_FEATURES = [
    "hour_sin", "hour_cos", "session_asia", "session_london", "session_ny", "session_overlap",
    "ret_1", "ret_5", "ret_15", "abs_ret_1", "range_pct", "rv_10", "rv_30", "rv_60",
    "volatility_regime_high", "price_to_sma_30", "mom_5", "mom_15",
]
SHORT_FEATURES = ["ret_1", "ret_5", "abs_ret_1", "range_pct", "rv_10"]
LONG_FEATURES = ["rv_10", "rv_30", "rv_60", "rv_ratio_10_60"]
SESSION_FEATURES = ["session_asia", "session_london", "session_ny", "session_overlap"]
SHORT_STEPS, LONG_STEPS = 15, 60
LR_STRENGTHS = (0.001, 0.01, 0.1, 1.0)
