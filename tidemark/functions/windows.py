"""Ordered-series expressions.

Rows are the time axis: frames count rows of one instrument in time order, never
minutes.  Expressions over the same window share one sort when selected together.
"""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def series(by: str = "pair", order: str | list[str] = "ts") -> WindowSpec:
    return Window.partitionBy(by).orderBy(order)


def so_far(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, 0)


def simple_return(col: str, k: int, w: WindowSpec) -> Column:
    return F.try_divide(F.col(col), F.lag(col, k).over(w)) - 1


def log_return(col: str, w: WindowSpec) -> Column:
    return F.ln(F.col(col)) - F.ln(F.lag(col, 1).over(w))


def forward_return(col: str, k: int, w: WindowSpec) -> Column:
    return F.try_divide(F.lead(col, k).over(w), F.col(col)) - 1


def _full(value: Column, x: Column, n: int, frame: WindowSpec) -> Column:
    return F.when(F.count(x).over(frame) >= n, value)


def rolling_mean(x: Column, n: int, w: WindowSpec) -> Column:
    frame = w.rowsBetween(-(n - 1), 0)
    return _full(F.avg(x).over(frame), x, n, frame)


def rolling_std(x: Column, n: int, w: WindowSpec) -> Column:
    """Sample deviation of n rows; exactly 0 on a constant frame."""
    frame = w.rowsBetween(-(n - 1), 0)
    flat = F.max(x).over(frame) == F.min(x).over(frame)
    return _full(F.when(flat, F.lit(0.0)).otherwise(F.stddev_samp(x).over(frame)), x, n, frame)


def channel_high(x: Column, n: int, w: WindowSpec) -> Column:
    """Highest of the n rows before this one."""
    frame = w.rowsBetween(-n, -1)
    return _full(F.max(x).over(frame), x, n, frame)


def channel_low(x: Column, n: int, w: WindowSpec) -> Column:
    frame = w.rowsBetween(-n, -1)
    return _full(F.min(x).over(frame), x, n, frame)


def rolling_zscore(x: Column, n: int, w: WindowSpec) -> Column:
    sd = rolling_std(x, n, w)
    return F.when(sd != 0, F.try_divide(x - rolling_mean(x, n, w), sd))


def expanding_quantile(x: Column, q: float, w: WindowSpec, least: int = 30) -> Column:
    """Exact, linearly interpolated; costs grow with the square of a series' length.
    Long series go through ``tidemark.operators.order_stats``."""
    frame = so_far(w)
    return F.when(F.count(x).over(frame) >= least, F.percentile(x, q).over(frame))


def crossing_up(above: Column, w: WindowSpec, default: bool = False) -> Column:
    """True where a condition begins to hold."""
    return above & ~F.lag(above, 1, default).over(w)


def forward_fill_signal(signal: str, w: WindowSpec) -> Column:
    kept = F.when(F.col(signal) != 0, F.col(signal))
    return F.coalesce(F.last(kept, ignorenulls=True).over(so_far(w)), F.lit(0))


def drawdown(equity: Column, w: WindowSpec) -> Column:
    peak = F.max(equity).over(so_far(w))
    return F.try_divide(equity - peak, peak)


def rolling_sharpe(x: Column, n: int, scale: float, w: WindowSpec) -> Column:
    """Annualised mean over population deviation of at most n rows; 0 below two rows
    or on a constant frame."""
    frame = w.rowsBetween(-(n - 1), 0)
    sd = F.stddev_pop(x).over(frame)
    varied = (F.count(x).over(frame) >= 2) & (F.max(x).over(frame) != F.min(x).over(frame))
    return F.when(varied, F.try_divide(F.avg(x).over(frame), sd) * scale**0.5).otherwise(0.0)
