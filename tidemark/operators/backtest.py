"""Signals to positions, trades, curves and metrics.

Masks and positions are window expressions.  The trade machine depends on its own path
(targets hang on the entry price); on long series it is a scan over chunks of time
(``tidemark.operators.trades``), in sweeps of many short runs a fold over one of them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.config import PROFIT_FACTOR_CAP, SESSION_SETS
from tidemark.functions import scalars as S
from tidemark.functions import windows as W
from tidemark.operators.trades import run_curves, run_trades  # noqa: F401

DIRECTIONS = ("both", "long_only", "short_only")


def masked_signal(
    signal: str, ts: str, direction: str = "both", session: str | None = None, entry_time: str | None = None
) -> Column:
    """Direction first, then session hours and earliest entry time.  Only signals are
    silenced: a position that is open stays open."""
    if direction not in DIRECTIONS:
        raise ValueError(f"unknown direction: {direction}")
    s = F.col(signal)
    if direction == "long_only":
        s = F.greatest(s, F.lit(0))
    elif direction == "short_only":
        s = F.least(s, F.lit(0))
    if session:
        s = F.when(S.in_session(F.hour(ts), session), s).otherwise(0)
    if entry_time:
        h, m = map(int, entry_time.split(":"))
        s = F.when(F.hour(ts) * 60 + F.minute(ts) >= h * 60 + m, s).otherwise(0)
    return s


def label_session_signal(signal: str, name: str, session: str = "session") -> Column:
    """Silences signals outside a session set; ``global`` masks nothing."""
    if name == "global":
        return F.col(signal)
    return F.when(F.col(session).isin(SESSION_SETS[name]), F.col(signal)).otherwise(0)


def with_position(df: DataFrame, signal: str, keys: list[str], ts: str) -> DataFrame:
    """Adds ``position``: the last signal so far, taken one bar later."""
    w = Window.partitionBy(*keys).orderBy(ts)
    return df.withColumn("held_", W.forward_fill_signal(signal, w)).withColumn(
        "position", F.lag("held_", 1, 0).over(w).cast("int")
    ).drop("held_")


def simulate(
    price: np.ndarray,
    position: np.ndarray,
    spread: float,
    take: float | None = None,
    stop: float | None = None,
    max_hold: int | None = None,
    capital: float = 10_000.0,
    no_return: float | None = 0.0,
) -> tuple[list[tuple], np.ndarray, np.ndarray]:
    """Trades, realised equity and bar returns.

    On each bar an open trade is tested for target, stop, holding time and opposite
    position, in that order, at the bar's price; then, if flat and the position is
    not 0, a trade opens at the same price.  The spread is charged once, at the exit.
    A trade still open at the end closes on the last bar and changes the capital
    only.  A trade entered at price 0 has no return: its gains are ``no_return`` and the
    cash stays.  Distances of 0 or None are off."""
    n = len(price)
    equity, returns, trades = np.ones(n), np.zeros(n), []
    base = capital if capital else 1.0
    cash, side, entry, at = capital, 0, 0.0, 0

    def close(i: int, reason: str) -> float:
        nonlocal cash
        move = side * (price[i] - entry) / entry if entry else 0.0
        net = move - (spread / entry if entry else 0.0)
        gained = cash * net
        cash += gained
        pnl = (round(float(net * 100), 6), round(float(gained), 4)) if entry else (no_return, no_return)
        trades.append((at, i, i - at, side, round(float(entry), 6), round(float(price[i]), 6), *pnl, reason))
        return net

    for i in range(1, n):
        now, equity[i] = int(position[i]), cash / base
        if side:
            ahead, reason = side * (price[i] - entry), None
            if take and ahead >= take:
                reason = "TP"
            elif stop and ahead <= -stop:
                reason = "SL"
            elif max_hold and i - at >= max_hold:
                reason = "MAX_HOLD"
            elif now == -side:
                reason = "SIGNAL_FLIP"
            if reason:
                returns[i] = close(i, reason)
                side, equity[i] = 0, cash / base
            elif price[i - 1]:
                returns[i] = side * (price[i] - price[i - 1]) / price[i - 1]
        if not side and now:
            side, entry, at = now, price[i], i
    if side:
        close(n - 1, "END_OF_DATA")
    return trades, equity, returns


def trade_metrics(trades: DataFrame, keys: list[str], annualisation: int, capital: float = 10_000.0) -> DataFrame:
    """Metrics that need the trade log alone, from its rounded returns."""
    r = F.col("pnl_pct") / 100
    per_year = F.floor(F.greatest(F.lit(1.0), annualisation / F.greatest(F.avg("bars_held"), F.lit(1.0))))

    def ratio(mean: Column, x: Column, least: int) -> Column:
        sd, ok = F.stddev_pop(x), (F.count(x) >= least) & (F.max(x) != F.min(x))
        return F.when(ok, mean / sd * F.sqrt(per_year)).otherwise(0.0)

    win, loss = F.when(r > 0, r), F.when(r < 0, r)
    lost = F.abs(F.sum(loss))
    return trades.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_trades"),
        ratio(F.avg(r), r, 2).alias("net_sharpe"),
        ratio(F.avg(r), loss, 2).alias("sortino"),
        ratio(F.avg(win), win, 2).alias("gross_sharpe"),
        F.avg((r >= 0).cast("double")).alias("win_rate"),
        F.when(lost > 0, F.least(F.coalesce(F.sum(win), F.lit(0.0)) / lost, F.lit(PROFIT_FACTOR_CAP)))
        .otherwise(PROFIT_FACTOR_CAP)
        .alias("profit_factor"),
        F.avg("bars_held").alias("avg_trade_bars"),
        (capital + F.coalesce(F.sum("pnl_dollars"), F.lit(0.0))).alias("capital_final"),
    )


def curve_metrics(curves: DataFrame, keys: list[str], ts: str) -> DataFrame:
    """Total return, drawdown, Calmar and turnover of realised equity."""
    w = Window.partitionBy(*keys).orderBy(ts)
    dd = curves.withColumn("dd_", W.drawdown(F.col("equity"), w))
    out = dd.groupBy(*keys).agg(
        (F.max_by("equity", ts) - 1).alias("total_return"),
        F.min("dd_").alias("max_drawdown"),
        F.avg((F.col("position") != 0).cast("double")).alias("turnover"),
    )
    calmar = F.when(F.col("max_drawdown") < 0, F.col("total_return") / F.abs("max_drawdown")).otherwise(0.0)
    return out.withColumn("calmar", calmar)


def buy_and_hold(df: DataFrame, keys: list[str], ts: str, price: str = "close") -> DataFrame:
    first, last = F.min_by(price, ts), F.max_by(price, ts)
    return df.groupBy(*keys).agg(F.try_divide(last - first, first).alias("bah_return"))


def signal_distribution(df: DataFrame, keys: list[str], signal: str = "signal") -> DataFrame:
    s = F.col(signal)
    return df.groupBy(*keys).agg(
        F.count_if(s == 1).alias("n_long"), F.count_if(s == -1).alias("n_short"), F.count_if(s == 0).alias("n_flat")
    )


def next_bar_return(df: DataFrame, keys: list[str], ts: str, price: str = "close", signal: str = "signal") -> DataFrame:
    """Adds ``signal_return``: signal times the next bar's return, null as 0."""
    w = Window.partitionBy(*keys).orderBy(ts)
    return df.withColumn("signal_return", F.coalesce(F.col(signal) * W.forward_return(price, 1, w), F.lit(0.0)))


# -- many variants of one signal ----------------------------------------------------


def _ratio(x: np.ndarray, spread: np.ndarray, per_year: int, least: int) -> float:
    sd = float(spread.std()) if len(spread) >= least else 0.0
    return float(x.mean() / sd * np.sqrt(per_year)) if sd > 0 else 0.0


def metrics_of(trades: list[tuple], equity: np.ndarray, position: np.ndarray, annualisation: int, capital: float) -> dict:
    """All thirteen metrics of one run."""
    r = np.array([t[6] for t in trades if t[6] is not None], dtype=float) / 100
    held = np.array([t[2] for t in trades], dtype=float)
    per_year = int(max(1, annualisation / max(held.mean() if len(held) else 1.0, 1.0)))
    total = float(equity[-1] - 1) if len(equity) else 0.0
    peak = np.maximum.accumulate(equity) if len(equity) else np.ones(1)
    dd = float(((equity - peak) / np.where(peak != 0, peak, 1)).min()) if len(equity) else 0.0
    win, loss = r[r > 0], r[r < 0]
    lost = abs(float(loss.sum()))
    return {
        "n_trades": len(trades),
        "net_sharpe": _ratio(r, r, per_year, 2),
        "sortino": _ratio(r, loss, per_year, 2),
        "gross_sharpe": _ratio(win, win, per_year, 2),
        "total_return": total,
        "max_drawdown": dd,
        "calmar": total / abs(dd) if dd < 0 else 0.0,
        "win_rate": float((r >= 0).mean()) if len(r) else 0.0,
        "profit_factor": min(float(win.sum()) / lost, PROFIT_FACTOR_CAP) if lost else PROFIT_FACTOR_CAP,
        "avg_trade_bars": float(held.mean()) if len(held) else 0.0,
        "turnover": float((position != 0).mean()) if len(position) else 0.0,
        "capital_final": capital + float(sum(t[7] for t in trades if t[7] is not None)),
    }


METRICS = (
    "n_trades long, net_sharpe double, sortino double, gross_sharpe double, total_return double, max_drawdown double,"
    " calmar double, win_rate double, profit_factor double, avg_trade_bars double, turnover double, capital_final double"
)
SPEC = "session string, direction string, tp double, sl double, spread double, max_hold int, warmup int"


def _hours_mask(hours: np.ndarray, session: str | None) -> np.ndarray:
    from tidemark.config import SESSION_HOURS

    if session is None:
        return np.ones(len(hours), dtype=bool)
    lo, hi = SESSION_HOURS[session]
    return (hours >= lo) & (hours < hi) if lo < hi else (hours >= lo) | (hours < hi)


def run_variants(
    signals: DataFrame, keys: list[str], ts: str, specs: DataFrame, annualisation: int, capital: float = 10_000.0, always: bool = False
) -> DataFrame:
    """Outcome rows (keys, spec, metrics, signals after masks, status, error) of every
    series and every spec that its keys have in ``specs`` (columns of ``SPEC``; null:
    off).

    A series not longer than its warm-up is skipped; one whose signals are all 0 before
    any mask has status ZERO_SIGNALS; with ``always`` both are run like any other and count
    as they come out, without trades.  A series is shipped once, with its specs beside
    it; one that fails becomes a status row."""
    shape = [f.split()[0] for f in SPEC.split(", ")]
    grouped = specs.groupBy(*keys).agg(F.collect_list(F.struct(*shape)).alias("specs"))  # a grid: tens of rows
    grouped = grouped.select(*[F.col(k).alias(k) for k in keys], "specs")
    rows = signals.select(*keys, ts, "close", "signal").join(F.broadcast(grouped.select(*keys)), keys, "left_semi")
    rows = rows.select(*[F.col(c).alias(c) for c in rows.columns])
    schema = T.StructType([signals.schema[k] for k in keys])
    schema = T.StructType([*schema, *T.StructType.fromDDL(f"{SPEC}, {METRICS}, n_long long, n_short long, n_flat long, status string, error string")])

    def run(bars: pd.DataFrame, grid: pd.DataFrame) -> pd.DataFrame:
        bars = bars.sort_values(ts, kind="stable")
        price, raw, hours = bars["close"].to_numpy(), bars["signal"].to_numpy(), bars[ts].dt.hour.to_numpy()
        key = [bars[k].iloc[0] for k in keys] if len(bars) else [grid[k].iloc[0] for k in keys]
        out = []
        for spec in grid["specs"].iloc[0] if len(grid) else []:
            v = dict(zip(shape, spec.values() if isinstance(spec, dict) else spec, strict=True))
            lacks = "NO_DATA_IN_WINDOW" if not len(raw) else "SKIP_WARMUP_GT_DATA" if len(raw) <= (v["warmup"] or 0) else None
            lacks = lacks or (None if (raw != 0).any() else "ZERO_SIGNALS")
            lacks = None if always and len(raw) else lacks
            if lacks:
                out.append([*key, *v.values(), *[None] * 15, lacks, None])
                continue
            try:
                s = np.where(_hours_mask(hours, v["session"]), raw, 0)
                s = np.maximum(s, 0) if v["direction"] == "long_only" else np.minimum(s, 0) if v["direction"] == "short_only" else s
                held = pd.Series(s).where(s != 0).ffill().fillna(0).to_numpy(int)
                pos = np.concatenate([[0], held[:-1]]) if len(held) else held
                trades, equity, _ = simulate(price, pos, v["spread"] or 0.0, v["tp"], v["sl"], v["max_hold"], capital, None)
                got = metrics_of(trades, equity, pos, annualisation, capital)
                signs = [int((s == k).sum()) for k in (1, -1, 0)]
                out.append([*key, *v.values(), *got.values(), *signs, "OK" if trades else "ZERO_TRADES", None])
            except Exception as e:  # one failing spec must not end the sweep
                out.append([*key, *v.values(), *[None] * 15, "ENGINE_ERROR", str(e)[:200]])
        return pd.DataFrame(out, columns=[f.name for f in schema])

    return rows.groupBy(*keys).cogroup(grouped.groupBy(*keys)).applyInPandas(run, schema)
