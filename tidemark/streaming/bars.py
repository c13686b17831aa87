"""Streaming variants: bars from ticks, and cooled signals per instrument."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def stream_bars(ticks: DataFrame, every: str, late: str, keys: list[str], ts: str = "ts", price: str = "price") -> DataFrame:
    """OHLCV windows over a stream of ticks; a bar is emitted (append mode) once the
    watermark, ``late`` behind the newest tick, has passed its end."""
    bars = ticks.withWatermark(ts, late).groupBy(*keys, F.window(ts, every).alias("w")).agg(
        F.min_by(price, ts).alias("open"),
        F.max(price).alias("high"),
        F.min(price).alias("low"),
        F.max_by(price, ts).alias("close"),
        F.count(F.lit(1)).alias("volume"),
    )
    return bars.select(*keys, F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume")


def stream_cooldown(signals: DataFrame, bars: int, key: str = "pair", order: str = "bar_no") -> DataFrame:
    """Cooldown over an unbounded stream: the state per key is the first row number at
    which a signal may pass again.  Rows of a micro-batch are taken in order."""

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        free = state.get[0] if state.exists else -(1 << 62)
        rows = pd.concat(list(frames)).sort_values(order, kind="stable")
        cooled = []
        for n, s in zip(rows[order], rows["signal"], strict=True):
            passed = s if s and n >= free else 0
            if passed:
                free = n + bars + 1
            cooled.append(passed)
        state.update((int(free),))
        yield pd.DataFrame({key: k[0], order: rows[order].to_numpy(), "signal": cooled})

    return signals.select(key, order, "signal").groupBy(key).applyInPandasWithState(
        run, f"{key} string, {order} long, signal int", "free long", "append", GroupStateTimeout.NoTimeout
    )
