"""The trade log as a table function for SQL, and the worst fall as a mergeable summary."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from tidemark.schema import TRADES


@udtf(returnType=f"series string, {TRADES}")
class TradeLog:
    """Trades of each series, row by row, by the rules of ``backtest.simulate``; what it
    keeps of a series is the open trade and the last price."""

    def __init__(self) -> None:
        self.bar, self.cash, self.side, self.entry, self.at = -1, 10_000.0, 0, 0.0, 0
        self.price, self.series, self.spread = None, None, 0.0

    def _closed(self, reason: str) -> tuple:
        move = self.side * (self.price - self.entry) / self.entry if self.entry else 0.0
        net = move - (self.spread / self.entry if self.entry else 0.0)
        gained = self.cash * net
        self.cash += gained
        side, self.side = self.side, 0
        pnl = (round(net * 100, 6), round(gained, 4)) if self.entry else (None, None)
        return (self.series, self.at, self.bar, self.bar - self.at, side, round(self.entry, 6), round(self.price, 6), *pnl, reason)

    def eval(self, row: Row, spread: float, take: float, stop: float, max_hold: int) -> Iterator[tuple]:
        self.bar += 1
        self.price, self.series, self.spread = float(row["price"]), row["series"], float(spread)
        now = int(row["position"])
        if not self.bar:
            return
        if self.side:
            ahead = self.side * (self.price - self.entry)
            if take and ahead >= take:
                yield self._closed("TP")
            elif stop and ahead <= -stop:
                yield self._closed("SL")
            elif max_hold and self.bar - self.at >= max_hold:
                yield self._closed("MAX_HOLD")
            elif now == -self.side:
                yield self._closed("SIGNAL_FLIP")
        if not self.side and now:
            self.side, self.entry, self.at = now, self.price, self.bar

    def terminate(self) -> Iterator[tuple]:
        if self.side:
            yield self._closed("END_OF_DATA")


def register(spark: SparkSession) -> None:
    """``trade_log(TABLE(...) PARTITION BY (series) ORDER BY (...), spread, take, stop,
    max_hold)`` for SQL; the table has series (string), price and position, and what it is
    ordered by.  Distances of 0 or null are off."""
    spark.udtf.register("trade_log", TradeLog)


def worst_fall(df: DataFrame, keys: list[str], order: str, value: str, chunk: str = "30 days") -> DataFrame:
    """Per series the worst fall from the highest value so far, relative to it, of positive
    values.

    A chunk of time is summed up by its highest and lowest value and its own worst fall; of
    two neighbours the fall from the first's high to the second's low is the only new one.
    So no task holds more than a chunk, and chunks may be of any length."""
    w = Window.partitionBy(*keys, "chunk_").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    cut = df.select(*keys, order, value, F.window(order, chunk)["start"].alias("chunk_"))
    top = cut.withColumn("top_", F.max(value).over(w))
    fall = lambda x, peak: F.try_divide(F.col(x) - F.col(peak), F.col(peak))
    parts = top.groupBy(*keys, "chunk_").agg(F.max(value).alias("high_"), F.min(value).alias("low_"), F.min(fall(value, "top_")).alias("own_"))
    before = Window.partitionBy(*keys).orderBy("chunk_").rowsBetween(Window.unboundedPreceding, -1)
    met = parts.withColumn("peak_", F.max("high_").over(before))
    return met.groupBy(*keys).agg(F.least(F.min("own_"), F.min(fall("low_", "peak_")), F.lit(0.0)).alias("worst_fall"))
