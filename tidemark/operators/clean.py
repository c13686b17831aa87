"""Cleaning: validity, duplicates, sparse days, and their summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OHLC = ("open", "high", "low", "close")


def invalid_ohlc() -> Column:
    """high below low, or open or close outside [low, high]; comparisons with null
    count as fine."""
    parts = [
        F.col("high") < F.col("low"),
        F.col("open") > F.col("high"),
        F.col("open") < F.col("low"),
        F.col("close") > F.col("high"),
        F.col("close") < F.col("low"),
    ]
    found = F.lit(False)
    for p in parts:
        found = found | F.coalesce(p, F.lit(False))
    return found


def dedupe_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key; ``order`` must be total to be repeatable."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("n_", n).filter("n_ = 1").drop("n_")


def dense_days(df: DataFrame, least: int, keys: list[str], ts: str) -> DataFrame:
    """Rows of days (UTC) that have at least ``least`` rows.

    Counting by group and joining back keeps partial aggregation, where a window
    would move every row."""
    day = F.to_date(ts)
    full = df.groupBy(*keys, day.alias("day_")).agg(F.count(F.lit(1)).alias("n_")).filter(F.col("n_") >= least)
    return df.withColumn("day_", day).join(full.drop("n_"), [*keys, "day_"], "left_semi").drop("day_")


def clean(bars: DataFrame, least_per_day: int, keys: list[str], ts: str, tie: list[str]) -> DataFrame:
    """Null prices, repeated timestamps, impossible bars and sparse days go, in that
    order (days are counted after the bad rows are gone)."""
    df = bars.dropna(subset=[ts, *OHLC])
    df = dedupe_first(df, [*keys, ts], tie)
    df = df.filter(~invalid_ohlc())
    return dense_days(df, least_per_day, keys, ts)


def duplicate_count(*cols: str) -> Column:
    """Rows minus distinct values, null being one value."""
    nulls = F.max(F.when(F.struct(*cols).isNotNull() & F.coalesce(*[F.col(c).isNull() for c in cols]), 1).otherwise(0))
    return F.count(F.lit(1)) - F.count_distinct(*cols) - nulls


def missing_ohlc() -> Column:
    return F.coalesce(*[F.when(F.col(c).isNull(), True) for c in OHLC], F.lit(False))


def summary(before: DataFrame, after: DataFrame, least_per_day: int, keys: list[str], ts: str, tie: list[str]) -> DataFrame:
    """One row per instrument: what cleaning met, what it removed, and both spans."""
    had = before.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows_before"),
        F.count_if(missing_ohlc()).alias("missing_ohlc_rows_before"),
        duplicate_count(ts).alias("duplicate_timestamps_before"),
        F.count_if(invalid_ohlc()).alias("invalid_ohlc_rows_before"),
        F.bool_and(F.col("volume") == 0).alias("volume_all_zero"),
        F.min(ts).alias("start_before"),
        F.max(ts).alias("end_before"),
    )
    left = after.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows_after"), F.min(ts).alias("start_after"), F.max(ts).alias("end_after"))
    sound = dedupe_first(before.dropna(subset=[ts, *OHLC]), [*keys, ts], tie).filter(~invalid_ohlc())
    sparse = daily_counts(sound, keys, ts).filter(F.col("n") < least_per_day).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("days_dropped_low_coverage"), F.sum("n").alias("rows_removed_low_coverage_days")
    )
    counts = ["rows_after", "days_dropped_low_coverage", "rows_removed_low_coverage_days"]
    out = had.join(left, keys, "left").join(sparse, keys, "left").fillna(0, counts)
    removed = F.col("rows_before") - F.col("rows_after")
    return out.withColumns(
        {
            "rows_removed_total": removed,
            "pct_rows_removed_total": removed / F.col("rows_before"),
            "min_obs_day_threshold": F.lit(least_per_day),
        }
    )


def daily_counts(df: DataFrame, keys: list[str], ts: str) -> DataFrame:
    return df.groupBy(*keys, F.to_date(ts).alias("day")).agg(F.count(F.lit(1)).alias("n"))
