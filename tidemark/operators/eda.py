"""Exploratory aggregates."""

from __future__ import annotations

from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.clean import OHLC, daily_counts, duplicate_count, invalid_ohlc, missing_ohlc


def monthly_coverage(df: DataFrame, keys: list[str], ts: str, per_day: int = 1440) -> DataFrame:
    daily = df.groupBy(*keys, F.to_date(ts).alias("day")).agg(F.count(F.lit(1)).alias("n"))
    daily = daily.withColumn("ratio", F.col("n") / per_day)
    return daily.groupBy(*keys, F.date_format("day", "yyyy-MM").alias("month")).agg(
        F.sum("n").alias("n_rows"),
        F.avg("ratio").alias("mean_ratio"),
        F.min("ratio").alias("min_ratio"),
        F.max("ratio").alias("max_ratio"),
        F.count(F.lit(1)).alias("days"),
    )


def sample_skewness(x: str) -> Column:
    n = F.count(x).cast("double")
    return F.skewness(x) * F.sqrt(n * (n - 1)) / (n - 2)


def sample_kurtosis(x: str) -> Column:
    n = F.count(x).cast("double")
    return (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(x) + 6)


def distribution(df: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """One row per group and metric."""
    long = df.unpivot(keys, metrics, "metric", "x").filter("x is not null")
    q = {"p1": 0.01, "p5": 0.05, "p50": 0.5, "p95": 0.95, "p99": 0.99}
    return long.groupBy(*keys, "metric").agg(
        F.count("x").alias("n"),
        F.avg("x").alias("mean"),
        F.stddev_samp("x").alias("std"),
        F.min("x").alias("min"),
        *[F.percentile("x", p).alias(k) for k, p in q.items()],
        F.max("x").alias("max"),
        sample_skewness("x").alias("skew"),
        sample_kurtosis("x").alias("kurt"),
    )


def acf(df: DataFrame, col: str, keys: list[str], ts: str, lags: int = 60) -> DataFrame:
    """Biased autocorrelations of the series without its nulls; none below three
    rows, null without variance."""
    w = Window.partitionBy(*keys).orderBy(ts)
    some = df.filter(F.col(col).isNotNull())
    stats = some.groupBy(*keys).agg(F.avg(col).alias("m_"), F.count(F.lit(1)).alias("n_")).filter("n_ >= 3")
    x = some.join(stats, keys).withColumn("x_", F.col(col) - F.col("m_"))
    x = x.select(*keys, "x_", F.array(*[F.lag("x_", k).over(w) for k in range(lags + 1)]).alias("past"))
    sums = x.groupBy(*keys).agg(
        F.sum(F.col("x_") * F.col("x_")).alias("ss"),
        F.array(*[F.sum(F.col("x_") * F.get("past", F.lit(k))) for k in range(lags + 1)]).alias("sp"),
    )
    out = sums.select(*keys, "ss", F.posexplode("sp").alias("lag", "s"))
    return out.select(*keys, "lag", F.when(F.col("ss") > 0, F.col("s") / F.col("ss")).alias("acf"))


def correlations(wide: DataFrame, cols: list[str]) -> DataFrame:
    """Pairwise-complete Pearson matrix in long form, one aggregate for all pairs."""
    pairs = list(combinations_with_replacement(cols, 2))
    one = wide.agg(*[F.corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    rows = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{i}").alias("corr")) for i, (a, b) in enumerate(pairs)])
    return one.select(F.inline(rows))


def quality(df: DataFrame, keys: list[str], ret: str, ts: str, per_day: int, times: float = 10.0, low: float = 0.5) -> DataFrame:
    """Duplicates, missing and impossible prices, extreme jumps (beyond ``times`` sample
    deviations), days of low coverage (below ``low``), and both limits."""
    sd = df.groupBy(*keys).agg(F.stddev_samp(ret).alias("sd_"))
    rows = df.join(sd, keys).groupBy(*keys).agg(
        duplicate_count(ts).alias("duplicate_timestamps"),
        F.count_if(missing_ohlc()).alias("missing_core_ohlc_rows"),
        F.count_if(invalid_ohlc()).alias("invalid_ohlc_rows"),
        F.count_if((F.col("sd_") > 0) & (F.abs(ret) > times * F.col("sd_"))).alias("extreme_jump_rows"),
    )
    days = df.groupBy(*keys, F.to_date(ts).alias("d")).agg(F.count(F.lit(1)).alias("n"))
    few = days.groupBy(*keys).agg(F.count_if(F.col("n") / per_day < low).alias("low_coverage_days"))
    limits = {"extreme_jump_std_multiplier": F.lit(times), "low_coverage_threshold": F.lit(low)}
    return rows.join(few, keys).withColumns(limits)


def overview(df: DataFrame, keys: list[str], ts: str) -> DataFrame:
    """Rows, span, and counts of faults per instrument."""
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.min(ts).alias("first_ts"),
        F.max(ts).alias("last_ts"),
        duplicate_count(ts).alias("duplicate_ts"),
        *[F.count_if(F.col(c).isNull()).alias(f"missing_{c}") for c in (*OHLC, "volume")],
        F.count_if(invalid_ohlc()).alias("invalid_ohlc"),
        F.count_if(F.col("volume") == 0).alias("zero_volume"),
    )


def inspect(df: DataFrame, keys: list[str], ts: str, columns: list[str], least: int) -> DataFrame:
    """Nulls per column, faults, and rows per day: least, most, median, and days with
    fewer than ``least``."""
    days = daily_counts(df.filter(F.col(ts).isNotNull()), keys, ts).groupBy(*keys).agg(
        F.min("n").alias("min_per_day"), F.max("n").alias("max_per_day"), F.median("n").alias("median_per_day"),
        F.count_if(F.col("n") < least).alias("short_days"),
    )
    rows = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in columns],
        duplicate_count(ts).alias("duplicate_ts"),
        F.count_if(invalid_ohlc()).alias("invalid_ohlc"),
        F.count_if(F.col("volume") == 0).alias("zero_volume"),
    )
    return rows.join(days, keys)


def year_month_counts(df: DataFrame, keys: list[str], ts: str) -> DataFrame:
    return df.groupBy(*keys, F.year(ts).alias("year"), F.month(ts).alias("month")).agg(F.count(F.lit(1)).alias("n"))


def range_stats(df: DataFrame, by: list[str], ret: str = "ret") -> DataFrame:
    """Range, absolute return and volume per group, such as session or hour."""
    rng = F.col("high") - F.col("low")
    return df.groupBy(*by).agg(
        F.avg(rng).alias("mean_range"),
        F.median(rng).alias("median_range"),
        F.avg(F.abs(ret)).alias("mean_abs_ret"),
        F.avg("volume").alias("mean_volume"),
        F.count(F.lit(1)).alias("n"),
    )


def value_counts(df: DataFrame, by: list[str]) -> DataFrame:
    """Rows per group, such as labels by session."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


def label_summary(before: DataFrame, after: DataFrame, keys: list[str], horizons: dict[str, tuple[str, int, float]]) -> DataFrame:
    """Rows before and after the tail is cut and, per name in ``horizons`` (label column,
    horizon, threshold), the parameters and the count of each class."""
    counts = []
    for name, (label, horizon, band) in horizons.items():
        x = F.col(label)
        counts += [F.lit(horizon).alias(f"horizon_{name}"), F.lit(band).alias(f"threshold_{name}")]
        counts += [F.count_if(x == v).alias(f"{name}_{n}_count") for v, n in ((1, "long"), (0, "no_trade"), (-1, "short"))]
        counts.append(F.count_if(x.isNull()).alias(f"{name}_nan_count"))
    had = before.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows_before"))
    out = had.join(after.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows_after"), *counts), keys, "left")
    return out.withColumn("rows_after", F.coalesce("rows_after", F.lit(0))).withColumn(
        "rows_removed_tail", F.col("rows_before") - F.col("rows_after")
    )


def feature_summary(before: DataFrame, after: DataFrame, keys: list[str], base: list[str]) -> DataFrame:
    """Rows before and after incomplete ones are dropped, and numbers of columns."""
    n = {"num_total_columns": F.lit(len(after.columns)), "num_feature_columns": F.lit(len(set(after.columns) - set(base)))}
    had = before.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows_before"))
    left = after.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows_after"))
    out = had.join(left, keys, "left").withColumn("rows_after", F.coalesce("rows_after", F.lit(0)))
    return out.withColumn("rows_removed", F.col("rows_before") - F.col("rows_after")).withColumns(n)


def histogram(df: DataFrame, col: str, keys: list[str], bins: int, lo: float | None = None, hi: float | None = None) -> DataFrame:
    """Counts per equal bin from the least to the greatest value of each group (or of
    the range given, values outside it being left out); the last bin is closed.  Null
    values are not counted; a group of one value has it in bin 0."""
    x, own = F.col(col), df.filter(F.col(col).isNotNull())
    ends = own.groupBy(*keys).agg(F.min(col).alias("lo_"), F.max(col).alias("hi_"))
    if lo is not None and hi is not None:
        own, ends = own.filter(x.between(lo, hi)), ends.withColumns({"lo_": F.lit(lo), "hi_": F.lit(hi)})
    at = F.least(F.floor((x - F.col("lo_")) * bins / (F.col("hi_") - F.col("lo_"))), F.lit(bins - 1))
    bin_ = F.when(F.col("hi_") > F.col("lo_"), at).otherwise(0).cast("int")
    return own.join(F.broadcast(ends), keys).groupBy(*keys, bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
