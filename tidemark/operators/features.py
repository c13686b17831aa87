"""Bar features and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, WindowSpec
from pyspark.sql import functions as F

from tidemark.config import SPREAD_PIPS, Config
from tidemark.functions import scalars as S
from tidemark.functions import windows as W
from tidemark.operators import folds, order_stats


def time_features(df: DataFrame, ts: str = "ts") -> DataFrame:
    hour = F.hour(ts)
    angle = hour * (2 * 3.141592653589793 / 24)
    return df.withColumns(
        {
            "hour": hour,
            "day_of_week": F.weekday(ts),
            "minute_of_day": hour * 60 + F.minute(ts),
            "hour_sin": F.sin(angle),
            "hour_cos": F.cos(angle),
            "is_overlap_session": S.in_session(hour, "overlap").cast("tinyint"),
            "is_month_end": (F.to_date(ts) == F.last_day(ts)).cast("tinyint"),
        }
    )


def session_flags(df: DataFrame, session: str = "session") -> DataFrame:
    names = {"asia": "Asia", "london": "London", "overlap": "Overlap", "ny": "New_York"}
    return df.withColumns({f"session_{k}": (F.col(session) == v).cast("tinyint") for k, v in names.items()})


def price_features(df: DataFrame, w: WindowSpec, c: Config = Config()) -> DataFrame:
    """Returns, ranges, volatility and trend: one pass over one window order."""
    close, high, low = F.col("close"), F.col("high"), F.col("low")
    df = df.withColumns(
        {"log_ret_1": W.log_return("close", w), "range": high - low, "range_pct": F.try_divide(high - low, close)}
        | {f"ret_{k}": W.simple_return("close", k, w) for k in c.ret_windows}
        | {f"mom_{k}": W.simple_return("close", k, w) for k in c.mom_windows}
        | {f"sma_{k}": W.rolling_mean(close, k, w) for k in c.ma_windows}
    )
    df = df.withColumns(
        {f"range_ma_{k}": W.rolling_mean(F.col("range"), k, w) for k in c.range_windows}
        | {f"rv_{k}": W.rolling_std(F.col("log_ret_1"), k, w) for k in c.vol_windows}
        | {"abs_ret_1": F.abs("ret_1")}
        | {f"price_to_sma_{k}": F.try_divide(close, F.col(f"sma_{k}")) - 1 for k in c.ma_windows if k in (30, 60)}
        | {"volume_zscore_60": W.rolling_zscore(F.col("volume"), 60, w)}
    )
    return df.withColumn("rv_ratio_10_60", F.try_divide(F.col("rv_10"), F.col("rv_60")))


def same_slot_range(df: DataFrame, by: str = "pair", ts: str = "ts") -> DataFrame:
    """ln(high/low) of the last earlier bar at the same clock minute."""
    from pyspark.sql import Window

    slot = F.date_format(ts, "HH:mm")
    w = Window.partitionBy(by, slot).orderBy(ts)
    spread = F.ln(F.try_divide(F.col("high"), F.col("low")))
    return df.withColumn("same_minute_prev_day_logrange", F.lag(spread, 1).over(w))


def regime(df: DataFrame, keys: list[str], ts: str, c: Config = Config()) -> DataFrame:
    """High-volatility flag against the quantile of all values so far."""
    rv, name = f"rv_{c.regime_window}", f"rv_{c.regime_window}_q{round(c.regime_quantile * 100)}"
    df = order_stats.expanding_quantile(df, rv, c.regime_quantile, keys, ts, c.regime_window, name)
    high = F.coalesce(F.col(rv) > F.col(name), F.lit(False)).cast("tinyint")
    return df.withColumns({"volatility_regime_high": high, "volatility_regime_code": high})


def rsi_feature(df: DataFrame, keys: list[str], ts: str, n: int = 14) -> DataFrame:
    return folds.rsi(df, n, keys, ts, name=f"rsi_{n}")


def dimension(spark) -> DataFrame:
    """pair, pip, spread_pips: a handful of rows, always broadcast."""
    from tidemark.config import pip_size

    return spark.createDataFrame([(p, pip_size(p), s) for p, s in SPREAD_PIPS.items()], "pair string, pip double, spread_pips double")


def spread_features(df: DataFrame, dim: DataFrame) -> DataFrame:
    df = df.join(F.broadcast(dim), "pair", "left")
    df = df.withColumns({"pip": F.coalesce("pip", F.lit(0.0001)), "spread_pips": F.coalesce("spread_pips", F.lit(1.0))})
    pips = (F.col("high") - F.col("low")) / F.col("pip")
    ratio = F.try_divide(pips, F.col("spread_pips"))
    return df.withColumns({"bar_range_pips": pips, "bar_range_to_spread_ratio": ratio}).drop("pip")


def cross_returns(df: DataFrame, pairs: list[str], w: WindowSpec, ks: tuple[int, ...] = (1, 5), ts: str = "ts") -> DataFrame:
    """Every other instrument's returns at the same time, each computed on that
    instrument's own bars.  One aggregate and one join stand for all pairwise joins."""
    own = df.select("pair", ts, *[W.simple_return("close", k, w).alias(f"r{k}") for k in ks])
    at = [F.max(F.when(F.col("pair") == p, F.col(f"r{k}"))).alias(f"{p}_ret_{k}_xpair") for p in pairs for k in ks]
    out = df.join(own.groupBy(ts).agg(*at), ts, "left")
    names = [(p, f"{p}_ret_{k}_xpair") for p in pairs for k in ks]
    return out.withColumns({n: F.when(F.col("pair") != p, F.col(n)) for p, n in names})


def aligned_returns(df: DataFrame, pairs: list[str], w: WindowSpec, ts: str = "ts") -> DataFrame:
    """Times at which every instrument has a return (inner alignment)."""
    own = df.select("pair", ts, W.simple_return("close", 1, w).alias("r")).filter("r is not null")
    return own.groupBy(ts).pivot("pair", pairs).agg(F.first("r")).dropna()


def labels(df: DataFrame, w: WindowSpec, c: Config = Config()) -> DataFrame:
    """Forward returns and three-way labels; ``label`` is the primary horizon's."""
    df = df.withColumns({f"future_ret_{h}": W.forward_return("close", h, w) for h in c.horizons})
    named = {
        f"label_3class_{h}": S.three_way(F.col(f"future_ret_{h}"), b) for h, b in zip(c.horizons, c.flat_band, strict=True)
    }
    return df.withColumns(named).withColumn("label", F.col(f"label_3class_{c.horizons[0]}"))
