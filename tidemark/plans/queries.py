"""Queries over the driver's tables.

``events`` serve as ticks: event_type is the instrument, ts the clock, value the
price.  Hourly bars of them feed windows, strategies and the simulator; the star
schema feeds the relational selection rules.  Accumulated doubles are rounded to six
places, as sums depend on their order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.config import LONG_FEATURES, LR_FEATURES, SESSION_FEATURES, SHORT_FEATURES, Config
from tidemark.functions import scalars as S
from tidemark.functions import windows as W
from tidemark.operators import backtest, clean, eda, evaluate, features, folds, logs, ml, numbering, order_stats, reports, splits, strategies
from tidemark.sources import archives
from tidemark.sources import bars as B
from tidemark.sources.tables import fresh_folder, written

PAIRS = ["click", "error", "purchase", "signup", "view"]
KEY, ORDER = ["pair"], "ts"
CONFIG = Config()
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn: Callable) -> Callable:
    QUERIES[fn.__name__] = fn
    return fn


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def ticks(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "events").select(F.col("event_type").alias("pair"), "ts", F.col("value").alias("close"), "event_id")


def bars(spark: SparkSession, sf: str) -> DataFrame:
    return B.resample(ticks(spark, sf), "1 hour", KEY, "ts", price="close")


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def w() -> object:
    return W.series()


# -- sources and cleaning -----------------------------------------------------------


@query
def ohlcv_resample(spark, sf):
    return bars(spark, sf)


@query
def ohlcv_resample_daily(spark, sf):
    return B.resample(bars(spark, sf), "1 day", KEY, "ts")


def dirty_bars(spark, sf):
    """Bars with planted faults: every 17th tick number spoils a price."""
    b = bars(spark, sf).withColumn("n", F.row_number().over(w()))
    return b.withColumns(
        {
            "high": F.when(F.col("n") % 17 == 0, F.col("low") - 1).otherwise(F.col("high")),
            "open": F.when(F.col("n") % 23 == 0, F.col("high") + 1).otherwise(F.col("open")),
            "close": F.when(F.col("n") % 29 == 0, None).otherwise(F.col("close")),
        }
    )


@query
def ohlc_validity(spark, sf):
    d = dirty_bars(spark, sf).withColumn("bad", clean.invalid_ohlc())
    return d.groupBy("pair", "bad").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"))


@query
def clean_bars(spark, sf):
    d = dirty_bars(spark, sf)
    out = clean.clean(d, 18, KEY, "ts", ["n"])
    return out.select("pair", "ts", "open", "high", "low", "close", "volume")


@query
def cleaning_summary(spark, sf):
    d = dirty_bars(spark, sf)
    d = d.unionByName(d.filter("n % 50 = 0"))
    return clean.summary(d, clean.clean(d, 18, KEY, "ts", ["n"]), 18, KEY, "ts", ["n"])


@query
def dedupe_first(spark, sf):
    t = ticks(spark, sf).withColumn("slot", F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 1800))
    return clean.dedupe_first(t, ["pair", "slot"], ["ts", "event_id"]).select("pair", "ts", "close", "event_id")


@query
def sparse_days(spark, sf):
    b = bars(spark, sf)
    return clean.dense_days(b, 23, KEY, "ts").groupBy("pair").agg(F.count(F.lit(1)).alias("n"), F.countDistinct(F.to_date("ts")).alias("days"))


@query
def tz_normalise(spark, sf):
    stamp = F.date_format(F.col("ts") + F.expr("INTERVAL 54 DAYS"), "yyyyMMdd HHmmss")
    raw = ticks(spark, sf).select("event_id", stamp.alias("stamp"))
    local = F.try_to_timestamp("stamp", F.lit("yyyyMMdd HHmmss"))
    utc = B.to_utc(local)
    return raw.select("event_id", utc.alias("u")).filter("u is not null").select(
        "event_id", F.date_format("u", "yyyy-MM-dd HH:mm:ss").alias("utc"), S.session_label(F.hour("u")).alias("session")
    )


# -- exploration --------------------------------------------------------------------


@query
def daily_coverage(spark, sf):
    d = clean.daily_counts(bars(spark, sf), KEY, "ts")
    return d.withColumns({"ratio": F.col("n") / 24, "day": F.date_format("day", "yyyy-MM-dd")})


@query
def monthly_coverage(spark, sf):
    m = eda.monthly_coverage(bars(spark, sf), KEY, "ts", 24)
    return m.withColumns({c: r6(c) for c in ("mean_ratio", "min_ratio", "max_ratio")})


@query
def year_month_counts(spark, sf):
    return eda.year_month_counts(bars(spark, sf), KEY, "ts")


def _session(df):
    return df.withColumn("session", S.session_label(F.hour("ts")))


@query
def session_stats(spark, sf):
    b = _session(bars(spark, sf)).withColumn("ret", W.simple_return("close", 1, w()))
    s = eda.range_stats(b, ["pair", "session"])
    return s.select("pair", "session", "n", *[r6(c).alias(c) for c in s.columns[2:-1]])


@query
def hourly_stats(spark, sf):
    b = bars(spark, sf).withColumns({"ret": W.simple_return("close", 1, w()), "hour": F.hour("ts")})
    s = eda.range_stats(b, ["pair", "hour"])
    return s.select("pair", "hour", "n", *[r6(c).alias(c) for c in s.columns[2:-1]])


@query
def overview(spark, sf):
    return eda.overview(dirty_bars(spark, sf), KEY, "ts")


@query
def distribution_summary(spark, sf):
    b = bars(spark, sf)
    b = b.select("pair", W.simple_return("close", 1, w()).alias("ret"), (F.col("high") - F.col("low")).alias("rng"))
    d = eda.distribution(b, KEY, ["ret", "rng"])
    return d.select("pair", "metric", "n", *[r6(c).alias(c) for c in d.columns[3:]])


@query
def acf(spark, sf):
    b = bars(spark, sf).withColumn("ret", W.log_return("close", w()))
    a = eda.acf(b, "ret", KEY, "ts", 20)
    return a.select("pair", "lag", r6("acf").alias("acf"))


@query
def correlation_matrix(spark, sf):
    wide = features.aligned_returns(bars(spark, sf), PAIRS, w())
    c = eda.correlations(wide, PAIRS)
    return c.select("a", "b", r6("corr").alias("corr"))


@query
def quality_summary(spark, sf):
    b = dirty_bars(spark, sf).withColumn("ret", W.simple_return("close", 1, w()))
    return eda.quality(b, KEY, "ret", "ts", 24, 3.0)


@query
def inspect_days(spark, sf):
    return eda.inspect(dirty_bars(spark, sf), KEY, "ts", ["ts", "open", "close"], 24)


@query
def histogram(spark, sf):
    return eda.histogram(ticks(spark, sf), "close", KEY, 64)


# -- features and labels ------------------------------------------------------------


@query
def time_features(spark, sf):
    b = features.time_features(bars(spark, sf))
    keep = ["pair", "ts", "hour", "day_of_week", "minute_of_day", "is_overlap_session", "is_month_end"]
    return b.select(*keep, *[(r6(c) + 0.0).alias(c) for c in ("hour_sin", "hour_cos")])  # + 0.0: no -0.0


@query
def session_flags(spark, sf):
    b = features.session_flags(_session(bars(spark, sf)))
    return b.select("pair", "ts", "session", "session_asia", "session_london", "session_overlap", "session_ny")


@query
def simple_returns(spark, sf):
    b = bars(spark, sf)
    return b.select("pair", "ts", *[W.simple_return("close", k, w()).alias(f"ret_{k}") for k in (1, 5, 15)])


@query
def log_returns(spark, sf):
    return bars(spark, sf).select("pair", "ts", r6(W.log_return("close", w())).alias("log_ret_1"))


@query
def rolling_vol(spark, sf):
    b = bars(spark, sf).withColumn("r", W.log_return("close", w()))
    return b.select("pair", "ts", *[r6(W.rolling_std(F.col("r"), k, w())).alias(f"rv_{k}") for k in (10, 30, 60)])


@query
def rolling_sma(spark, sf):
    return bars(spark, sf).select("pair", "ts", *[r6(W.rolling_mean(F.col("close"), k, w())).alias(f"sma_{k}") for k in (10, 30, 60, 120)])


@query
def price_to_sma(spark, sf):
    f = features.price_features(bars(spark, sf), w())
    return f.select("pair", "ts", *[r6(c).alias(c) for c in ("price_to_sma_30", "range_ma_10", "range_pct", "mom_15")])


@query
def volume_zscore(spark, sf):
    return bars(spark, sf).select("pair", "ts", r6(W.rolling_zscore(F.col("close"), 60, w())).alias("z"))


@query
def expanding_quantile(spark, sf):
    b = bars(spark, sf).withColumn("r", F.col("high") - F.col("low"))
    q = order_stats.expanding_quantile(b, "r", 0.8, KEY, "ts", 30, "q80")
    high = F.coalesce(F.col("r") > F.col("q80"), F.lit(False)).cast("int")
    return q.select("pair", "ts", r6("q80").alias("q80"), high.alias("regime_high"))


@query
def same_slot_lag(spark, sf):
    b = features.same_slot_range(bars(spark, sf))
    return b.select("pair", "ts", r6("same_minute_prev_day_logrange").alias("prev_range"))


@query
def spread_features(spark, sf):
    dim = spark.createDataFrame([("click", 0.01, 0.7), ("view", 0.1, 1.4)], "pair string, pip double, spread_pips double")
    b = features.spread_features(bars(spark, sf), dim)
    return b.select("pair", "ts", *[r6(c).alias(c) for c in ("bar_range_pips", "bar_range_to_spread_ratio")])


@query
def cross_instrument_join(spark, sf):
    c = features.cross_returns(bars(spark, sf), PAIRS, w(), (1,))
    return c.select("pair", "ts", *[f"{p}_ret_1_xpair" for p in PAIRS])


@query
def aligned_returns(spark, sf):
    return features.aligned_returns(bars(spark, sf), PAIRS, w())


@query
def forward_label(spark, sf):
    b = bars(spark, sf).withColumn("f", W.forward_return("close", 5, w()))
    return b.select("pair", "ts", F.col("f").alias("future_ret_5"), S.three_way(F.col("f"), 0.25).alias("label"))


def _labelled(spark, sf):
    b = _session(bars(spark, sf)).withColumn("f", W.forward_return("close", 5, w()))
    return b.withColumn("label", S.three_way(F.col("f"), 0.25).cast("int"))


@query
def label_distribution(spark, sf):
    return eda.value_counts(_labelled(spark, sf), ["pair", "label"])


@query
def label_summary(spark, sf):
    b = bars(spark, sf).withColumns({f"f{k}": W.forward_return("close", k, w()) for k in (5, 15)})
    b = b.withColumns({f"label_{k}": S.three_way(F.col(f"f{k}"), band) for k, band in ((5, 0.25), (15, 0.5))})
    after = b.filter("f15 is not null")
    return eda.label_summary(b, after, KEY, {"primary": ("label_5", 5, 0.25), "secondary": ("label_15", 15, 0.5)})


@query
def feature_summary(spark, sf):
    b = bars(spark, sf)
    f = b.withColumns({f"sma_{k}": W.rolling_mean(F.col("close"), k, w()) for k in (10, 30)})
    return eda.feature_summary(f, f.dropna(subset=["sma_30"]), KEY, b.columns)


@query
def session_label_distribution(spark, sf):
    return eda.value_counts(_labelled(spark, sf), ["session", "label"])


@query
def class_weights(spark, sf):
    c = evaluate.class_weights(_labelled(spark, sf).filter("label is not null"), KEY, "label")
    return c.select("pair", "label", "n", r6("weight").alias("weight"))


# -- splits -------------------------------------------------------------------------

TRAIN_END, VAL_END = "2024-01-15 23:59:59", "2024-01-22 23:59:59"
FOLDS = [
    ("2024-01-08 23:59:59", "2024-01-09", "2024-01-12 23:59:59"),
    ("2024-01-12 23:59:59", "2024-01-13", "2024-01-16 23:59:59"),
    ("2024-01-16 23:59:59", "2024-01-17", "2024-01-20 23:59:59"),
]


@query
def split_purge(spark, sf):
    s = splits.fixed_split(bars(spark, sf), TRAIN_END, VAL_END, 15, KEY, "ts")
    return s.select("pair", "ts", "split", "close")


@query
def fold_boundaries(spark, sf):
    f = splits.folds(bars(spark, sf), FOLDS, 15, KEY, "ts")
    return f.groupBy("pair", "fold", "kind").agg(
        F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")
    )


@query
def split_label_stats(spark, sf):
    s = splits.fixed_split(_labelled(spark, sf), TRAIN_END, VAL_END, 15, KEY, "ts")
    share = lambda v: r6(F.avg((F.col("label") == v).cast("double")) * 100)
    return s.groupBy("pair", "split").agg(
        F.count(F.lit(1)).alias("n"), share(1).alias("pct_long"), share(-1).alias("pct_short"), share(0).alias("pct_flat"),
        r6(F.avg((F.col("session") == "Asia").cast("double")) * 100).alias("pct_asia"),
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
    )


@query
def split_manifest(spark, sf):
    s = splits.fixed_split(_labelled(spark, sf), TRAIN_END, VAL_END, 15, KEY, "ts")
    m = splits.manifest(s, KEY, "ts", 15, {"train_end": TRAIN_END, "val_end": VAL_END}, "label")
    return m.select(*[r6(c).alias(c) if c.endswith("_pct") else F.col(c) for c in m.columns])


@query
def session_training(spark, sf):
    s = splits.fixed_split(_session(bars(spark, sf)), TRAIN_END, VAL_END, 15, KEY, "ts").filter("split = 'train'")
    sets = [df.groupBy("pair").agg(F.lit(n).alias("train_set"), F.count(F.lit(1)).alias("n")) for n, df in splits.session_training(s).items()]
    return sets[0].unionByName(sets[1]).unionByName(sets[2]).unionByName(sets[3])


@query
def date_window(spark, sf):
    return splits.date_window(bars(spark, sf), "ts", "2024-01-05", "2024-01-09").select("pair", "ts", "close")


@query
def scaler_stats(spark, sf):
    b = bars(spark, sf).withColumn("ret", W.simple_return("close", 1, w()))
    s = splits.scaler(b, ["close", "volume", "ret"], KEY)
    return s.select("pair", "pos", "feature", r6("mean").alias("mean"), r6("scale").alias("scale"))


# -- strategies ---------------------------------------------------------------------


def _events(df: DataFrame) -> DataFrame:
    return df.filter("signal != 0").select("pair", "ts", F.col("signal").cast("int").alias("signal"))


@query
def ma_cross_sma(spark, sf):
    return _events(strategies.ma_crossover(5, 20, "sma").generate(bars(spark, sf), KEY))


@query
def ma_cross_ema(spark, sf):
    return _events(strategies.ma_crossover(5, 20, "ema").generate(bars(spark, sf), KEY))


@query
def momentum(spark, sf):
    return _events(strategies.momentum(24).generate(bars(spark, sf), KEY))


@query
def donchian(spark, sf):
    return _events(strategies.donchian(20).generate(bars(spark, sf), KEY))


@query
def bollinger(spark, sf):
    return _events(strategies.bollinger(20, 2.0).generate(bars(spark, sf), KEY))


@query
def rsi_reversion(spark, sf):
    return _events(strategies.rsi_reversion(14, 40, 60).generate(bars(spark, sf), KEY))


@query
def macd_cross(spark, sf):
    return _events(strategies.macd_cross(6, 13, 5).generate(bars(spark, sf), KEY))


@query
def ewm(spark, sf):
    e = folds.ewm(bars(spark, sf), {"e": ("close", folds.span(20))}, KEY, "ts")
    return e.select("pair", "ts", r6("e").alias("ema_20"))


@query
def rsi(spark, sf):
    return features.rsi_feature(bars(spark, sf), KEY, "ts").select("pair", "ts", r6("rsi_14").alias("rsi_14"))


@query
def cooldown(spark, sf):
    return _events(strategies.momentum(12, cooldown=10).generate(bars(spark, sf), KEY))


@query
def signal_distribution(spark, sf):
    s = strategies.momentum(24).generate(bars(spark, sf), KEY)
    return backtest.signal_distribution(s, KEY)


# -- positions, trades, metrics -----------------------------------------------------


def _positions(spark, sf, direction="both", session=None):
    s = strategies.momentum(24).generate(bars(spark, sf), KEY)
    s = s.withColumn("signal", backtest.masked_signal("signal", "ts", direction, session).cast("int"))
    return backtest.with_position(s, "signal", KEY, "ts")


@query
def position_ffill(spark, sf):
    return _positions(spark, sf).select("pair", "ts", "signal", "position")


@query
def session_mask(spark, sf):
    s = strategies.momentum(24).generate(bars(spark, sf), KEY)
    m = {
        f"s_{n}": backtest.masked_signal("signal", "ts", d, n).cast("int")
        for n, d in (("london", "both"), ("asia", "long_only"), ("ny", "short_only"))
    }
    late = backtest.masked_signal("signal", "ts", entry_time="13:30").cast("int")
    return s.withColumns(m | {"s_late": late}).select("pair", "ts", *m, "s_late")


VARIANTS = [
    {"spread": 0.5, "take": 20.0, "stop": 10.0, "max_hold": 24},
    {"spread": 0.5, "take": None, "stop": None, "max_hold": None},
]


@query
def trade_sim(spark, sf):
    t = backtest.run_trades(_positions(spark, sf), KEY, "ts", VARIANTS)
    return t.select(
        "pair", "variant", "entry_bar", "exit_bar", "bars_held", "direction", "entry_price", "exit_price",
        F.round(F.col("pnl_pct") + 1e-9, 4).alias("pnl_pct"), "exit_reason",  # off ties
    )


@query
def trade_sim_ticks(spark, sf):
    """Every event as a tick; chunks of a day."""
    s = strategies.momentum(24).generate(ticks(spark, sf), KEY, ["ts", "event_id"])
    p = backtest.with_position(s, "signal", KEY, ["ts", "event_id"])
    t = backtest.run_trades(p, KEY, ["ts", "event_id"], VARIANTS, seconds=86_400)
    return t.select(
        "pair", "variant", "entry_bar", "exit_bar", "bars_held", "direction", "entry_price", "exit_price",
        F.round(F.col("pnl_pct") + 1e-9, 4).alias("pnl_pct"), "exit_reason",
    )


@query
def trade_log(spark, sf):
    """The simulator's trades by the table function, from SQL."""
    logs.register(spark)
    p = _positions(spark, sf).select(F.col("pair").alias("series"), "ts", F.col("close").alias("price"), "position")
    call = "SELECT {v} AS variant, * FROM trade_log(TABLE(SELECT * FROM {{p}}) PARTITION BY (series) ORDER BY (ts), {args})"
    args = [", ".join("null" if v[k] is None else str(v[k]) for k in ("spread", "take", "stop", "max_hold")) for v in VARIANTS]
    t = spark.sql(" UNION ALL ".join(call.format(v=i, args=a) for i, a in enumerate(args)), p=p)
    return t.select(
        F.col("series").alias("pair"), "variant", "entry_bar", "exit_bar", "bars_held", "direction", "entry_price", "exit_price",
        F.round(F.col("pnl_pct") + 1e-9, 4).alias("pnl_pct"), "exit_reason",
    )


@query
def worst_fall(spark, sf):
    """Worst fall of every tick's value, a day being a chunk."""
    t = ticks(spark, sf).filter("close > 0")
    return logs.worst_fall(t, KEY, "ts", "close", "1 day").select("pair", r6("worst_fall").alias("worst_fall"))


@query
def regime(spark, sf):
    """High-volatility flag of every tick against the quantile of all before it."""
    order = ["ts", "event_id"]
    t = ticks(spark, sf).withColumn("rv_30", W.rolling_std(F.col("close"), 30, W.series(order=order)))
    r = features.regime(t, KEY, order)
    return r.select("pair", "event_id", r6("rv_30_q80").alias("q80"), F.col("volatility_regime_high").cast("int").alias("high"))


@query
def trade_metrics(spark, sf):
    """Metrics over a trade log (order lines as trades)."""
    li = read(spark, sf, "lineitem")
    pnl = F.round((F.col("l_discount") - 0.05) * F.col("l_quantity"), 6)
    t = li.select(
        (F.col("l_suppkey") % 5).alias("run"), pnl.alias("pnl_pct"), F.col("l_linenumber").alias("bars_held"),
        F.round(pnl * 3, 4).alias("pnl_dollars"),
    )
    m = backtest.trade_metrics(t, ["run"], CONFIG.annualisation)
    exact = ("run", "n_trades")
    return m.select(*exact, *[r6(c).alias(c) for c in m.columns if c not in exact])


@query
def curve_metrics(spark, sf):
    p = _positions(spark, sf)
    c = backtest.run_curves(p, KEY, "ts", VARIANTS[0])
    m = backtest.curve_metrics(c, KEY, "ts")
    # event values are no prices and compound to huge sums: magnitudes are compared as logarithms
    size = lambda x: (F.signum(x) * F.round(F.log10(1 + F.abs(x)), 6)).alias(f"log_{x}")
    return m.select("pair", F.round("turnover", 6).alias("turnover"), *[size(x) for x in ("total_return", "max_drawdown", "calmar")])


@query
def drawdown(spark, sf):
    b = bars(spark, sf)
    return b.select("pair", "ts", W.drawdown(F.col("close"), w()).alias("dd"))


@query
def rolling_sharpe(spark, sf):
    b = bars(spark, sf).withColumn("r", F.coalesce(W.simple_return("close", 1, w()), F.lit(0.0)))
    return b.select("pair", "ts", F.round(W.rolling_sharpe(F.col("r"), 48, 98280, w()), 4).alias("sharpe"))


@query
def buy_and_hold(spark, sf):
    return backtest.buy_and_hold(bars(spark, sf), KEY, "ts")


@query
def signal_returns(spark, sf):
    s = strategies.momentum(24).generate(bars(spark, sf), KEY)
    return backtest.next_bar_return(s, KEY, "ts").select("pair", "ts", "signal_return")


@query
def price_diff_returns(spark, sf):
    p = _positions(spark, sf)
    diff = F.coalesce((F.col("close") - F.lag("close", 1).over(w())) * F.col("position"), F.lit(0.0))
    return p.select("pair", "ts", diff.alias("pnl"))


@query
def walk_forward(spark, sf):
    """All folds' training slices in one job, the fold being part of the key."""
    f = splits.folds(bars(spark, sf), FOLDS, 15, KEY, "ts").filter("kind = 'train'")
    keys = ["pair", "fold"]
    s = strategies.momentum(24).generate(f, keys)
    p = backtest.with_position(s.withColumn("signal", F.col("signal").cast("int")), "signal", keys, "ts")
    return p.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum("position").alias("net_position"), F.count_if(F.col("signal") != 0).alias("n_signals")
    )


# -- selection and evaluation -------------------------------------------------------


def outcomes(spark, sf) -> DataFrame:
    """Run outcomes from order lines: scores per instrument, strategy, session and
    direction."""
    li = read(spark, sf, "lineitem").select(
        F.concat(F.lit("P"), F.col("l_suppkey") % 5).alias("pair"),
        F.concat(F.lit("S"), F.lpad((F.col("l_partkey") % 13).cast("string"), 2, "0")).alias("strategy"),
        F.when(F.col("l_linenumber") % 3 == 0, None).when(F.col("l_linenumber") % 3 == 1, "london").otherwise("ny").alias("session"),
        (F.col("l_orderkey") % 3).cast("int").alias("direction"),
        (F.col("l_quantity") - 25).alias("a"), (F.col("l_discount") - 0.05).alias("b"), "l_tax",
    )
    return li.groupBy("pair", "strategy", "session", "direction").agg(
        F.count(F.lit(1)).alias("n_trades"),
        F.round(F.avg("a"), 4).alias("net_sharpe"),
        F.round(F.avg("b") * 100, 4).alias("sortino"),
        F.round(F.avg("l_tax") * 50, 4).alias("calmar"),
        F.round(-F.avg("l_tax") * 10, 4).alias("max_drawdown"),
    )


def scored_outcomes(spark, sf) -> DataFrame:
    o = outcomes(spark, sf)
    c = [F.col(x) for x in ("n_trades", "net_sharpe", "sortino", "calmar", "max_drawdown")]
    return o.withColumn("composite", S.composite_score(*c))


@query
def config_grid(spark, sf):
    """Every instrument of the table with every setting."""
    g = evaluate.grid(spark, strategy=list(strategies.REGISTRY), session=[None, "london", "ny"], direction=["both", "long_only", "short_only"])
    settings = F.array_agg(F.struct(*g.columns)).alias("settings")  # a grid: tens of rows
    known = ticks(spark, sf).select("pair").distinct().withColumn("all_", F.lit(1))
    both = known.join(F.broadcast(g.agg(settings).withColumn("all_", F.lit(1))), "all_")
    return both.select("pair", F.inline("settings"))


@query
def composite_score(spark, sf):
    s = scored_outcomes(spark, sf)
    return s.select("pair", "strategy", "session", "direction", r6("composite").alias("composite"), S.grade(F.col("composite")).alias("grade"))


def _by_strategy(spark, sf):
    family = F.concat(F.lit("F"), F.substring("strategy", 2, 2).cast("int") % 4)
    return scored_outcomes(spark, sf).groupBy("pair", "strategy").agg(F.round(F.avg("net_sharpe"), 4).alias("score")).withColumn("family", family)


@query
def topk_per_group(spark, sf):
    return evaluate.top_fraction(_by_strategy(spark, sf), "pair", "score", "strategy", 0.4, -0.05)


@query
def family_floor(spark, sf):
    s = _by_strategy(spark, sf)
    kept = evaluate.top_fraction(s, "pair", "score", "strategy", 0.2, 0.0)
    return evaluate.family_floor(kept, s, "pair", "family", "score", "strategy")


@query
def group_argmax(spark, sf):
    b = evaluate.best(scored_outcomes(spark, sf), ["pair", "strategy"], "composite", ["session", "direction"])
    return b.select("pair", "strategy", "session", "direction", r6("composite").alias("composite"))


@query
def argmax_or_baseline(spark, sf):
    s = scored_outcomes(spark, sf).select("pair", "strategy", "session", "direction", "composite")
    base, tuned = s.filter("direction = 0").drop("direction"), s.filter("direction = 1").drop("direction")
    out = evaluate.beats_baseline(tuned, base, ["pair", "strategy", "session"], "composite")
    return out.withColumn("composite", r6("composite"))


def _fold_runs(spark, sf):
    li = read(spark, sf, "lineitem")
    return li.select(
        F.concat(F.lit("P"), F.col("l_suppkey") % 5).alias("pair"), F.concat(F.lit("S"), F.col("l_partkey") % 7).alias("strategy"),
        (F.col("l_orderkey") % 5).cast("int").alias("fold"), "l_quantity", "l_discount", "l_tax", "l_linenumber",
    ).groupBy("pair", "strategy", "fold").agg(
        F.round(F.avg("l_quantity") - 25.3, 4).alias("net_sharpe"), F.round(F.avg("l_discount") - 0.05, 6).alias("total_return"),
        F.count(F.lit(1)).alias("n_trades"), F.round(F.sum("l_quantity"), 2).alias("capital_final"),
        F.round(-F.avg("l_tax"), 6).alias("max_drawdown"), F.round(F.avg("l_tax") * 30, 6).alias("calmar"), F.round(F.avg("l_discount") * 7, 6).alias("win_rate"),
        F.round(F.avg("l_quantity") / 20, 6).alias("profit_factor"), F.round(F.avg("l_linenumber"), 6).alias("avg_trade_bars"),
        F.round(F.avg("l_discount"), 6).alias("turnover"), F.round(F.avg("l_tax") - 0.04, 6).alias("sortino"),
        F.round(F.max("l_quantity") / 10, 6).alias("gross_sharpe"), F.count_if(F.col("l_linenumber") == 1).alias("n_long"),
        F.count_if(F.col("l_linenumber") == 2).alias("n_short"), F.count_if(F.col("l_linenumber") > 2).alias("n_flat"),
    )


def _rounded_folds(spark, sf):
    f = evaluate.fold_aggregate(_fold_runs(spark, sf), ["pair", "strategy"])
    means = ("fold_mean", "fold_std", *evaluate.FOLD_MEANS)
    return f.withColumns({c: r6(c) for c in means} | {"stability": F.round(F.col("fold_mean") - 0.5 * F.col("fold_std"), 3)})


@query
def fold_aggregate(spark, sf):
    return _rounded_folds(spark, sf)


@query
def final_rank(spark, sf):
    return evaluate.final_rank(_rounded_folds(spark, sf), 10, 3).select("pair", "strategy", "stability", "rank")


SESSIONS = ["asia", "global", "london", "ny"]


def _transfers(spark, sf):
    names = F.array(*map(F.lit, SESSIONS))
    li = read(spark, sf, "lineitem")
    return li.groupBy(
        F.get(names, (F.col("l_suppkey") % 4).cast("int")).alias("train_session"),
        F.get(names, (F.col("l_partkey") % 4).cast("int")).alias("eval_session"),
        F.when(F.col("l_linenumber") % 2 == 0, 1.0).otherwise(2.0).alias("spread_mult"),
    ).agg(F.round(F.avg("l_quantity") - 25, 4).alias("net_sharpe"))


@query
def transfer_pivot(spark, sf):
    return evaluate.transfer_matrix(_transfers(spark, sf), SESSIONS)


@query
def generalisability(spark, sf):
    g = evaluate.generalisability(_transfers(spark, sf).filter("spread_mult = 1.0"))
    return g.select("train_session", "n_out", *[r6(c).alias(c) for c in ("in_domain", "out_of_domain", "gap")])


@query
def breakeven(spark, sf):
    li = read(spark, sf, "lineitem")
    mult = F.when(F.col("l_linenumber") == 1, 0.5).when(F.col("l_linenumber") == 2, 1.0).otherwise(2.0)
    run = F.col("l_partkey") % 40
    runs = li.groupBy(run.alias("run"), mult.alias("spread_mult")).agg(
        # two runs in twenty stay at 0 from 0.5 to 1 or from 1 to 2
        F.round(F.avg(F.when((run % 20 == 3) & (mult < 2) | (run % 20 == 4) & (mult > 0.5), 0.0).otherwise(F.col("l_quantity") - 25.5)), 4).alias("net_sharpe")
    )
    return evaluate.breakeven(runs, ["run"])


@query
def dm_test(spark, sf):
    a = features.aligned_returns(bars(spark, sf), PAIRS, w())
    stats = evaluate.dm_statistics(a.withColumn("one", F.lit(1)), ["one"], "click", "view")
    return stats.select("n", r6("mean").alias("mean"), r6("var").alias("var"), F.round("stat", 3).alias("stat"))


@query
def dm_p_value(spark, sf):
    """Every pair of instruments, p by Student's t."""
    b = bars(spark, sf).withColumn("r", W.simple_return("close", 1, w())).filter("r is not null")
    names = [(x, f"{x}_vs_{y}", y) for i, x in enumerate(PAIRS) for y in PAIRS[i + 1 :]]
    pairs = spark.createDataFrame([(1, c, x, y) for x, c, y in names], "one int, comparison string, a string, b string")
    t = evaluate.compared(b.withColumn("one", F.lit(1)), pairs, ["one"], "pair", "ts", "r")
    return t.select("comparison", "a", "b", "n", F.round("stat", 3).alias("stat"), F.round("p", 3).alias("p"))


@query
def dm_by_position(spark, sf):
    """Every pair of instruments, paired by the number of the bar."""
    b = bars(spark, sf).withColumn("r", W.simple_return("close", 1, w())).filter("r is not null")
    names = [(x, f"{x}_vs_{y}", y) for i, x in enumerate(PAIRS) for y in PAIRS[i + 1 :]]
    pairs = spark.createDataFrame([(1, c, x, y) for x, c, y in names], "one int, comparison string, a string, b string")
    t = evaluate.compared_by_position(b.withColumn("one", F.lit(1)), pairs, ["one"], "pair", "ts", "r")
    return t.select("comparison", "a", "b", "n", F.round("stat", 3).alias("stat"), F.round("p", 3).alias("p"))


@query
def classification_report(spark, sf):
    l = _labelled(spark, sf).filter("label is not null")
    pred = F.coalesce(S.three_way(W.simple_return("close", 5, w()), 0.25).cast("int"), F.lit(0))
    c = evaluate.classification_report(l.withColumn("pred", -pred), KEY, "label", "pred")
    return c.select("pair", "n", r6("accuracy").alias("accuracy"), r6("macro_f1").alias("macro_f1"))


@query
def family_performance(spark, sf):
    s = _by_strategy(spark, sf)
    by_pair = s.groupBy("family", "pair").agg(F.round(F.avg("score"), 6).alias("m"))
    return by_pair.groupBy("family").agg(
        r6(F.avg("m")).alias("mean_score"),
        F.max_by("pair", F.struct("m", "pair")).alias("best_pair"),
        F.min_by("pair", F.struct("m", "pair")).alias("worst_pair"),
    )


@query
def strategy_summary(spark, sf):
    """Every registered strategy appears; those without good runs with zeros."""
    names = spark.createDataFrame([(f"S{k:02d}",) for k in range(15)], "strategy string")
    ok = scored_outcomes(spark, sf).filter("composite > 0")
    g = ok.groupBy("strategy").agg(F.count(F.lit(1)).alias("runs"), F.round(F.avg("net_sharpe"), 6).alias("mean_sharpe"))
    return names.join(g, "strategy", "left").fillna(0, ["runs", "mean_sharpe"])


@query
def best_and_worst(spark, sf):
    s = scored_outcomes(spark, sf)
    who = F.struct("strategy", F.coalesce("session", F.lit("-")).alias("session"), "direction")
    return s.groupBy("pair").agg(
        F.max_by(who, F.struct("composite", who)).alias("b"), F.min_by(who, F.struct("net_sharpe", who)).alias("x")
    ).select("pair", F.concat_ws("/", "b.*").alias("best_run"), F.concat_ws("/", "x.*").alias("worst_run"))


@query
def champion_runner_up(spark, sf):
    s = evaluate.best(_by_strategy(spark, sf), ["strategy"], "score", ["pair"])
    return s.withColumn("place", F.row_number().over(Window.orderBy(F.desc("score"), "strategy"))).filter("place <= 2").select("place", "strategy", "pair", "score")


@query
def legacy_top_n(spark, sf):
    """Three best distinct instruments per strategy, then ten strategies by mean less
    spread."""
    b = evaluate.best(scored_outcomes(spark, sf), ["strategy", "pair"], "net_sharpe", ["session", "direction"])
    n = F.row_number().over(Window.partitionBy("strategy").orderBy(F.desc("net_sharpe"), "pair"))
    g = b.withColumn("n", n).filter("n <= 3").groupBy("strategy").agg(
        F.round(F.avg("net_sharpe"), 6).alias("mean"), F.round(F.stddev_pop("net_sharpe"), 6).alias("std")
    )
    return g.filter("std <= 1.5").orderBy(F.desc("mean"), "std", "strategy").limit(10)


@query
def run_status(spark, sf):
    o = read(spark, sf, "orders")
    nb = F.when(F.col("o_orderkey") % 7 == 0, None).when(F.col("o_orderkey") % 11 == 0, 0).otherwise(F.col("o_custkey") % 100)
    s = evaluate.status(nb, F.lit(20), F.col("o_orderkey") % 5, F.col("o_custkey") % 3)
    return o.groupBy(s.alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query
def spec_flags(spark, sf):
    li = read(spark, sf, "lineitem")
    tp = F.when(F.col("l_linenumber") % 3 != 0, F.col("l_quantity"))
    sl = F.when(F.col("l_linenumber") % 4 != 0, F.col("l_quantity") / 2)
    flags = F.concat_ws("|", evaluate.spec_flags(tp, sl, F.lit(10.0)))
    return li.groupBy(flags.alias("flags")).agg(F.count(F.lit(1)).alias("n"))


CODE_PAIRS, CODE_KINDS, CODE_SETS = ["eurusd", "USDJPY", "gbpusd", "abcdef"], ["lr", "LSTM", "xx"], ["gl", "ldn", "NY", "as", "lo"]


@query
def model_codes(spark, sf):
    """Codes put together from customers, some of them unknown, short or long."""
    k = F.col("c_custkey")
    pick = lambda names, by: F.get(F.array(*map(F.lit, names)), (by % len(names)).cast("int"))
    parts = [pick(CODE_PAIRS, k), pick(CODE_KINDS, k + F.col("c_nationkey")), pick(CODE_SETS, F.col("c_nationkey"))]
    text = F.when(k % 11 == 0, F.concat_ws("-", *parts[:2])).when(k % 13 == 0, F.concat_ws("-", *parts, F.lit("d"))).otherwise(F.concat_ws("-", *parts))
    c = read(spark, sf, "customer").select(F.when(k % 17 > 0, text).otherwise("").alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("n"))
    return c.select("code", "n", S.model_code(F.col("code")).alias("m")).select("code", "n", "m.*")


@query
def in_domain_vs_rest(spark, sf):
    """One instrument against the mean of all others at the same time."""
    b = bars(spark, sf).withColumn("r", W.simple_return("close", 1, w())).filter("r is not null")
    return b.groupBy("ts").agg(
        F.max(F.when(F.col("pair") == "click", F.col("r"))).alias("own"),
        r6(F.avg(F.when(F.col("pair") != "click", F.col("r")))).alias("rest"),
    )


# -- models (rows only) -------------------------------------------------------------


def _model_rows(spark, sf):
    f = features.price_features(features.session_flags(_session(features.time_features(bars(spark, sf)))), w())
    f = f.withColumn("future", W.forward_return("close", 5, w())).withColumn("label", S.three_way(F.col("future"), 0.25).cast("int"))
    return f.fillna(0.0, ["ret_1", "ret_5", "abs_ret_1", "range_pct", "rv_10", "rv_30", "rv_60", "rv_ratio_10_60", "mom_5"])


def _scaled_rows(spark, sf, wanted: list[str]) -> tuple[DataFrame, list[str]]:
    """Rows of all splits with inputs standardised by the training split's scaler, in
    its order."""
    rows = written(features.regime(_model_rows(spark, sf), KEY, "ts"), "model-rows")  # several passes follow
    rows = splits.fixed_split(rows, TRAIN_END, VAL_END, 15, KEY, "ts")
    scaler = splits.scaler(rows.filter("split = 'train'").withColumn("all_", F.lit(1)), wanted, ["all_"])
    names = [f"x{i}" for i in range(len(wanted))]
    return ml.scaled(rows, scaler, wanted).withColumns({n: F.get("x", F.lit(i)) for i, n in enumerate(names)}), names


@query
def logistic_signals(spark, sf):
    rows, names = _scaled_rows(spark, sf, LR_FEATURES)
    model, inputs = ml.fit_logistic(rows.filter("split = 'train'"), names, "label")
    return ml.predict(model, inputs, rows, names).select("pair", "ts", "split", "signal")


@query
def network_signals(spark, sf):
    net = ml.TwoBranchNetwork(len(SHORT_FEATURES), len(LONG_FEATURES))
    wanted = [*SHORT_FEATURES, *[c for c in LONG_FEATURES if c not in SHORT_FEATURES]]
    rows, names = _scaled_rows(spark, sf, wanted)
    named = rows.withColumns({c: F.col(x) for c, x in zip(wanted, names, strict=True)})
    return ml.network_signals(named, net, SHORT_FEATURES, LONG_FEATURES, SESSION_FEATURES, KEY, "ts").select("pair", "ts", "signal")


@query
def network_training(spark, sf):
    """Losses per epoch of a small network over the training split."""
    from tidemark.operators import training

    wanted = [*SHORT_FEATURES, *[c for c in LONG_FEATURES if c not in SHORT_FEATURES]]
    rows, names = _scaled_rows(spark, sf, wanted)
    rows = rows.withColumns({c: F.col(x) for c, x in zip(wanted, names, strict=True)})
    sides = [rows.filter(F.col("split") == s) for s in ("train", "val")]
    _, told = training.train(*sides, SHORT_FEATURES, LONG_FEATURES, SESSION_FEATURES, "label", KEY, "ts", hidden=8, epochs=4, steps=2)
    out = spark.createDataFrame([(t["epoch"], t["train_loss"], t["val_loss"], t["best"]) for t in told], "epoch int, train_loss double, val_loss double, best boolean")
    return out.select("epoch", F.round("train_loss", 4).alias("train_loss"), F.round("val_loss", 4).alias("val_loss"), "best")


@query
def sequence_windows(spark, sf):
    s = ml.sequences(bars(spark, sf), ["close"], 15, KEY, "ts")
    return s.select("pair", "ts", F.size("seq").alias("steps"), r6(F.aggregate(F.flatten("seq"), F.lit(0.0), lambda a, x: a + x)).alias("total"))


def _session_windows(spark, sf, step: str | None) -> DataFrame:
    """The last three closes before each bar of a session set, as text."""
    rows = _session(features.time_features(bars(spark, sf)))
    s = ml.session_sequences(rows, ["close"], 3, KEY, "ts", ["London", "Overlap"], step=step)
    texts = F.transform(F.flatten("seq"), lambda x: F.round(x.cast("double") * 100).cast("long").cast("string"))
    return s.select("pair", "ts", F.array_join(texts, ",").alias("closes"))


@query
def session_windows(spark, sf):
    """Windows go on over the hours that the session leaves out."""
    return _session_windows(spark, sf, None)


@query
def gap_aware_windows(spark, sf):
    """No window crosses an hour that is not there."""
    return _session_windows(spark, sf, "1 hour")


# -- whole runs (rows only) ---------------------------------------------------------


@query
def run_backtest(spark, sf):
    from tidemark.plans import master

    # event values are no prices: their curves compound to sums that are compared in curve_metrics
    b, signals = bars(spark, sf), strategies.momentum(24)
    out = master.run_backtest(b, signals, "ts", 0.5, 20.0, 10.0, 24, session="london", direction="long_only", start="2024-01-03", end="2024-01-28")
    exact = ["pair", "status", "n_trades", "n_long", "n_short", "n_flat"]
    return out["metrics"].select(*exact, *[F.round(c, 4).alias(c) for c in ("net_sharpe", "sortino", "gross_sharpe", "win_rate", "profit_factor", "avg_trade_bars", "turnover")])


SMALL_SET = {
    "MA_5_20": strategies.ma_crossover(5, 20, "sma", 6), "Momentum_24": strategies.momentum(24, 6),
    "Donchian_20": strategies.donchian(20, 6), "BB_20": strategies.bollinger(20, 2.0, 6), "RSI_14": strategies.rsi_reversion(14, 40, 60, 6),
}


def _sweep(spark, sf, sessions: list, directions: list) -> DataFrame:
    """Runs of all registered strategies with their warm-up, family and ordinal."""
    from tidemark.plans import master

    registry = strategies.REGISTRY
    rows = [(n, s.family, k, s.warmup) for k, (n, s) in enumerate(registry.items())]
    known = F.broadcast(spark.createDataFrame(rows, "strategy string, family string, ordinal int, warmup int"))
    b = bars(spark, sf)
    s = master.all_signals(b, registry)
    runs = b.select("pair").distinct().crossJoin(F.broadcast(known.select("strategy", "warmup")))  # a grid
    specs = master._specs(runs, 0.5, 24, session=sessions, direction=directions)
    return backtest.run_variants(s, ["pair", "strategy"], "ts", specs, CONFIG.annualisation).drop("warmup").join(known, "strategy")


@query
def variant_sweep(spark, sf):
    """Signals once per strategy, all session and direction variants inside the fold."""
    out = _sweep(spark, sf, [None, "london", "ny"], list(backtest.DIRECTIONS))
    exact = ["pair", "strategy", "session", "direction", "n_trades", "n_long", "n_short", "n_flat", "status"]
    return out.select(*exact, F.round("net_sharpe", 4).alias("net_sharpe"), F.round("avg_trade_bars", 6).alias("avg_trade_bars"))


@query
def tier1_survivors(spark, sf):
    """What passes the first tier of the selection."""
    return evaluate.tier1_survivors(_sweep(spark, sf, [None], ["both"]))


@query
def tier4_ranking(spark, sf):
    """Walk-forward: every fold counts, those too short for the warm-up with zeros."""
    from tidemark.plans import master

    registry = {f"Momentum_{n}": strategies.momentum(n) for n in (12, 24, 120, 240)}
    parts = splits.folds(bars(spark, sf), FOLDS, 15, KEY, "ts").filter("kind = 'train'")
    s = master.all_signals(parts, registry, "ts", ["pair", "fold"])
    rows = [(n, x.warmup, k) for n, x in registry.items() for k in range(len(FOLDS))]
    grid = spark.createDataFrame(rows, "strategy string, warmup int, fold int")
    specs = master._specs(parts.select("pair").distinct().crossJoin(F.broadcast(grid)), 0.5, 24)
    runs = backtest.run_variants(s, ["pair", "strategy", "fold"], "ts", specs, CONFIG.annualisation, always=True)
    folded = evaluate.fold_aggregate(runs.filter(evaluate.ok(F.col("status"))), ["pair", "strategy"])
    return evaluate.final_rank(folded, 10, 3).select(
        "pair", "strategy", "n_trades", "negative_folds", F.round("fold_mean", 4).alias("fold_mean"), F.round("fold_std", 4).alias("fold_std"), "rank"
    )


@query
def flat_outcomes(spark, sf):
    """The flat table of a first tier's runs."""
    out = evaluate.flat_outcomes(_sweep(spark, sf, [None], ["both"]), "T1", "val")
    return out.select("tier", "pair", "strategy", "split", "direction", "ok", "status", "n_trades", "signal_long", "signal_short", "warning_flags")


@query
def stage_manifest(spark, sf):
    """Bars to splits as stages, run twice: what was made, and whether the second run
    found it."""
    from tidemark.plans import stages

    source = {"bars": written(bars(spark, sf), "bars")}
    plan = stages.preparation(18, TRAIN_END, VAL_END, 15, 0.25, 5)
    folder = fresh_folder(spark, "stages")
    _, first = stages.run(spark, plan, source, folder)
    _, second = stages.run(spark, plan, source, folder)
    again = second.select("stage", "pair", F.col("status").alias("second_run"))
    return first.select("stage", "pair", "status", "rows").join(again, ["stage", "pair"])


@query
def deterministic_sample(spark, sf):
    """A repeatable sample for reports."""
    digest = F.md5(F.col("o_orderkey").cast("string").cast("binary"))
    b = read(spark, sf, "orders").filter(F.substring(digest, 1, 2) == "00")
    return b.select("o_orderkey", "o_custkey")


@query
def sample_rows(spark, sf):
    """Exactly forty orders of each priority."""
    return numbering.exact_sample(read(spark, sf, "orders"), ["o_orderpriority"], ["o_orderkey"], n=40, seed=7).select("o_orderkey", "o_orderpriority")


@query
def sample_fraction(spark, sf):
    """One order line in a hundred of each return flag."""
    li = read(spark, sf, "lineitem")
    return numbering.exact_sample(li, ["l_returnflag"], ["l_orderkey", "l_linenumber"], fraction=0.01).select("l_orderkey", "l_linenumber", "l_returnflag")


@query
def numbered_rows(spark, sf):
    """Every order's place among those of its priority, by time."""
    o = read(spark, sf, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority")
    return numbering.numbered(o, ["o_orderpriority"], ["o_orderdate", "o_orderkey"]).select("o_orderkey", "o_orderpriority", "position")


@query
def archive_round_trip(spark, sf):
    """Bars written as archives by instrument and year and read back."""
    b = bars(spark, sf).withColumn("volume", F.col("volume").cast("double"))
    folder = fresh_folder(spark, "archives")
    archives.write_archives(b.withColumns({"stamp": F.date_format("ts", "yyyyMMdd HHmmss"), "year": F.year("ts")}), folder)
    back = archives.read_archives(spark, folder)
    return back.select(
        "pair", F.to_timestamp("stamp", "yyyyMMdd HHmmss").alias("ts"), "open", "high", "low", "close", F.col("volume").cast("long").alias("volume"), "year"
    )


@query
def set_operations(spark, sf):
    o = read(spark, sf, "orders")
    a = o.filter("o_orderstatus = 'F'").select("o_custkey")
    b = o.filter("o_totalprice > 150000").select("o_custkey")
    parts = {"union_all": a.unionByName(b), "union": a.union(b).distinct(), "intersect": a.intersect(b), "except": a.subtract(b)}
    out = [df.agg(F.lit(n).alias("op"), F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("o_custkey"), F.lit(0)).alias("total")) for n, df in parts.items()]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


# -- summary tables and comparisons of a whole evaluation ---------------------------


@query
def run_summary(spark, sf):
    """Means, positive runs, best and worst run of every fold."""
    s = reports.run_summary(_fold_runs(spark, sf), ["fold"], ["pair", "strategy"])
    return s.withColumns({c: r6(c) for c in ("mean_sharpe", "mean_return", "mean_drawdown")})


@query
def strategy_table(spark, sf):
    """All five columns; names without runs have zeros."""
    names = read(spark, sf, "part").select(F.concat(F.lit("S"), F.col("p_partkey") % 9).alias("strategy")).distinct()
    t = reports.strategy_table(_fold_runs(spark, sf), names)
    return t.withColumns({c: r6(c) for c in ("mean_sharpe", "mean_return", "mean_dd", "mean_trades")})


@query
def family_table(spark, sf):
    """The registry's families over its strategies' runs."""
    runs = _sweep(spark, sf, [None], ["both"])
    t = reports.family_table(runs.filter(evaluate.ok(F.col("status"))))
    return t.withColumns({c: F.round(c, 4) for c in ("mean_sharpe", "mean_sortino")})


@query
def report_meta(spark, sf):
    m = reports.report_meta(_fold_runs(spark, sf), ["fold"])
    return m.withColumns({c: F.array_join(c, ",") for c in ("pairs", "strategies")})


NAMED = ["pair", "strategy", "session", "direction"]


@query
def ranked_results(spark, sf):
    """Every run with its place by score."""
    s = scored_outcomes(spark, sf).withColumns({"composite": r6("composite"), "session": F.coalesce("session", F.lit("-"))})
    return reports.ranked(s, "composite", NAMED).select(*NAMED, "composite", "rank")


@query
def top_results(spark, sf):
    """The fifty best runs."""
    s = scored_outcomes(spark, sf).withColumns({"composite": r6("composite"), "session": F.coalesce("session", F.lit("-"))})
    return reports.top(s, "composite", NAMED, 50).select(*NAMED, "composite", "rank")


@query
def session_shares(spark, sf):
    s = splits.fixed_split(_labelled(spark, sf), TRAIN_END, VAL_END, 15, KEY, "ts")
    return reports.shares(s, ["pair", "split"], "session", {"Asia": "asia_pct", "London": "london_pct", "Overlap": "overlap_pct", "New_York": "ny_pct"})


@query
def prediction_histogram(spark, sf):
    l = _labelled(spark, sf).filter("label is not null")
    pred = F.coalesce(S.three_way(W.simple_return("close", 5, w()), 0.25).cast("int"), F.lit(0))
    return reports.prediction_histogram(l.withColumn("pred", -pred), KEY, "label", "pred", [-1, 0, 1])


@query
def daily_range_correlation(spark, sf):
    c = eda.correlations(reports.daily_ranges(bars(spark, sf), PAIRS), PAIRS)
    return c.select("a", "b", r6("corr").alias("corr"))


@query
def legacy_selection(spark, sf):
    """Survivors, their best instruments, and the ranking over folds."""
    li = read(spark, sf, "lineitem").select(
        F.concat(F.lit("P"), F.col("l_suppkey") % 5).alias("pair"),
        F.concat(F.lit("S"), F.lpad((F.col("l_partkey") % 13).cast("string"), 2, "0")).alias("strategy"),
        (F.col("l_orderkey") % 5).cast("int").alias("fold"), "l_quantity",
    )
    runs = li.groupBy("strategy", "pair", "fold").agg(F.round(F.avg("l_quantity") - 25.3, 4).alias("net_sharpe"))
    out = reports.legacy_selection(scored_outcomes(spark, sf), runs, ["session", "direction"], -0.2, most_negative=3)
    return out.select("rank", "strategy", "pair", "session", "direction", "fold_mean", "fold_std", "negative_folds", "folds")


@query
def fold_outcomes(spark, sf):
    """Walk-forward with simulation and metrics of every fold."""
    from tidemark.plans import master

    registry = {f"Momentum_{n}": strategies.momentum(n) for n in (12, 24, 120, 240)}
    f = master.fold_outcomes(bars(spark, sf), registry, FOLDS, 0.5, 24)
    return f.select("pair", "strategy", "fold", "n_trades", "n_long", "n_short", *[F.round(c, 4).alias(c) for c in ("net_sharpe", "avg_trade_bars")])


def priced(spark, sf) -> DataFrame:
    """Bars whose close walks like a price: from 100 by thousandths that the values set."""
    step = (F.floor(F.col("close") * 100) % 101).cast("long") - 50
    return bars(spark, sf).withColumn("close", 100 + F.sum(step).over(W.so_far(w())) / F.lit(1000.0))


PRICED = {"spread": 0.01, "take": 0.2, "stop": 0.15, "max_hold": 48}


@query
def priced_backtest(spark, sf):
    """All metrics of a back-test over a price-like series."""
    from tidemark.plans import master

    p = PRICED
    m = master.run_backtest(priced(spark, sf), strategies.momentum(24), "ts", p["spread"], p["take"], p["stop"], p["max_hold"])["metrics"]
    exact = ["pair", "status", "n_trades", "n_long", "n_short", "n_flat"]
    return m.select(
        *exact, *[F.round(c, 4).alias(c) for c in ("net_sharpe", "sortino", "gross_sharpe", "win_rate", "profit_factor", "avg_trade_bars", "turnover", "calmar")],
        *[r6(c).alias(c) for c in ("total_return", "max_drawdown")], F.round("capital_final", 2).alias("capital_final"),
    )


@query
def trade_curves(spark, sf):
    """Equity, dollars and bar returns of every bar of that back-test."""
    s = strategies.momentum(24).generate(priced(spark, sf), KEY)
    p = backtest.with_position(s.withColumn("signal", F.col("signal").cast("int")), "signal", KEY, "ts")
    c = backtest.run_curves(p, KEY, "ts", PRICED | {"capital": 10_000.0})
    return c.select("pair", "ts", r6("equity").alias("equity"), F.round(F.col("equity") * 10_000, 3).alias("dollars"), (r6("bar_return") + 0.0).alias("bar_return"))  # no -0.0


@query
def trade_dollars(spark, sf):
    """What each trade of that back-test gained."""
    s = strategies.momentum(24).generate(priced(spark, sf), KEY)
    p = backtest.with_position(s.withColumn("signal", F.col("signal").cast("int")), "signal", KEY, "ts")
    t = backtest.run_trades(p, KEY, "ts", [PRICED], capital=10_000.0)
    off_ties = lambda c, n: F.round(F.col(c) + 1e-9, n).alias(c)
    return t.select("pair", "entry_bar", "exit_bar", "exit_reason", off_ties("pnl_pct", 5), off_ties("pnl_dollars", 3))


RULES = {f"Rule_{n}": n for n in (6, 12, 24)}
MODELS = {"LR_global": 8, "LR_london": 10, "LSTM_global": 16, "LSTM_asia": 20, "LSTM_ny": 12}


def _split_signals(spark, sf, part: str, lookbacks: dict[str, int]) -> tuple[DataFrame, DataFrame]:
    """Bars of a split with their session, and the signals of rules that stand for models."""
    from tidemark.plans import master

    b = splits.fixed_split(_session(bars(spark, sf)), TRAIN_END, VAL_END, 15, KEY, "ts").filter(F.col("split") == part)
    s = master.all_signals(b, {k: strategies.momentum(n) for k, n in lookbacks.items()})
    return b, s.join(b.select("pair", "ts", "session"), ["pair", "ts"])


@query
def comparison_set(spark, sf):
    """All comparisons of an evaluation; runs are scored by their mean return."""
    from tidemark.plans import comparison

    val_bars, val = _split_signals(spark, sf, "val", RULES)
    test_bars, test = _split_signals(spark, sf, "test", MODELS)
    score = [F.round(F.avg("value"), 6).alias("composite"), F.count(F.lit(1)).alias("n_trades"), F.lit(True).alias("ok")]
    rules = comparison.bar_returns(val).groupBy("pair", "strategy").agg(*score)
    by = comparison.by_session(comparison.bar_returns(test)).groupBy("pair", "strategy", "eval_session").agg(*score)
    models = by.withColumns({"train_session": F.substring_index("strategy", "_", -1), "spread_mult": F.lit(1.0)})
    out = comparison.comparison_set(rules, models, val, test, val_bars, test_bars)
    return out.select("pair", "comparison", "strategy_a", "strategy_b", "n", "stat")


@query
def model_evaluation(spark, sf):
    """Models within their own session at three spreads."""
    from tidemark.plans import comparison

    _, test = _split_signals(spark, sf, "test", MODELS)
    m = comparison.model_evaluation(test, spread=0.5)
    return m.select("pair", "strategy", "spread_multiplier", "n_trades", "status", *[F.round(c, 4).alias(c) for c in ("net_sharpe", "win_rate")])


@query
def model_test(spark, sf):
    """One model against another on price differences."""
    from tidemark.plans import comparison

    t = comparison.model_test(_split_signals(spark, sf, "test", MODELS)[1])
    return t.select("pair", "comparison", "n", "stat")
