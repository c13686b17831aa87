"""Selection and comparison over run outcomes.

Outcomes are a small relational table (one row per run).  Every ranking carries an
explicit tie-break, so results do not depend on the order runs finish in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.operators.numbering import numbered


def grid(spark: SparkSession, **axes: list) -> DataFrame:
    """Cross product of configuration axes (tens to thousands of rows)."""
    out = None
    for name, values in axes.items():
        kinds = {type(v) for v in values if v is not None}
        kind = {int: "long", float: "double", str: "string"}[kinds.pop() if len(kinds) == 1 else float]
        one = spark.createDataFrame([(v,) for v in values], f"{name} {kind}")
        out = one if out is None else out.crossJoin(F.broadcast(one))
    return out


def top_fraction(df: DataFrame, group: str, score: str, tie: str, share: float, floor: float) -> DataFrame:
    """Per group, of rows above ``floor`` the best max(1, floor(share * n))."""
    good = df.filter(F.col(score) > floor)
    w = Window.partitionBy(group)
    rank = F.row_number().over(w.orderBy(F.desc(score), tie))
    size = F.greatest(F.lit(1), F.floor(share * F.count(F.lit(1)).over(w)))
    return good.withColumns({"r_": rank, "m_": size}).filter("r_ <= m_").drop("r_", "m_")


def family_floor(kept: DataFrame, df: DataFrame, group: str, family: str, score: str, tie: str) -> DataFrame:
    """``kept`` plus, for each family that it lacks in a group, that family's best."""
    lacking = df.join(kept.select(group, family).distinct(), [group, family], "left_anti")
    return kept.unionByName(best(lacking, [group, family], score, [tie]))


def best(df: DataFrame, keys: list[str], score: str, tie: list[str]) -> DataFrame:
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(score), *tie))
    return df.withColumn("n_", n).filter("n_ = 1").drop("n_")


def beats_baseline(tuned: DataFrame, base: DataFrame, keys: list[str], score: str) -> DataFrame:
    """Baseline rows with the tuned settings where those score strictly more; keys may
    hold nulls."""
    a, b = base.alias("a"), tuned.alias("b")
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    better = F.coalesce(F.col(f"b.{score}") > F.col(f"a.{score}"), F.lit(False))
    return a.join(b, same, "left").select(
        *[F.col(f"a.{k}") for k in keys],
        F.when(better, F.col(f"b.{score}")).otherwise(F.col(f"a.{score}")).alias(score),
        better.alias("tuned"),
    )


FOLD_MEANS = ("total_return", "max_drawdown", "calmar", "win_rate", "profit_factor", "avg_trade_bars", "turnover", "sortino")
FOLD_LAST = ("capital_final", "gross_sharpe", "n_long", "n_short", "n_flat")


def fold_aggregate(df: DataFrame, keys: list[str]) -> DataFrame:
    """Means over folds, trades in all, spread of Sharpe; what the last fold ended with
    (capital, gross Sharpe, signals).  Columns that ``df`` lacks are left out."""
    means = [c for c in FOLD_MEANS if c in df.columns]
    last = [c for c in FOLD_LAST if c in df.columns]
    out = df.groupBy(*keys).agg(
        F.avg("net_sharpe").alias("fold_mean"),
        F.stddev_pop("net_sharpe").alias("fold_std"),
        F.sum("n_trades").alias("n_trades"),
        F.count_if(F.col("net_sharpe") < 0).alias("negative_folds"),
        *[F.avg(c).alias(c) for c in means],
        *[F.max_by(c, "fold").alias(c) for c in last],
    )
    return out.withColumn("stability", F.round(F.col("fold_mean") - 0.5 * F.col("fold_std"), 4))


def final_rank(folded: DataFrame, least_trades: int = 10, most_negative: int = 2) -> DataFrame:
    ok = folded.filter((F.col("n_trades") >= least_trades) & (F.col("negative_folds") <= most_negative))
    keys = [c for c in ("pair", "strategy", "session", "direction") if c in folded.columns]
    return ok.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("stability"), *keys)))


def transfer_matrix(df: DataFrame, names: list[str]) -> DataFrame:
    """train_session by eval_session at spread multiple 1; all four rows appear."""
    spark = df.sparkSession
    at_one = df.filter(F.abs(F.col("spread_mult") - 1) < 0.01)
    wide = at_one.groupBy("train_session").pivot("eval_session", names).agg(F.avg("net_sharpe"))
    rows = spark.createDataFrame([(n,) for n in names], "train_session string")
    return rows.join(wide, "train_session", "left")


def generalisability(df: DataFrame) -> DataFrame:
    """Per training session: in-domain value, mean of the others, and the gap."""
    inside = F.col("train_session") == F.col("eval_session")
    out = df.groupBy("train_session").agg(
        F.avg(F.when(inside, F.col("net_sharpe"))).alias("in_domain"),
        F.avg(F.when(~inside, F.col("net_sharpe"))).alias("out_of_domain"),
        F.count(F.when(~inside, F.col("net_sharpe"))).alias("n_out"),
    )
    return out.withColumn("gap", F.col("in_domain") - F.col("out_of_domain"))


def breakeven(df: DataFrame, keys: list[str], mult: str = "spread_mult", value: str = "net_sharpe") -> DataFrame:
    """Spread multiple at which the value crosses 0 first, as text; series of one
    point are left out."""
    w = Window.partitionBy(*keys).orderBy(mult)
    d = df.withColumns({"m2_": F.lead(mult).over(w), "v2_": F.lead(value).over(w)})
    v, v2, m, m2 = F.col(value), F.col("v2_"), F.col(mult), F.col("m2_")
    crosses = v * v2 <= 0  # two zeros in a row: at the first of them
    zero = F.round(m - v * (m2 - m) / F.when(v2 == v, F.lit(1.0)).otherwise(v2 - v), 2)
    out = d.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("points"),
        F.min_by(F.when(crosses, zero), F.when(crosses, m)).alias("zero"),
        F.min(value).alias("low"),
        F.max(F.when(F.abs(m - 1) < 0.01, v)).alias("at_one"),
    )
    text = F.when(F.col("zero").isNotNull(), F.format_string("%.2f", F.col("zero"))).when(F.col("low") >= 0, ">2.0").otherwise("<0.5")
    return out.filter("points >= 2").select(*keys, text.alias("breakeven"), "at_one")


def dm_statistics(df: DataFrame, keys: list[str], a: str, b: str, lag: int = 0, order: str | None = None) -> DataFrame:
    """Loss-differential means and variances; ``lag`` > 0 adds Bartlett-weighted
    autocovariances in the order of ``order``."""
    d = df.withColumn("d_", F.col(a) - F.col(b))
    if not lag:
        out = d.groupBy(*keys).agg(F.count("d_").alias("n"), F.avg("d_").alias("mean"), F.var_samp("d_").alias("var"))
    else:
        w = Window.partitionBy(*keys).orderBy(order)
        m = d.groupBy(*keys).agg(F.avg("d_").alias("mean"))
        c = d.join(m, keys).withColumn("c_", F.col("d_") - F.col("mean"))
        c = c.withColumns({f"l{k}_": F.lag("c_", k).over(w) for k in range(1, lag + 1)})
        var = F.var_samp("c_")
        for k in range(1, lag + 1):
            var = var + 2 * (1 - k / (lag + 1)) * F.sum(F.col("c_") * F.col(f"l{k}_")) / (F.count("c_") - 1)
        out = c.groupBy(*keys).agg(F.count("c_").alias("n"), F.first("mean").alias("mean"), var.alias("var"))
    usable = (F.col("n") >= 10) & (F.col("var") > 0)
    return out.withColumn("stat", F.when(usable, F.round(F.col("mean") / F.sqrt(F.col("var") / F.col("n")), 4)))


def with_p_value(stats: DataFrame) -> DataFrame:
    """Two-sided p of Student's t with n - 1 degrees; 1 where there is no statistic."""
    out = stats.withColumn("p", F.round(S.t_two_sided(F.col("stat"), F.col("n") - 1), 4))
    return out.withColumn("significant", F.col("p") < 0.05)


def status(n_bars: Column, warmup: Column, n_signals: Column, n_trades: Column) -> Column:
    return (
        F.when(n_bars.isNull(), "MISSING_FILE")
        .when(n_bars == 0, "NO_DATA_IN_WINDOW")
        .when(warmup >= n_bars, "SKIP_WARMUP_GT_DATA")
        .when(n_signals == 0, "ZERO_SIGNALS")
        .when(n_trades == 0, "ZERO_TRADES")
        .otherwise("OK")
    )


def ok(state: Column) -> Column:
    """Whether a run counts as one: it ran, with trades or without."""
    return state.isin("OK", "ZERO_TRADES")


def tier1_survivors(outcomes: DataFrame, share: float = 0.4, least: float = 0.0) -> DataFrame:
    """(pair, strategy) that pass the first tier, from outcomes with family and ordinal:
    per pair the best ``share`` by mean Sharpe above ``least``, and the best of every
    family these lack.  Only runs that are ok take part."""
    keys = ["pair", "strategy", "family", "ordinal"]
    scores = outcomes.filter(ok(F.col("status"))).groupBy(*keys).agg(F.avg("net_sharpe").alias("score"))
    good, per, family = F.col("score") > least, Window.partitionBy("pair"), Window.partitionBy("pair", "family")
    best_first = [F.desc("score"), "ordinal"]
    rank = F.row_number().over(per.orderBy(F.desc(good), *best_first))  # good ones lead
    most = F.greatest(F.lit(1), F.floor(share * F.count_if(good).over(per)))
    of_family = F.row_number().over(family.orderBy(*best_first))
    ranked = scores.withColumns({"kept_": good & (rank <= most), "f_": of_family})
    there = F.max("kept_").over(family)
    return ranked.withColumn("there_", there).filter("kept_ OR (f_ = 1 AND NOT there_)").select("pair", "strategy")


def champions(outcomes: DataFrame, keys: list[str], place: str, score: str, tie: list[str]) -> DataFrame:
    """Champion and runner-up per group: the two best rows with distinct ``place``."""
    per = best(outcomes, [*keys, place], score, tie)
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(score), place))
    return per.withColumn("rank", n).filter("rank <= 2")


def compared(returns: DataFrame, pairs: DataFrame, keys: list[str], name: str, ts: str, value: str, lag: int = 0, losses: bool = True) -> DataFrame:
    """Diebold-Mariano tests of the listed comparisons.

    ``returns``: one row per series (``keys``, ``name``) and time; ``pairs``: ``keys``,
    comparison, a and b, names of two series.  Losses are the negative returns, so the
    statistic is below 0 where a gains more; without ``losses`` returns are compared as
    they are.  Series are paired by time."""
    v = -F.col(value) if losses else F.col(value)
    loss = returns.select(*keys, F.col(name).alias("n_"), F.col(ts).alias("t_"), v.alias("v_"))
    left = pairs.join(loss.withColumnsRenamed({"n_": "a", "v_": "loss_a"}), [*keys, "a"])
    both = left.join(loss.withColumnsRenamed({"n_": "b", "v_": "loss_b"}), [*keys, "b", "t_"])
    of = [*keys, "comparison", "a", "b"]
    return with_p_value(dm_statistics(both, of, "loss_a", "loss_b", lag, "t_"))


def compared_by_position(returns: DataFrame, pairs: DataFrame, keys: list[str], name: str, ts: str, value: str, lag: int = 0) -> DataFrame:
    """The same tests with series paired by position: the first with the first and so on,
    the longer one cut to the shorter."""
    placed = numbered(returns.select(*keys, name, ts, value), [*keys, name], [ts], "position")
    return compared(placed, pairs, keys, name, "position", value, lag)


# The columns of a flat outcome table, in order.
OUTCOME = [
    "tier", "pair", "strategy", "split", "session", "direction", "tp_pips", "sl_pips", "folds", "eval_session",
    "spread_mult", "model_type", "train_session", "ok", "status", "net_sharpe", "gross_sharpe", "total_return",
    "max_drawdown", "calmar", "win_rate", "profit_factor", "avg_trade_bars", "turnover", "sortino", "n_trades",
    "capital_final", "signal_long", "signal_short", "signal_flat", "fold_mean_sharpe", "fold_std_sharpe",
    "negative_fold_count", "composite_score", "stability_score", "grade", "warning_flags", "notes", "error",
]
_TEXT = {"tier", "pair", "strategy", "split", "session", "direction", "eval_session", "model_type", "train_session", "status", "grade", "warning_flags", "notes", "error"}
_ZERO_WITHOUT_RUN = set(OUTCOME[15:36]) - _TEXT


def flat_outcomes(runs: DataFrame, tier: str, split: str) -> DataFrame:
    """Runs as the flat outcome table: what a run lacks is null, or 0 for a metric;
    score and grade are computed, warnings joined by commas."""
    names = {
        "tp": "tp_pips", "sl": "sl_pips", "n_long": "signal_long", "n_short": "signal_short", "n_flat": "signal_flat",
        "fold_mean": "fold_mean_sharpe", "fold_std": "fold_std_sharpe", "negative_folds": "negative_fold_count", "stability": "stability_score",
    }
    d = runs.withColumnsRenamed({k: v for k, v in names.items() if k in runs.columns})
    d = d.withColumns({"tier": F.lit(tier), "split": F.lit(split)})
    if "status" not in d.columns:
        d = d.withColumn("status", F.lit("OK"))
    d = d.withColumn("ok", ok(F.col("status")))
    for c in OUTCOME:
        if c not in d.columns:
            d = d.withColumn(c, F.lit(None).cast("string" if c in _TEXT else "double"))
    d = d.withColumns({c: F.coalesce(c, F.lit(0)) for c in _ZERO_WITHOUT_RUN})
    d = d.withColumns({"folds": F.coalesce("folds", F.lit(0)), "spread_mult": F.coalesce("spread_mult", F.lit(1.0))})
    score = S.composite_score(*[F.col(c) for c in ("n_trades", "net_sharpe", "sortino", "calmar", "max_drawdown")])
    d = d.withColumn("composite_score", F.when(F.col("ok"), score).otherwise(0.0))
    flags = F.array_compact(
        F.array(
            F.nullif(F.col("warning_flags"), F.lit("")),
            F.when(F.col("status") == "SKIP_WARMUP_GT_DATA", "WARMUP_GT_DATA"),
            F.when(F.col("status").isin("ZERO_SIGNALS", "ZERO_TRADES"), F.col("status")),
            F.when(F.col("ok") & (F.col("profit_factor") >= 998), "PF_CAPPED"),
        )
    )
    d = d.withColumns({"grade": S.grade(F.col("composite_score")), "warning_flags": F.array_join(flags, ",")})
    return d.select(*OUTCOME)


def spec_flags(tp: Column, sl: Column, spread: Column) -> Column:
    return F.array_compact(
        F.array(
            F.when(tp.isNull() != sl.isNull(), "PARTIAL_TP_SL"),
            F.when(tp <= spread, "TP_LE_SPREAD"),
            F.when(sl <= spread, "SL_LE_SPREAD"),
        )
    )


def classification_report(df: DataFrame, keys: list[str], y: str, pred: str) -> DataFrame:
    """Accuracy and macro F1 (a class without hits counts 0)."""
    cells = df.groupBy(*keys, y, pred).agg(F.count(F.lit(1)).alias("n"))
    hits = F.when(F.col(y) == F.col(pred), F.col("n")).otherwise(0)
    by_y = cells.groupBy(*keys, F.col(y).alias("c")).agg(F.sum(hits).alias("tp"), F.sum("n").alias("have"))
    by_p = cells.groupBy(*keys, F.col(pred).alias("c")).agg(F.sum("n").alias("said"))
    f1 = by_y.join(by_p, [*keys, "c"], "full").fillna(0, ["tp", "have", "said"])
    f1 = f1.withColumn("f1", 2 * F.col("tp") / (F.col("have") + F.col("said")))
    return f1.groupBy(*keys).agg(
        F.sum("have").alias("n"), (F.sum("tp") / F.sum("have")).alias("accuracy"), F.avg("f1").alias("macro_f1")
    )


def class_weights(df: DataFrame, keys: list[str], y: str, classes: int = 3) -> DataFrame:
    n = df.groupBy(*keys, y).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(*keys))
    return n.withColumn("weight", total / (classes * F.col("n") + 1e-8))
