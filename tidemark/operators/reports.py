"""Summary tables over run outcomes, and the rules of the older selection.

Outcomes hold one row per run.  All tables here are one aggregate, or an aggregate of an
aggregate; ties go to the smallest name.  Runs without a Sharpe ratio count nowhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import evaluate
from tidemark.operators.numbering import numbered


def _first(what: Column, *order: Column) -> Column:
    return F.min_by(what, F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)]))


def run_summary(runs: DataFrame, keys: list[str], name: list[str]) -> DataFrame:
    """Per group the number of runs, means of Sharpe, return and drawdown, how many runs do
    not lose, and the best and the worst run by Sharpe with its name and return."""
    have = runs.filter(F.col("net_sharpe").isNotNull())
    who = F.struct(*name, "net_sharpe", "total_return")
    names = [F.col(c) for c in name]
    out = have.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("runs"),
        F.avg("net_sharpe").alias("mean_sharpe"),
        F.avg("total_return").alias("mean_return"),
        F.avg("max_drawdown").alias("mean_drawdown"),
        F.count_if(F.col("net_sharpe") >= 0).alias("positive_runs"),
        _first(who, -F.col("net_sharpe"), *names).alias("best"),
        _first(who, F.col("net_sharpe"), *names).alias("worst"),
    )
    fields = {"net_sharpe": "sharpe", "total_return": "return"}
    picked = [F.col(f"{s}.{c}").alias(f"{s}_{fields.get(c, c)}") for s in ("best", "worst") for c in (*name, *fields)]
    return out.select(*keys, "runs", "mean_sharpe", "mean_return", "mean_drawdown", "positive_runs", *picked)


def strategy_table(runs: DataFrame, names: DataFrame) -> DataFrame:
    """Runs and means of Sharpe, return, drawdown and trades of every strategy in ``names``
    (one column ``strategy``); zeros for those without a run."""
    means = {"net_sharpe": "mean_sharpe", "total_return": "mean_return", "max_drawdown": "mean_dd", "n_trades": "mean_trades"}
    have = runs.filter(F.col("net_sharpe").isNotNull())
    by = have.groupBy("strategy").agg(F.count(F.lit(1)).alias("runs"), *[F.avg(c).alias(n) for c, n in means.items()])
    return names.select("strategy").distinct().join(by, "strategy", "left").fillna(0, ["runs", *means.values()])


def family_table(runs: DataFrame) -> DataFrame:
    """Means of Sharpe and Sortino over a family's runs, and the instruments with the best
    and the worst mean Sharpe (to six places)."""
    have = runs.filter(F.col("net_sharpe").isNotNull())
    by_pair = have.groupBy("family", "pair").agg(
        F.count(F.lit(1)).alias("n"), F.sum("net_sharpe").alias("s"), F.sum("sortino").alias("o")
    )
    mean = F.round(F.col("s") / F.col("n"), 6)
    return by_pair.groupBy("family").agg(
        F.sum("n").alias("runs"),
        (F.sum("s") / F.sum("n")).alias("mean_sharpe"),
        (F.sum("o") / F.sum("n")).alias("mean_sortino"),
        _first(F.col("pair"), -mean, F.col("pair")).alias("best_pair"),
        _first(F.col("pair"), mean, F.col("pair")).alias("worst_pair"),
    )


def report_meta(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Sorted distinct instruments and strategies, and the mean of the final capitals
    above 0 (null if there is none).  Lists hold names of a registry, not of rows."""
    good = F.when(F.col("capital_final") > 0, F.col("capital_final"))
    return runs.groupBy(*keys).agg(
        F.sort_array(F.collect_set("pair")).alias("pairs"),
        F.sort_array(F.collect_set("strategy")).alias("strategies"),
        F.round(F.avg(good), 2).alias("capital_final_avg"),
    )


def ranked(runs: DataFrame, score: str, name: list[str]) -> DataFrame:
    """All runs with their ``rank`` by ``score``, highest first, ties by ``name``, from 1;
    numbered over ranges, without one window over all rows.  Null scores come last."""
    falling = F.coalesce(-F.col(score), F.lit(float("inf")))
    out = numbered(runs.withColumn("falling_", falling), [], ["falling_", *name], "rank")
    return out.withColumn("rank", F.col("rank") + 1).drop("falling_")


def top(runs: DataFrame, score: str, name: list[str], n: int) -> DataFrame:
    """The ``n`` best runs with their rank; each task keeps n rows at most."""
    few = runs.filter(F.col(score).isNotNull()).orderBy(F.desc(score), *name).limit(n)
    return few.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(score), *name)))


def shares(df: DataFrame, keys: list[str], of: str, values: dict[str, str]) -> DataFrame:
    """Per group the share of rows, in per cent to two places, that have each of
    ``values`` (value: column name) in ``of``; a null counts as a row with none."""
    hit = lambda v: F.coalesce(F.col(of) == v, F.lit(False)).cast("double")
    return df.groupBy(*keys).agg(*[F.round(F.avg(hit(v)) * 100, 2).alias(n) for v, n in values.items()])


def prediction_histogram(df: DataFrame, keys: list[str], y: str, pred: str, classes: list[int]) -> DataFrame:
    """One row per group and class: rows that have it, rows predicted as it, and hits;
    a class that never occurs has zeros."""
    of = F.explode(F.array(*map(F.lit, classes))).alias("class")
    had, said = F.col(y) == F.col("class"), F.col(pred) == F.col("class")
    cells = df.groupBy(*keys, y, pred).agg(F.count(F.lit(1)).alias("n")).select("*", of)
    count = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    return cells.groupBy(*keys, "class").agg(count(had).alias("actual"), count(said).alias("predicted"), count(had & said).alias("hits"))


def daily_ranges(df: DataFrame, names: list[str], ts: str = "ts") -> DataFrame:
    """Mean of high - low per day, a column per instrument; only days that every
    instrument has."""
    reach = F.col("high") - F.col("low")
    by_day = df.groupBy(F.to_date(ts).alias("day"), "pair").agg(F.avg(reach).alias("m"))
    wide = by_day.groupBy("day").agg(*[F.max(F.when(F.col("pair") == p, F.col("m"))).alias(p) for p in names])
    return wide.dropna(subset=names)


# -- the older selection ------------------------------------------------------------


def legacy_survivors(runs: DataFrame, least: float = 0.0, most: int = 8) -> DataFrame:
    """The ``most`` strategies with the highest mean Sharpe above ``least``."""
    by = runs.groupBy("strategy").agg(F.round(F.avg("net_sharpe"), 6).alias("mean"))
    return by.filter(F.col("mean") > least).orderBy(F.desc("mean"), "strategy").limit(most).select("strategy")


def legacy_places(runs: DataFrame, settings: list[str], most: int = 3) -> DataFrame:
    """Per strategy its best settings on each of its ``most`` best instruments by Sharpe."""
    best = evaluate.best(runs, ["strategy", "pair"], "net_sharpe", settings)
    w = Window.partitionBy("strategy").orderBy(F.desc("net_sharpe"), "pair")
    return best.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= most)


def legacy_rank(folds: DataFrame, most_negative: int = 2, most_spread: float = 1.5, n: int = 10) -> DataFrame:
    """Of outcomes per fold, the ``n`` best (strategy, pair) by mean over folds, then by
    the smaller deviation over folds; those with over ``most_negative`` folds below 0 or a
    deviation over ``most_spread`` go."""
    by = folds.groupBy("strategy", "pair").agg(
        F.round(F.avg("net_sharpe"), 6).alias("fold_mean"),
        F.round(F.stddev_pop("net_sharpe"), 6).alias("fold_std"),
        F.count_if(F.col("net_sharpe") < 0).alias("negative_folds"),
        F.count(F.lit(1)).alias("folds"),
    )
    stable = by.filter((F.col("negative_folds") <= most_negative) & (F.col("fold_std") <= most_spread))
    order = [F.desc("fold_mean"), "fold_std", "strategy", "pair"]
    return stable.orderBy(*order).limit(n).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def legacy_selection(runs: DataFrame, folds: DataFrame, settings: list[str], least: float = 0.0, **limits) -> DataFrame:
    """Survivors by mean, their best instruments, and the final ranking by folds."""
    places = legacy_places(runs.join(F.broadcast(legacy_survivors(runs, least)), "strategy"), settings)
    chosen = places.select("strategy", "pair", *settings)
    return legacy_rank(folds.join(chosen.select("strategy", "pair"), ["strategy", "pair"]), **limits).join(chosen, ["strategy", "pair"])
