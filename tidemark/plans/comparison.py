"""Diebold-Mariano comparisons of a whole evaluation, and models evaluated alone.

Outcomes are small tables, a row per run; signals are long ones.  Picks are made on the
outcomes, and only the series picked are paired.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import SESSION_SETS, Config
from tidemark.functions import scalars as S
from tidemark.functions import windows as W
from tidemark.operators import backtest, evaluate

SESSIONS = ["global", *SESSION_SETS]
HOLD = "buy_and_hold"


def _next_return(df: DataFrame, keys: list[str], ts: str) -> DataFrame:
    """``df`` with ``move``, the return to the next bar, less each series' last bar; from
    a price of 0 the move itself."""
    w = Window.partitionBy(*keys).orderBy(ts)
    later, price = F.lead("close").over(w), F.col("close")
    move = (later - price) / F.when(price == 0, F.lit(1.0)).otherwise(price)
    return df.withColumn("move", move).filter(F.col("move").isNotNull())


def bar_returns(signals: DataFrame, ts: str = "ts") -> DataFrame:
    """(pair, strategy, ts, session if given, value): the raw signal times the move to the
    next bar, without spread."""
    moved = _next_return(signals, ["pair", "strategy"], ts)
    kept = [c for c in ("pair", "strategy", ts, "session") if c in signals.columns]
    return moved.select(*kept, (F.col("signal") * F.col("move")).alias("value"))


def by_session(returns: DataFrame) -> DataFrame:
    """Returns of models, once per evaluation session; outside it they are 0."""
    name = F.explode(F.array(*map(F.lit, SESSIONS))).alias("eval_session")
    inside = F.col("eval_session") == "global"
    for n, labels in SESSION_SETS.items():
        inside |= (F.col("eval_session") == n) & F.coalesce(F.col("session").isin(labels), F.lit(False))
    return returns.select("*", name).withColumn("value", F.when(inside, F.col("value")).otherwise(0.0))


def _places(runs: DataFrame, score: str, *tie: str) -> DataFrame:
    """The two best rows of each instrument, with their ``place``."""
    w = Window.partitionBy("pair").orderBy(F.desc(score), *tie)
    return runs.withColumn("place", F.row_number().over(w)).filter("place <= 2")


def _listed(df: DataFrame, part: str, comparison: Column, a: Column, b: Column, strategy_a: Column, strategy_b: Column) -> DataFrame:
    return df.select(
        F.lit(part).alias("part"), "pair", comparison.alias("comparison"), a.alias("a"), b.alias("b"),
        strategy_a.alias("strategy_a"), strategy_b.alias("strategy_b"),
    )


def comparison_set(
    rules: DataFrame, models: DataFrame, val: DataFrame, test: DataFrame, val_bars: DataFrame, test_bars: DataFrame,
    score: str = "composite", least_trades: int = 10, ts: str = "ts",
) -> DataFrame:
    """All tests of an evaluation per instrument: (pair, comparison, strategy_a,
    strategy_b, n, stat, p, significant); ``stat`` is above 0 where a gains more.

    best_RB_vs_BAH            the best rule against holding, on validation bars
    best_ML_vs_BAH            the best model at its evaluation session, on test bars
    in_domain_X_vs_transfer   a model of session X within X against the mean of all runs
                              of models of X elsewhere, bar by bar
    RB_champion_vs_runner_up  the two best runs of rules, if they are of two strategies
    ML_champion_vs_runner_up  the two best of distinct strategy and evaluation session

    ``rules``: pair, strategy, ok, n_trades and ``score``; ``models`` also train_session,
    eval_session, spread_mult, of which those at 1 count.  ``val`` and ``test``: signals
    (pair, strategy, ts, close, signal), those of models with the bars' label session.
    Only runs that are ok, and outside the third kind have ``least_trades``, are picked;
    ties go to the smallest name, and of several models of X to the first by name."""
    good = F.col("ok") & (F.col("n_trades") >= least_trades)
    ran = models.filter(F.col("ok") & (F.abs(F.col("spread_mult") - 1) < 0.01))
    run = F.concat("strategy", F.lit("/eval="), "eval_session")
    rule = _places(rules.filter(good), score, "strategy")
    model = _places(evaluate.best(ran.filter(good), ["pair", "strategy", "eval_session"], score, ["n_trades"]).withColumn("run", run), score, "strategy", "eval_session")

    def two(places: DataFrame, name: str) -> DataFrame:
        at = lambda k: F.max(F.when(F.col("place") == k, F.col(name)))
        return places.groupBy("pair").agg(at(1).alias("one"), at(2).alias("two")).filter("one != two")

    one, second, hold = F.col("one"), F.col("two"), F.lit(HOLD)
    lists = [
        _listed(rule.filter("place = 1"), "val", F.lit("best_RB_vs_BAH"), F.col("strategy"), hold, F.col("strategy"), hold),
        _listed(model.filter("place = 1"), "test", F.lit("best_ML_vs_BAH"), F.col("run"), hold, F.col("strategy"), hold),
        _listed(two(rule, "strategy"), "val", F.lit("RB_champion_vs_runner_up"), one, second, one, second),
        _listed(two(model, "run"), "test", F.lit("ML_champion_vs_runner_up"), one, second, one, second),
    ]
    own = F.col("eval_session") == F.col("train_session")
    home = ran.filter(F.col("train_session").isin(list(SESSION_SETS)))
    both = home.groupBy("pair", "train_session").agg(F.min(F.when(own, run)).alias("run"), F.count_if(~own).alias("away")).filter("run is not null and away > 0")
    s = F.col("train_session")
    lists.append(
        _listed(both, "test", F.concat(F.lit("in_domain_"), s, F.lit("_vs_transfer")), F.col("run"), F.concat(F.lit("transfer/"), s),
                F.concat(F.lit("LR/LSTM_"), s, F.lit("_in_domain")), F.concat(F.lit("LR/LSTM_"), s, F.lit("_out_of_domain")))
    )
    pairs = lists[0]
    for x in lists[1:]:
        pairs = pairs.unionByName(x)

    told = [F.lit("val").alias("part"), "pair", F.col("strategy").alias("name"), ts, "value"]
    series = bar_returns(val, ts).select(*told)
    masked = by_session(bar_returns(test, ts))
    series = series.unionByName(masked.select(F.lit("test").alias("part"), "pair", run.alias("name"), ts, "value"))
    away = home.filter(~own).select("pair", "strategy", "train_session", "eval_session").distinct()
    mean = masked.join(F.broadcast(away), ["pair", "strategy", "eval_session"]).groupBy("pair", "train_session", ts).agg(F.avg("value").alias("value"))
    series = series.unionByName(mean.select(F.lit("test").alias("part"), "pair", F.concat(F.lit("transfer/"), s).alias("name"), ts, "value"))
    for part, bars in (("val", val_bars), ("test", test_bars)):
        held = _next_return(bars.select("pair", ts, "close"), ["pair"], ts)
        series = series.unionByName(held.select(F.lit(part).alias("part"), "pair", F.lit(HOLD).alias("name"), ts, F.col("move").alias("value")))
    tests = evaluate.compared(series, pairs.select("part", "pair", "comparison", "a", "b"), ["part", "pair"], "name", ts, "value", losses=False)
    names = pairs.select("part", "pair", "comparison", "strategy_a", "strategy_b")
    return tests.join(names, ["part", "pair", "comparison"]).select("pair", "comparison", "strategy_a", "strategy_b", "n", "stat", "p", "significant")


def own_session(signals: DataFrame) -> DataFrame:
    """Signals of models named kind_session, silenced outside the session they were
    trained on; ``global`` and unknown names are left as they are."""
    trained, masked = F.substring_index("strategy", "_", -1), F.col("signal")
    for n, labels in SESSION_SETS.items():
        out = (trained == n) & ~F.coalesce(F.col("session").isin(labels), F.lit(False))
        masked = F.when(out, 0).otherwise(masked)
    return signals.withColumn("signal", masked.cast("int"))


def model_evaluation(signals: DataFrame, spreads: tuple = (0.5, 1.0, 2.0), spread: float | None = None, ts: str = "ts", config: Config | None = None) -> DataFrame:
    """Models on test bars, each within its own session, at multiples of the spread: one
    row per (pair, strategy, spread_multiplier) with its metrics.  ``spread`` is in price
    units; None takes the instrument's usual one in pips.  A model without signals or
    trades has a row of zeros."""
    config, keys = config or Config(), ["pair", "strategy"]
    masked = own_session(signals)
    if spread is None:
        masked = masked.withColumn("close", F.col("close") / S.pip(F.col("pair")))
    usual = S.typical_spread(F.col("pair")) if spread is None else F.lit(float(spread))
    grid = evaluate.grid(signals.sparkSession, mult=list(spreads))
    specs = masked.select(*keys).distinct().crossJoin(F.broadcast(grid)).withColumn("spread", F.col("mult") * usual)
    empty = {"session": "string", "tp": "double", "sl": "double", "max_hold": "int", "warmup": "int"}
    specs = specs.withColumns({c: F.lit(None).cast(t) for c, t in empty.items()} | {"direction": F.lit("both")})
    out = backtest.run_variants(masked, keys, ts, specs, config.annualisation, config.capital, always=True)
    metrics = ["net_sharpe", "sortino", "max_drawdown", "calmar", "win_rate", "n_trades", "total_return"]
    return out.select(*keys, F.round(F.col("spread") / usual, 6).alias("spread_multiplier"), *metrics, "status")


def model_test(signals: DataFrame, a: str = "LSTM_global", b: str = "LR_global", ts: str = "ts") -> DataFrame:
    """Diebold-Mariano test of two models per instrument, on price differences times the
    position held within each model's session; instruments that lack one have no row."""
    keys = ["pair", "strategy"]
    held = backtest.with_position(own_session(signals).filter(F.col("strategy").isin(a, b)), "signal", keys, ts)
    w = Window.partitionBy(*keys).orderBy(ts)
    step = F.coalesce(F.col("close") - F.lag("close").over(w), F.lit(0.0))
    gains = held.withColumn("value", F.col("position") * step)
    pairs = gains.groupBy("pair").agg(F.lit(f"{a}_vs_{b}").alias("comparison"), F.lit(a).alias("a"), F.lit(b).alias("b"))
    return evaluate.compared(gains, pairs, ["pair"], "strategy", ts, "value", losses=False).drop("mean", "var")


def evaluation_tables(rules: DataFrame, models: DataFrame, tests: DataFrame, importance: DataFrame | None = None, score: str = "composite") -> dict[str, DataFrame]:
    """The small tables of a whole evaluation, ready for ``sinks.write_bundle``: results of
    rules, of models and of both by score; best and worst run per instrument; the matrix of
    sessions per kind of model; generalisability; break-even spreads; tests; and the
    weights of inputs, if given.

    ``rules`` and ``models`` as in ``comparison_set``, models with ``model_type``."""
    ran = models.filter("ok")
    both = rules.unionByName(models, allowMissingColumns=True)
    name = [c for c in ("pair", "strategy", "eval_session", "spread_mult", "session", "direction") if c in both.columns]
    order = lambda df: df.orderBy(F.desc(score), *[c for c in name if c in df.columns])
    run = F.struct(*[c for c in ("strategy", "eval_session") if c in both.columns], score)
    by = [F.struct(F.col(score), "strategy"), F.struct(-F.col(score), "strategy")]
    ends = both.filter("ok").groupBy("pair").agg(F.min_by(run, by[1]).alias("best"), F.min_by(run, by[0]).alias("worst"))
    ends = ends.select("pair", *[F.col(f"{e}.{c}").alias(f"{e}_{c}") for e in ("best", "worst") for c in ("strategy", score)]).orderBy("pair")
    at_one = ran.filter(F.abs(F.col("spread_mult") - 1) < 0.01)
    out = {"results_rule_based": order(rules), "results_ml": order(models), "results_all": order(both), "best_worst": ends}
    for kind in ("LR", "LSTM"):
        out[f"transfer_{kind.lower()}"] = evaluate.transfer_matrix(ran.filter(F.col("model_type") == kind), SESSIONS).orderBy("train_session")
    out["generalisability"] = evaluate.generalisability(at_one).orderBy("train_session")
    series = ran.groupBy("pair", "strategy", "eval_session", "spread_mult").agg(F.avg("net_sharpe").alias("net_sharpe"))
    out["breakeven"] = evaluate.breakeven(series, ["pair", "strategy", "eval_session"]).orderBy("pair", "strategy", "eval_session")
    out["dm_tests"] = tests.orderBy("pair", "comparison")
    return out if importance is None else out | {"feature_importance": importance}
