"""Whole evaluations: one back-test, and the tiered selection over a strategy set."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.config import Config
from tidemark.functions import scalars as S
from tidemark.operators import backtest, evaluate, splits
from tidemark.operators.strategies import REGISTRY, Strategy, signals_of
from tidemark.sources.bars import resample

KEYS = ["pair", "strategy"]


def all_signals(bars: DataFrame, registry: dict[str, Strategy], ts: str = "ts", keys: list[str] | None = None) -> DataFrame:
    """(keys, by default pair; strategy, family, ts, close, signal) of every strategy, from
    one pass over the bars."""
    keys = keys or ["pair"]
    names = {f"signal_{k}": s for k, s in enumerate(registry.values())}
    wide = signals_of(bars, names, keys, ts)
    rows = [
        F.struct(F.lit(n).alias("strategy"), F.lit(s.family).alias("family"), F.col(c).cast("int").alias("signal"))
        for (n, s), c in zip(registry.items(), names, strict=True)
    ]
    return wide.select(*keys, ts, "close", F.inline(F.array(*rows))).select(*keys, "strategy", "family", ts, "close", "signal")


def run_backtest(
    bars: DataFrame,
    strategy: Strategy,
    ts: str = "ts",
    spread: float | None = 0.0,
    take: float | None = None,
    stop: float | None = None,
    max_hold: int | None = None,
    capital: float = 10_000.0,
    session: str | None = None,
    entry_time: str | None = None,
    every: str | None = None,
    direction: str = "both",
    start: str | None = None,
    end: str | None = None,
    pips: bool = False,
    config: Config | None = None,
) -> dict[str, DataFrame]:
    """Signals, trades, curves and metrics with status per instrument, of the bars from
    ``start`` to ``end``.  Distances are in price units or, with ``pips``, in pips of the
    instrument; then a spread of None is its usual one."""
    config, keys = config or Config(), ["pair"]
    bars = splits.date_window(bars, ts, start, end)
    if every:
        bars = resample(bars, every, keys, ts).withColumnRenamed("ts", ts)
    signals = strategy.generate(bars, keys, ts)
    masked = backtest.masked_signal("signal", ts, direction, session, entry_time).cast("int")
    held = backtest.with_position(signals.withColumn("signal", masked), "signal", keys, ts)
    kw = {"spread": spread or 0.0, "take": take, "stop": stop, "max_hold": max_hold}
    if pips:
        unit, usual = S.pip(F.col("pair")), S.typical_spread(F.col("pair"))
        sizes = {"spread": F.lit(spread) if spread is not None else usual, "take": F.lit(take), "stop": F.lit(stop)}
        held = held.withColumns({f"{k}_": v.cast("double") * unit for k, v in sizes.items() if k == "spread" or kw[k]})
        kw |= {k: f"{k}_" for k in sizes if f"{k}_" in held.columns}
    trades = backtest.run_trades(held, keys, ts, [kw], capital=capital)
    curves = backtest.run_curves(held, keys, ts, kw | {"capital": capital})
    metrics = (
        backtest.curve_metrics(curves, keys, ts)
        .join(backtest.trade_metrics(trades, keys, config.annualisation, capital), keys, "left")
        .join(backtest.signal_distribution(held, keys), keys, "left")
        .fillna(0, ["n_trades", "net_sharpe", "sortino", "gross_sharpe", "win_rate", "avg_trade_bars"])
        .fillna(999.0, ["profit_factor"])
        .fillna(capital, ["capital_final"])
    )
    raw = signals.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_bars"), F.count_if(F.col("signal") != 0).alias("n_raw"))
    state = evaluate.status(F.col("n_bars"), F.lit(strategy.warmup), F.col("n_raw"), F.col("n_trades"))
    metrics = metrics.join(raw, keys).withColumn("status", state).drop("n_bars", "n_raw")
    return {"signals": held, "trades": trades.drop("variant"), "curves": curves, "metrics": metrics}


def _specs(runs: DataFrame, spread: float | None, max_hold: int | None, **axes: list) -> DataFrame:
    """Specs of ``runs`` (pair, strategy and any fixed axes) times the given axes; a
    spread of None is the instrument's usual one."""
    off = {"session": "string", "direction": "string", "tp": "double", "sl": "double"}
    out = runs
    if axes:
        out = out.drop(*axes).crossJoin(F.broadcast(evaluate.grid(runs.sparkSession, **axes)))
    for name, kind in off.items():
        if name not in out.columns:
            out = out.withColumn(name, F.lit("both" if name == "direction" else None).cast(kind))
    out = out.withColumns({"spread": S.typical_spread(F.col("pair")) if spread is None else F.lit(float(spread)), "max_hold": F.lit(max_hold).cast("int")})
    return out if "warmup" in out.columns else out.withColumn("warmup", F.lit(None).cast("int"))


def _scored(outcomes: DataFrame) -> DataFrame:
    c = [F.col(x) for x in ("n_trades", "net_sharpe", "sortino", "calmar", "max_drawdown")]
    return outcomes.withColumn("composite", F.coalesce(S.composite_score(*c), F.lit(0.0)))


def tiered_selection(
    bars: DataFrame,
    train_end: str,
    val_end: str,
    folds: list[tuple[str, str, str]],
    registry: dict[str, Strategy] | None = None,
    ts: str = "ts",
    spread: float | None = None,
    max_hold: int | None = None,
    sessions: tuple = (None, "london", "ny"),
    tp_sl: tuple | None = None,
    test_from: str | None = None,
    test_to: str | None = None,
    pips: bool = True,
    config: Config | None = None,
    *,
    work: str,
) -> dict[str, DataFrame]:
    """Screen, session and direction sweep, targets (by default the configured grid),
    walk-forward, final test (of the window given).  Runs that are not ok take no part
    in any choice.  Spread and targets are in pips, or without ``pips`` in price units;
    a spread of None is the instrument's usual one.

    Each tier is one job over (pair, strategy) series; only outcome tables, a row per
    run, pass between tiers; they and the signals are written below ``work``."""
    config, registry = config or Config(), registry or REGISTRY
    tp_sl = config.tp_sl_grid if tp_sl is None else tp_sl
    names = {n: (s.family, k, s.warmup) for k, (n, s) in enumerate(registry.items())}
    spark = bars.sparkSession

    def cut(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{work}/{name}")
        return spark.read.parquet(f"{work}/{name}")

    order = spark.createDataFrame([(n, *x) for n, x in names.items()], "strategy string, family string, ordinal int, warmup int")
    warm = F.broadcast(order.select("strategy", "warmup"))
    tag = splits.fixed_split(bars, train_end, val_end, config.purge_rows, ["pair"], ts)
    val = cut(all_signals(tag.filter("split = 'val'"), registry, ts), "val-signals")

    def run(signals: DataFrame, specs: DataFrame, keys: list[str] = KEYS, always: bool = False) -> DataFrame:
        specs = specs.drop("warmup").join(warm, "strategy")
        if pips:  # returns do not depend on the unit of price
            signals = signals.withColumn("close", F.col("close") / S.pip(F.col("pair")))
        return _scored(backtest.run_variants(signals, keys, ts, specs, config.annualisation, config.capital, always))

    good = evaluate.ok(F.col("status"))
    runs = val.select(*KEYS).distinct()
    t1 = cut(run(val, _specs(runs, spread, max_hold)).drop("warmup").join(F.broadcast(order), "strategy"), "t1")
    survivors = cut(evaluate.tier1_survivors(t1), "survivors")

    t2 = cut(run(val, _specs(survivors, spread, max_hold, session=list(sessions), direction=list(backtest.DIRECTIONS))), "t2")
    base = evaluate.best(t2.filter(good), KEYS, "composite", ["session", "direction"])
    chosen = base.select(*KEYS, "session", "direction")

    best = base
    if tp_sl:
        pairs = spark.createDataFrame([(float(a), float(b)) for a, b in tp_sl], "tp double, sl double")
        t3 = cut(run(val, _specs(chosen.crossJoin(F.broadcast(pairs)), spread, max_hold)), "t3")
        tuned = evaluate.best(t3.filter(good), KEYS, "composite", ["tp", "sl"])
        beat = tuned.alias("t").join(base.alias("b"), KEYS).filter("t.composite > b.composite").select("t.*")
        best = beat.unionByName(base.join(beat.select(*KEYS), KEYS, "left_anti"))
    chosen = cut(best.select(*KEYS, "session", "direction", "tp", "sl"), "chosen")

    parts = splits.folds(bars, folds, config.purge_rows, ["pair"], ts).filter("kind = 'train'")
    fold_signals = cut(all_signals(parts, registry, ts, ["pair", "fold"]), "fold-signals")
    numbers = spark.createDataFrame([(k,) for k in range(len(folds))], "fold int")
    specs = _specs(chosen, spread, max_hold).crossJoin(F.broadcast(numbers))
    # a fold without signals, or not longer than the warm-up, counts with zeros
    t4 = cut(run(fold_signals, specs, [*KEYS, "fold"], always=True), "t4")
    folded = evaluate.fold_aggregate(t4.filter(good), [*KEYS, "session", "direction"])
    final = cut(evaluate.final_rank(folded), "ranking")

    window = splits.date_window(tag.filter("split = 'test'"), ts, test_from, test_to)
    test = cut(all_signals(window, registry, ts), "test-signals")
    t5 = run(test, _specs(chosen.join(final.select(*KEYS), KEYS, "left_semi"), spread, max_hold))
    t5 = without_data(t5.withColumn("grade", S.grade(F.col("composite"))), final)
    return {"t1": t1, "survivors": survivors, "t2": t2, "chosen": chosen, "t4": t4, "ranking": final, "t5": t5}


def fold_outcomes(
    bars: DataFrame, registry: dict[str, Strategy], folds: list[tuple[str, str, str]], spread: float | None = None,
    max_hold: int | None = None, ts: str = "ts", config: Config | None = None,
) -> DataFrame:
    """Walk-forward: signals, trades and metrics of every strategy on every fold's training
    bars, one row per (pair, strategy, fold), the folds being one job.  A fold without
    signals or not longer than the warm-up has zeros; one without bars has no row."""
    config, keys = config or Config(), [*KEYS, "fold"]
    parts = splits.folds(bars, folds, config.purge_rows, ["pair"], ts).filter("kind = 'train'")
    signals = all_signals(parts, registry, ts, ["pair", "fold"])
    specs = _specs(signals.select(*keys).distinct(), spread, max_hold)
    return backtest.run_variants(signals, keys, ts, specs, config.annualisation, config.capital, always=True)


def without_data(outcomes: DataFrame, expected: DataFrame) -> DataFrame:
    """``outcomes`` with a row of status NO_DATA_IN_WINDOW for every expected run
    whose series has no bar in the window."""
    missing = expected.select(*KEYS).join(outcomes, KEYS, "left_anti").withColumn("status", F.lit("NO_DATA_IN_WINDOW"))
    return outcomes.unionByName(missing, allowMissingColumns=True)


def session_transfer(signals: DataFrame, ts: str, spreads: tuple = (0.5, 1.0, 2.0), spread: float | None = None, config: Config | None = None) -> DataFrame:
    """Each model's signals (pair, strategy = training session) over every evaluation
    session and multiple of the spread in pips (None: the instrument's usual one);
    signals are computed once."""
    config = config or Config()
    runs = signals.select(*KEYS).distinct()
    grid = evaluate.grid(signals.sparkSession, session=[None, "london", "ny", "asia"], spread_mult=list(spreads))
    usual = S.typical_spread(F.col("pair")) if spread is None else F.lit(spread)
    specs = _specs(runs.crossJoin(F.broadcast(grid)), 0.0, None).withColumn("spread", F.col("spread_mult") * usual)
    signals = signals.withColumn("close", F.col("close") / S.pip(F.col("pair")))
    out = backtest.run_variants(signals, KEYS, ts, specs, config.annualisation, config.capital)
    return out.select(
        "pair",
        F.col("strategy").alias("train_session"),
        F.coalesce("session", F.lit("global")).alias("eval_session"),
        F.round(F.col("spread") / usual, 6).alias("spread_mult"),
        "net_sharpe",
        "n_trades",
        "status",
    )
