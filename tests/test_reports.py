"""Summary tables, the older selection and the comparisons of an evaluation, by hand."""

from __future__ import annotations

from datetime import datetime, timedelta

import numpy as np
import pytest

from tidemark.operators import reports
from tidemark.plans import comparison
from tidemark.sources import sinks

RUN = "pair string, strategy string, net_sharpe double, total_return double, max_drawdown double, n_trades long, sortino double, family string, capital_final double"
RUNS = [
    ("A", "x", 1.0, 0.1, -0.2, 10, 2.0, "trend", 11_000.0),
    ("A", "y", 1.0, 0.3, -0.4, 20, 4.0, "trend", 0.0),
    ("B", "x", -1.0, -0.1, -0.6, 30, 0.0, "trend", 9_000.0),
    ("B", "y", 0.0, 0.0, 0.0, 0, 0.0, "breakout", -5.0),
    ("B", "z", None, None, None, None, None, "breakout", None),
]


@pytest.fixture(scope="module")
def runs(spark):
    return spark.createDataFrame(RUNS, RUN).cache()


def test_run_summary(runs):
    (r,) = reports.run_summary(runs, [], ["pair", "strategy"]).collect()
    assert (r.runs, r.positive_runs) == (4, 3)  # zero counts as not losing, null as no run
    assert (r.best_pair, r.best_strategy, r.best_return) == ("A", "x", 0.1)  # the tie goes to the smaller name
    assert (r.worst_pair, r.worst_sharpe) == ("B", -1.0)
    assert r.mean_drawdown == pytest.approx(-0.3)
    assert reports.run_summary(runs.filter("false"), ["pair"], ["pair", "strategy"]).count() == 0


def test_strategies_without_runs_have_zeros(spark, runs):
    names = spark.createDataFrame([("x",), ("z",), ("z",), ("q",)], "strategy string")
    got = {r.strategy: r for r in reports.strategy_table(runs, names).collect()}
    assert set(got) == {"x", "z", "q"} and got["q"].runs == got["z"].runs == 0 and got["q"].mean_dd == 0
    assert got["x"].runs == 2 and got["x"].mean_trades == 20


def test_families(runs):
    got = {r.family: r for r in reports.family_table(runs).collect()}
    t = got["trend"]
    assert (t.runs, t.best_pair, t.worst_pair) == (3, "A", "B")
    assert t.mean_sharpe == pytest.approx(1 / 3) and t.mean_sortino == 2.0
    assert got["breakout"].best_pair == got["breakout"].worst_pair == "B"


def test_report_meta(runs):
    (r,) = reports.report_meta(runs, []).collect()
    assert (r.pairs, r.strategies, r.capital_final_avg) == (["A", "B"], ["x", "y", "z"], 10_000.0)


def test_ranks(runs):
    got = [(r.pair, r.strategy) for r in reports.ranked(runs, "net_sharpe", ["pair", "strategy"]).orderBy("rank").collect()]
    assert got == [("A", "x"), ("A", "y"), ("B", "y"), ("B", "x"), ("B", "z")]  # null last
    top = reports.top(runs, "net_sharpe", ["pair", "strategy"], 2).orderBy("rank").collect()
    assert [(r.strategy, r.rank) for r in top] == [("x", 1), ("y", 2)]
    assert reports.ranked(runs.filter("false"), "net_sharpe", ["pair", "strategy"]).count() == 0


def test_shares_and_histogram(spark):
    df = spark.createDataFrame([("A", "Asia", 1, 0), ("A", None, 1, 1), ("A", "London", 0, 0)], "pair string, session string, y int, p int")
    (s,) = reports.shares(df, ["pair"], "session", {"Asia": "asia", "Overlap": "overlap"}).collect()
    assert (s.asia, s.overlap) == (33.33, 0.0)
    got = {r["class"]: (r.actual, r.predicted, r.hits) for r in reports.prediction_histogram(df, ["pair"], "y", "p", [-1, 0, 1]).collect()}
    assert got == {-1: (0, 0, 0), 0: (1, 2, 1), 1: (2, 1, 1)}


def test_older_selection(spark):
    rows = [("A", "x", 1, 0.5), ("A", "x", 2, 0.9), ("B", "x", 1, 0.7), ("C", "x", 1, 0.1), ("D", "x", 1, 0.05), ("A", "y", 1, -3.0)]
    runs = spark.createDataFrame(rows, "pair string, strategy string, setting int, net_sharpe double")
    assert [r.strategy for r in reports.legacy_survivors(runs).collect()] == ["x"]
    places = {r.pair: (r.setting, r.place) for r in reports.legacy_places(runs.filter("strategy = 'x'"), ["setting"]).collect()}
    assert places == {"A": (2, 1), "B": (1, 2), "C": (1, 3)}
    folds = [("A", "x", k, v) for k, v in enumerate((1.0, 1.0, -1.0))] + [("B", "x", k, v) for k, v in enumerate((4.0, 0.0, 0.0))]
    folds += [("C", "x", k, -1.0) for k in range(3)] + [("D", "x", k, 9.0) for k in range(3)]
    got = reports.legacy_selection(runs, spark.createDataFrame(folds, "pair string, strategy string, fold int, net_sharpe double"), ["setting"]).collect()
    assert [(r.pair, r.rank, r.setting) for r in got] == [("A", 1, 2)]  # B spreads over 1.5, C has three bad folds, D is the fourth


def _series(spark, names: list[str], n: int = 60, seed: int = 1):
    rng, rows = np.random.default_rng(seed), []
    close = 100 + np.cumsum(rng.normal(0, 1, n))
    close[5] = 0.0
    labels = ["Asia", "London", "Overlap", "New_York"]
    signals = {m: rng.integers(-1, 2, n) for m in names}
    for i in range(n):
        for m in names:
            rows.append(("A", m, datetime(2024, 1, 1) + timedelta(hours=i), float(close[i]), int(signals[m][i]), labels[i % 4]))
    df = spark.createDataFrame(rows, "pair string, strategy string, ts timestamp_ntz, close double, signal int, session string")
    return df, close, signals, np.array([labels[i % 4] for i in range(n)])


def _stat(a, b):
    d = a - b
    return round(float(d.mean() / np.sqrt(d.var(ddof=1) / len(d))), 4)


def test_comparison_set(spark):
    val, close, sig, _ = _series(spark, ["r1", "r2"])
    test, tclose, tsig, labels = _series(spark, ["LR_london", "LSTM_global"], seed=2)
    move = lambda c: np.diff(c) / np.where(c[:-1] == 0, 1, c[:-1])
    ret = lambda s, c: s[:-1] * move(c)
    mask = {"global": np.ones(60, bool), "london": np.isin(labels, ["London", "Overlap"]), "ny": np.isin(labels, ["New_York", "Overlap"]), "asia": labels == "Asia"}
    rules = spark.createDataFrame(
        [("A", "r1", True, 20, 5.0), ("A", "r2", True, 20, 7.0), ("A", "r3", True, 9, 99.0), ("A", "r4", False, 50, 99.0)],
        "pair string, strategy string, ok boolean, n_trades long, composite double",
    )
    models = [("A", m, True, 20, {"LR_london": 3.0, "LSTM_global": 4.0}[m] - k, m.split("_")[1], e, 1.0) for m in ("LR_london", "LSTM_global") for k, e in enumerate(mask)]
    models += [("A", "LR_london", True, 20, 99.0, "london", "global", 2.0)]  # another spread
    models = spark.createDataFrame(models, "pair string, strategy string, ok boolean, n_trades long, composite double, train_session string, eval_session string, spread_mult double")
    bars = lambda df: df.select("pair", "ts", "close").distinct()
    got = {r.comparison: r for r in comparison.comparison_set(rules, models, val, test, bars(val), bars(test)).collect()}
    lr = {e: ret(np.where(m, tsig["LR_london"], 0), tclose) for e, m in mask.items()}
    want = {
        "best_RB_vs_BAH": ("r2", "buy_and_hold", _stat(ret(sig["r2"], close), move(close))),
        "best_ML_vs_BAH": ("LSTM_global", "buy_and_hold", _stat(ret(tsig["LSTM_global"], tclose), move(tclose))),
        "RB_champion_vs_runner_up": ("r2", "r1", _stat(ret(sig["r2"], close), ret(sig["r1"], close))),
        # 4 at global; then 3 twice: the smaller name comes first
        "ML_champion_vs_runner_up": ("LSTM_global/eval=global", "LR_london/eval=global", _stat(ret(tsig["LSTM_global"], tclose), lr["global"])),
        "in_domain_london_vs_transfer": ("LR/LSTM_london_in_domain", "LR/LSTM_london_out_of_domain", _stat(lr["london"], np.mean([lr["global"], lr["ny"], lr["asia"]], axis=0))),
    }
    assert set(got) == set(want)
    for name, (a, b, stat) in want.items():
        assert (got[name].strategy_a, got[name].strategy_b, got[name].n) == (a, b, 59)
        assert got[name].stat == pytest.approx(stat, abs=2e-4), name
    # nothing to pick from
    none = comparison.comparison_set(rules.filter("false"), models.filter("false"), val, test, bars(val), bars(test))
    assert none.count() == 0


def test_models_alone(spark):
    test, close, sig, labels = _series(spark, ["LR_global", "LSTM_global", "LR_asia"])
    own = {(r.strategy, r.ts.hour % 4) for r in comparison.own_session(test).filter("signal != 0").collect()}
    assert {h for s, h in own if s == "LR_asia"} == {0} and {h for s, h in own if s == "LR_global"} == {0, 1, 2, 3}
    rows = comparison.model_evaluation(test, spread=0.5).collect()
    assert len(rows) == 9 and {r.spread_multiplier for r in rows} == {0.5, 1.0, 2.0}
    (t,) = comparison.model_test(test).collect()
    hold = lambda s: np.concatenate([[0], [next((x for x in s[: i + 1][::-1] if x), 0) for i in range(len(s) - 1)]])
    step = np.diff(close, prepend=close[0])
    assert t.stat == pytest.approx(_stat(hold(sig["LSTM_global"]) * step, hold(sig["LR_global"]) * step), abs=2e-4)
    assert comparison.model_test(test.filter("strategy != 'LR_global'")).count() == 0


def test_bundle_and_pages(spark, tmp_path):
    rules = spark.createDataFrame([("A", "r1", True, 20, 5.0, 1.0)], "pair string, strategy string, ok boolean, n_trades long, composite double, net_sharpe double")
    models = spark.createDataFrame(
        [("A", "LR_ny", "LR", True, 20, 6.0, v, "ny", e, m) for e, v in (("ny", 2.0), ("asia", 1.0)) for m in (0.5, 1.0, 2.0)],
        "pair string, strategy string, model_type string, ok boolean, n_trades long, composite double, net_sharpe double, train_session string, eval_session string, spread_mult double",
    )
    tests = spark.createDataFrame([("A", "c<d", 1.25)], "pair string, comparison string, stat double")
    tables = comparison.evaluation_tables(rules, models, tests)
    sinks.write_bundle(tables, str(tmp_path))
    back = {n: spark.read.option("header", "true").csv(f"{tmp_path}/{n}").collect() for n in tables}
    assert len(back["results_all"]) == 7 and float(back["results_all"][-1].composite) == 5.0
    assert (back["best_worst"][0].best_strategy, back["best_worst"][0].worst_strategy) == ("LR_ny", "r1")
    ny = next(r for r in back["transfer_lr"] if r.train_session == "ny")
    assert (ny.ny, ny.asia, ny["global"]) == ("2.0", "1.0", None) and len(back["transfer_lstm"]) == 4
    assert float(back["generalisability"][0].gap) == 1.0 and {r.breakeven for r in back["breakeven"]} == {">2.0"}
    page = sinks.comparison_html("Models", {"Tests": tables["dm_tests"]})
    assert "<td>c&lt;d</td><td>1.2500</td>" in page and "<h2>Tests</h2>" in page
    text = sinks.report_parts("Master", {"Rules": rules, "Tests": tests, "None": tests.filter("false")})
    assert text.index("PART 1: Rules") < text.index("PART 2: Tests") < text.index("PART 3: None")


def test_daily_ranges(spark):
    t = datetime(2024, 1, 1)
    rows = [(p, t + timedelta(days=d), 3.0 + d, 1.0) for p in ("A", "B") for d in range(3) if (p, d) != ("B", 2)]
    got = reports.daily_ranges(spark.createDataFrame(rows, "pair string, ts timestamp_ntz, high double, low double"), ["A", "B"]).orderBy("day").collect()
    assert [(r.A, r.B) for r in got] == [(2.0, 2.0), (3.0, 3.0)]
