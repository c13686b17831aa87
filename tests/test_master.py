from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.config import Config
from tidemark.operators import backtest
from tidemark.plans import master
from tidemark.plans import queries as Q

SF = "/root/testdata/sf0.001"


def test_metrics_of_equals_table_form(spark):
    bars = Q.bars(spark, SF)
    out = master.run_backtest(bars, Q.strategies.momentum(6), "ts", 0.5, 20.0, 10.0, 24)
    s = out["signals"].select("pair", F.lit("m").alias("strategy"), "ts", "close", "signal")
    specs = master._specs(s.select("pair", "strategy").distinct(), 0.5, 24).withColumns({"tp": F.lit(20.0), "sl": F.lit(10.0)})
    inside = {r["pair"]: r for r in backtest.run_variants(s, master.KEYS, "ts", specs, Config().annualisation).collect()}
    for r in out["metrics"].collect():
        for name in ("n_trades", "net_sharpe", "sortino", "gross_sharpe", "total_return", "max_drawdown", "win_rate", "profit_factor", "turnover", "capital_final"):
            assert inside[r["pair"]][name] == pytest.approx(r[name], rel=1e-6, abs=1e-6), name


def test_failing_spec_becomes_a_row(spark):
    s = master.all_signals(Q.bars(spark, SF), {"a": Q.strategies.momentum(6)})
    specs = master._specs(s.select("pair", "strategy").distinct(), 0.5, 24, session=[None, "nowhere"])
    got = backtest.run_variants(s, master.KEYS, "ts", specs, 98280).groupBy("status").count().collect()
    assert {r["status"] for r in got} >= {"ENGINE_ERROR"} and sum(r["count"] for r in got) == 10


def test_tiers(spark, tmp_path):
    c = Config(purge_rows=15)
    out = master.tiered_selection(
        Q.bars(spark, "/root/testdata/sf0.01"), Q.TRAIN_END, Q.VAL_END, Q.FOLDS[:2], {k: Q.SMALL_SET[k] for k in ("Momentum_24", "Donchian_20", "BB_20")},
        spread=0.5, max_hold=24, sessions=(None, "london"), tp_sl=((40, 20),), test_from="2024-01-24", pips=False, config=c, work=str(tmp_path),
    )
    ok = [r for r in out["t1"].collect() if r["status"] in ("OK", "ZERO_TRADES")]
    by = {(r["pair"], r["family"]): max(x["net_sharpe"] for x in ok if (x["pair"], x["family"]) == (r["pair"], r["family"])) for r in ok}
    chosen = {(r["pair"], r["strategy"]) for r in out["survivors"].collect()}
    assert chosen == {(r["pair"], r["strategy"]) for r in ok if by[r["pair"], r["family"]] == r["net_sharpe"]}  # one strategy a family: all stay
    assert out["t5"].filter("status = 'OK'").count() > 0
    t1, survivors, t2 = out["t1"].count(), out["survivors"].count(), out["t2"].count()
    assert t1 == 15 and 0 < survivors <= t1 and t2 == survivors * 6
    assert out["chosen"].count() == survivors and out["t4"].count() == survivors * 2
    assert np.all([r["grade"] in "ABCDF" for r in out["t5"].collect()])


def test_pips_are_units_of_price(spark):
    """The same run in pips and in price units."""
    b = Q.bars(spark, SF).withColumn("pair", F.when(F.col("pair") == "view", "USDJPY").when(F.col("pair") == "click", "EURUSD").otherwise("OTHER")).filter("pair != 'OTHER'")
    inside = master.run_backtest(b, Q.strategies.momentum(6), "ts", None, 2000.0, 1000.0, 24, pips=True)["trades"]
    for pair, unit, usual in (("USDJPY", 0.01, 0.7), ("EURUSD", 0.0001, 0.6)):
        plain = master.run_backtest(b.filter(F.col("pair") == pair), Q.strategies.momentum(6), "ts", usual * unit, 2000 * unit, 1000 * unit, 24)["trades"]
        assert sorted(map(tuple, inside.filter(F.col("pair") == pair).collect())) == sorted(map(tuple, plain.collect()))
