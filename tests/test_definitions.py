"""Hand-computed cases and properties of the bar operators."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.config import Config
from tidemark.functions import scalars as S
from tidemark.operators import backtest, clean, eda, evaluate, features, folds, ml, splits, strategies
from tidemark.schema import TableMismatch, require_columns
from tidemark.sources import bars as B
from tidemark.sources import sinks


def frame(spark, closes, pair="A"):
    ts = pd.date_range("2024-01-01", periods=len(closes), freq="min")
    c = np.asarray(closes, dtype=float)
    df = pd.DataFrame({"pair": pair, "ts": ts, "open": c, "high": c + 0.5, "low": c - 0.5, "close": c, "volume": 1})
    return spark.createDataFrame(df).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def walk(n=2000, seed=0):
    return np.exp(np.cumsum(np.random.default_rng(seed).normal(0, 0.001, n)) + 7)


def test_cooldown_case():
    assert folds.cooldown(np.array([1, 1, 0, -1, 1, 0, 1]), 2).tolist() == [1, 0, 0, -1, 0, 0, 1]
    assert folds.cooldown(np.array([1, 1, -1]), 0).tolist() == [1, 1, -1]


def test_signal_flip_and_end_of_data():
    price, pos = np.array([100, 101, 103, 102, 99, 98.0]), np.array([0, 1, 1, 1, -1, -1])
    trades, equity, _ = backtest.simulate(price, pos, 0.5)
    assert [t[:4] + t[8:] for t in trades] == [(1, 4, 3, 1, "SIGNAL_FLIP"), (4, 5, 1, -1, "END_OF_DATA")]
    assert [t[6] for t in trades] == [-2.475248, 0.505051]
    assert [t[7] for t in trades] == [-247.5248, 49.2549]
    assert equity[-1] == pytest.approx(0.97524752)  # the last trade does not show


def test_take_profit_and_same_bar_entry():
    price, pos = np.array([100, 100, 105, 105, 90.0]), np.array([0, 1, 1, 1, 1])
    trades, _, _ = backtest.simulate(price, pos, 0.0, 4.0, 6.0)
    assert [(t[0], t[1], t[8], t[6]) for t in trades] == [
        (1, 2, "TP", 5.0), (2, 4, "SL", -14.285714), (4, 4, "END_OF_DATA", 0.0),
    ]


def test_max_hold_and_zero_is_off():
    price, pos = np.full(6, 100.0), np.array([0, 1, 1, 1, 1, 1])
    trades, _, _ = backtest.simulate(price, pos, 0.0, 0, 0, 2)
    assert [t[8] for t in trades] == ["MAX_HOLD", "MAX_HOLD", "END_OF_DATA"]
    trades, _, _ = backtest.simulate(price, pos, 0.0, 0, 0, 0)
    assert [t[8] for t in trades] == ["END_OF_DATA"]


def test_registry_invariants(spark):
    df = frame(spark, walk()).cache()
    for name, s in strategies.REGISTRY.items():
        got = s.generate(df, ["pair"]).orderBy("ts").toPandas()["signal"].to_numpy()
        assert len(got) == 2000 and set(np.unique(got)) <= {-1, 0, 1}
        assert (got == 0).mean() > (0.5 if s.family in ("mean_reversion",) else 0.8), name
        hits = np.flatnonzero(got)
        assert not len(hits) or (np.diff(hits) > s.cooldown).all()
    df.unpersist()


def test_no_look_ahead(spark):
    c = walk(300)
    changed = c.copy()
    changed[200:] *= 2
    for s in (strategies.momentum(20), strategies.macd_cross(5, 12, 4), strategies.bollinger(20)):
        a, b = (s.generate(frame(spark, x), ["pair"]).orderBy("ts").toPandas()["signal"][:200] for x in (c, changed))
        assert (a == b).all()


def test_constructor_checks():
    for bad in (
        lambda: strategies.ma_crossover(5, 5), lambda: strategies.momentum(1), lambda: strategies.donchian(1),
        lambda: strategies.rsi_reversion(14, 70, 30), lambda: strategies.bollinger(20, 0), lambda: strategies.macd_cross(5, 9, 0),
        lambda: strategies.get_strategy("nope"), lambda: Config(purge_rows=1),
    ):
        with pytest.raises(ValueError):
            bad()


def test_dst_rejection(spark):
    stamps = ["20240310 015900", "20240310 023000", "20240310 030000", "20241103 005900", "20241103 013000", "20241103 020000", "bad"]
    raw = spark.createDataFrame([(s, 1.0, 1.0, 1.0, 1.0, 0.0, "EURUSD") for s in stamps], "stamp string, open double, high double, low double, close double, volume double, pair string")
    got = [str(r[0]) for r in B.canonical(raw).orderBy("timestamp_utc").select(F.col("timestamp_utc").cast("string")).collect()]
    assert got == ["2024-03-10 06:59:00", "2024-03-10 07:00:00", "2024-11-03 04:59:00", "2024-11-03 07:00:00"]


def test_purge(spark):
    df = frame(spark, np.arange(40.0)).unionByName(frame(spark, np.arange(10.0), "B"))
    got = {r["pair"]: r["count"] for r in splits.purge_tail(df, 15, ["pair"], "ts").groupBy("pair").count().collect()}
    assert got == {"A": 25, "B": 10}


def test_clean_counts_days_after_bad_rows(spark):
    df = frame(spark, np.arange(1.0, 21.0)).withColumn("high", F.when(F.col("close") == 5, -1.0).otherwise(F.col("high")))
    assert clean.clean(df, 20, ["pair"], "ts", ["close"]).count() == 0
    assert clean.clean(df, 19, ["pair"], "ts", ["close"]).count() == 19


def test_labels_null_where_no_future(spark):
    got = features.labels(frame(spark, np.full(20, 2.0)), __import__("tidemark.functions.windows", fromlist=["series"]).series()).orderBy("ts").toPandas()
    assert got["label_3class_5"].isna().sum() == 5 and got["label_3class_15"].isna().sum() == 15
    assert (got["label"].dropna() == 0).all()


def test_resample_conserves_volume(spark):
    df = frame(spark, walk(500))
    assert B.resample(df, "1 hour", ["pair"]).agg(F.sum("volume")).first()[0] == 500


def test_student_t(spark):
    rows = [(2.0, 10, 0.0733880), (0.0, 5, 1.0), (12.7062, 1, 0.05), (-2.0, 10, 0.0733880), (1.96, 100_000, 0.0499977), (None, 5, 1.0), (float("nan"), 5, 1.0), (300.0, 20, 0.0)]
    df = spark.createDataFrame(rows, "t double, df int, want double")
    for r in df.withColumn("p", S.t_two_sided(F.col("t"), F.col("df"))).collect():
        assert r["p"] == pytest.approx(r["want"], abs=1e-5)


def test_tier_one_rules(spark):
    """By hand: the share, the family floor, and runs that are not ok."""
    rows = [
        ("A", "t1", "trend", 0, "OK", 3.0), ("A", "t2", "trend", 1, "OK", 2.0), ("A", "m1", "momentum", 2, "OK", 1.0), ("A", "b1", "breakout", 3, "OK", -0.2),
        ("A", "b2", "breakout", 4, "ZERO_SIGNALS", 0.0), ("A", "r1", "mean_reversion", 5, "ZERO_TRADES", 0.0), ("A", "r2", "mean_reversion", 6, "ENGINE_ERROR", 9.0),
        ("B", "t1", "trend", 0, "OK", -1.0), ("B", "m1", "momentum", 2, "SKIP_WARMUP_GT_DATA", None),
    ]
    df = spark.createDataFrame(rows, "pair string, strategy string, family string, ordinal int, status string, net_sharpe double")
    got = {tuple(r) for r in evaluate.tier1_survivors(df).collect()}
    assert got == {("A", "t1"), ("A", "m1"), ("A", "b1"), ("A", "r1"), ("B", "t1")}


def test_break_even_at_two_zeros(spark):
    rows = [("a", 0.5, 1.0), ("a", 1.0, 0.0), ("a", 2.0, 0.0), ("b", 0.5, 0.0), ("b", 1.0, 0.0), ("c", 0.5, 2.0), ("c", 1.0, 1.0), ("d", 0.5, -1.0), ("d", 2.0, -2.0), ("e", 1.0, 1.0)]
    df = spark.createDataFrame(rows, "k string, spread_mult double, net_sharpe double")
    got = {r["k"]: r["breakeven"] for r in evaluate.breakeven(df, ["k"]).collect()}
    assert got == {"a": "1.00", "b": "0.50", "c": ">2.0", "d": "<0.5"}


def test_histogram_keeps_every_value(spark):
    df = spark.createDataFrame([("a", float(x)) for x in range(101)] + [("b", 7.0), ("b", 7.0), ("b", None)], "k string, x double")
    got = {(r["k"], r["bin"]): r["n"] for r in eda.histogram(df, "x", ["k"], 10).collect()}
    assert got == {("a", i): 10 for i in range(9)} | {("a", 9): 11, ("b", 0): 2}
    assert sum(r["n"] for r in eda.histogram(df, "x", ["k"], 5, 0.0, 50.0).filter("k = 'a'").collect()) == 51


def test_models_by_name():
    assert strategies.get_strategy("MACD_f26_s65_sig9").warmup == 73
    silent = strategies.get_strategy("LR_london", or_silent=True)
    assert silent.family == "none" and strategies.get_strategy("LSTM_ny", {"LSTM_ny": silent}) is silent
    for bad in ("LR_london", "nothing"):
        with pytest.raises(ValueError):
            strategies.get_strategy(bad)


def test_scaled_keeps_the_order_of_its_scaler(spark):
    df = spark.createDataFrame([(1, 1.0, 10.0), (2, 3.0, None), (3, 5.0, 20.0)], "i int, a double, b double").withColumn("k", F.lit("x"))
    scaler = splits.scaler(df, ["b", "a"], ["k"]).filter("k = 'x'")
    got = [r["x"] for r in ml.scaled(df, scaler, ["b", "a"]).orderBy("i").collect()]
    b, a = np.array([10.0, 0.0, 20.0]), np.array([1.0, 3.0, 5.0])
    assert np.allclose(got, np.stack([(b - b.mean()) / b.std(), (a - a.mean()) / a.std()], 1))
    with pytest.raises(KeyError):
        ml.scaled(df.drop("a"), scaler, ["b"])


def test_network_by_plain_loop():
    net, rng = ml.TwoBranchNetwork(3, 2, 4, hidden=5), np.random.default_rng(0)
    x = rng.normal(size=(4, 7, 3)).astype(np.float32)
    wx, wh, b = net.branches[0]
    h, c, sig = np.zeros((4, 5)), np.zeros((4, 5)), lambda z: 1 / (1 + np.exp(-z))
    for t in range(7):
        z = x[:, t] @ wx + h @ wh + b
        c = sig(z[:, 5:10]) * c + sig(z[:, :5]) * np.tanh(z[:, 10:15])
        h = sig(z[:, 15:]) * np.tanh(c)
    assert np.allclose(net._run(x, net.branches[0]), h, atol=1e-5)


def test_sources(spark, tmp_path):
    """Raw text and zip archives to canonical bars, the files of a folder, the catalog."""
    import zipfile

    lines = "20240102 030000;1.1;1.2;1.0;1.15;0\n20240102 030100;1.15;1.25;1.1;1.2;0\nbad;1;1;1;1;0\n"
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "EURUSD_2024.csv").write_text(lines)
    with zipfile.ZipFile(tmp_path / "raw" / "EURUSD_2024.zip", "w") as z:
        z.writestr("data.csv", lines)
    raw = B.read_raw_csv(spark, str(tmp_path / "raw" / "*.csv"))
    assert raw.count() == 3
    assert sorted(r["close"] for r in B.read_zips(spark, str(tmp_path / "raw")).collect() if r["stamp"] != "bad") == [1.15, 1.2]
    frame(spark, walk(5)).write.parquet(str(tmp_path / "set" / "EURUSD_2015_2025.parquet"))
    found = B.discover(spark, str(tmp_path / "set"), ["EURUSD"])
    assert found.columns == ["pair", "tag", "file"]
    c = B.Catalog()
    c.add("train", raw)
    assert c.resolve("train") is raw
    with pytest.raises(ValueError):
        c.resolve("test")
    with pytest.raises(TableMismatch):
        c.require(["val"])


def test_types_are_checked(spark):
    from pyspark.sql import types as T

    want = T.StructType([T.StructField("id", T.LongType())])
    assert require_columns(spark.range(1), want).columns == ["id"]
    with pytest.raises(TableMismatch):
        require_columns(spark.range(1), T.StructType([T.StructField("id", T.StringType())]))


def test_grades(spark):
    df = spark.createDataFrame([(9, 5.0, 0.0), (10, 5.0, -0.95), (10, 5.0, -0.96)], "n long, s double, dd double")
    got = [r[0] for r in df.select(S.composite_score(F.col("n"), F.col("s"), F.col("s"), F.col("s"), F.col("dd"))).collect()]
    assert got[0] == 0.0 and got[1] > 80 and got[2] == 0.0


def test_logistic_separates(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(0, 1, (600, 2))
    y = np.where(x[:, 0] > 0.5, 1, np.where(x[:, 0] < -0.5, -1, 0))
    df = spark.createDataFrame(pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "label": y}))
    model, inputs = ml.fit_logistic(df, ["a", "b"], "label", max_iter=100)
    got = ml.predict(model, inputs, df, ["a", "b"]).agg(F.avg((F.col("signal") == F.col("label")).cast("double"))).first()[0]
    assert got > 0.9 and ml.importance(model, ["a", "b"])[0][0] == "a"


def test_hac_reduces_to_plain(spark):
    df = frame(spark, walk(50)).withColumn("z", F.lit(0.0))
    plain = evaluate.with_p_value(evaluate.dm_statistics(df, ["pair"], "close", "z")).first()
    assert plain["n"] == 50 and plain["significant"]


def test_required_columns(spark):
    with pytest.raises(TableMismatch):
        require_columns(spark.range(1), ["x"])


def test_sinks(spark, tmp_path):
    df = frame(spark, walk(10))
    sinks.write_bars(df, str(tmp_path / "b"), "ts")
    sinks.write_bars(df.limit(1), str(tmp_path / "b"), "ts")  # stays as it is
    assert spark.read.parquet(str(tmp_path / "b")).count() == 10
    bad = spark.createDataFrame([(float("nan"), 1.0)], "a double, b double")
    assert sinks.as_json(bad).first()[0] == '{"a":null,"b":1.0}'
    page = sinks.report_html("t", spark.createDataFrame([(float("inf"), "</script>")], "a double, b string"))
    assert "<table>" in page and '"a":null' in page and page.count("</script>") == 1
    assert sinks.report_text("Title", bad).splitlines()[0] == "Title"
    sinks.write_bundle({"one": bad, "two": df.select("pair")}, str(tmp_path / "bundle"))
    assert spark.read.option("header", "true").csv(str(tmp_path / "bundle" / "two")).count() == 10


def test_partition_count_does_not_matter(spark):
    df = frame(spark, walk(400)).cache()
    seen = set()
    for n in (1, 7):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got = strategies.donchian(20, 5).generate(df.repartition(n), ["pair"]).orderBy("ts").toPandas()["signal"]
        seen.add(tuple(got))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(seen) == 1
