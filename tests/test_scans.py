"""Scans over chunks of time: any length of chunk gives what one pass over a series gives."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import backtest, folds, logs, order_stats, trades

#: Minutes of a chunk: one row, a few, all.
CHUNKS = (60, 60 * 37, 10**9)


def series(spark, n=300, gaps=0.1, seed=0):
    """Two instruments of minutes, one a third as long, some closes missing."""
    rng = np.random.default_rng(seed)
    parts = []
    for pair, k in (("A", n), ("B", n // 3)):
        close = np.round(100 + np.cumsum(rng.normal(0, 0.5, k)), 2)
        close[k // 2 : k // 2 + 20] = close[k // 2]  # flat
        parts.append(pd.DataFrame({"pair": pair, "ts": pd.date_range("2024-03-10", periods=k, freq="min"), "close": np.where(rng.random(k) < gaps, np.nan, close), "signal": rng.choice([0, 0, 0, 1, -1], k)}))
    pdf = pd.concat(parts, ignore_index=True)
    df = spark.createDataFrame(pdf.sample(frac=1, random_state=1)).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    return pdf, df.withColumn("close", F.when(~F.isnan("close"), F.col("close")))


def back(df, column):
    return df.orderBy("pair", "ts").toPandas()[column].to_numpy(dtype=float)


@pytest.mark.parametrize("seconds", CHUNKS)
def test_averages(spark, seconds):
    pdf, df = series(spark)
    got = folds.ewm(df, {"f": ("close", folds.span(9)), "s": ("close", 1 / 14)}, ["pair"], "ts", seconds).orderBy("pair", "ts").toPandas()
    for name, kw in (("f", {"span": 9}), ("s", {"alpha": 1 / 14})):
        want = pdf.groupby("pair")["close"].transform(lambda x: x.ewm(adjust=False, **kw).mean())  # noqa: B023
        assert np.allclose(got[name].to_numpy(dtype=float), want, rtol=1e-12, equal_nan=True)


@pytest.mark.parametrize("seconds", CHUNKS)
def test_averages_of_a_constant_are_exact(spark, seconds):
    """Signals compare averages: no difference may come from the cut."""
    pdf = pd.DataFrame({"pair": "A", "ts": pd.date_range("2024-01-01", periods=150, freq="min"), "close": 1.1})
    got = folds.ewm(spark.createDataFrame(pdf), {"f": ("close", folds.span(5)), "s": ("close", folds.span(50))}, ["pair"], "ts", seconds)
    assert got.filter("f != s or f != 1.1").count() == 0


@pytest.mark.parametrize("seconds", CHUNKS)
@pytest.mark.parametrize("gaps", [0.0, 0.2])
def test_strength_index(spark, seconds, gaps):
    pdf, df = series(spark, gaps=gaps)

    def plain(x):
        change = x.diff()
        gain, loss = (y.ewm(alpha=1 / 14, adjust=False).mean() for y in (change.clip(lower=0), (-change).clip(lower=0)))
        return 100 - 100 / (1 + gain / loss.where(loss != 0))

    got = back(folds.rsi(df, 14, ["pair"], "ts", seconds=seconds), "rsi")
    assert np.allclose(got, pdf.groupby("pair")["close"].transform(plain), rtol=1e-9, equal_nan=True)


@pytest.mark.parametrize("seconds", CHUNKS)
@pytest.mark.parametrize("bars", [0, 1, 7, 500])
def test_cooldown(spark, seconds, bars):
    pdf, df = series(spark)
    want = np.concatenate([folds.cooldown(g["signal"].to_numpy(), bars) for _, g in pdf.groupby("pair")])
    assert (back(folds.with_cooldown(df, bars, ["pair"], "ts", seconds=seconds), "cooled") == want).all()


def test_silence_is_the_state_after_a_chunk():
    rng = np.random.default_rng(3)
    for _ in range(200):
        s, bars = rng.choice([0, 0, 1, -1], rng.integers(0, 30)), int(rng.integers(0, 40))
        got = folds.silence_after(s, bars)
        for free in range(bars + 1):
            kept = np.flatnonzero(folds.cooldown(s, bars, free))
            assert got[free] == max((kept[-1] + bars + 1 if len(kept) else free) - len(s), 0)


@pytest.mark.parametrize(
    "seconds,buckets,q,least", [(60, 5, 0.8, 30), (60 * 37, 1024, 0.0, 1), (60 * 37, 3, 1.0, 2), (60 * 11, 1, 0.37, 5), (10**9, 64, 0.8, 30)]
)
def test_expanding_quantile(spark, seconds, buckets, q, least):
    pdf, df = series(spark, gaps=0.15)
    rounded = df.withColumn("close", F.round("close", 0))  # many ties
    for d, x in ((df, pdf["close"]), (rounded, pdf["close"].round(0))):
        want = x.groupby(pdf["pair"]).transform(lambda v: v.expanding(min_periods=least).quantile(q))
        got = back(order_stats.expanding_quantile(d, "close", q, ["pair"], "ts", least, "q", seconds, buckets), "q")
        if d is rounded:  # halves round otherwise in numpy
            want = pd.Series(back(d, "close")).groupby(pdf["pair"]).transform(lambda v: v.expanding(min_periods=least).quantile(q))
        assert np.allclose(got, want, rtol=1e-12, equal_nan=True)


def test_chunks_of_the_quantile_are_bounded(spark):
    """However many rows share a span of time, or an instant, no chunk has more than it may."""
    rng = np.random.default_rng(4)
    n = 900
    x = np.round(rng.normal(0, 1, n), 1)
    rows = [("AB"[i % 3 == 0], int(i // 300 * 1000), i, float(v)) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "pair string, ts long, id long, x double")
    order = ["ts", "id"]
    cut = order_stats.chunked(df, ["pair"], order, 1e6, 64)
    sizes = [r["count"] for r in cut.groupBy("pair", "chunk_").count().collect()]
    assert sum(sizes) == n and max(sizes) == 64 and len(sizes) == -(-300 // 64) + -(-600 // 64)
    assert order_stats.chunked(df, ["pair"], order, 1e6, n).select("chunk_").distinct().count() == 1
    got = order_stats.expanding_quantile(df, "x", 0.8, ["pair"], order, 5, "q", 1e6, 16, rows=64).orderBy("id").toPandas()
    want = got.groupby("pair")["x"].transform(lambda v: v.expanding(min_periods=5).quantile(0.8))
    assert np.allclose(got["q"], want, rtol=1e-12, equal_nan=True)


def test_a_chunk_gets_what_is_near_the_place(spark):
    """Of a long past a chunk is sent some rows, not all."""
    before, own, q = 100_000, 100, 0.8
    chunks, bucket = np.repeat([0, 1], 1000), np.tile(np.arange(1000), 2)
    n = np.repeat([before // 1000, own // 1000 or 1], 1000)
    (_, _, _, f0, l0), (_, m, below, first, last) = order_stats.wanted(chunks, bucket, n, np.array([0, 1]), q)
    assert f0 > l0 and m == before
    assert (last - first + 1) * (before // 1000) < 3_000 and below < q * before < below + 3_000


RULES = [
    {"spread": 0.3, "take": 2.0, "stop": 1.0, "max_hold": 24},
    {"spread": 0.3, "take": None, "stop": None, "max_hold": None},
    {"spread": 0.0, "take": 0, "stop": 3.0, "max_hold": 5},
]


@pytest.mark.parametrize("seconds", CHUNKS)
def test_trades_and_curves(spark, seconds):
    pdf, df = series(spark, gaps=0.0)
    held = backtest.with_position(df, "signal", ["pair"], "ts")
    log = trades.run_trades(held, ["pair"], "ts", RULES, seconds=seconds).toPandas()
    curves = [trades.run_curves(held, ["pair"], "ts", kw | {"capital": 500.0}, seconds=seconds).orderBy("pair", "ts").toPandas() for kw in RULES]
    for pair, g in pdf.groupby("pair"):
        kept = g["signal"].replace(0, np.nan).ffill().fillna(0).to_numpy(int)
        position = np.concatenate([[0], kept[:-1]])
        for v, kw in enumerate(RULES):
            want, _, _ = backtest.simulate(g["close"].to_numpy(), position, **kw)
            got = log[(log["pair"] == pair) & (log["variant"] == v)].sort_values("exit_bar", kind="stable")
            rows = list(got.drop(columns=["pair", "variant"]).itertuples(index=False, name=None))
            assert [r[:7] + r[8:] for r in sorted(rows)] == [t[:7] + t[8:] for t in sorted(want)]
            assert np.allclose(sorted(r[7] for r in rows), sorted(t[7] for t in want), atol=2e-4)
            _, equity, returns = backtest.simulate(g["close"].to_numpy(), position, **kw, capital=500.0)
            c = curves[v][curves[v]["pair"] == pair]
            assert np.allclose(c["equity"], equity, rtol=1e-12) and np.allclose(c["bar_return"], returns, rtol=1e-12)


def test_machine_on_random_series():
    """Positions that jump, prices at 0, every mix of rules, any cut."""
    rng = np.random.default_rng(5)
    for it in range(400):
        n = int(rng.integers(1, 40))
        price = np.round(100 + np.cumsum(rng.normal(0, 1, n)), int(rng.integers(0, 3)))
        price = np.where(rng.random(n) < 0.2, 0, price) if it % 7 == 0 else price
        position = np.where(rng.random(n) < 0.5, 0, rng.integers(-1, 2, n))
        kw = {"spread": float(rng.choice([0, 0.5])), "take": rng.choice([None, 0, 1, 5.0]), "stop": rng.choice([None, 0, 3.0]), "max_hold": rng.choice([None, 0, 1, 3, 10])}
        want, _, _ = backtest.simulate(price, position, **kw)
        machine = trades.Machine((kw,), "close", "position", 10_000.0)
        fold, size, got = machine.fold(), int(rng.integers(1, n + 1)), []
        state, left = fold.start, None
        for s in range(0, n, size):
            part = pd.DataFrame({"close": price[s : s + size], "position": position[s : s + size]})
            closed, left, _ = machine.closed(part, state, 0)
            got += [(at, s + i, side, why) for side, _, at, i, _, why in closed]
            state = fold.advance(state, fold.summarise(part))
            assert (state[2][0].side != 0) == (left is not None)
        got += [(left.at, n - 1, left.side, "END_OF_DATA")] if left else []
        assert got == [(t[0], t[1], t[3], t[8]) for t in want]
        closed_cash = 10_000 + sum(t[7] for t in want if t[8] != "END_OF_DATA")
        assert state[2][0].cash == pytest.approx(closed_cash, abs=1e-3 * (1 + len(want)))


def test_a_trade_entered_at_zero_has_no_return(spark):
    """As in SQL: null, never 0, and nothing of it in the metrics."""
    price, position = [5.0, 0.0, 2.0, 4.0, 5.0], [0, 1, -1, -1, 1]
    df = spark.createDataFrame([("s", i, p, h) for i, (p, h) in enumerate(zip(price, position, strict=True))], "series string, at int, close double, position int")
    log = trades.run_trades(df, ["series"], "at", [{"spread": 0.5}]).orderBy("entry_bar")
    want = [(1, 2, 0.0, None, None), (2, 4, 2.0, -175.0, -17500.0), (4, 4, 5.0, -10.0, 750.0)]
    cols = ["entry_bar", "exit_bar", "entry_price", "pnl_pct", "pnl_dollars"]
    assert [tuple(r) for r in log.select(*cols).collect()] == want
    logs.register(spark)
    df.withColumnRenamed("close", "price").createOrReplaceTempView("held_at_zero")
    call = "SELECT * FROM trade_log(TABLE(held_at_zero) PARTITION BY (series) ORDER BY (at), 0.5, null, null, null) ORDER BY entry_bar"
    assert [tuple(r) for r in spark.sql(call).select(*cols).collect()] == want
    got, equity, _ = backtest.simulate(np.array(price), np.array(position), 0.5, no_return=None)
    assert [(t[0], t[1], t[4], t[6], t[7]) for t in got] == want
    assert backtest.metrics_of(got, equity, np.array(position), 1, 10_000.0)["win_rate"] == 0
    assert backtest.trade_metrics(log, ["series"], 1).first()["win_rate"] == 0


def test_summaries_stay_small():
    """What a chunk tells of itself does not hold its bars."""
    rng = np.random.default_rng(1)
    price = 100 + np.cumsum(rng.normal(0, 1, 43_200))
    position = np.concatenate([[0], np.sign(rng.normal(size=43_199))]).astype(int)
    s = trades.summarised(price, position, trades.Rules(0.1, 5.0, 3.0, 240))
    assert len(s.at) < 3_000


def test_one_instrument_uses_many_tasks(spark):
    df = spark.range(5000).select(F.lit("A").alias("pair"), F.timestamp_seconds(F.col("id") * 60).alias("ts"), F.rand(1).alias("close"))
    assert folds.with_chunk(df, "ts", 86_400).select("chunk_").distinct().count() == 4
    got = folds.ewm(df, {"e": ("close", 0.1)}, ["pair"], "ts", 86_400)
    assert got.count() == 5000


def test_empty_series(spark):
    _, df = series(spark)
    none = df.filter("false")
    assert folds.ewm(none, {"e": ("close", 0.1)}, ["pair"], "ts").count() == 0
    assert order_stats.expanding_quantile(none, "close", 0.5, ["pair"], "ts").count() == 0
    held = backtest.with_position(none, "signal", ["pair"], "ts")
    assert trades.run_trades(held, ["pair"], "ts", RULES).count() == 0
