"""The network: gradients by finite differences, training over any partitions, scoring in
chunks, checkpoints."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.config import LONG_STEPS, SHORT_STEPS
from tidemark.operators import ml, training

SHORT, LONG, SESSION = ["a", "b"], ["b", "c"], ["s0", "s1"]


def rows(n=260, pairs=("A", "B"), seed=0):
    rng = np.random.default_rng(seed)
    parts = []
    for p in pairs:
        x = np.round(rng.normal(size=(n, 3)), 3)
        y = np.where(x[:, 0] > 0.6, 1, np.where(x[:, 0] < -0.6, -1, 0))
        parts.append(pd.DataFrame({"pair": p, "ts": pd.date_range("2024-01-01", periods=n, freq="min"), "a": x[:, 0], "b": x[:, 1], "c": x[:, 2], "s0": rng.integers(0, 2, n), "s1": 1.0, "label": y}))
    return pd.concat(parts, ignore_index=True)


def test_gradients_equal_finite_differences():
    rng = np.random.default_rng(1)
    net = ml.TwoBranchNetwork(2, 3, 2, hidden=3)
    a = {n: w.astype(float) + 0.1 * rng.normal(size=w.shape) for n, w in net.arrays().items()}
    data = rng.normal(size=(5, SHORT_STEPS, 2)), rng.normal(size=(5, LONG_STEPS, 3)), rng.normal(size=(5, 2)), np.array([0, 1, 2, 1, 0])
    weight = np.array([0.5, 2.0, 1.3])
    _, mass, grads = training.loss_and_gradients(a, *data, weight)
    assert mass == pytest.approx(0.5 * 2 + 2.0 * 2 + 1.3)
    for name, g in grads.items():
        for at in [tuple(rng.integers(0, k) for k in g.shape) for _ in range(6)]:
            sides = []
            for e in (1e-5, -1e-5):
                b = {n: w.copy() for n, w in a.items()}
                b[name][at] += e
                sides.append(training.loss_and_gradients(b, *data, weight, backward=False)[0])
            assert g[at] == pytest.approx((sides[0] - sides[1]) / 2e-5, rel=1e-4, abs=1e-7), (name, at)


def test_forward_is_the_scoring_network():
    rng = np.random.default_rng(2)
    net = ml.TwoBranchNetwork(2, 3, 2, hidden=4)
    s, g, f = (rng.normal(size=k).astype(np.float32) for k in ((6, SHORT_STEPS, 2), (6, LONG_STEPS, 3), (6, 2)))
    y = np.array([0, 1, 2, 0, 1, 2])
    loss, _, _ = training.loss_and_gradients(net.arrays(), s, g, f, y, np.ones(3), backward=False)
    assert loss == pytest.approx(-net.log_probs(s, g, f)[np.arange(6), y].sum(), rel=1e-4)


def trained(spark, pdf, partitions, **kw):
    df = spark.createDataFrame(pdf).repartition(partitions)
    cut = F.lit("2024-01-01 03:00:00").cast("timestamp")
    return training.train(df.filter(F.col("ts") < cut), df.filter(F.col("ts") >= cut), SHORT, LONG, SESSION, "label", ["pair"], "ts", hidden=4, steps=2, **kw)


def test_same_for_any_partitioning(spark):
    pdf = rows()
    net1, told1 = trained(spark, pdf, 1, epochs=3)
    net2, told2 = trained(spark, pdf.sample(frac=1, random_state=3), 7, epochs=3)
    assert told1 == told2
    for n, w in net1.arrays().items():
        assert (w == net2.arrays()[n]).all()


def test_learns_and_stops(spark):
    pdf = rows(n=300, pairs=("A", "B", "C"))
    _, told = trained(spark, pdf, 4, epochs=12, rate=0.05)
    assert told[-1]["train_loss"] < 0.7 * told[0]["train_loss"] < 0.9
    _, still = trained(spark, pdf, 4, epochs=9, rate=0.0, patience=2)
    assert [t["best"] for t in still] == [True, False, False]


def test_a_step_is_the_whole_batch(spark):
    """Against plain Adam over all windows at once."""
    pdf = rows(n=120, pairs=("A",))
    df = spark.createDataFrame(pdf)
    net, _ = training.train(df, df, SHORT, LONG, SESSION, "label", ["pair"], "ts", hidden=3, steps=1, epochs=1, kind=np.float64)
    x = {c: pdf[c].to_numpy(np.float32).astype(float) for c in pdf.columns if c not in ("pair", "ts")}
    view = np.lib.stride_tricks.sliding_window_view
    s = view(np.stack([x[c] for c in SHORT], 1), SHORT_STEPS, axis=0)[LONG_STEPS - SHORT_STEPS :].transpose(0, 2, 1)
    g = view(np.stack([x[c] for c in LONG], 1), LONG_STEPS, axis=0).transpose(0, 2, 1)
    f, y = np.stack([x[c] for c in SESSION], 1)[LONG_STEPS - 1 :], (pdf["label"].to_numpy() + 1)[LONG_STEPS - 1 :]
    weight = len(y) / (3 * np.bincount(y, minlength=3) + 1e-8)
    a = {n: w.astype(float) for n, w in ml.TwoBranchNetwork(2, 2, 2, 3).arrays().items()}
    _, mass, grads = training.loss_and_gradients(a, s, g, f, y, weight)
    for n, w in net.arrays().items():
        step = 0.001 * (grads[n] / mass) / (np.abs(grads[n] / mass) + 1e-8)
        assert np.allclose(w, a[n] - step, atol=2e-5), n


def test_no_rows(spark):
    df = spark.createDataFrame(rows()).filter("false")
    _, told = training.train(df, df, SHORT, LONG, SESSION, "label", ["pair"], "ts", hidden=3, epochs=2, steps=1)
    assert len(told) == 2 and not any(t["best"] for t in told)


@pytest.mark.parametrize("seconds", [60, 60 * 45, 10**9])
def test_scoring_in_chunks(spark, seconds):
    pdf = rows(n=150)
    net = ml.TwoBranchNetwork(2, 2, 2, hidden=4)
    df = spark.createDataFrame(pdf.sample(frac=1, random_state=1))
    got = ml.network_signals(df, net, SHORT, LONG, SESSION, ["pair"], "ts", batch=16, seconds=seconds).orderBy("pair", "ts").toPandas()
    for pair, p in pdf.groupby("pair"):
        want = np.zeros(len(p), int)
        for i in range(LONG_STEPS, len(p)):
            part = lambda cols, k, i=i, p=p: p[cols].to_numpy(np.float32)[None, i - k + 1 : i + 1]
            want[i] = net.log_probs(part(SHORT, SHORT_STEPS), part(LONG, LONG_STEPS), p[SESSION].to_numpy(np.float32)[i : i + 1]).argmax() - 1
        assert (got[got["pair"] == pair]["signal"].to_numpy() == want).all()


def test_checkpoint(spark, tmp_path):
    net = ml.TwoBranchNetwork(2, 3, 4, hidden=5, seed=9)
    ml.save_network(net, spark, str(tmp_path / "net"), val_loss=0.25)
    back, about = ml.load_network(spark, str(tmp_path / "net"))
    assert about == {"val_loss": 0.25} and all((w == back.arrays()[n]).all() for n, w in net.arrays().items())
    with pytest.raises(ValueError):
        ml.TwoBranchNetwork(2, 3, 4, hidden=6).with_arrays(net.arrays())
