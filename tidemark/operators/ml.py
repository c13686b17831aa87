"""Model fitting and scoring: multinomial logistic regression and a two-branch
recurrent network."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.config import LONG_STEPS, LR_STRENGTHS, SHORT_STEPS
from tidemark.operators import folds, splits


def scaled(df: DataFrame, scaler: DataFrame, features: list[str]) -> DataFrame:
    """``x``: features in the scaler's own order, nulls as 0, standardised.  ``scaler``
    has one row per feature (pos, feature, mean, scale)."""
    rows = scaler.orderBy("pos").collect()  # a few dozen rows: the column contract
    missing = [r["feature"] for r in rows if r["feature"] not in df.columns]
    if missing:
        raise KeyError(f"missing features: {', '.join(missing)}")
    parts = [(F.coalesce(F.col(r["feature"]).cast("double"), F.lit(0.0)) - r["mean"]) / r["scale"] for r in rows]
    return df.withColumn("x", F.array(*parts))


def fit_logistic(df: DataFrame, features: list[str], label: str, strength: float = 1.0, max_iter: int = 1000):
    """L2 multinomial fit with balanced weights; labels -1, 0, 1 become 0, 1, 2."""
    rows = df.filter(F.col(label).isNotNull()).withColumn("y", (F.col(label) + 1).cast("double"))
    counts = rows.groupBy("y").agg(F.count(F.lit(1)).alias("c"))
    k, n = counts.count(), rows.count()
    rows = rows.join(F.broadcast(counts), "y").withColumn("w", F.lit(float(n)) / (k * F.col("c")))
    inputs = VectorAssembler(inputCols=features, outputCol="v", handleInvalid="keep")
    lr = LogisticRegression(
        featuresCol="v", labelCol="y", weightCol="w", family="multinomial", standardization=False,
        maxIter=max_iter, tol=1e-8, regParam=1.0 / (strength * n),
    )
    filled = rows.fillna(0.0, features)
    return lr.fit(inputs.transform(filled)), inputs


def sweep(train: DataFrame, val: DataFrame, features: list[str], label: str, value, strengths=LR_STRENGTHS):
    """The first strength with the highest ``value(scored validation)``."""
    best = None
    for c in strengths:
        model, inputs = fit_logistic(train, features, label, c)
        got = value(predict(model, inputs, val, features))
        if best is None or got > best[0]:
            best = (got, c, model, inputs)
    return best


def predict(model, inputs, df: DataFrame, features: list[str]) -> DataFrame:
    """Adds ``signal``: most likely class minus 1."""
    out = model.transform(inputs.transform(df.fillna(0.0, features)))
    return out.withColumn("signal", (F.col("prediction") - 1).cast("tinyint")).drop("v", "rawPrediction", "probability")


def probabilities(model, inputs, df: DataFrame, features: list[str]) -> DataFrame:
    out = model.transform(inputs.transform(df.fillna(0.0, features)))
    return out.withColumn("p", vector_to_array("probability")).drop("v", "rawPrediction", "probability")


def importance(model, features: list[str], top: int = 5) -> list[tuple[str, float]]:
    """Mean absolute coefficient over classes, largest first."""
    w = np.abs(model.coefficientMatrix.toArray()).mean(axis=0)
    if len(w) != len(features):
        return []
    order = sorted(range(len(w)), key=lambda i: (-w[i], i))[:top]
    return [(features[i], round(float(w[i]), 6)) for i in order]


def sequences(df: DataFrame, features: list[str], steps: int, keys: list[str], ts: str) -> DataFrame:
    """``seq``: the last ``steps`` rows as an array of arrays, null before there are so
    many."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy(ts).rowsBetween(-(steps - 1), 0)
    row = F.array(*[F.coalesce(F.col(f).cast("float"), F.lit(0.0).cast("float")) for f in features])
    seq = F.collect_list(row).over(w)
    return df.withColumn("seq", F.when(F.size(seq) == steps, seq))


def session_sequences(
    df: DataFrame, features: list[str], steps: int, keys: list[str], ts: str, labels: list[str] | None = None, session: str = "session", step: str | None = None
) -> DataFrame:
    """Windows for training on the rows of some sessions (null: all).

    Without ``step`` the rows left are one series, so a window may go on from one day's
    session to the next one's; with it no window crosses a gap of more than ``step``."""
    kept = df.filter(F.col(session).isin(labels)) if labels else df
    if step is None:
        return sequences(kept, features, steps, keys, ts)
    return sequences(splits.islands(kept, keys, ts, step, "island_"), features, steps, [*keys, "island_"], ts).drop("island_")


class TwoBranchNetwork:
    """Two recurrent branches (short and long windows) and session flags into a dense
    layer and three classes; numpy forward pass with seeded or given weights."""

    def __init__(self, short: int, long: int, session: int = 4, hidden: int = 32, seed: int = 42) -> None:
        rng = np.random.default_rng(seed)
        draw = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.hidden = hidden
        self.branches = [(draw(n, 4 * hidden), draw(hidden, 4 * hidden), np.zeros(4 * hidden, np.float32)) for n in (short, long)]
        self.dense = (draw(2 * hidden + session, 32), np.zeros(32, np.float32))
        self.out = (draw(32, 3), np.zeros(3, np.float32))

    def arrays(self) -> dict[str, np.ndarray]:
        """All weights by name."""
        out = {f"branch{k}_{n}": w for k, branch in enumerate(self.branches) for n, w in zip("xhb", branch, strict=True)}
        return out | {"dense_w": self.dense[0], "dense_b": self.dense[1], "out_w": self.out[0], "out_b": self.out[1]}

    def with_arrays(self, arrays: dict[str, np.ndarray]) -> TwoBranchNetwork:
        for name, old in self.arrays().items():
            if name not in arrays or arrays[name].shape != old.shape:
                raise ValueError(f"checkpoint does not fit: {name}")
        a = {n: np.asarray(w, np.float32) for n, w in arrays.items()}
        self.branches = [tuple(a[f"branch{k}_{n}"] for n in "xhb") for k in (0, 1)]
        self.dense, self.out = (a["dense_w"], a["dense_b"]), (a["out_w"], a["out_b"])
        return self

    def _run(self, x: np.ndarray, branch: tuple) -> np.ndarray:
        wx, wh, b = branch
        n = self.hidden
        # a gate is 1/2 (1 + tanh(z / 2)): with its weights halved, one tanh serves all
        scale = np.full(4 * n, 0.5, np.float32)
        scale[2 * n : 3 * n] = 1
        half = lambda w: w * scale
        h, c = np.zeros((len(x), n), np.float32), np.zeros((len(x), n), np.float32)
        steps = np.ascontiguousarray(x.transpose(1, 0, 2))
        inputs = (steps.reshape(-1, x.shape[2]) @ half(wx) + half(b)).reshape(len(steps), len(x), 4 * n)
        wh = half(wh)
        for z in inputs:
            z += h @ wh
            np.tanh(z, out=z)
            i, f, g, o = z[:, :n], z[:, n : 2 * n], z[:, 2 * n : 3 * n], z[:, 3 * n :]
            c = 0.5 * ((1 + f) * c + (1 + i) * g)
            h = 0.5 * (1 + o) * np.tanh(c)
        return h

    def log_probs(self, short: np.ndarray, long: np.ndarray, session: np.ndarray) -> np.ndarray:
        both = [self._run(short, self.branches[0]), self._run(long, self.branches[1]), session]
        hid = np.maximum(np.concatenate(both, axis=1) @ self.dense[0] + self.dense[1], 0)
        z = hid @ self.out[0] + self.out[1]
        z = z - z.max(axis=1, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def network_signals(
    df: DataFrame,
    net: TwoBranchNetwork,
    short: list[str],
    long: list[str],
    session: list[str],
    keys: list[str],
    ts: str,
    batch: int = 512,
    seconds: float = 5 * 86_400,
) -> DataFrame:
    """Adds ``signal``; the first ``LONG_STEPS`` rows of a series are 0.

    A chunk of time is scored by one task, with the rows before it that its first windows
    reach back to; windows are strided views of one array."""
    shared = df.sparkSession.sparkContext.broadcast(net)
    cols = list(dict.fromkeys([*short, *long]))
    at = [[cols.index(c) for c in side] for side in (short, long)]
    take = lambda pdf, names: pdf[names].fillna(0).to_numpy(np.float32)

    def tail(pdf: pd.DataFrame) -> tuple[int, np.ndarray]:
        return len(pdf), take(pdf.tail(LONG_STEPS - 1), cols)

    def advance(state: tuple, summary: tuple) -> tuple:
        return state[0] + summary[0], np.concatenate([state[1], summary[1]])[-(LONG_STEPS - 1) :]

    def replay(pdf: pd.DataFrame, state: tuple) -> dict:
        seen, before = state
        x = np.concatenate([before, take(pdf, cols)])
        signal, first = np.zeros(len(pdf), dtype=np.int8), LONG_STEPS - 1 - len(before)
        if len(x) >= LONG_STEPS:
            view = np.lib.stride_tricks.sliding_window_view
            s = view(x[:, at[0]], SHORT_STEPS, axis=0)[LONG_STEPS - SHORT_STEPS :]
            g = view(x[:, at[1]], LONG_STEPS, axis=0)
            flags = take(pdf, session)[first:]
            for lo in range(0, len(g), batch):
                part = slice(lo, lo + batch)
                got = shared.value.log_probs(s[part].transpose(0, 2, 1), g[part].transpose(0, 2, 1), flags[part])
                signal[first + lo : first + lo + len(got)] = got.argmax(axis=1) - 1
        signal[: max(LONG_STEPS - seen, 0)] = 0
        return {"signal": signal}

    fold = folds.Fold((0, np.zeros((0, len(cols)), np.float32)), tail, advance)
    return folds.with_columns(df.drop("signal"), keys, ts, fold, replay, {"signal": T.ByteType()}, seconds)


def save_network(net: TwoBranchNetwork, spark, path: str, **about) -> None:
    """A checkpoint as a small table: a row per array, and what is told about it."""
    rows = [(n, [int(k) for k in w.shape], [float(v) for v in w.ravel()]) for n, w in net.arrays().items()]
    rows += [(f"about:{k}", [], [float(v)]) for k, v in about.items()]
    spark.createDataFrame(rows, "name string, shape array<int>, vals array<double>").coalesce(1).write.mode("overwrite").parquet(path)


def load_network(spark, path: str) -> tuple[TwoBranchNetwork, dict[str, float]]:
    rows = spark.read.parquet(path).collect()
    about = {r["name"][6:]: r["vals"][0] for r in rows if r["name"].startswith("about:")}
    arrays = {r["name"]: np.array(r["vals"]).reshape(r["shape"]) for r in rows if not r["name"].startswith("about:")}
    sizes = [arrays[f"branch{k}_x"].shape[0] for k in (0, 1)]
    hidden = arrays["branch0_h"].shape[0]
    net = TwoBranchNetwork(*sizes, arrays["dense_w"].shape[0] - 2 * hidden, hidden)
    return net.with_arrays(arrays), about


def save_model(model, scaler: DataFrame, path: str) -> None:
    """A fitted model and its scaler table (the order of its columns)."""
    model.write().overwrite().save(f"{path}/model")
    scaler.coalesce(1).write.mode("overwrite").parquet(f"{path}/scaler")


def load_model(spark, path: str):
    from pyspark.ml.classification import LogisticRegressionModel

    return LogisticRegressionModel.load(f"{path}/model"), spark.read.parquet(f"{path}/scaler")


def model_strategy(model, inputs, features: list[str], warmup: int = 0):
    """A fitted classifier as a strategy: most likely class, cooldown 0."""
    from tidemark.operators.strategies import Strategy

    def signal(bars: DataFrame, keys: list[str], order: str) -> DataFrame:
        missing = sorted(set(features) - set(bars.columns))
        if missing:
            raise KeyError(f"missing features: {', '.join(missing)}")
        return predict(model, inputs, bars, features).drop("prediction")

    return Strategy("LR", warmup, 0, {"features": features}, signal)
