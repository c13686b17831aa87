"""Training of the two-branch network: back-propagation through time over partitions.

Labelled windows are packed once into rows of bounded size that hold numpy arrays.  A step
sends the weights out, every pack gives the sum of its gradients, and the sums are added by
a tree; the driver holds weights and moments only.  Packs are formed by a hash of series
and time and gradients are added as fixed-point numbers, so training is the same for any
number of partitions and any order of arrival.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.config import LONG_STEPS, SHORT_STEPS
from tidemark.operators import ml
from tidemark.operators.ml import TwoBranchNetwork

#: Units of the fixed-point numbers in which gradients are added.
UNITS = float(1 << 32)
#: Windows of a pack.
PACK = 1024


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


def branch_forward(x: np.ndarray, wx: np.ndarray, wh: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, list[tuple]]:
    """Last hidden state, and what the way back needs of every step."""
    n, width = len(x), wh.shape[0]
    h, c, kept = np.zeros((n, width), x.dtype), np.zeros((n, width), x.dtype), []
    for t in range(x.shape[1]):
        z = x[:, t] @ wx + h @ wh + b
        i, f, g, o = _sigmoid(z[:, :width]), _sigmoid(z[:, width : 2 * width]), np.tanh(z[:, 2 * width : 3 * width]), _sigmoid(z[:, 3 * width :])
        before, c = c, f * c + i * g
        squashed = np.tanh(c)
        kept.append((h, before, i, f, g, o, squashed))
        h = o * squashed
    return h, kept


def branch_backward(x: np.ndarray, wx: np.ndarray, wh: np.ndarray, kept: list[tuple], dh: np.ndarray) -> tuple[np.ndarray, ...]:
    """Gradients of the weights from that of the last hidden state."""
    dwx, dwh, db = np.zeros_like(wx), np.zeros_like(wh), np.zeros(wh.shape[1], wx.dtype)
    dc = np.zeros_like(dh)
    for t in range(x.shape[1] - 1, -1, -1):
        h, before, i, f, g, o, squashed = kept[t]
        dc = dc + dh * o * (1 - squashed * squashed)
        dz = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), dc * i * (1 - g * g), dh * squashed * o * (1 - o)], axis=1)
        dwx += x[:, t].T @ dz
        dwh += h.T @ dz
        db += dz.sum(axis=0)
        dh, dc = dz @ wh.T, dc * f
    return dwx, dwh, db


def loss_and_gradients(a: dict[str, np.ndarray], short: np.ndarray, long: np.ndarray, session: np.ndarray, y: np.ndarray, weight: np.ndarray, backward: bool = True) -> tuple[float, float, dict[str, np.ndarray]]:
    """Sum of weighted negative log likelihoods, sum of weights, and the gradients of the
    first."""
    ends, kept = zip(*(branch_forward(x, *(a[f"branch{k}_{n}"] for n in "xhb")) for k, x in enumerate((short, long))), strict=True)
    joined = np.concatenate([*ends, session], axis=1)
    pre = joined @ a["dense_w"] + a["dense_b"]
    hid = np.maximum(pre, 0)
    z = hid @ a["out_w"] + a["out_b"]
    z = z - z.max(axis=1, keepdims=True)
    log_p = z - np.log(np.exp(z).sum(axis=1, keepdims=True))
    rows, w = np.arange(len(y)), weight[y]
    loss = float(-(w * log_p[rows, y]).sum())
    if not backward:
        return loss, float(w.sum()), {}
    dz = np.exp(log_p)
    dz[rows, y] -= 1
    dz *= w[:, None].astype(dz.dtype)
    out = {"out_w": hid.T @ dz, "out_b": dz.sum(axis=0)}
    dpre = (dz @ a["out_w"].T) * (pre > 0)
    out |= {"dense_w": joined.T @ dpre, "dense_b": dpre.sum(axis=0)}
    dj, width = dpre @ a["dense_w"].T, a["branch0_h"].shape[0]
    for k, x in enumerate((short, long)):
        got = branch_backward(x, a[f"branch{k}_x"], a[f"branch{k}_h"], kept[k], dj[:, k * width : (k + 1) * width])
        out |= {f"branch{k}_{n}": g for n, g in zip("xhb", got, strict=True)}
    return loss, float(w.sum()), out


def packs(df: DataFrame, short: list[str], long: list[str], session: list[str], label: str, keys: list[str], ts: str, steps: int, rows: int = PACK) -> DataFrame:
    """step, pack and the arrays of its labelled windows.  ``df`` is one split, labels -1,
    0 and 1; windows count rows of a series as they stand."""
    s = ml.sequences(df, short, SHORT_STEPS, keys, ts).withColumnRenamed("seq", "short_")
    s = ml.sequences(s, long, LONG_STEPS, keys, ts).withColumnRenamed("seq", "long_")
    s = s.filter(F.col("long_").isNotNull() & F.col(label).isNotNull())
    n_packs = max(1, -(-s.select(label).count() // (steps * rows)))
    flags = F.array(*[F.coalesce(F.col(c).cast("float"), F.lit(0.0).cast("float")) for c in session])
    digest = F.xxhash64(*[F.col(k).cast("string") for k in keys], F.col(ts).cast("string"))
    s = s.select(F.flatten("short_").alias("short"), F.flatten("long_").alias("long"), flags.alias("session"), (F.col(label) + 1).cast("int").alias("y"), digest.alias("d"))
    s = s.withColumns({"step": F.pmod("d", F.lit(steps)).cast("int"), "pack": F.pmod(F.floor(F.col("d") / steps), F.lit(n_packs)).cast("int")})

    def pack(t: pa.Table) -> pa.Table:
        t = t.sort_by("d")
        flat = [t[c].combine_chunks().flatten().to_numpy().astype(np.float32).tobytes() for c in ("short", "long", "session")]
        cols = [pa.array([t[c][0].as_py()], pa.int32()) for c in ("step", "pack")] + [pa.array([b], pa.binary()) for b in flat]
        cols.append(pa.array([t["y"].to_numpy().astype(np.int8).tobytes()], pa.binary()))
        return pa.table(cols, names=["step", "pack", "short", "long", "session", "y"])

    return s.groupBy("step", "pack").applyInArrow(pack, "step int, pack int, short binary, long binary, session binary, y binary")


def _arrays(r, widths: tuple[int, int, int], kind: type) -> tuple[np.ndarray, ...]:
    y = np.frombuffer(r["y"], np.int8).astype(np.int64)
    shapes = ((len(y), SHORT_STEPS, widths[0]), (len(y), LONG_STEPS, widths[1]), (len(y), widths[2]))
    return (*(np.frombuffer(r[c], np.float32).reshape(s).astype(kind) for c, s in zip(("short", "long", "session"), shapes, strict=True)), y)


def summed(data: DataFrame, a: dict[str, np.ndarray], weight: np.ndarray, widths: tuple[int, int, int], backward: bool = True) -> tuple[float, float, dict[str, np.ndarray]]:
    """Loss, weight and gradients over all packs, added by a tree."""
    names, sc = list(a), data.sparkSession.sparkContext
    held = sc.broadcast((a, weight))

    def part(rows: Iterator) -> Iterator[np.ndarray]:
        arrays, w = held.value
        total = None
        for r in rows:
            loss, mass, grads = loss_and_gradients(arrays, *_arrays(r, widths, arrays["out_w"].dtype.type), w, backward)
            flat = np.concatenate([[loss, mass], *(grads[n].ravel() for n in names)]) if backward else np.array([loss, mass])
            whole = np.rint(flat.astype(np.float64) * UNITS).astype(np.int64)
            total = whole if total is None else total + whole
        if total is not None:
            yield total

    size = 2 + (sum(w.size for w in a.values()) if backward else 0)
    got = data.rdd.mapPartitions(part).treeAggregate(np.zeros(size, np.int64), np.add, np.add)
    held.unpersist()
    got = got / UNITS
    grads, at = {}, 2
    for n in names if backward else []:
        grads[n], at = got[at : at + a[n].size].reshape(a[n].shape), at + a[n].size
    return float(got[0]), float(got[1]), grads


def balanced(data: DataFrame) -> np.ndarray:
    """Weights of the three classes: rows over three times those of the class."""
    counts = data.rdd.map(lambda r: np.bincount(np.frombuffer(r["y"], np.int8), minlength=3)).treeAggregate(np.zeros(3), np.add, np.add)
    return counts.sum() / (3.0 * counts + 1e-8)


def train(
    train_rows: DataFrame,
    val_rows: DataFrame,
    short: list[str],
    long: list[str],
    session: list[str],
    label: str,
    keys: list[str],
    ts: str,
    hidden: int = 32,
    epochs: int = 50,
    steps: int = 8,
    rate: float = 0.001,
    patience: int = 10,
    seed: int = 42,
    kind: type = np.float32,
) -> tuple[TwoBranchNetwork, list[dict]]:
    """The network of the epoch with the least validation loss, and each epoch's losses.

    Adam with the usual moments over ``steps`` batches an epoch (by a hash of the rows);
    classes are weighted by their rarity in the training rows; training ends after
    ``patience`` epochs without a better validation loss."""
    widths = (len(short), len(long), len(session))
    data = packs(train_rows, short, long, session, label, keys, ts, steps).persist(StorageLevel.MEMORY_AND_DISK)
    check = packs(val_rows, short, long, session, label, keys, ts, 1).persist(StorageLevel.MEMORY_AND_DISK)
    net = TwoBranchNetwork(*widths, hidden, seed)
    a = {n: w.astype(kind) for n, w in net.arrays().items()}
    first, second = ({n: np.zeros(w.shape) for n, w in a.items()} for _ in range(2))
    weight, best, best_loss, waited, told, t = balanced(data), a, np.inf, 0, [], 0
    parts = [data.filter(F.col("step") == k) for k in range(steps)]
    for epoch in range(1, epochs + 1):
        lost, mass = 0.0, 0.0
        for part in parts:
            loss, w, grads = summed(part, a, weight, widths)
            if not w:
                continue
            lost, mass, t = lost + loss, mass + w, t + 1
            for n, g in grads.items():
                g = g / w
                first[n] = 0.9 * first[n] + 0.1 * g
                second[n] = 0.999 * second[n] + 0.001 * g * g
                move = rate * (first[n] / (1 - 0.9**t)) / (np.sqrt(second[n] / (1 - 0.999**t)) + 1e-8)
                a[n] = (a[n] - move).astype(kind)
        loss, w, _ = summed(check, a, weight, widths, backward=False)
        val = loss / w if w else float("nan")
        better = val < best_loss - 1e-6
        if better:
            best, best_loss, waited = {n: x.copy() for n, x in a.items()}, val, 0
        else:
            waited += 1
        told.append({"epoch": epoch, "train_loss": lost / mass if mass else float("nan"), "val_loss": val, "best": better})
        if waited >= patience:
            break
    data.unpersist()
    check.unpersist()
    return net.with_arrays(best), told
