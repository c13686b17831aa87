"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives; a sample of all training text, toxic
or not, is the unlabelled set.  A logistic model over hashed word presence is
trained in numpy with the non-negative risk estimator

    prior * R_P(+)  +  max(0, R_U(-) - prior * R_P(-))

(whenever the bracket would fall below zero its gradient is reversed), so texts
without a label are never taken for clean ones.  The class prior is the share of
toxic rows among the labelled training rows.

Both samples are bounded (``max_positive``, ``max_unlabelled``); features are
extracted by the executors and only hashed word numbers reach the driver.  Scoring
covers every whole text, with nothing shuffled.

Defined results for odd input
    null or empty text      the score of a text without words
    no labelled positives   every document scores the same, below 1e-12
    repeated rows           one result row each
    empty table             an empty result with the full schema
    extra columns           ignored
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.sampling import by_hash, texts_of, training_labels
from tidemark.llm.shared import bounded_batches, give_back, id_bucket, text_or_empty

HELD_OUT = (4, 2)
THRESHOLD = 0.3
_WORDS = re.compile(r"[^\W\d_]+").findall


def word_slot(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) >> 1


def distinct_slots(text: str) -> list[int]:
    """Hashed numbers of the distinct words (letter runs, any case) of a text."""
    return sorted({word_slot(w) for w in set(_WORDS(text.lower()))})


@dataclass
class Model:
    weights: dict[int, float]  # word slot -> weight; all others weigh nothing
    bias: float
    prior: float


def _sums(values: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Sums of ``values`` over consecutive rows; empty rows sum to 0."""
    total = np.concatenate([[0.0], np.cumsum(values)])
    return total[begins[1:]] - total[begins[:-1]]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class _Rows:
    """Slot lists of documents, one after another in one array."""

    def __init__(self, slots: np.ndarray, begins: np.ndarray) -> None:
        self.slots, self.begins = slots, begins

    @classmethod
    def of(cls, rows: list) -> _Rows:
        begins = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
        return cls(np.concatenate([*rows, np.zeros(0, dtype=np.int32)]).astype(np.int32), begins)

    @classmethod
    def of_column(cls, lists: pa.ChunkedArray) -> _Rows:
        column = lists.combine_chunks() if lists.num_chunks else pa.array([], pa.list_(pa.int32()))
        widths = pc.list_value_length(column).to_numpy(zero_copy_only=False)
        return cls(column.flatten().to_numpy(), np.concatenate([[0], np.cumsum(widths)]).astype(np.int64))

    def __len__(self) -> int:
        return len(self.begins) - 1

    def only(self, slots: np.ndarray) -> _Rows:
        """The same rows, reduced to ``slots`` (sorted) and numbered by place there."""
        at = np.minimum(np.searchsorted(slots, self.slots), max(len(slots) - 1, 0))
        held = slots[at] == self.slots if len(slots) else np.zeros(len(self.slots), dtype=bool)
        total = np.concatenate([[0], np.cumsum(held)])
        return _Rows(at[held].astype(np.int64), total[self.begins])

    def batch(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        parts = [self.slots[self.begins[i] : self.begins[i + 1]] for i in which]
        begins = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
        return np.concatenate([*parts, np.zeros(0, dtype=np.int64)]), begins


def telling(pos: _Rows, unl: _Rows, least: int = 3, ratio: float = 3.0, deviations: float = 4.0) -> np.ndarray:
    """Slots that positives hold clearly more often than unlabelled text does; the
    model learns weights for these alone."""
    slots, have = np.unique(pos.slots, return_counts=True)
    slots, have = slots[have >= least], have[have >= least]
    others, n = np.unique(unl.slots, return_counts=True)
    at = np.minimum(np.searchsorted(others, slots), max(len(others) - 1, 0))
    elsewhere = np.where(others[at] == slots, n[at], 0) if len(others) else np.zeros(len(slots))
    p, q = have / len(pos), (elsewhere + 1) / (len(unl) + 1)
    return slots[(p >= ratio * q) & (p - q >= deviations * np.sqrt(q / len(pos)))]


def risk(fp: np.ndarray, fu: np.ndarray, prior: float) -> tuple[float, np.ndarray, np.ndarray]:
    """What a step makes smaller, and its gradients by the outputs for positive and
    unlabelled texts.  Logistic losses: l(+) = log(1 + e^-f), l(-) = log(1 + e^f)."""
    bracket = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
    minus_p, minus_u = -prior * _sigmoid(fp) / len(fp), _sigmoid(fu) / len(fu)
    if bracket < 0:  # overfitted: away from it
        return -bracket, -minus_p, -minus_u
    plus = prior * np.logaddexp(0, -fp).mean()
    return plus + bracket, minus_p - prior * _sigmoid(-fp) / len(fp), minus_u


def train(
    pos: _Rows,
    unl: _Rows,
    prior: float,
    steps: int = 1500,
    batch: int = 256,
    rate: float = 0.05,
    decay: float = 1e-4,
    seed: int = 7,
) -> Model:
    """Adam on the non-negative risk, logistic loss."""
    if not len(pos) or not len(unl) or prior <= 0:
        return Model({}, -30.0, 0.0)
    slots = telling(pos, unl)
    pos, unl, size = pos.only(slots), unl.only(slots), len(slots)
    rng = np.random.default_rng(seed)
    w, bias = np.zeros(size), float(np.log(prior / (1 - prior)) if prior < 1 else 30.0)
    m, v, mb, vb = np.zeros(size), np.zeros(size), 0.0, 0.0
    for step in range(1, steps + 1):
        sp, bp = pos.batch(rng.integers(0, len(pos), min(batch, len(pos))))
        su, bu = unl.batch(rng.integers(0, len(unl), min(2 * batch, len(unl))))
        fp, fu = _sums(w[sp], bp) + bias, _sums(w[su], bu) + bias
        _, gp, gu = risk(fp, fu, prior)
        g = np.bincount(sp, np.repeat(gp, np.diff(bp)), size) + np.bincount(su, np.repeat(gu, np.diff(bu)), size)
        g, gb = g + decay * w, float(gp.sum() + gu.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        fix1, fix2 = 1 - 0.9**step, 1 - 0.999**step
        slower = rate * (1 - step / (steps + 1))
        w -= slower * (m / fix1) / (np.sqrt(v / fix2) + 1e-6)
        bias -= slower * (mb / fix1) / (np.sqrt(vb / fix2) + 1e-6)
    return Model(dict(zip(slots.tolist(), w.tolist(), strict=True)), float(bias), prior)


def fit(
    docs: DataFrame,
    labels: DataFrame,
    max_positive: int = 4000,
    max_unlabelled: int = 8000,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> Model:
    """Learns from documents whose identifier does not fall into the held-out fold."""
    known = training_labels(labels, "toxic", *HELD_OUT)
    n, n_toxic = known.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0))).first()
    if not n or not n_toxic:
        return train(_Rows.of([]), _Rows.of([]), 0.0)
    toxic = by_hash(known.filter("y = 1"), max_positive).select("doc_id", F.lit(1).alias("role"))
    ids = docs.select(F.col(id_col).cast("long").alias("doc_id")).filter(F.col("doc_id").isNotNull())
    ids = ids.filter(id_bucket("doc_id", HELD_OUT[0]) != HELD_OUT[1])
    some = by_hash(ids, max_unlabelled).distinct().select("doc_id", F.lit(0).alias("role"))
    texts = texts_of(docs, toxic.unionByName(some), id_col, text_col).select("role", "text", "doc_id")

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = pa.array([distinct_slots(t.as_py()) for t in b.column(1)], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), found, b.column(2)], names=["role", "slots", "doc_id"])

    got = texts.mapInArrow(slots, "role int, slots array<int>, doc_id long").toArrow().sort_by("doc_id")
    pos, unl = (_Rows.of_column(got.filter(pc.field("role") == r)["slots"]) for r in (1, 0))
    return train(pos, unl, n_toxic / n)


class _Weights(dict):
    """word -> weight, kept for words met before (bounded)."""

    def __init__(self, weights: dict[int, float], limit: int = 300_000) -> None:
        self.weights, self.limit = weights, limit

    def __missing__(self, word: str) -> float:
        if len(self) >= self.limit:
            self.clear()
        got = self[word] = self.weights.get(word_slot(word), 0.0)
        return got


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score and predicted for every whole text."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = shared.value
        look = _Weights(weights).__getitem__
        for b in batches:
            f = np.empty(b.num_rows)
            for i, t in enumerate(b.column(1)):
                f[i] = sum(map(look, set(_WORDS(t.as_py().lower()))))
            p = _sigmoid(np.clip(f + bias, -30, 30))
            cols = [b.column(0), pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "score", "predicted"])
        del look
        give_back()

    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return given.mapInArrow(run, "doc_id long, score double, predicted int")


def kept(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, all columns."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = shared.value
        look = _Weights(weights).__getitem__
        for b in batches:
            words = (set(_WORDS((t.as_py() or "").lower())) for t in b.column(at))
            f = np.array([sum(map(look, w)) for w in words], dtype=np.float64)
            stay = _sigmoid(np.clip(f + bias, -30, 30)) < THRESHOLD
            yield b.filter(pa.array(stay))
        del look
        give_back()

    return docs.mapInArrow(run, docs.schema)
