"""Quality classifier on supervised subword embeddings.

The features of a text are its words, the 3- and 4-byte n-grams of its words (with
their ends marked) and its pairs of neighbouring words, hashed into one table of
learned vectors.  A document is the average of its feature vectors, classified by a
softmax; vectors and output are trained together by stochastic gradient descent in
numpy on a bounded sample of labelled rows.

As the average is linear, scoring needs one number per feature: its vector's
projection on the output.  A batch of texts is split, its distinct words are hashed
together as one array of bytes and their sums are dealt back to the documents.

Defined results for odd input
    null or empty text   the score of the bias alone
    no labels            every document scores 0.5
    repeated rows        one result row each
    empty table          an empty result with the full schema
    extra columns        ignored
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.sampling import by_hash, texts_of, training_labels
from tidemark.llm.shared import bounded_batches, give_back, split_words, text_or_empty

BUCKET_BITS = 17
DIMENSION = 8
HELD_OUT = (5, 0)
THRESHOLD = 0.3
_BASE = np.uint64(0x9E3779B97F4A7C15)


def slot_of(x: np.ndarray, kind: int) -> np.ndarray:
    """Hashes of features of one kind as rows of the table."""
    x = (x + np.uint64(kind)) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    return ((x * np.uint64(0x94D049BB133111EB)) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


@dataclass
class Words:
    """Distinct words: hash, and rows of the table of their n-grams; those of word w
    are ``grams[begins[w]:begins[w + 1]]``."""

    hash: np.ndarray
    grams: np.ndarray
    begins: np.ndarray

    @classmethod
    def of(cls, words: list[bytes]) -> Words:
        if not words:
            return cls(np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64), np.zeros(1, dtype=np.int64))
        data = np.frombuffer(b"<" + b"><".join(words) + b">", dtype=np.uint8).astype(np.uint64)
        size = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 2
        ends = np.cumsum(size)
        begin = np.repeat(ends - size, size)
        at = np.arange(len(data))
        power = np.cumprod(np.full(int(size.max()), _BASE))
        found = np.add.reduceat(data * power[at - begin], ends - size)
        three = (data[:-2] * _BASE + data[1:-1]) * _BASE + data[2:]
        four = three[:-1] * _BASE + data[3:]
        left = np.repeat(ends, size) - at  # bytes from here to the word's end
        rows, owner = [], []
        word = np.repeat(np.arange(len(words)), size)
        for kind, (n, gram) in enumerate(((3, three), (4, four)), 1):
            fits = np.flatnonzero(left[: len(gram)] >= n)
            rows.append(slot_of(gram[fits], kind))
            owner.append(word[fits])
        order = np.argsort(np.concatenate(owner), kind="stable")
        counts = np.bincount(np.concatenate(owner), minlength=len(words))
        return cls(found, np.concatenate(rows)[order], np.concatenate([[0], np.cumsum(counts)]))


def pair_slots(number: np.ndarray, hashes: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the table of all pairs of neighbouring words, and the positions of
    their first words."""
    first = np.ones(len(number), dtype=bool)
    first[begins[1:-1][begins[1:-1] < len(number)]] = False
    at = np.flatnonzero(first[1:])
    h = hashes[number]
    return slot_of(h[at] * _BASE + h[at + 1], 3), at


@dataclass
class Model:
    project: np.ndarray  # per row of the table: vector times (output 1 - output 0)
    bias: float

    def score(self, texts: pa.Array) -> np.ndarray:
        """Log odds of label 1."""
        number, names, begins = split_words(texts)
        words = Words.of(names)
        reach = np.diff(words.begins)
        value = np.concatenate([[0.0], np.cumsum(self.project[words.grams], dtype=np.float64)])
        value = value[words.begins[1:]] - value[words.begins[:-1]] + self.project[slot_of(words.hash, 0)]
        pairs, at = pair_slots(number, words.hash, begins)
        sums, count = value[number], reach[number] + 1
        sums[at] += self.project[pairs]
        count[at] += 1
        owner = np.repeat(np.arange(len(texts)), np.diff(begins))
        total = np.bincount(owner, sums, len(texts))
        return total / np.maximum(np.bincount(owner, count, len(texts)), 1) + self.bias


@dataclass
class Counted:
    """Training documents: distinct rows of the table and their shares in the average;
    those of document d lie in ``begins[d]:begins[d + 1]``."""

    slot: np.ndarray
    share: np.ndarray
    begins: np.ndarray


def counted(texts: pa.Array, at_once: int = 200) -> Counted:
    slots, shares, sizes = [], [], []
    for lo in range(0, len(texts), at_once):
        part = texts.slice(lo, at_once)
        number, names, begins = split_words(part)
        words = Words.of(names)
        owner = np.repeat(np.arange(len(part)), np.diff(begins))
        reach = np.diff(words.begins)[number]
        gram_at = np.repeat(words.begins[number] - np.concatenate([[0], np.cumsum(reach)[:-1]]), reach) + np.arange(reach.sum()) if len(number) else np.zeros(0, dtype=np.int64)
        pairs, at = pair_slots(number, words.hash, begins)
        of = np.concatenate([owner, np.repeat(owner, reach), owner[at]])
        slot = np.concatenate([slot_of(words.hash, 0)[number], words.grams[gram_at], pairs])
        key, times = np.unique(of << BUCKET_BITS | slot, return_counts=True)
        of = key >> BUCKET_BITS
        slots.append((key & ((1 << BUCKET_BITS) - 1)).astype(np.int32))
        shares.append((times / np.bincount(of, times, len(part))[of]).astype(np.float32))
        sizes.append(np.bincount(of, minlength=len(part)))
    none = [np.zeros(0, dtype=np.int64)]
    begins = np.concatenate([[0], np.cumsum(np.concatenate(sizes or none))]).astype(np.int64)
    return Counted(np.concatenate(slots or none), np.concatenate(shares or none), begins)


def train(
    docs: Counted,
    labels: np.ndarray,
    epochs: int = 5,
    min_steps: int = 400,
    batch: int = 64,
    rate: float = 0.5,
    seed: int = 11,
) -> Model:
    """Plain SGD with a linearly falling rate; gradients of vectors are scaled as for
    a sum over the documents of a batch.

    With two outputs the error of a document is (e, -e), so its gradients need no
    vector per feature: with g = the sum of share * e per row of the table, those of
    the vectors are g times the outputs' difference, and that of the outputs is the
    table's transpose times g."""
    size, n_docs = 1 << BUCKET_BITS, len(labels)
    if not n_docs:
        return Model(np.zeros(size, dtype=np.float32), 0.0)
    rng = np.random.default_rng(seed)
    table = (rng.uniform(-1, 1, (size, DIMENSION)) / DIMENSION).astype(np.float32)
    out, bias = np.zeros((DIMENSION, 2), dtype=np.float32), np.zeros(2)
    epochs = max(epochs, -(-min_steps * batch // n_docs))
    steps, done = epochs * -(-n_docs // batch), 0
    begins, width = docs.begins, np.diff(docs.begins)
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(n_docs), -(-n_docs // batch)):
            lr = rate * (1 - done / steps)
            done += 1
            reach = width[part]
            at = np.repeat(begins[part] - np.concatenate([[0], np.cumsum(reach)[:-1]]), reach) + np.arange(reach.sum())
            row, slot, share = np.repeat(np.arange(len(part)), reach), docs.slot[at], docs.share[at]
            apart = out[:, 1] - out[:, 0]
            odds = np.bincount(row, share * (table @ apart)[slot], len(part)) + bias[1] - bias[0]
            e = 1 / (1 + np.exp(-np.clip(odds, -30, 30))) - labels[part]  # error of output 1
            g = np.bincount(slot, share * e[row], size).astype(np.float32)
            pull = table.T @ g
            table -= lr * g[:, None] * apart
            out -= lr * np.stack([-pull, pull], axis=1) / np.sqrt(len(part))
            bias -= lr * np.array([-e.mean(), e.mean()])
    return Model((table @ (out[:, 1] - out[:, 0])).astype(np.float32), float(bias[1] - bias[0]))


def fit(
    docs: DataFrame, labels: DataFrame, max_rows: int = 4000, id_col: str = "doc_id", text_col: str = "text"
) -> Model:
    """Learns from at most ``max_rows`` labelled documents outside the held-out fold;
    their whole texts come to the driver."""
    chosen = by_hash(training_labels(labels, "quality", *HELD_OUT), max_rows)
    got = texts_of(docs, chosen, id_col, text_col).select("doc_id", "y", "text").toArrow()
    got = got.sort_by([("doc_id", "ascending"), ("text", "ascending")])
    texts = got["text"].combine_chunks() if len(got) else pa.array([], pa.string())
    return train(counted(texts), np.array(got["y"].to_pylist(), dtype=np.int64).clip(0, 1))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score and predicted for every whole text."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((model.project, model.bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        for b in batches:
            p = 1 / (1 + np.exp(-np.clip(own.score(b.column(1)), -30, 30)))
            cols = [b.column(0), pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "score", "predicted"])
        give_back()

    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return given.mapInArrow(run, "doc_id long, score double, predicted int")
