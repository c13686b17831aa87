"""Exact quantiles of everything so far, on order statistics that merge.

A series is cut into chunks of time (``folds.with_chunk``), or of rows by number where the
clock is dense, and its values into buckets, by bounds that the chunks' own quantiles give.
Per chunk and bucket a cell holds the
distinct values and how often they occur: counts indexed by rank, which add up over
chunks.  Within a chunk of n rows the order statistic sought moves by n ranks at most, so a
chunk needs of all rows before it only their number below and the cells around that place,
some n values; it gets those, puts its own rows into their order and moves a pointer
through it, one rank at a time.

No task holds more than a chunk and the cells sent to it; cells are sent once for each
chunk that looks at their bucket.  Any bounds give the same result.  The rows and the cells
are written to the shared folder once, as several passes read them.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.folds import CHUNK_SECONDS, sorted_rows, with_chunk
from tidemark.operators.numbering import numbered
from tidemark.sources.tables import written

#: Quantiles that a chunk gives for the bounds, and buckets of a series.
SAMPLES, BUCKETS = 64, 1024
#: Rows that a chunk may have.
CHUNK_ROWS = 50_000


def bounds_of(samples: list[np.ndarray], counts: np.ndarray, buckets: int) -> np.ndarray:
    """Values that part the chunks' samples, weighted by their rows, in equal shares."""
    values = np.concatenate([s for s in samples if len(s)] or [np.zeros(0)])
    weights = np.concatenate([np.full(len(s), n / len(s)) for s, n in zip(samples, counts, strict=True) if len(s)] or [np.zeros(0)])
    if not len(values):
        return values
    o = np.argsort(values, kind="stable")
    share = np.cumsum(weights[o]) / weights.sum()
    at = np.searchsorted(share, np.arange(1, buckets) / buckets)
    return np.unique(values[o][np.minimum(at, len(o) - 1)])


def cells_of(x: np.ndarray, bounds: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(bucket, distinct values, how often) of a chunk."""
    values, often = np.unique(x[~np.isnan(x)], return_counts=True)
    bucket = np.searchsorted(bounds, values, side="right")
    cut = np.flatnonzero(np.diff(bucket)) + 1
    return [(int(b[0]), v, n) for b, v, n in zip(*(np.split(a, cut) for a in (bucket, values, often)), strict=True) if len(v)]


def wanted(chunks: np.ndarray, bucket: np.ndarray, n: np.ndarray, every: np.ndarray, q: float) -> list[tuple[int, int, int, int, int]]:
    """Per chunk of ``every``: rows with a value before it, those below the first bucket
    it needs, and that bucket and the last one (first > last: none)."""
    total = np.zeros(int(bucket.max(initial=-1)) + 1, dtype=np.int64)
    order = np.argsort(chunks, kind="stable")
    chunks, bucket, n = chunks[order], bucket[order], n[order]
    out = []
    for c in np.sort(every):
        mine = slice(*np.searchsorted(chunks, [c, c + 1]))
        own, before = int(n[mine].sum()), int(total.sum())
        if before and own:
            low = max(0, math.floor(q * (before - 1)) - own)
            high = min(before - 1, math.ceil(q * (before + own - 1)) + 1)
            upto = np.cumsum(total)
            first, last = (int(np.searchsorted(upto, r, side="right")) for r in (low, high))
            out.append((int(c), before, int(upto[first] - total[first]), first, last))
        elif before:  # no values of its own: only the place itself
            place = q * (before - 1)
            upto = np.cumsum(total)
            first, last = (int(np.searchsorted(upto, r, side="right")) for r in (math.floor(place), math.ceil(place)))
            out.append((int(c), before, int(upto[first] - total[first]), first, last))
        else:
            out.append((int(c), 0, 0, 1, 0))
        np.add.at(total, bucket[mine], n[mine])
    return out


def quantiles(x: np.ndarray, q: float, least: int, before: int, below: int, values: np.ndarray, often: np.ndarray) -> np.ndarray:
    """The interpolated quantile at every row of a chunk, of ``before`` earlier values and
    the chunk's so far.  ``values`` and ``often`` are the earlier values around the place,
    ``below`` the number of those left out under them.

    Rows are taken out from the last to the first; the pointer moves along what is left."""
    known, at = np.unique(values, return_inverse=True)
    count = np.bincount(at, weights=often, minlength=len(known)).astype(np.int64)
    seen = ~np.isnan(x)
    own = x[seen]
    both = np.concatenate([known, own])
    order = np.argsort(both, kind="stable")
    place = np.empty(len(both), dtype=np.int64)
    place[order] = np.arange(len(both))
    val, cnt = both[order].tolist(), np.concatenate([count, np.ones(len(own), np.int64)])[order].tolist()
    item, size = place[len(known) :].tolist(), len(both)
    after, prior = list(range(1, size + 1)), list(range(-1, size - 1))
    so_far = (before + np.cumsum(seen)).tolist()
    out, p, j = np.full(len(x), np.nan), 0, len(own)
    for i in range(len(x) - 1, -1, -1):
        m = so_far[i]
        if m >= max(1, least):
            t = q * (m - 1)
            k = int(t)
            while k < below:
                p = prior[p]
                below -= cnt[p]
            while k >= below + cnt[p]:
                below += cnt[p]
                p = after[p]
            v = val[p]
            if t != k:
                up = v if k + 1 < below + cnt[p] else val[after[p]]
                v += (up - v) * (t - k)
            out[i] = v
        if seen[i]:
            j -= 1
            it = item[j]
            cnt[it] -= 1
            if it < p:
                below -= 1
            if not cnt[it]:
                a, b = prior[it], after[it]
                if a >= 0:
                    after[a] = b
                if b < size:
                    prior[b] = a
                if it == p and b < size:
                    p = b
                elif it == p and a >= 0:
                    p, below = a, below - cnt[a]
    return out


def chunked(df: DataFrame, keys: list[str], order: str | list[str], seconds: float, rows: int) -> DataFrame:
    """``df`` with ``chunk_``, written.  Chunks are spans of time; if any holds over ``rows``
    rows, the rows of each series are numbered in order and cut by their numbers, so that
    a chunk is bounded however many rows share a span or an instant."""
    at = written(with_chunk(df, order, seconds), "quantile-rows")
    most = at.groupBy(*keys, "chunk_").count().agg(F.max("count")).first()[0]
    if (most or 0) <= rows:
        return at
    placed = numbered(at.drop("chunk_"), keys, [order] if isinstance(order, str) else list(order), "chunk_")
    return written(placed.withColumn("chunk_", F.floor(F.col("chunk_") / rows)), "quantile-rows")


def expanding_quantile(
    df: DataFrame,
    col: str,
    q: float,
    keys: list[str],
    order: str | list[str],
    least: int = 30,
    name: str = "quantile",
    seconds: float = CHUNK_SECONDS,
    buckets: int = BUCKETS,
    rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Adds the exact, linearly interpolated quantile of all values so far, null below
    ``least`` of them.  Rows without a value get that of the values before."""
    by = [*keys, "chunk_"]
    at = chunked(df, keys, order, seconds, rows)
    fields = [at.schema[k] for k in by]
    more = lambda ddl: T.StructType([*fields, *T.StructType.fromDDL(ddl)])

    def sample(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf[col].to_numpy(dtype=float)
        x = x[~np.isnan(x)]
        ends = np.quantile(x, np.linspace(0, 1, SAMPLES), method="nearest") if len(x) else x
        return pdf[by].head(1).assign(sample=[ends], n=len(x))

    def bounds(pdf: pd.DataFrame) -> pd.DataFrame:
        b = bounds_of(list(pdf["sample"]), pdf["n"].to_numpy(), buckets)
        return pdf[by].assign(bounds=[b] * len(pdf))

    def cells(pdf: pd.DataFrame, given: pd.DataFrame) -> pd.DataFrame:
        got = cells_of(pdf[col].to_numpy(dtype=float), np.asarray(given["bounds"].iloc[0], dtype=float))
        out = pdf[by].head(1)
        # a chunk without values has a cell as well, so that all chunks are known
        got = got or [(-1, np.zeros(0), np.zeros(0, np.int64))]
        return out.loc[out.index.repeat(len(got))].assign(
            bucket=[b for b, _, _ in got], vals=[v for _, v, _ in got], often=[n for _, _, n in got], n=[int(n.sum()) for _, _, n in got]
        )

    def places(pdf: pd.DataFrame) -> pd.DataFrame:
        some = pdf[pdf["bucket"] >= 0]
        got = wanted(*(some[c].to_numpy() for c in ("chunk_", "bucket", "n")), pdf["chunk_"].unique(), q)
        out = pdf[keys].head(1)
        out = out.loc[out.index.repeat(len(got))]
        cols = ("chunk_", "before", "below", "first", "last")
        return out.assign(**{c: [g[i] for g in got] for i, c in enumerate(cols)})

    def run(pdf: pd.DataFrame, sent: pd.DataFrame) -> pd.DataFrame:
        pdf = sorted_rows(pdf, order).drop(columns="chunk_")
        head = sent.iloc[0]
        some = sent[sent["vals"].notna()]
        values, often = (np.concatenate([*some[c], np.zeros(0)]) for c in ("vals", "often"))
        got = quantiles(pdf[col].to_numpy(dtype=float), q, least, int(head["before"]), int(head["below"]), values, often)
        return pdf.assign(**{name: got})

    sampled = at.groupBy(*by).applyInPandas(sample, more("sample array<double>, n long"))
    known = sampled.groupBy(*keys).applyInPandas(bounds, more("bounds array<double>"))
    cell = at.groupBy(*by).cogroup(known.groupBy(*by)).applyInPandas(cells, more("bucket int, vals array<double>, often array<long>, n long"))
    cell = written(cell, "quantile-cells")
    place = cell.select(*by, "bucket", "n").groupBy(*keys).applyInPandas(places, more("before long, below long, first int, last int"))
    ask = place.filter("first <= last").withColumn("bucket", F.explode(F.sequence("first", "last"))).alias("a")
    have = cell.alias("h")
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"h.{k}")) for k in (*keys, "bucket")]
    found = ask.join(have, [*same, F.col("h.chunk_") < F.col("a.chunk_")])
    sent = found.select(*[f"a.{k}" for k in by], "a.before", "a.below", "h.vals", "h.often")
    empty = [F.lit(None).cast(t).alias(n) for n, t in (("vals", "array<double>"), ("often", "array<long>"))]
    sent = sent.unionByName(place.select(*by, "before", "below", *empty))
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.DoubleType())])
    return at.groupBy(*by).cogroup(sent.groupBy(*by)).applyInPandas(run, schema)
