"""Embedding near-duplicates through a pivot-permutation index.

Reference points (pivots) are chosen from a bounded, repeatable sample by
farthest-first traversal; their number grows as the square root of the number of
distinct vectors.  Every vector is described by its ``k`` nearest pivots, nearest
first, and posted under each pair of them, so two vectors meet in an inverted list
exactly when they share at least two pivots.  In a list shared pivots are counted
and pairs are verified by cosine in double precision.  A pair that meets in several
lists counts in one: that of its two smallest shared pivots.

Lists of over ``BLOCK`` members are dealt out as pairs of blocks.  Equal vectors are
merged before indexing and counted by their number; each distinct one gets a key of
its own, so identifiers need not be unique.

Defined results for odd input
    null vector, null, NaN or infinite component, zero vector   no links
    vectors of different length                                 never linked
    repeated rows, one identifier on several vectors            a result row each
    null identifier                                             a result row; never the
                                                                smallest of a component
                                                                that has an identifier
    empty table                                                 an empty result
    extra columns                                               ignored
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.components import components, forest
from tidemark.llm.shared import by_key, materialise

BLOCK = 4096
NEAREST = 6
#: Stands for a missing identifier where the smallest is sought: after all others.
NO_ID = (1 << 63) - 1


def usable(vec: str) -> Column:
    """True for a vector that has a direction."""
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists(vec, lambda x: x != 0)
    return F.coalesce(F.col(vec).isNotNull() & finite & some, F.lit(False))


def unit_rows(flat: np.ndarray, width: int) -> np.ndarray:
    """Rows of length 1 in double precision (scaled first, so squares cannot
    overflow or vanish)."""
    x = flat.astype(np.float64).reshape(-1, width)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def pivot_count(n: int, least: int = 64, most: int = 16_384) -> int:
    """The power of two next to the square root of the number of vectors."""
    return int(np.clip(1 << int(np.ceil(np.log2(max(2.0, np.sqrt(n))))), least, most))


def farthest_first(unit: np.ndarray, count: int) -> np.ndarray:
    """``count`` rows of the sample, each the one least similar to those before."""
    count = min(count, len(unit))
    picked, near = [0], unit @ unit[0]
    while len(picked) < count:
        at = int(near.argmin())
        picked.append(at)
        near = np.maximum(near, unit @ unit[at])
    return unit[picked]


def choose_pivots(distinct: DataFrame, n: int) -> dict[int, np.ndarray]:
    """Pivots per vector length, from at most four times as many sampled vectors."""
    count = pivot_count(n)
    sample = distinct.orderBy(F.xxhash64("vec"), "rep").limit(4 * count).select("vec").toPandas()["vec"]
    by_width: dict[int, list] = {}
    for v in sample:
        by_width.setdefault(len(v), []).append(np.asarray(v, dtype=np.float64))
    return {w: farthest_first(unit_rows(np.concatenate(rows), w), count) for w, rows in by_width.items()}


def posted(distinct: DataFrame, pivots: dict[int, np.ndarray], nearest: int) -> DataFrame:
    """One row per vector and pair of its nearest pivots."""
    shared = distinct.sparkSession.sparkContext.broadcast(pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            widths = np.diff(b.column(2).offsets.to_numpy())
            for width in np.unique(widths):
                pick = np.flatnonzero(widths == width)
                part = b.take(pa.array(pick))
                flat = part.column(2).flatten().to_numpy(zero_copy_only=False)
                ref = shared.value.get(int(width))
                if ref is None:  # a length that the sample missed: all meet in one list
                    ref = np.eye(1, int(width))
                k = min(nearest, len(ref))
                sims = unit_rows(flat, int(width)) @ ref.T
                order = np.argsort(-sims, axis=1, kind="stable")[:, :k]
                pairs = list(combinations(range(k), 2)) or [(0, 0)]
                low = np.minimum(order[:, [a for a, _ in pairs]], order[:, [c for _, c in pairs]])
                high = np.maximum(order[:, [a for a, _ in pairs]], order[:, [c for _, c in pairs]])
                key = ((np.int64(width) << 32) | (low.astype(np.int64) << 16) | high).ravel()
                rep = pa.array(np.repeat(np.arange(len(pick)), len(pairs)))
                near = pa.FixedSizeListArray.from_arrays(pa.array(order.astype(np.int32).ravel()), k)
                near = near.cast(pa.list_(pa.int32()))
                cols = [pa.array(key), *(part.column(i).take(rep) for i in (0, 1, 3)), near.take(rep), part.column(2).take(rep)]
                yield pa.RecordBatch.from_arrays(cols, names=["list", "id", "copies", "first", "near", "vec"])

    given = distinct.select("rep", "copies", F.col("vec").cast("array<double>").alias("vec"), "first")
    return given.mapInArrow(run, "list long, id long, copies long, first long, near array<int>, vec array<double>")


def _forest(linked: np.ndarray, a: np.ndarray, b: np.ndarray, cross: bool) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between members ``a`` and ``b``."""
    r, c = np.nonzero(linked)
    if not cross:
        keep = r < c
        r, c = r[keep], c[keep]
    return forest(a[r], b[c])


def verify_list(
    key: int, copies: np.ndarray, near: np.ndarray, unit: np.ndarray, side: np.ndarray, threshold: float
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Link counts per member (pairs whose own list this is) and forest edges between
    members.

    ``side`` holds the block of each member; in a list of two blocks only pairs
    across them are looked at."""
    cross = side[0] != side[-1]
    a = np.flatnonzero(side == side[0]) if cross else np.arange(len(side))
    b = np.flatnonzero(side != side[0]) if cross else a
    low, high = key >> 16 & 0xFFFF, key & 0xFFFF
    cols, at = np.unique(near, return_inverse=True)
    member = np.zeros((len(side), len(cols)), dtype=np.float32)
    member[np.arange(len(side))[:, None], at.reshape(near.shape)] = 1
    shared = member[a] @ member[b].T
    before = member[:, (cols < high) & (cols != low)]
    own = (before[a] @ before[b].T) == 0
    linked = (unit[a] @ unit[b].T >= threshold) & (shared >= min(2, near.shape[1]))
    if not cross:
        np.fill_diagonal(linked, False)
    counted = linked & own
    n = np.zeros(len(side), dtype=np.int64)
    n[a] += counted @ copies[b]
    if cross:
        n[b] += counted.T @ copies[a]
    return n, *_forest(linked, a, b, cross)


LINK_SCHEMA = "u long, u_first long, v long, v_first long, n long"


def _verified(rows: DataFrame, threshold: float) -> DataFrame:
    """Link counts (v null) and forest edges (n null), from rows sorted by list; holds
    one list (or pair of blocks) at a time."""

    def one(t: pa.Table) -> pa.RecordBatch:
        key = t["list"][0].as_py()
        ids, first, copies, side = (t[c].to_numpy() for c in ("id", "first", "copies", "side"))
        near = t["near"].combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
        unit = unit_rows(t["vec"].combine_chunks().flatten().to_numpy(), len(t["vec"][0]))
        n, us, vs = verify_list(key, copies, near, unit, side, threshold)
        some = np.flatnonzero(n)
        u = np.concatenate([some, us])
        lacks = pa.nulls(len(some), pa.int64()), pa.nulls(len(us), pa.int64())
        cols = [pa.array(ids[u]), pa.array(first[u]), pa.concat_arrays([lacks[0], pa.array(ids[vs])])]
        cols += [pa.concat_arrays([lacks[0], pa.array(first[vs])]), pa.concat_arrays([pa.array(n[some]), lacks[1]])]
        return pa.RecordBatch.from_arrays(cols, names=["u", "u_first", "v", "v_first", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([b])])
            group = t["group"].to_numpy()
            cut = np.flatnonzero(group[1:] != group[:-1]) + 1
            edges = [0, *cut.tolist()]
            for lo, hi in zip(edges, edges[1:], strict=False):
                if hi - lo > 1:
                    yield one(t.slice(lo, hi - lo))
            rest = t.slice(edges[-1])
        if rest is not None and rest.num_rows > 1:
            yield one(rest)

    return rows.select("group", "list", "id", "copies", "first", "near", "vec", "side").mapInArrow(run, LINK_SCHEMA)


def near_duplicates(
    vectors: DataFrame,
    threshold: float = 0.95,
    nearest: int = NEAREST,
    block: int = BLOCK,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row."""
    given = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("vec"))
    able = given.filter(usable("vec"))
    distinct = able.groupBy("vec").agg(F.min("vec_id").alias("first_id"), F.count(F.lit(1)).alias("copies"))
    distinct = distinct.withColumn("first", F.coalesce("first_id", F.lit(NO_ID))).withColumn("rep", F.monotonically_increasing_id())
    distinct = materialise(distinct, "distinct-vectors")
    n = distinct.count()
    keyed = distinct.select("vec", "rep", (F.col("copies") - 1).alias("others"), F.col("copies").alias("size"))
    ids = materialise(by_key(able, keyed, ["vec"]).select("vec_id", "rep", "others"), "vector-ids")
    lists = materialise(posted(distinct, choose_pivots(distinct, n), nearest), "pivot-lists")
    sizes = lists.groupBy("list").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") > block)
    hot = materialise(sizes.withColumn("blocks", F.ceil(F.col("size") / block).cast("int")), "hot-lists")
    rows = lists.withColumns({"group": F.xxhash64("list"), "side": F.lit(0)})
    if hot.head(1):
        cold = rows.join(hot.select("list"), "list", "left_anti")
        split = lists.join(hot.select("list", "blocks"), "list")
        split = split.withColumn("side", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
        split = split.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        split = split.withColumn("group", F.xxhash64("list", F.least("side", "other"), F.greatest("side", "other")))
        rows = cold.unionByName(split.select(*cold.columns))
    parts = rows.repartition("group").sortWithinPartitions("group", "side")
    found = materialise(_verified(parts, threshold), "vector-links")
    links = found.filter("n is not null").groupBy(F.col("u").alias("rep")).agg(F.sum("n").alias("n"))
    node = [F.struct(F.col(f"{x}_first").alias("id"), F.col(x).alias("rep")).alias(x) for x in ("u", "v")]
    roots = components(found.filter("v is not null").select(*node))
    roots = roots.select(F.col("node.rep").alias("rep"), F.col("root.id").alias("lowest"))
    per_rep = distinct.select("rep", "first", F.col("copies").alias("size")).join(links, "rep", "left").join(roots, "rep", "left")
    per_rep = per_rep.withColumn("lowest", F.coalesce("lowest", "first"))
    linked = by_key(ids, materialise(per_rep.drop("first"), "vector-components"), ["rep"]).select(
        "vec_id",
        (F.coalesce("n", F.lit(0)) + F.col("others")).cast("long").alias("n_links"),
        F.when(F.col("lowest") != NO_ID, F.col("lowest")).alias("component_id"),
    )
    alone = given.filter(~usable("vec")).select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")
    )
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
