"""Connected components of a distributed edge list.

Alternating large-star and small-star rounds (Kiveris et al., 2014): each round is
a few joins and partial aggregates, written to the shared folder, so lost executors
cost a stage and not the run.  Neither edges nor components reach the driver, which
compares two numbers per round.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import drop_table, give_back, materialise

#: Edges that one task holds while it thins them.
EDGES_AT_ONCE = 1 << 20


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from every node that is not the smallest of its component to that one."""
    nodes, where = np.unique(np.concatenate([u, v]), return_inverse=True)
    i, j = where[: len(u)], where[len(u) :]
    label = np.arange(len(nodes))
    while True:
        low = label.copy()
        np.minimum.at(low, i, label[j])
        np.minimum.at(low, j, label[i])
        low = low[low]
        if (low == label).all():
            break
        label = low
    away = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[away], nodes[label[away]]


def thinned(edges: DataFrame, at_once: int = EDGES_AT_ONCE) -> DataFrame:
    """Edges (u, v, longs) with the same components and no cycle among those of one
    task: groups that are linked many times over keep about one edge a node.  Tasks
    hold at most ``at_once`` edges at a time; there are more of them as edges grow."""
    edges = materialise(edges.select("u", "v"), "links")
    parts = max(1, -(-edges.count() // at_once))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u, v, size = [], [], 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x) for x in forest(np.concatenate(u), np.concatenate(v))], names=["u", "v"])

        for b in batches:
            u.append(b.column(0).to_numpy())
            v.append(b.column(1).to_numpy())
            size += b.num_rows
            if size >= at_once:
                yield out()
                u, v, size = [], [], 0
        if size:
            yield out()
        give_back()

    return edges.repartition(parts).mapInArrow(run, "u long, v long")


def _state(edges: DataFrame) -> tuple[int, int]:
    n, s = edges.agg(
        F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))
    ).first()
    return int(n), int(s)


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour above u, and u's own smallest neighbour, hang on that one."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    hung = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.filter("u != v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """With every edge pointing down (u > v), u's neighbours and u hang on its
    smallest neighbour."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    hung = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = low.select("u", F.col("m").alias("v"))
    return hung.unionByName(own).filter("u != v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of an edge list (u, v); root is the smallest node
    that can be reached.  Nodes without edges do not appear.  Nodes may be of any type
    with an order, such as structs that lead with an identifier: the root then names
    the smallest identifier without a further join."""
    now = materialise(edges.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = _state(now)
    while before[0]:
        after = materialise(_small_star(_large_star(now)), "edges")
        state = _state(after)
        drop_table(now)
        now = after
        if state == before:
            break
        before = state
    # at the end every edge is (node, root); the root stands for itself
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
