"""Centroid clustering by Lloyd's rounds, sharded by dimension.

Vectors become integers and are cut into column blocks: a record holds the components
of one block for one chunk of vectors, and all records of a block lie apart from those
of other blocks.  In a round every block task computes the exact partial squared
distances between its slice of the vectors and its slice of the centroids;
``reduceByKey`` adds the blocks of a chunk and takes the nearest centroid.  The labels
of a chunk go back to its blocks, which stay where they are; each block sums its own
columns per cluster and updates its own slice of the centroids.

All arithmetic is on integers, so results do not depend on blocks, chunks, partitions
or the order in which sums arrive.  The driver holds the centroids (k times the number
of dimensions) and nothing that grows with the vectors.  The chunks are a table in the
shared folder: what a lost executor held is read from it again.

Defined results for odd input
    null vector, other length, null, NaN or infinite component   no result row
    repeated rows       take part each
    null identifier     takes part; as a first centroid it counts as the empty text
    ties                nearest: the smaller number; first centroids of one identifier:
                        the smaller vector
    fewer than k rows   as many clusters as rows
    empty table         an empty result with the full schema
    extra columns       ignored
    components of 2**27 / scale or more    refused (distances would not fit a long)
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.rdd import RDD
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import drop_table, materialise

#: Vectors of a chunk.
CHUNK = 4096
#: Largest integer of a component: 64 squared differences then fit a long.
LARGEST = 1 << 27


def usable(vec: str, width: int) -> Column:
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vec) == width) & finite, F.lit(False))


def integers(flat: np.ndarray, width: int, scale: int) -> np.ndarray:
    """Rows of floor(scale * x), x as double."""
    x = np.floor(flat.astype(np.float64) * scale).reshape(-1, width)
    if len(x) and np.abs(x).max() >= LARGEST:
        raise ValueError(f"components of {LARGEST / scale:g} or more: distances would not fit a long")
    return x.astype(np.int32)


def column_blocks(given: DataFrame, width: int, scale: int, block: int, chunk: int) -> DataFrame:
    """chunk, block, data (its columns for the chunk's vectors, 32-bit integers) and, at
    block 0, the identifiers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, rest = TaskContext.get().partitionId(), 0, None

        def out(t: pa.Table) -> pa.RecordBatch:
            flat = t["vec"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
            x = integers(flat, width, scale)
            starts = range(0, width, block)
            data = [np.ascontiguousarray(x[:, s : s + block]).tobytes() for s in starts]
            ids = [t["id"].to_pylist(), *[None] * (len(data) - 1)]
            cols = [pa.array([part << 32 | made] * len(data), pa.int64()), pa.array(range(len(data)), pa.int32())]
            cols += [pa.array(ids, pa.list_(pa.int64())), pa.array(data, pa.binary())]
            return pa.RecordBatch.from_arrays(cols, names=["chunk", "block", "ids", "data"])

        for b in batches:
            t = pa.Table.from_batches([b])
            rest = t if rest is None else pa.concat_tables([rest, t])
            while rest.num_rows >= chunk:
                yield out(rest.slice(0, chunk))
                rest, made = rest.slice(chunk), made + 1
        if rest is not None and rest.num_rows:
            yield out(rest)

    return given.mapInArrow(run, "chunk long, block int, ids array<long>, data binary")


def partial_distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances between rows of x and rows of c, exact."""
    size = max(int(np.abs(x).max(initial=0)), int(np.abs(c).max(initial=0)), 1)
    # sums of at most 2**53 are exact in double precision, where products are fastest
    kind = np.float64 if 4 * size * size * max(1, x.shape[1]) < 1 << 53 else np.int64
    x, c = x.astype(kind), c.astype(kind)
    d = (x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)[None, :]
    return d.astype(np.int64)


def _columns(data: bytes, width: int) -> np.ndarray:
    return np.frombuffer(data, dtype=np.int32).reshape(-1, width)


def nearest(blocks: RDD, slices: dict[int, np.ndarray], parts: int) -> RDD:
    """(chunk, (labels, distances)): the blocks of a chunk added up."""
    held = blocks.ctx.broadcast(slices)

    def partial(record: tuple) -> tuple:
        (chunk, b), data = record
        c = held.value[b]
        return chunk, partial_distances(_columns(data, c.shape[1]), c)

    def best(d: np.ndarray) -> tuple:
        return d.argmin(axis=1).astype(np.int32), d.min(axis=1)

    return blocks.map(partial).reduceByKey(np.add, parts).mapValues(best)


def moved(blocks: RDD, labels: RDD, slices: dict[int, np.ndarray], parts: int, deal) -> dict[int, np.ndarray]:
    """The new slice of every block: per cluster the floor of the mean of its vectors; a
    cluster without any stays."""
    held = blocks.ctx.broadcast(slices)
    n_blocks = len(slices)
    spread = labels.flatMap(lambda r: [((r[0], b), r[1][0]) for b in range(n_blocks)]).partitionBy(parts, deal)

    def sums(records: Iterator[tuple]) -> Iterator[tuple]:
        of, total = {}, {}
        for key, value in records:  # the labels of a partition come before its blocks
            if isinstance(value, np.ndarray):
                of[key] = value
                continue
            old = held.value[key[1]]
            x, lab = _columns(value, old.shape[1]).astype(np.int64), of.pop(key)
            s, n = total.setdefault(key[1], (np.zeros(old.shape, np.int64), np.zeros(len(old), np.int64)))
            np.add.at(s, lab, x)
            n += np.bincount(lab, minlength=len(old))
        yield from total.items()

    def update(record: tuple) -> tuple:
        b, (s, n) = record
        return b, np.where(n[:, None] > 0, s // np.maximum(n, 1)[:, None], held.value[b])

    both = spread.union(blocks)
    if both.getNumPartitions() != blocks.getNumPartitions():
        raise ValueError("labels and blocks are dealt differently")
    added = both.mapPartitions(sums).reduceByKey(lambda a, c: (a[0] + c[0], a[1] + c[1]), n_blocks)
    return dict(added.map(update).collect())


def first_centroids(given: DataFrame, k: int, seed: int, width: int, scale: int) -> np.ndarray:
    """The k vectors with the smallest sha256 of seed and identifier, in that order."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    rows = given.select(key.alias("key"), "vec").orderBy("key", "vec").limit(k).collect()
    flat = np.array([x for r in rows for x in r["vec"]], dtype=np.float64)
    return integers(flat, width, scale).astype(np.int64)


SCHEMA = "vec_id long, cluster int, distance long"


def _rows(chunks: DataFrame) -> DataFrame:
    """One row per vector from a chunk's identifiers, labels and distances."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                ids = b.column(0).slice(i, 1).flatten()
                lab, dist = (np.frombuffer(b.column(c)[i].as_py(), dtype=t) for c, t in ((1, np.int32), (2, np.int64)))
                yield pa.RecordBatch.from_arrays([ids, pa.array(lab), pa.array(dist)], names=["vec_id", "cluster", "distance"])

    return chunks.select("ids", "labels", "distances").mapInArrow(run, SCHEMA)


def lloyd(
    vectors: DataFrame,
    k: int = 8,
    rounds: int = 10,
    width: int = 64,
    scale: int = 1024,
    seed: int = 3,
    block: int = 32,
    chunk: int = CHUNK,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
) -> tuple[DataFrame, np.ndarray]:
    """vec_id, cluster and distance of every vector of ``width`` components after
    ``rounds`` rounds (a written table), and the final centroids."""
    spark = vectors.sparkSession
    given = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    given = given.filter(usable("vec", width))
    start = first_centroids(given, k, seed, width, scale)
    if not len(start):
        return spark.createDataFrame([], SCHEMA), start
    table = materialise(column_blocks(given, width, scale, block, chunk), "column-blocks")
    starts = range(0, width, block)
    slices = {b: start[:, s : s + block] for b, s in enumerate(starts)}
    n_blocks = len(slices)
    each = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // n_blocks, table.count() // n_blocks // 64)
    parts = each * n_blocks

    def deal(key: tuple) -> int:
        chunk_, b = key
        return b * each + (chunk_ * 0x9E3779B97F4A7C15 >> 24) % each

    records = table.select("chunk", "block", "data").rdd.map(lambda r: ((r[0], r[1]), bytes(r[2])))
    blocks = records.partitionBy(parts, deal).persist(StorageLevel.MEMORY_AND_DISK)
    parts = blocks.getNumPartitions()
    for _ in range(rounds):
        slices = moved(blocks, nearest(blocks, slices, parts), slices, parts, deal)
    final = nearest(blocks, slices, parts).map(lambda r: (r[0], bytearray(r[1][0].tobytes()), bytearray(r[1][1].tobytes())))
    labelled = spark.createDataFrame(final, "chunk long, labels binary, distances binary")
    found = materialise(_rows(table.filter("block = 0").join(labelled, "chunk")), "clusters")
    blocks.unpersist()
    drop_table(table)
    return found, np.concatenate([slices[b] for b in range(n_blocks)], axis=1)


def digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(str(int(x)) for x in centroid).encode()).hexdigest()


def clustered(vectors: DataFrame, **settings) -> DataFrame:
    """The rows of ``lloyd`` with the inertia of their cluster and of all, and the digest
    of their cluster's final centroid."""
    found, final = lloyd(vectors, **settings)
    spark = vectors.sparkSession
    per = {r["cluster"]: r["s"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    rows = [(c, per.get(c, 0), sum(per.values()), digest(x)) for c, x in enumerate(final)]  # k rows
    known = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
