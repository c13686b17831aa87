"""Helpers every operator uses: the shared folder, split hashes, table access."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ASCII_WS = r"[\x20\x09-\x0D]+"


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    A cluster names it in ``spark.checkpoint.dir``.  Only where that setting is absent
    and driver and executors are one machine (tests) a local folder is made.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + os.path.join(tempfile.gettempdir(), "tidemark-shared")
    return root.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/tidemark/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and return the table read back.

    Survives lost executors (unlike a local checkpoint) and cuts the lineage.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def drop_table(df: DataFrame) -> None:
    """Delete the files behind a table that ``materialise`` wrote."""
    roots = {f.rpartition("/")[0] for f in df.inputFiles()}
    for root in roots:
        drop_path(df.sparkSession, root)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_bucket(id_col: str, modulus: int) -> Column:
    """crc32 of the identifier as text, modulo; a null identifier counts as ''."""
    text = F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")
    return F.crc32(text) % modulus


def text_or_empty(text_col: str) -> Column:
    return F.coalesce(F.col(text_col), F.lit(""))


def bounded_batches(spark: SparkSession) -> None:
    """Texts may be long: what a Python worker and the JVM hold of them at a time is
    bounded by bytes and rows of an Arrow batch."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4194304")


def without(docs: DataFrame, dropped: DataFrame, same: Column, most: int = 200_000) -> DataFrame:
    """``docs`` less the rows that match ``dropped`` (a written table).

    Up to ``most`` rows (some MB) are broadcast after counting them, so that texts
    stay where they are; more are joined by a shuffle."""
    few = dropped.limit(most + 1).count() <= most
    return docs.join(F.broadcast(dropped) if few else dropped, same, "left_anti")


def by_key(rows: DataFrame, keyed: DataFrame, keys: list[str], hot: int = 20_000, most: int = 200_000) -> DataFrame:
    """``rows`` joined with the one row of ``keyed`` (a written table) for their keys,
    whose column ``size`` says how many rows share them.

    Keys of over ``hot`` rows, at most one in ``hot`` rows of the table and counted
    against ``most``, are broadcast: no key's rows land in one task."""
    large = keyed.filter(F.col("size") > hot)
    n = large.limit(most + 1).count()
    if not n or n > most:
        return rows.join(keyed, keys)
    spread = rows.join(F.broadcast(large), keys)
    others = rows.join(F.broadcast(large.select(*keys)), keys, "left_anti").join(keyed.filter(F.col("size") <= hot), keys)
    return spread.unionByName(others)


def split_words(texts: pa.Array) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """Word numbers of all texts one after another, the distinct words (between ASCII
    white space), and where each text begins (one more entry at the end)."""
    parts = pc.ascii_split_whitespace(texts)
    flat, lengths = parts.flatten(), np.diff(parts.offsets.to_numpy())
    some = pc.greater(pc.binary_length(flat), 0)
    owner = np.repeat(np.arange(len(texts)), lengths)[some.to_numpy(zero_copy_only=False)]
    coded = flat.filter(some).dictionary_encode()
    words = coded.dictionary.cast(pa.binary()).to_pylist()
    begins = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(texts)))])
    return coded.indices.to_numpy().astype(np.int64), words, begins


def give_back() -> None:
    """Called by a Python worker at the end of a task: what its caches held goes back
    to the system, as idle workers live on beside other stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return
