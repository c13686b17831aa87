"""Bounded, repeatable samples of rows for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import id_bucket


def training_labels(labels: DataFrame, label: str, modulus: int, held_remainder: int) -> DataFrame:
    """(doc_id, y) of the rows that may be learned from; a document labelled more
    than once takes its largest label, null labels and identifiers are left out."""
    open_ = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
    open_ = open_.filter(id_bucket("doc_id", modulus) != held_remainder)
    return open_.groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))


def by_hash(rows: DataFrame, most: int, key: str = "doc_id") -> DataFrame:
    """At most ``most`` rows, those whose key hashes smallest."""
    return rows.orderBy(F.xxhash64(key), key).limit(most)


def texts_of(docs: DataFrame, chosen: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The whole texts of the chosen rows; ``chosen`` has a bounded number of rows
    (the sample size), which is what makes the broadcast safe."""
    small = chosen.withColumnRenamed("doc_id", "chosen_id")
    given = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return given.join(F.broadcast(small), F.col("doc_id") == F.col("chosen_id")).drop("chosen_id")
