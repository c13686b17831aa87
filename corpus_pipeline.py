"""Corpus preparation: toxicity, language, exact and near duplicates, packing.

Each stage takes (spark, docs, sf_dir) and works on every document its predecessor
kept; its result is written as Parquet and read again as the next stage's documents,
and its input, if a stage wrote it, is deleted then.  All but the last return the
columns of ``documents``.

Defined results for odd input
    null or empty text    not toxic; without letters, hence gone after the language stage
    null identifier       kept or dropped by its text like any other; of equal texts a
                          null identifier stays before all others, in the near-duplicate
                          stage it comes last
    repeated rows         one stays (exact copies)
    repeated identifiers  each row goes by its own text; of near copies with the same
                          identifier the text with the smallest md5 stays
    ties                  the smallest identifier stays
    empty table           an empty result with the full schema
    extra columns         passed through to packing, whatever their names
    no labels, no lang    nothing is toxic; no language is learned, so all go
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import exact_dedup, language, packing, simhash, toxicity
from tidemark.llm.shared import drop_table, materialise, table

CAPACITY = 4096


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go; the model learns from the stage's own input."""
    return toxicity.kept(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or unlike every learned language, go."""
    return language.kept(docs, language.learn(docs))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the smallest doc_id stays."""
    return exact_dedup.deduplicated(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity 0.8) the
    document with the smallest doc_id stays."""
    return simhash.representatives(docs, simhash.NEAR_TEXT)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The remaining documents as pieces placed in sequences of ``CAPACITY`` tokens."""
    pieces = packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=CAPACITY)
    return packing.pack(pieces, CAPACITY)


STAGES = [
    ("toxicity", drop_toxic),
    ("language", keep_known_languages),
    ("exact dedup", drop_exact_copies),
    ("near dedup", drop_near_copies),
    ("packing", pack),
]

#: Trained models and packing have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return applied(spark, table(spark, sf_dir, "documents"), sf_dir)


def applied(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All stages over ``docs``."""
    written = None
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if written is not None:
            drop_table(written)
        written = docs
    packed = STAGES[-1][1](spark, docs, sf_dir)  # reads its documents at once
    drop_table(written)
    return packed
