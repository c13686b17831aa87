"""Line deduplication: lines found in many documents go from all of them.

Every line gets a key: ASCII white space stripped at both ends, A-Z lower-cased.  Keys
are hashed to 128 bits; the documents of each hash are counted (every task sums what
its batches hold before anything is shuffled), and the lines whose key at least
``least_docs`` documents share are found again by a join on the hash.  What comes back
to a document is the positions of its lines to drop; the text itself is split once more
and joined from the lines that stay, in their order.

A document is a row, whatever its identifier.  Rows are known by the place in their
file, so the lines of a document meet again without carrying its text.  A key that
fills more than its share of all lines is dealt out over salts, so no key's rows land
in one task; the keys that need this are at most ``MOST_HOT``, whatever the input.

Defined results for odd input
    null or empty text      one empty line, which is never dropped (its key is empty)
    null identifier         a result row like any other
    repeated rows           documents of their own, each counts
    a key twice in a text   counts once, goes in both places
    all lines dropped       the empty text
    empty table             an empty result with the full schema
    extra columns           ignored
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import bounded_batches, drop_table, give_back, materialise

STRIPPED = " \t\n\x0b\x0c\r"
#: A key of more lines than this may be dealt out over several tasks.
HOT_LINES = 4096
#: Most keys that are dealt out; the size at which a key is hot grows with the input.
MOST_HOT = 50_000


def rows_with_place(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text, and the place of the row: file (hash of its path) and row."""
    given = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    place = [F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")]
    try:
        return given.select("*", *place)
    except AnalysisException:  # not a plain scan of files
        return materialise(given, "documents-in-place").select("*", *place)


def split_lines(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All lines one after another, and where each text's lines begin (one more entry
    at the end)."""
    parts = pc.split_pattern(texts, "\n")
    return parts.flatten(), np.concatenate([[0], np.cumsum(pc.list_value_length(parts).to_numpy(zero_copy_only=False))]).astype(np.int64)


def keyed(lines: pa.Array, least_chars: int) -> tuple[np.ndarray, np.ndarray]:
    """The number of each line's key (-1: too short to count) and the hashes of all
    distinct keys, two longs each."""
    keys = pc.ascii_lower(pc.ascii_trim(lines, characters=STRIPPED)).dictionary_encode()
    codes, distinct = keys.indices.to_numpy(zero_copy_only=False).astype(np.int64), keys.dictionary
    digests = b"".join(xxhash.xxh3_128_digest(k) for k in distinct.cast(pa.binary()).to_pylist())
    long_enough = pc.greater_equal(pc.utf8_length(distinct), least_chars).to_numpy(zero_copy_only=False)
    codes = np.where(long_enough[codes], codes, -1) if len(distinct) else codes
    return codes, np.frombuffer(digests, dtype="<i8").reshape(-1, 2)


def documents_per_key(docs: DataFrame, least_chars: int) -> DataFrame:
    """h1, h2, n: in how many documents a key stands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lines, begins = split_lines(b.column(0))
            codes, hashes = keyed(lines, least_chars)
            owner = np.repeat(np.arange(b.num_rows), np.diff(begins))[codes >= 0]
            once = np.unique(owner * max(1, len(hashes)) + codes[codes >= 0]) % max(1, len(hashes))
            n = np.bincount(once, minlength=len(hashes))
            some = np.flatnonzero(n)
            cols = [hashes[some, 0], hashes[some, 1], n[some]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["h1", "h2", "n"])
        give_back()

    return docs.select("text").mapInArrow(run, "h1 long, h2 long, n long").groupBy("h1", "h2").agg(F.sum("n").alias("n"))


def lines_of(docs: DataFrame, least_chars: int, salts: pd.DataFrame) -> DataFrame:
    """A row for every line long enough: its key's hash, a salt (0 but for hot keys) and
    its place (file, row, pos)."""
    dealt = {(int(a), int(b)): int(s) for a, b, s in salts.itertuples(index=False)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lines, begins = split_lines(b.column(0))
            codes, hashes = keyed(lines, least_chars)
            count = np.diff(begins)
            pos = np.arange(len(codes)) - np.repeat(begins[:-1], count)
            file, row = (np.repeat(b.column(i).to_numpy(), count) for i in (1, 2))
            some = np.flatnonzero(codes >= 0)
            codes, pos, file, row = codes[some], pos[some], file[some], row[some]
            of = np.array([dealt.get((a, c), 1) for a, c in hashes.tolist()], dtype=np.int64) if dealt else np.ones(len(hashes), np.int64)
            salt = (row + pos) % of[codes]
            cols = [hashes[codes, 0], hashes[codes, 1], salt.astype(np.int32), file, row, pos.astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["h1", "h2", "salt", "file", "row", "pos"])
        give_back()

    return docs.select("text", "file", "row").mapInArrow(run, "h1 long, h2 long, salt int, file long, row long, pos int")


def reassembled(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped and kept_text from doc_id, text and the positions
    ``dropped`` (null: none)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lines, begins = split_lines(b.column(1))
            gone = b.column(2)
            count = pc.fill_null(pc.list_value_length(gone), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            stays = np.ones(len(lines), dtype=bool)
            stays[np.repeat(begins[:-1], count) + gone.flatten().to_numpy(zero_copy_only=False)] = False
            ends = np.concatenate([[0], np.cumsum(stays)])[begins].astype(np.int32)
            kept = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), lines.filter(pa.array(stays))), "\n")
            cols = [b.column(0), pa.array(np.diff(begins)), pa.array(count), kept]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_lines", "n_dropped", "kept_text"])
        give_back()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", "dropped").mapInArrow(run, f"doc_id {kind}, n_lines long, n_dropped long, kept_text string")


def without_common_lines(
    docs: DataFrame,
    least_docs: int = 10,
    least_chars: int = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
    hot: int = HOT_LINES,
    most_hot: int = MOST_HOT,
) -> DataFrame:
    """doc_id, n_lines, n_dropped and kept_text of every document, without the lines
    whose key of at least ``least_chars`` code points stands in ``least_docs`` documents
    or more."""
    spark = docs.sparkSession
    bounded_batches(spark)
    placed = rows_with_place(docs, id_col, text_col)
    common = materialise(documents_per_key(placed, least_chars).filter(F.col("n") >= least_docs), "common-lines")
    # a key of over total / most_hot lines: there are at most most_hot of them
    total = common.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    share = max(hot, -(-total // most_hot))
    dealt = common.filter(F.col("n") > share).withColumn("salts", F.ceil(F.col("n") / share).cast("int"))
    salts = dealt.select("h1", "h2", "salts").toPandas()
    copies = F.greatest(F.ceil(F.col("n") / share).cast("int"), F.lit(1))
    wanted = common.select("h1", "h2", F.explode(F.sequence(F.lit(0), copies - 1)).alias("salt"))
    found = lines_of(placed, least_chars, salts).join(wanted, ["h1", "h2", "salt"], "left_semi")
    dropped = materialise(found.groupBy("file", "row").agg(F.collect_list("pos").alias("dropped")), "dropped-lines")
    drop_table(common)
    # dropped lines grow with the documents: the same join at every size
    return reassembled(placed.join(dropped.hint("merge"), ["file", "row"], "left"))
