"""Exact deduplication by stateful streaming.

Every record arrives as (digest, identifier, content locator).  A streaming
aggregation keeps, per digest and without expiry, the smallest identifier, that
record's content locator and the number of arrivals; its state lives on disk in
RocksDB and is committed to the shared folder.  Hits (digests that came more than
once) are then checked on the full bytes: their texts are grouped by digest and
text, and a digest with two different texts is resolved by the texts themselves.

All steps are DataFrame operations.  The state's key is the digest and it holds
one row per distinct text; hot groups cost one partial row per task and digest.

Defined results for odd input
    null text         equal to the empty text
    null identifier   sorts before every other, so such a row stays
    repeated rows     rows with the same identifier and text are copies of each
                      other; the one with the smallest locator stays
    empty table       an empty result with the full schema
    extra columns     ignored by ``duplicates``, passed through by ``deduplicated``
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.shared import ASCII_WS, by_key, fresh_path, materialise, text_or_empty, without

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "96",
    "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "4",
    # many small stores: no disk space set aside, and commits write what changed
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}
#: Most bits of the map that says which digests may have come twice: its table of
#: 64-bit words then has 2**21 rows, the size up to which it may be broadcast.
MOST_HIT_BITS = 27


def normalised(text_col: str) -> Column:
    return F.regexp_replace(text_or_empty(text_col), ASCII_WS, " ")


def text_digest(text_col: str, digest_bytes: int = 32) -> Column:
    whole = F.unhex(F.sha2(normalised(text_col), 256))
    return whole if digest_bytes == 32 else F.substring(whole, 1, digest_bytes)


def with_locator(docs: DataFrame) -> DataFrame:
    """Adds src_file (hash of the file's path) and src_row; null when ``docs`` is
    not a plain file scan."""
    try:
        return docs.select(
            "*",
            F.xxhash64("_metadata.file_path").alias("src_file"),
            F.col("_metadata.row_index").alias("src_row"),
        )
    except AnalysisException:
        return docs.select("*", F.lit(None).cast("long").alias("src_file"), F.lit(None).cast("long").alias("src_row"))


def land(docs: DataFrame, id_col: str, text_col: str, digest_bytes: int) -> str:
    """Write the arrivals (no text) to the shared folder; returns their path."""
    path = fresh_path(docs.sparkSession, "arrivals")
    with_locator(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text_"))).select(
        F.col("doc_id").cast("long").alias("doc_id"),
        text_digest("text_", digest_bytes).alias("digest"),
        text_digest("text_").alias("sha256"),
        "src_file",
        "src_row",
    ).write.parquet(path)
    return path


def located(arrivals: DataFrame) -> DataFrame:
    """Arrivals with a locator that is never null and never repeats."""
    return arrivals.withColumn(
        "locator",
        F.struct(
            F.coalesce("src_file", F.xxhash64("_metadata.file_path")).alias("file"),
            F.coalesce("src_row", F.col("_metadata.row_index")).alias("row"),
        ),
    )


def absorb(spark: SparkSession, arrivals_path: str, state_path: str) -> None:
    """Feed all arrivals not seen yet into the keyed state at ``state_path``.

    May be called again after more files have landed: the state goes on from
    where it was, so copies of earlier records are found as well.
    """
    before = {k: spark.conf.get(k, None) for k in STATE_SETTINGS}
    try:
        for k, v in STATE_SETTINGS.items():
            spark.conf.set(k, v)
        schema = spark.read.parquet(arrivals_path).schema
        stream = located(spark.readStream.schema(schema).parquet(arrivals_path))
        state = stream.groupBy("digest").agg(
            F.min(F.struct("doc_id", "locator")).alias("first"), F.count(F.lit(1)).alias("n")
        )
        query = (
            state.writeStream.outputMode("update")
            .format("noop")
            .option("checkpointLocation", state_path)
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def read_state(spark: SparkSession, state_path: str) -> DataFrame:
    """(digest, keep_id, keep_at, group_size), straight from the state store."""
    state = spark.read.format("statestore").load(state_path)
    first, count = (f.name for f in state.schema["value"].dataType.fields)
    return state.select(
        F.col("key.digest").alias("digest"),
        F.col(f"value.`{first}`.doc_id").alias("keep_id"),
        F.col(f"value.`{first}`.locator").alias("keep_at"),
        F.col(f"value.`{count}`").alias("group_size"),
    )


def hit_map_bits(digests: int) -> int:
    """log2 of the map's bits: sixteen or more per digest that came twice."""
    return min(MOST_HIT_BITS, max(16, (16 * digests).bit_length()))


def collided(docs: DataFrame, state: DataFrame, text_col: str, digest_bytes: int) -> DataFrame:
    """Digests that came more than once and whose full bytes differ.

    A bit map, sized by the number of such digests, keeps texts that certainly came
    once out of the shuffle; the rest are grouped by digest and whole text.
    """
    hits = state.filter("group_size > 1")
    bit = F.pmod(F.xxhash64("digest"), F.lit(1 << hit_map_bits(hits.count())))
    words = (
        hits.select(F.floor(bit / 64).alias("word_no"), F.expr("shiftleft(1L, cast(pmod(xxhash64(digest), 64) as int))").alias("b"))
        .groupBy("word_no")
        .agg(F.bit_or("b").alias("word"))
    )
    texts = docs.select(text_digest(text_col, digest_bytes).alias("digest"), normalised(text_col).alias("text_"))
    held = texts.withColumn("word_no", F.floor(bit / 64)).join(F.broadcast(words), "word_no")
    maybe = held.filter("(word & shiftleft(1L, cast(pmod(xxhash64(digest), 64) as int))) != 0")
    by_text = maybe.groupBy("digest", "text_").agg(F.count(F.lit(1)).alias("n"))
    return by_text.groupBy("digest").agg(F.count(F.lit(1)).alias("texts")).filter("texts > 1").select("digest")


def _by_text(docs: DataFrame, bad: DataFrame, id_col: str, text_col: str, digest_bytes: int) -> DataFrame:
    """The exact way for colliding digests: classes of equal whole texts."""
    rows = (
        with_locator(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text_")))
        .withColumn("digest", text_digest("text_", digest_bytes))
        .withColumn("sha256", text_digest("text_"))
        .withColumn("norm_", normalised("text_"))
        .join(bad, "digest", "left_semi")
        .withColumn("tie", F.monotonically_increasing_id())
    )
    keyed = F.struct("doc_id", F.struct(F.coalesce("src_file", F.lit(0)), F.coalesce("src_row", "tie")))
    rows = rows.withColumn("me", keyed)
    classes = rows.groupBy("digest", "norm_").agg(F.min("me").alias("first"), F.count(F.lit(1)).alias("group_size"))
    return rows.join(classes, ["digest", "norm_"]).select(
        "doc_id",
        F.col("first.doc_id").alias("keep_id"),
        "group_size",
        (F.col("me") == F.col("first")).alias("kept"),
        "sha256",
        "src_file",
        "src_row",
    )


def duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_bytes: int = 32) -> DataFrame:
    """One row per record: doc_id, keep_id, group_size, kept, text_sha256,
    src_file and src_row.

    ``digest_bytes`` shortens the state's key; results do not depend on it.
    """
    spark = docs.sparkSession
    arrivals_path, state_path = land(docs, id_col, text_col, digest_bytes), fresh_path(spark, "dedup-state")
    absorb(spark, arrivals_path, state_path)
    arrivals = located(spark.read.parquet(arrivals_path))
    if not spark.read.parquet(arrivals_path).head(1):
        empty = "doc_id long, keep_id long, group_size long, kept boolean, text_sha256 string, src_file long, src_row long"
        return spark.createDataFrame([], empty)
    state = materialise(read_state(spark, state_path), "dedup-classes")
    bad = collided(docs, state, text_col, digest_bytes)
    has_bad = bool(bad.head(1))  # never with whole SHA-256 digests
    joined = by_key(arrivals, state.withColumn("size", F.col("group_size")), ["digest"])
    if has_bad:
        joined = joined.join(bad, "digest", "left_anti")
    out = joined.select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("locator") == F.col("keep_at")).alias("kept"),
        "sha256",
        "src_file",
        "src_row",
    )
    if has_bad:
        out = out.unionByName(_by_text(docs, bad, id_col, text_col, digest_bytes))
    return out.withColumn("text_sha256", F.lower(F.hex("sha256"))).drop("sha256")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, all columns.

    Rows are told apart by their place in the files of ``docs``; a table that is
    not a file scan is written to the shared folder first.
    """
    spark = docs.sparkSession
    if with_locator(docs).filter("src_row is not null").head(1) == []:
        path = fresh_path(spark, "dedup-input")
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
    gone = duplicates(docs, id_col, text_col).filter("not kept").select(
        F.col("src_file").alias("gone_file"), F.col("src_row").alias("gone_row")
    )
    same = (F.col("src_file") == F.col("gone_file")) & (F.col("src_row") == F.col("gone_row"))
    left = without(with_locator(docs), materialise(gone, "dedup-gone"), same)
    return left.select(*[F.col(f"`{c}`") for c in docs.columns])
