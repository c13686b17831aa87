"""The ``opN_`` queries over the driver's tables, with their SQL where it exists."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import (
    centroids,
    chunked_bpe,
    context_tree,
    exact_dedup,
    hard_negatives,
    language,
    line_dedup,
    packing,
    pivot_index,
    quality,
    sharding,
    simhash,
    toxicity,
)
from tidemark.llm.shared import fresh_path, id_bucket, table

N_SHARDS = 24


def vocabulary() -> str:
    return public_tokenizers.path("word_bpe_49k.json")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_documents(table(spark, sf_dir, "documents"), N_SHARDS, fresh_path(spark, "slot-map"))
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "virtual_slot",
        "map_version",
    )


def _held_out(fold: tuple[int, int]) -> Column:
    return (id_bucket("doc_id", fold[0]) == fold[1]).alias("held_out")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select("doc_id", _held_out(toxicity.HELD_OUT), "score", "predicted")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_tree.scored(table(spark, sf_dir, "documents"))


def op6_pivot_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivot_index.near_duplicates(table(spark, sf_dir, "embeddings"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model).select("doc_id", _held_out(quality.HELD_OUT), "score", "predicted")


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language.identify(docs, language.learn(docs))
    return found.select("doc_id", _held_out(language.HELD_OUT), "lang_pred", "score")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(table(spark, sf_dir, "documents"), vocabulary()))


def op10_chunked_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunked_bpe.round_trip_digests(table(spark, sf_dir, "documents"), vocabulary())


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.clustered(table(spark, sf_dir, "embeddings"), k=8, rounds=10, width=64, scale=1024, seed=3)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mined(table(spark, sf_dir, "embeddings"))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.without_common_lines(table(spark, sf_dir, "documents"), least_docs=10, least_chars=1)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


OP8_SQL = r"""
WITH n AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id,
       min(doc_id) OVER w AS keep_id,
       count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept,
       text_sha256
FROM n WINDOW w AS (PARTITION BY text_sha256)
"""

OP6_SQL = """
WITH RECURSIVE
v AS (
  SELECT row_number() OVER () AS r, vec_id, embedding::DOUBLE[] AS e,
         coalesce(len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
                  AND len(list_filter(embedding, lambda x: x <> 0)) > 0, false) AS usable
  FROM embeddings
),
links AS (
  SELECT a.r AS a, b.r AS b FROM v a JOIN v b ON a.r <> b.r AND len(a.e) = len(b.e)
  WHERE a.usable AND b.usable AND list_cosine_similarity(a.e, b.e) >= 0.95
),
reach AS (
  SELECT r AS a, r AS b FROM v
  UNION
  SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
),
low AS (SELECT reach.a AS r, min(v.vec_id) AS component_id FROM reach JOIN v ON v.r = reach.b GROUP BY reach.a),
n AS (SELECT a AS r, count(*) AS n_links FROM links GROUP BY a)
SELECT v.vec_id, coalesce(n.n_links, 0) AS n_links, low.component_id, v.vec_id = low.component_id AS kept
FROM v JOIN low USING (r) LEFT JOIN n USING (r)
"""



def lloyd_sql(k: int, rounds: int) -> str:
    """The rounds one after another: every vector against all centroids (c0, c1, ...),
    then the floors of the means, dimension by dimension."""
    parts = [
        "v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * x::DOUBLE) AS BIGINT)) AS e FROM embeddings"
        " WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0)",
        "c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1)::INT AS cluster, e AS c FROM v"
        f" ORDER BY sha256('3:' || vec_id) LIMIT {k})",
    ]
    for r in range(rounds + 1):
        parts.append(
            f"a{r} AS MATERIALIZED (SELECT vec_id, any_value(e) AS e, arg_min(cluster, (d, cluster)) AS cluster, min(d) AS distance FROM"
            f" (SELECT vec_id, e, cluster, list_sum(list_transform(range(1, 65), lambda i: (e[i] - c[i]) * (e[i] - c[i])))::BIGINT AS d FROM v CROSS JOIN c{r}) GROUP BY vec_id)"
        )
        if r < rounds:
            parts.append(
                f"m{r} AS (SELECT cluster, list(x ORDER BY i) AS c FROM (SELECT cluster, i, CAST(floor(sum(x)::DOUBLE / count(*)) AS BIGINT) AS x FROM"
                f" (SELECT cluster, unnest(e) AS x, unnest(range(64)) AS i FROM a{r}) GROUP BY 1, 2) GROUP BY 1),"
                f" c{r + 1} AS MATERIALIZED (SELECT c{r}.cluster, coalesce(m{r}.c, c{r}.c) AS c FROM c{r} LEFT JOIN m{r} USING (cluster))"
            )
    return (
        "WITH " + ",\n".join(parts) + f" SELECT vec_id, cluster, distance, sum(distance) OVER (PARTITION BY cluster)::BIGINT AS cluster_inertia,"
        f" sum(distance) OVER ()::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} USING (cluster)"
    )


OP12_SQL = """
WITH v AS MATERIALIZED (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
),
s AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, a.label AS own, b.vec_id AS other_id, b.label, list_inner_product(a.e, b.e)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
),
p AS (
  SELECT anchor_id, own, other_id AS positive_id, score AS positive_score FROM s WHERE label = own
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT anchor_id, positive_id, row_number() OVER w::INT AS rank, other_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE s.label <> p.own AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id)
QUALIFY row_number() OVER w <= 10
"""

OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS MATERIALIZED (
  SELECT r, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT r, unnest(lines) AS line, unnest(range(len(lines))) AS i FROM d)
),
common AS (SELECT key FROM l WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT r) >= 10),
k AS (
  SELECT r, count(*) AS n_lines, count(common.key) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (common.key IS NULL), '') AS kept
  FROM l LEFT JOIN common USING (key) GROUP BY r
)
SELECT doc_id, n_lines, n_dropped, sha256(kept) AS kept_sha256 FROM d JOIN k USING (r)
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": op1_sharding,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_toxicity": op3_toxicity,
    "op4_simhash": op4_simhash,
    "op5_context_tree": op5_context_tree,
    "op6_pivot_index": op6_pivot_index,
    "op7_quality": op7_quality,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_language": op9_language,
    "op10_chunked_bpe": op10_chunked_bpe,
    "op11_centroid_clustering": op11_centroid_clustering,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_line_dedup": op13_line_dedup,
}

ORACLE_SQL: dict[str, str] = {
    "op6_pivot_index": OP6_SQL,
    "op8_exact_dedup": OP8_SQL,
    "op11_centroid_clustering": lloyd_sql(8, 10),
    "op12_hard_negatives": OP12_SQL,
    "op13_line_dedup": OP13_SQL,
}
