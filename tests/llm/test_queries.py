"""The registered queries: names, types and rows of what they return."""

from __future__ import annotations

import zlib

import pytest

import __spark_entry__
from tidemark.llm import shared

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_sharding": "doc_id long, size long, text_crc32 long, law string, shard int, slot long, grown_shard int",
    "op2_best_fit_packing": "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long",
    "op3_toxicity": "doc_id long, held_out boolean, score double, predicted int",
    "op4_simhash": "doc_id long, fingerprint string, component_id long",
    "op5_context_tree": "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double",
    "op6_pivot_index": "vec_id long, n_links long, component_id long, kept boolean",
    "op7_quality": "doc_id long, held_out boolean, score double, predicted int",
    "op8_exact_dedup": "doc_id long, keep_id long, group_size long, kept boolean, text_sha256 string",
    "op9_language": "doc_id long, held_out boolean, lang_pred string, score double",
    "op10_chunked_bpe": "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string",
    "op11_centroid_clustering": "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string",
    "op13_line_dedup": "doc_id long, n_lines long, n_dropped long, kept_sha256 string",
}
FOLDS = {"op3_toxicity": (4, 2), "op5_context_tree": (10, 0), "op7_quality": (5, 0), "op9_language": (4, 2)}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_rows(spark, name):
    got = __spark_entry__.queries()[name](spark, SF)
    kinds = {"bigint": "long"}
    have = {c: kinds.get(t, t) for c, t in got.dtypes}
    want = dict(x.split() for x in COLUMNS[name].split(", "))
    assert {c: have.get(c) for c in want} == want
    rows = got.collect()
    key = next(iter(want))
    given = shared.table(spark, SF, "embeddings" if key == "vec_id" else "documents")
    ids = sorted(r[key] for r in given.select(key).collect())
    assert (sorted({r[key] for r in rows}) if name == "op2_best_fit_packing" else sorted(r[key] for r in rows)) == ids
    if name in FOLDS:
        n, rest = FOLDS[name]
        assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % n == rest) for r in rows)
    if "predicted" in want:
        assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
