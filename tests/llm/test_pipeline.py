"""The pipeline's stages, one after another, against brute force on a small table."""

from __future__ import annotations

import re

import corpus_pipeline
from tidemark.llm import language, shared, toxicity

SF = "/root/testdata/sf0.001"


def brute_representatives(rows):
    """Smallest identifiers of the groups that chains of a similarity of 0.8 or more
    of five-word shingle sets make."""
    sets, root = [], list(range(len(rows)))
    for _, text in rows:
        w = re.sub("[A-Z]", lambda m: m[0].lower(), text or "").encode().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)})

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            both = len(a & b)
            if both >= 0.8 * (len(a) + len(b) - both):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return {rows[find(i)][0] for i in range(len(rows))}


def test_stages(spark):
    docs = shared.table(spark, SF, "documents")
    columns, seen = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        docs = shared.materialise(stage(spark, before, SF), f"test-stage-{k}")
        seen[name] = (before, docs)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
    ids = {n: ({r[0] for r in a.select("doc_id").collect()}, {r[0] for r in b.select("doc_id").distinct().collect()}) for n, (a, b) in seen.items()}

    before = seen["toxicity"][0]
    scores = toxicity.score(before, toxicity.fit(before, shared.table(spark, SF, "labels"))).collect()
    assert ids["toxicity"][1] == {r["doc_id"] for r in scores if r["score"] < 0.3}

    before = seen["language"][0]
    found = language.identify(before, language.learn(before)).collect()
    assert ids["language"][1] == {r["doc_id"] for r in found if r["lang_pred"] != "und" and r["bits"] <= language.FOREIGN_BITS}

    first = {}
    for r in seen["exact dedup"][0].orderBy("doc_id").collect():
        first.setdefault(re.sub(r"[\x20\x09-\x0d]+", " ", r["text"]), r["doc_id"])
    assert ids["exact dedup"][1] == set(first.values())

    near = seen["near dedup"][0].orderBy("doc_id").collect()
    assert ids["near dedup"][1] == brute_representatives([(r["doc_id"], r["text"]) for r in near])
    assert ids["packing"][1] == ids["packing"][0]


def test_run_equals_stages(spark):
    got = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "sequence_id", "offset"} <= set(got.columns) and got.count() > 100


def test_odd_and_empty_documents(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, shard int, length string, fp string"
    words = " ".join(f"word{'abcdefghij'[i % 10]}{'klmnop'[i % 6]} and the other" for i in range(60))
    texts = [None, "", " \n", "!!! 123", words, words, words.replace(" ", "  "), words + " again", "x" * 50_000, "Short text.", None]
    rows = [(i, t, "en", "s", 0, 1, "z", "f") for i, t in enumerate(texts)] + [(None, "a text without a number " * 9, None, None, None, None, None, None)]
    known = shared.table(spark, SF, "documents").filter("lang = 'en'").limit(60).collect()
    rows += [(1000 + r["doc_id"], r["text"], "en", "s", 0, 1, "z", "f") for r in known]
    df = spark.createDataFrame(rows, schema)
    got = corpus_pipeline.applied(spark, df, SF).toPandas()
    ids = set(got["doc_id"].fillna(-1).astype(int))
    assert {4, 9, -1} <= ids and not ids & {0, 1, 2, 3, 5, 6, 7, 10}
    assert corpus_pipeline.applied(spark, df.filter("false"), SF).count() == 0
