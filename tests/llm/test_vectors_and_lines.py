"""Centroids, hard negatives and line deduplication against plain loops."""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidemark.llm import centroids, hard_negatives, line_dedup
from tidemark.llm.queries import OP12_SQL

SF = "/root/testdata/sf0.001"


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, cluster string")


def random_rows(n, d, seed=1, labels=4):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)) / 8 + rng.normal(size=(labels, d))[rng.integers(0, labels, n)] / 3
    return [(i, [float(v) for v in np.float32(x[i])], int(rng.integers(0, labels)), "x") for i in range(n)]


# -- centroids ------------------------------------------------------------------------


def plain_lloyd(rows, k, rounds, d, scale=1024, seed=3):
    kept = [(i, [int(np.floor(float(np.float32(x)) * scale)) for x in v]) for i, v, *_ in rows if v is not None and len(v) == d and all(x is not None and np.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    c = [v for _, v in kept[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, m, strict=True)), j) for j, m in enumerate(c)) for _, v in kept]

    for _ in range(rounds):
        near = assign()
        for j in range(len(c)):
            mine = [v for (_, v), (_, n) in zip(kept, near, strict=True) if n == j]
            if mine:
                c[j] = [sum(col) // len(mine) for col in zip(*mine, strict=True)]
    return sorted((i is not None, i or 0, j, d_) for (i, _), (d_, j) in zip(kept, assign(), strict=True)), c


@pytest.mark.parametrize("block,chunk", [(3, 7), (10, 1000), (4, 1)])
def test_lloyd_equals_plain_rounds(spark, block, chunk):
    odd = [
        (None, [0.5] * 10, 1, "a"), (900, None, 1, "b"), (901, [0.1] * 9, 1, "c"), (902, [0.1] * 9 + [float("nan")], 0, "d"),
        (903, [0.1] * 9 + [float("inf")], 0, "e"), (904, [0.1] * 9 + [None], 0, "f"), (7, [0.25] * 10, 1, "g"), (7, [0.25] * 10, None, "g"),
    ]
    rows = random_rows(60, 10) + odd
    found, final = centroids.lloyd(vectors(spark, rows), k=5, rounds=4, width=10, block=block, chunk=chunk)
    got = sorted((r["vec_id"] is not None, r["vec_id"] or 0, r["cluster"], r["distance"]) for r in found.collect())
    want, c = plain_lloyd(rows, 5, 4, 10)
    assert got == want
    assert final.tolist() == c


def test_lloyd_sums(spark):
    got = centroids.clustered(vectors(spark, random_rows(40, 6)), k=3, rounds=2, width=6).collect()
    per = defaultdict(int)
    for r in got:
        per[r["cluster"]] += r["distance"]
    assert all(r["cluster_inertia"] == per[r["cluster"]] and r["inertia"] == sum(per.values()) for r in got)


def test_lloyd_small_tables(spark):
    assert centroids.clustered(vectors(spark, []), width=6).collect() == []
    got = centroids.clustered(vectors(spark, [(1, [0.5, -0.5], 0, "x"), (2, [0.5, -0.5], 0, "x")]), width=2, rounds=3).collect()
    assert [(r["cluster"], r["distance"]) for r in got] == [(0, 0)] * 2  # fewer rows than clusters, ties
    with pytest.raises(Exception, match="would not fit"):
        centroids.lloyd(vectors(spark, [(1, [1e9, 0.0], 0, "x")]), width=2)


def test_partial_distances_are_exact():
    x = np.array([[(1 << 27) - 1, -(1 << 27) + 1], [3, -4]])
    c = np.array([[-(1 << 27) + 1, (1 << 27) - 1], [0, 0]])
    want = [[sum((int(a) - int(b)) ** 2 for a, b in zip(r, m, strict=True)) for m in c] for r in x]
    assert centroids.partial_distances(x, c).tolist() == want


# -- hard negatives -------------------------------------------------------------------


def plain_mined(rows, every=100, positives=5, negatives=10):
    no_id = (1 << 63) - 1
    kept = []
    for i, v, label, _ in rows:
        if label is None or not v or not all(x is not None and np.isfinite(x) for x in v):
            continue
        label = (label + 1) % 10 if i is not None and i % 7 == 0 else label
        kept.append((no_id if i is None else i, [int(np.floor(float(np.float32(x)) * 256)) for x in v], label))
    out = []
    for n, (a, va, la) in enumerate(kept):
        if a == no_id or a % every:
            continue
        scored = sorted((-sum(p * q for p, q in zip(va, v, strict=True)), i, label) for m, (i, v, label) in enumerate(kept) if m != n and len(v) == len(va))
        for p, i, _ in [s for s in scored if s[2] == la][:positives]:
            hard = [s for s in scored if s[2] != la and 30 * -p <= 100 * -s[0] <= 90 * -p][:negatives]
            out += [(a, i, k + 1, j, -p, -s) for k, (s, j, _) in enumerate(hard)]
    return Counter(tuple(None if x == no_id else x for x in r) for r in out)


def mined(spark, rows, **kw):
    return Counter(tuple(r) for r in hard_negatives.mined(vectors(spark, rows), **kw).collect())


def test_mined_equals_plain_loops(spark):
    odd = [
        (None, [0.3] * 12, 1, "a"), (901, None, 1, "b"), (902, [0.1] * 5, 1, "c"), (903, [0.1] * 11 + [float("nan")], 0, "d"), (904, [], 0, "e"),
        (905, [0.2] * 12, None, "f"), (700, [0.25] * 12, 1, "g"), (700, [0.25] * 12, 1, "g"), (800, [0.0] * 12, 1, "h"), (1000, [-0.3] * 12, 77, "rare"),
        (1100, [0.1] * 5, 2, "other width"), (1101, [0.2] * 5, 2, "other width"), (1102, [0.11] * 5, 3, "other width"),
    ]
    rows = random_rows(400, 12) + odd
    assert mined(spark, rows, anchor_every=20) == plain_mined(rows, 20)


def test_blocks_of_any_size(spark, monkeypatch):
    rows = random_rows(300, 20, seed=5, labels=3)
    monkeypatch.setattr(hard_negatives, "ROWS", 17)
    monkeypatch.setattr(hard_negatives, "ANCHORS", 3)
    monkeypatch.setattr(hard_negatives, "ANCHORS_AT_ONCE", 5)
    assert mined(spark, rows, anchor_every=25) == plain_mined(rows, 25)


def test_no_anchors_and_no_rows(spark):
    assert not mined(spark, [])
    assert not mined(spark, [(1, [0.5], 1, "x"), (2, [0.5], 2, "x")])


@pytest.mark.parametrize("t", [-float("inf"), 0.0, 900.0, 3000.0, 9000.0])
def test_index_finds_all_above_and_leaves_out(t):
    rng = np.random.default_rng(3)
    # energy in the first dimensions, as the order of dimensions provides
    x = np.rint(rng.normal(size=(200, 30)) * 40 / np.arange(1, 31)).astype(int)
    q = x[:9]
    each = np.full(len(q), t) + np.arange(len(q)) * (t > 0)
    a, i, s = hard_negatives.above(q, each, x)
    full = q @ x.T
    want = {(m, n, int(full[m, n])) for m, n in zip(*np.nonzero(full >= each[:, None]), strict=True)}
    assert set(zip(a.tolist(), i.tolist(), s.tolist(), strict=True)) == want and len(a) == len(want)


def test_index_touches_less_for_high_thresholds(monkeypatch):
    rng = np.random.default_rng(4)
    x = np.rint(rng.normal(size=(2000, 64)) * 100 / np.arange(1, 65)).astype(int)
    seen = []
    whole = np.einsum
    monkeypatch.setattr(hard_negatives.np, "einsum", lambda *a: seen.append(len(a[1])) or whole(*a))
    q = x[:5]
    hard_negatives.above(q, 0.9 * (q * q).sum(axis=1), x)
    assert sum(seen) < 0.1 * len(q) * len(x)


def test_mined_equals_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    got = hard_negatives.mined(spark.read.parquet(f"{SF}/embeddings.parquet")).collect()
    assert sorted(tuple(r) for r in got) == sorted(con.sql(OP12_SQL).fetchall())


# -- lines ----------------------------------------------------------------------------


def plain_lines(texts, least_docs, least_chars=1):
    strip = " \t\n\x0b\x0c\r"
    lower = {c: c + 32 for c in range(65, 91)}
    split = [(t or "").split("\n") for t in texts]
    keys = [[x.strip(strip).translate(lower) for x in lines] for lines in split]
    n = Counter(k for own in keys for k in set(own) if len(k) >= least_chars)
    out = []
    for lines, own in zip(split, keys, strict=True):
        kept = [x for x, k in zip(lines, own, strict=True) if n[k] < least_docs]
        out.append((len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def some_texts():
    lines = ["Common Line", "  common line\t", "COMMON LINE\r", "ÄÖÜ Straße", "äÖÜ straße", "", "   ", "rare", "\x1crare", "a\x00b"]
    rng = np.random.default_rng(2)
    texts = ["\n".join(rng.choice(lines, size=rng.integers(0, 9))) for _ in range(60)]
    return [*texts, None, "", "\n", "\n\n\n", "x" * 300_000 + "\ncommon line\n" * 2000, "only here", "common line", "é\nÉ"]


@pytest.mark.parametrize("hot,most", [(10_000, 50_000), (5, 3), (1, 1_000)])
@pytest.mark.parametrize("least_docs,least_chars", [(10, 1), (2, 5), (1, 1)])
def test_lines_equal_plain_loops(spark, hot, most, least_docs, least_chars):
    texts = some_texts()
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, row string")
    got = line_dedup.without_common_lines(docs, least_docs, least_chars, hot=hot, most_hot=most).collect()
    by_id = {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["kept_text"]) for r in got}
    assert [by_id[i] for i in range(len(texts))] == plain_lines(texts, least_docs, least_chars)


def test_rows_of_one_identifier_are_documents(spark):
    docs = spark.createDataFrame([(None, "same\nown a"), (None, "same\nown b"), (5, "same"), (5, "same")], "doc_id long, text string")
    got = line_dedup.without_common_lines(docs, 4).collect()
    assert sorted((r["doc_id"] or 0, r["n_dropped"], r["kept_text"]) for r in got) == [(0, 1, "own a"), (0, 1, "own b"), (5, 1, ""), (5, 1, "")]
    assert sum(r["n_dropped"] for r in line_dedup.without_common_lines(docs, 5).collect()) == 0


def test_no_documents(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    got = line_dedup.without_common_lines(docs)
    assert got.columns == ["doc_id", "n_lines", "n_dropped", "kept_text"] and got.collect() == []


def test_copied_anchors_never_pass_the_driver(spark):
    """Anchors are copied for every part of the rows; Spark would broadcast so few rows."""
    rng = np.random.default_rng(2)
    rows = spark.createDataFrame([(i, i, i % 3, [int(x) for x in rng.integers(-99, 99, 8)], [0.0]) for i in range(300)], "r long, id long, label long, vec array<long>, ends array<double>")
    rows = hard_negatives.materialise(rows, "vector-rows")
    order = hard_negatives.dimension_order(rows)
    blocks = hard_negatives.materialise(hard_negatives.in_blocks(rows, order, 100, parts=1), "row-blocks")
    anchors = hard_negatives.in_blocks(rows.filter("id % 50 = 0"), order, 100, "ends", 1)
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "600")
    try:
        met = hard_negatives.met(blocks, anchors, 6, True)
        assert "Broadcast" not in met._jdf.queryExecution().executedPlan().toString()
        assert met.count() == blocks.count() == 3
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
