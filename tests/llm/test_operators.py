"""Corpus operators against brute force, exact round trips and held-out accuracy,
with nulls, empty and long texts, ties, repeated rows, empty tables and extra columns."""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from collections import Counter
from math import log10

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import (
    chunked_bpe, components, context_tree, exact_dedup, language, packing, pivot_index, quality, queries, sharding, shared, simhash,
    tokens, toxicity,
)

SF = "/root/testdata/sf0.001"
VOCAB = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard int, slot string, kept string, fp string"


@pytest.fixture(scope="module")
def odd(spark):
    """Odd rows, with columns whose names clash with those the operators make."""
    texts = [None, "", " \n", "a", "One two three four five", "one  two three\tfour five", "One two three four five", "x" * 50_000,
             "the idiot and pathetic moron is stupid worthless trash " * 1200, "Ünï çödé ﬁ́ <|endoftext|> don't", "!!! ??? 123", None]
    rows = [(i, t, "en", "s", 0, 1, "z", "k", "f") for i, t in enumerate(texts)]
    rows += [rows[4], (None, "no id", None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return shared.table(spark, SF, "documents")


@pytest.fixture(scope="module")
def labels(spark):
    return shared.table(spark, SF, "labels")


def held(doc_id, modulus):
    return zlib.crc32(str(doc_id).encode()) % modulus


# -- 1 sharding


def check_shards(got, n):
    assert (got.groupby("shard")["slot"].apply(lambda s: sorted(s) == list(range(len(s))))).all()
    assert got["shard"].between(0, n - 1).all()


def test_sharding(spark, docs, tmp_path):
    path = str(tmp_path / "map")
    got = sharding.shard_documents(docs, 24, path).toPandas()
    want = docs.toPandas()
    assert len(got) == len(want)
    check_shards(got, 24)
    sizes = want.set_index("doc_id")["text"].map(lambda t: len(t.encode()) + 8)
    assert (got.set_index("doc_id")["size"] == sizes.reindex(got["doc_id"]).to_numpy()).all()
    crc = want.set_index("doc_id")["text"].map(lambda t: zlib.crc32(t.encode()))
    assert (got.set_index("doc_id")["text_crc32"] == crc.reindex(got["doc_id"]).to_numpy()).all()
    load = got.groupby("shard")["size"].sum()
    assert load.max() - load.min() <= max(0.01 * load.mean(), sizes.max())
    first, second = sharding.load_map(spark, path, 0), sharding.load_map(spark, path)
    assert second.version == 1 and (first.shard == np.arange(4096) % 24).all()
    bigger = sharding.grow(second)
    assert set(bigger.shard[bigger.moved]) == {24} and (bigger.shard[~bigger.moved] == second.shard[~bigger.moved]).all()


def test_sharding_odd(odd, none, tmp_path):
    got = sharding.shard_documents(odd, 3, str(tmp_path / "a")).toPandas()
    assert len(got) == 14
    check_shards(got, 3)
    assert sharding.shard_documents(none, 3, str(tmp_path / "b")).count() == 0


# -- 8 exact dedup


def brute_dedup(rows):
    norm = {i: re.sub(r"[\x20\x09-\x0d]+", " ", t or "") for i, t in rows}
    groups: dict[str, list] = {}
    for i, t in norm.items():
        groups.setdefault(t, []).append(i)
    return {i: (min(groups[t]), len(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for i, t in norm.items()}


@pytest.mark.parametrize("digest_bytes", [32, 1])
def test_exact_dedup(docs, digest_bytes):
    want = brute_dedup([(r["doc_id"], r["text"]) for r in docs.collect()])
    got = exact_dedup.duplicates(docs, digest_bytes=digest_bytes).collect()
    assert len(got) == len(want)
    for r in got:
        assert (r["keep_id"], r["group_size"], r["text_sha256"]) == want[r["doc_id"]]
        assert r["kept"] == (r["doc_id"] == r["keep_id"])


def test_exact_dedup_odd(odd, none):
    got = exact_dedup.duplicates(odd).toPandas()
    assert len(got) == 14
    empty = got[got["text_sha256"] == hashlib.sha256(b"").hexdigest()]
    assert sorted(empty["doc_id"]) == [0, 1, 11] and empty["kept"].sum() == 1
    five = got[got["doc_id"].isin([4, 6])]
    assert (five["group_size"] == 3).all() and five["kept"].sum() == 1  # the repeated row once only
    assert got["kept"].sum() == got["text_sha256"].nunique()
    assert exact_dedup.duplicates(none).count() == 0
    kept = exact_dedup.deduplicated(odd)
    assert kept.columns == odd.columns and kept.count() == got["text_sha256"].nunique()


def test_state_goes_on(spark, docs):
    """Copies that arrive later are found in the state."""
    path, state = exact_dedup.land(docs.filter("doc_id < 100"), "doc_id", "text", 32), shared.fresh_path(spark, "state")
    exact_dedup.absorb(spark, path, state)
    more = exact_dedup.land(docs.filter("doc_id >= 100"), "doc_id", "text", 32)
    spark.read.parquet(more).write.mode("append").parquet(path)
    exact_dedup.absorb(spark, path, state)
    want = brute_dedup([(r["doc_id"], r["text"]) for r in docs.collect()])
    got = {(r["keep_id"], r["group_size"]) for r in exact_dedup.read_state(spark, state).collect()}
    assert got == {(k, n) for k, n, _ in want.values()}


def test_exact_dedup_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.sql(queries.OP8_SQL).df().sort_values("doc_id").reset_index(drop=True)
    got = queries.op8_exact_dedup(spark, SF).toPandas().sort_values("doc_id").reset_index(drop=True)
    pd.testing.assert_frame_equal(got[want.columns], want)


# -- 10 and 2 tokens


@pytest.fixture(scope="module")
def tok():
    return tokens.load_tokenizer(chunked_bpe.read_definition(VOCAB))


def test_chunked_bpe(docs, odd, none, tok):
    for df in (docs, odd):
        rows = [(r["doc_id"], r["text"] or "") for r in df.collect()]
        got = Counter(tuple(r) for r in chunked_bpe.round_trip_digests(df, VOCAB).collect())
        want = Counter()
        for i, t in rows:
            ids = tok.encode(t, add_special_tokens=False).ids
            raw, back = np.array(ids, dtype="<u4").tobytes(), tok.decode(ids, skip_special_tokens=False)
            want[i, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(back.encode()).hexdigest()] += 1
        assert got == want
    assert chunked_bpe.round_trip_digests(none, VOCAB).count() == 0


def test_encode_then_decode(odd, tok):
    enc = chunked_bpe.encoded(odd, VOCAB)
    want = sorted((r["doc_id"] or -1, tok.decode(r["ids"], skip_special_tokens=False)) for r in enc.collect())
    assert want == sorted((r["doc_id"] or -1, r["text"]) for r in chunked_bpe.decoded(enc, VOCAB).collect())


def other_vocabularies():
    given = json.loads(chunked_bpe.read_definition(VOCAB))
    bare = {**given, "normalizer": None}
    marked = {**given, "added_tokens": [*given["added_tokens"], {**given["added_tokens"][0], "id": 49408, "content": "hello"}]}
    bytewise = chunked_bpe.read_definition(VOCAB.replace("word_bpe_49k", "byte_bpe_50k"))
    return [bytewise, json.dumps(bare), json.dumps(marked)]


@pytest.mark.parametrize("which", range(3))
def test_vocabularies_with_other_rules(which):
    """No short way: the library's own ids, through each of the encoders."""
    definition = other_vocabularies()[which]
    lib = tokens.load_tokenizer(definition)
    words = tokens.WordEncoder(definition)
    chunks = chunked_bpe.ChunkEncoder(words, bits=4)
    texts = ["Hello World", "", "  two\n\nlines  ", "hello, don't STOP 12 " * 30, "naïve 漢字 Σς"]
    want = [lib.encode(t, add_special_tokens=False).ids for t in texts]
    assert not tokens.word_wise(definition) and tokens.word_wise(chunked_bpe.read_definition(VOCAB))
    for t, ids in zip(texts, want, strict=True):
        assert np.frombuffer(words.encode(t.encode()), "<u4").tolist() == ids
        got = np.frombuffer(chunks.encode(t.encode()), "<u4")
        assert got.tolist() == ids and chunks.decode(got) == lib.decode(ids, skip_special_tokens=False)
    flat, begins = words.encode_all(pa.array(texts))
    assert [flat[a:b].tolist() for a, b in zip(begins[:-1], begins[1:], strict=True)] == want


def test_joins_are_repaired(tok):
    words = tokens.WordEncoder(chunked_bpe.read_definition(VOCAB))
    enc = chunked_bpe.ChunkEncoder(words, bits=3)
    rng = np.random.default_rng(0)
    alphabet = list("aAbé'stT1²½ıİſß̀́\x1c\x85\xa0 ,.!\n\t漢Σς-") + ["<|endoftext|>"]
    for _ in range(1500):
        text = "".join(rng.choice(alphabet, rng.integers(0, 200)))
        assert np.frombuffer(enc.encode(text.encode()), "<u4").tolist() == tok.encode(text, add_special_tokens=False).ids
    assert enc.encoded and enc.reused


def test_shared_passage_is_reused():
    words = tokens.WordEncoder(chunked_bpe.read_definition(VOCAB))
    enc = chunked_bpe.ChunkEncoder(words, bits=5)
    passage = " ".join(f"w{i}" for i in range(2000)).encode()
    enc.encode(b"first " + passage)
    before = enc.encoded
    enc.encode(b"second, longer start " + passage)
    assert enc.encoded - before < 5 and enc.reused > 50


def test_shared_chunks_outlive_a_full_cache():
    words = tokens.WordEncoder(chunked_bpe.read_definition(VOCAB))
    enc = chunked_bpe.ChunkEncoder(words, bits=5, max_bytes=60_000)
    passage = " ".join(f"w{i}" for i in range(100)).encode()
    for k in range(200):
        enc.encode(passage)
        enc.encode(" ".join(f"v{k}x{i}" for i in range(100)).encode())
    enc.encode(passage)
    before = enc.encoded
    enc.encode(passage)
    assert enc.encoded == before and enc.reused > 150 * len(chunked_bpe.cut_points(passage, 5))
    assert len(enc.chunks) + len(enc.older) < 1000


def check_packing(got, capacity):
    for _, seq in got.sort_values("offset").groupby("sequence_id"):
        assert (seq["offset"].to_numpy() == np.concatenate([[0], np.cumsum(seq["length"])[:-1]])).all()
        assert seq["length"].sum() <= capacity


def test_packing(docs, odd, none, tok):
    for df in (docs, odd):
        got = packing.pack(packing.pieces(df, VOCAB)).toPandas()
        check_packing(got, 4096)
        want = Counter()
        for r in df.collect():
            ids = [*tok.encode(r["text"] or "", add_special_tokens=False).ids, 1]
            for k, at in enumerate(range(0, len(ids), 4096)):
                part = np.array(ids[at : at + 4096], dtype="<u4").tobytes()
                want[-1 if r["doc_id"] is None else r["doc_id"], k, at, len(part) // 4, zlib.crc32(part)] += 1
        rows = got.assign(doc_id=got["doc_id"].fillna(-1).astype(int))[["doc_id", "piece", "start", "length", "ids_crc32"]]
        assert Counter(map(tuple, rows.to_numpy().tolist())) == want
        assert got["sequence_id"].nunique() <= -(-int(got["length"].sum()) // 4096) + 1
    assert packing.pack(packing.pieces(none, VOCAB)).count() == 0


def test_plan_serves_every_piece():
    rng = np.random.default_rng(5)
    hist = Counter(rng.integers(1, 101, 5000).tolist())
    plan = packing.make_plan(dict(hist), 100)
    served = Counter()
    for p, n in zip(plan.patterns, plan.copies, strict=True):
        assert sum(p) <= 100
        for x in p:
            served[x] += n
    assert served == hist
    assert plan.sequences() <= 1.03 * sum(k * v for k, v in hist.items()) / 100


@pytest.mark.parametrize("times", [1, 25, 10_000])
def test_program_places_the_sequences(docs, tok, times):
    """The linear program and not best-fit places them, as few as best-fit alone."""
    hist = Counter(len(tok.encode(r["text"] or "", add_special_tokens=False).ids) % 4096 + 1 for r in docs.collect())
    hist = {k: v * times for k, v in hist.items() if k < 4096}
    solved, left = packing.solve(hist, 4096)
    assert all(sum(p) == 4096 for p in solved.patterns)
    served = Counter(left)
    for p, n in zip(solved.patterns, solved.copies, strict=True):
        for x in p:
            served[x] += n
    assert served == hist
    rest = packing._best_fit(left, 4096).sequences()
    assert solved.sequences() >= 0.85 * (solved.sequences() + rest)
    assert packing.make_plan(hist).sequences() <= packing._best_fit(dict(hist), 4096).sequences()


@pytest.mark.parametrize(
    "hist",
    [
        {1500: 1000, 1400: 1000},
        Counter((np.random.default_rng(0).integers(1, 100, 20_000) * 40).tolist()),
        Counter(np.random.default_rng(1).integers(2049, 4000, 5000).tolist()),
        Counter((np.random.default_rng(2).integers(20, 580, 8000) * 7 + 3).tolist()),
    ],
    ids=["two lengths", "multiples of 40", "over half", "7 k + 3"],
)
def test_program_where_nothing_fills_exactly(hist):
    """Lengths that do not add up to the capacity: the program still places nearly all,
    in no more sequences than best-fit, and its bound holds."""
    hist = {int(k): int(v) for k, v in hist.items()}
    plan, (solved, _) = packing.make_plan(hist), packing.solve(hist, 4096, leave_room=True)
    served = Counter()
    for p, n in zip(plan.patterns, plan.copies, strict=True):
        assert sum(p) <= 4096
        for x in p:
            served[x] += n
    assert served == Counter(hist)
    placed = sum(sum(p) * n for p, n in zip(solved.patterns, solved.copies, strict=True))
    assert placed >= 0.9 * sum(k * v for k, v in hist.items())
    # where best-fit comes within half a hundredth of the bound, the program may need some more
    assert plan.sequences() <= max(packing._best_fit(dict(hist), 4096).sequences(), 1.006 * plan.bound)
    assert 0.85 * plan.sequences() < plan.bound <= plan.sequences()


def test_dual_bound_by_brute_force():
    """No packing of a few pieces has fewer sequences than any worths say."""
    rng = np.random.default_rng(4)
    for _ in range(30):
        items = rng.integers(1, 20, 6).tolist()
        least = len(items)
        for code in range(4 ** len(items)):  # every way into at most four sequences
            room = [0] * 4
            for k, x in enumerate(items):
                room[code // 4**k % 4] += x
            if max(room) <= 24:
                least = min(least, sum(r > 0 for r in room))
        lengths, need = np.unique(items, return_counts=True)
        for worth in (lengths / 24, rng.random(len(lengths)) + 0.1):
            assert packing.dual_bound(lengths, worth, need, 24) <= least + 1e-9


def test_equal_rows_are_split(spark):
    found = spark.createDataFrame([(None, 0, 0, 1, 7)] * 600, "doc_id long, piece int, start long, length int, ids_crc32 long").repartition(3)
    got = packing.pack(found, 64, rows_per_salt=50)
    check_packing(got.toPandas(), 64)
    assert got.count() == 600


def test_knapsack_by_brute_force():
    rng = np.random.default_rng(8)
    for _ in range(200):
        lengths, room = np.sort(rng.choice(np.arange(1, 15), 5, replace=False)), int(rng.integers(1, 30))
        worth, most = rng.random(5), rng.integers(1, 4, 5)
        fill = [(c @ worth, c) for c in np.stack(np.meshgrid(*[range(m + 1) for m in most]), -1).reshape(-1, 5) if c @ lengths == room]
        got = packing.price(lengths, worth, most, room)
        assert (got is None) == (not fill)
        if fill:
            assert sum(got) == room and sum(worth[np.searchsorted(lengths, got)]) == pytest.approx(max(f[0] for f in fill))


def test_hot_length_is_split(spark):
    rows = [(i, 0, 0, 7 if i % 3 else 5, i) for i in range(1000)]
    found = spark.createDataFrame(rows, "doc_id long, piece int, start long, length int, ids_crc32 long")
    got = packing.pack(found, 64, rows_per_salt=50).toPandas()
    check_packing(got, 64)
    assert sorted(got["doc_id"]) == list(range(1000)) and got["sequence_id"].nunique() <= -(-int(got["length"].sum()) // 64) + 1
    assert packing._salts({7: 667, 5: 333}, 50) == {7: 14, 5: 7}


# -- 3, 7 and 9 classifiers


def auc(y, s):
    rank = pd.Series(s).rank().to_numpy()
    n = y.sum()
    return (rank[y == 1].sum() - n * (n + 1) / 2) / (n * (len(y) - n))


BIG = "/root/testdata/sf0.01"


@pytest.mark.parametrize(("op", "label", "least"), [(toxicity, "toxic", 0.7), (quality, "quality", 0.95)])
def test_classifier(spark, op, label, least, odd, none):
    docs, labels = shared.table(spark, BIG, "documents"), shared.table(spark, BIG, "labels")
    model = op.fit(docs, labels)
    got = op.score(docs, model).toPandas().merge(labels.toPandas(), on="doc_id")
    assert got["score"].between(0, 1).all() and (got["predicted"] == (got["score"] >= 0.3)).all()
    mod, rem = op.HELD_OUT
    out = got[got["doc_id"].map(lambda i: held(i, mod) == rem)]
    assert auc(out[label].to_numpy(), out["score"].to_numpy()) > least
    again = op.fit(docs.repartition(7), labels.repartition(3))
    assert np.allclose(op.score(docs, again).toPandas().sort_values("doc_id")["score"], op.score(docs, model).toPandas().sort_values("doc_id")["score"])
    assert op.score(odd, model).count() == 14 and op.score(none, model).count() == 0
    nothing = op.fit(docs, labels.filter("false"))
    assert op.score(odd, nothing).filter("score is null").count() == 0
    flipped = labels.withColumn(label, F.when(shared.id_bucket("doc_id", mod) == rem, 1 - F.col(label)).otherwise(F.col(label)))
    same = op.fit(docs, flipped)
    assert np.allclose(op.score(odd, same).toPandas()["score"], op.score(odd, model).toPandas()["score"])


def test_toxicity_by_brute_force(spark, docs, odd):
    """The risk and its gradients by finite differences, on both sides of zero; scores
    by a plain loop over the words of whole texts."""
    rng = np.random.default_rng(3)
    for prior, shift in ((0.3, 1.0), (0.9, 0.0)):
        fp, fu = rng.normal(2 - shift, 1, 7), rng.normal(-2 + shift, 1, 9)
        value, gp, gu = toxicity.risk(fp, fu, prior)
        bracket = sum(np.log1p(np.exp(x)) for x in fu) / 9 - prior * sum(np.log1p(np.exp(x)) for x in fp) / 7
        assert (bracket < 0) == (prior == 0.9)
        assert value == pytest.approx(-bracket if bracket < 0 else bracket + prior * sum(np.log1p(np.exp(-x)) for x in fp) / 7)
        for x, g in ((fp, gp), (fu, gu)):
            for i in range(len(x)):
                x[i] += 1e-5
                up = toxicity.risk(fp, fu, prior)[0]
                x[i] -= 2e-5
                low = toxicity.risk(fp, fu, prior)[0]
                x[i] += 1e-5
                assert g[i] == pytest.approx((up - low) / 2e-5, abs=1e-6)
    model = toxicity.fit(docs, shared.table(spark, SF, "labels"))
    for df in (docs, odd):
        want = Counter()
        for r in df.collect():
            words = {w for w in re.split(r"[\W\d_]+", (r["text"] or "").lower()) if w}
            f = model.bias + sum(model.weights.get(zlib.crc32(w.encode()) >> 1, 0.0) for w in words)
            want[r["doc_id"], round(1 / (1 + np.exp(-min(30, max(-30, f)))), 9)] += 1
        assert Counter((r["doc_id"], round(r["score"], 9)) for r in toxicity.score(df, model).collect()) == want


def plain_features(text):
    """(kind, feature) of a text: words, n-grams of marked words, pairs."""
    words = (text or "").encode().split()
    out = [(0, w) for w in words] + [(3, p) for p in zip(words, words[1:], strict=False)]
    for w in words:
        m = b"<" + w + b">"
        out += [(n - 2, m[i : i + n]) for n in (3, 4) for i in range(len(m) - n + 1)]
    return out


def plain_slot(kind, feature):
    base, mod = 0x9E3779B97F4A7C15, 1 << 64

    def word(w):
        return sum(b * pow(base, i + 1, mod) for i, b in enumerate(b"<" + w + b">")) % mod

    if kind == 0:
        x = word(feature)
    elif kind == 3:
        x = (word(feature[0]) * base + word(feature[1])) % mod
    else:
        x = 0
        for b in feature:
            x = (x * base + b) % mod
    x = (x + kind) * 0xBF58476D1CE4E5B9 % mod
    x ^= x >> 29
    return (x * 0x94D049BB133111EB % mod) >> (64 - quality.BUCKET_BITS)


def test_quality_by_brute_force(docs, odd):
    """Features, shares and scores against a plain loop; the gradients of a step against
    finite differences of the loss."""
    texts = [r["text"] or "" for r in docs.limit(12).collect()] + [r["text"] or "" for r in odd.collect()] + ["a", "b a", "\x1c x\x0by  z "]
    arr, rng = pa.array(texts), np.random.default_rng(1)
    model = quality.Model(rng.normal(size=1 << quality.BUCKET_BITS).astype(np.float32), 0.25)
    got, have = model.score(arr), quality.counted(arr, at_once=5)
    for i, t in enumerate(texts):
        slots = Counter(plain_slot(*f) for f in plain_features(t))
        n = sum(slots.values())
        want = sum(model.project[s] * k for s, k in slots.items()) / max(n, 1) + 0.25
        assert got[i] == pytest.approx(want, abs=1e-5)
        at = slice(have.begins[i], have.begins[i + 1])
        assert dict(zip(have.slot[at].tolist(), have.share[at], strict=True)) == pytest.approx({s: k / n for s, k in slots.items()})

    y = np.arange(len(texts)) % 2
    one = quality.train(have, y, epochs=1, min_steps=0, batch=len(texts), rate=0.1)  # one step: outputs from zero
    table = (np.random.default_rng(11).uniform(-1, 1, (1 << quality.BUCKET_BITS, quality.DIMENSION)) / quality.DIMENSION).astype(np.float32)

    def loss(out):
        total = 0.0
        for i in range(len(texts)):
            at = slice(have.begins[i], have.begins[i + 1])
            z = (have.share[at, None] * table[have.slot[at]]).sum(0).astype(float) @ out
            total += np.log(np.exp(z).sum()) - z[y[i]]
        return total

    grad = np.zeros((quality.DIMENSION, 2))
    for k in np.ndindex(grad.shape):
        step = np.zeros_like(grad)
        step[k] = 1e-4
        grad[k] = (loss(step) - loss(-step)) / 2e-4
    out = -0.1 * grad / np.sqrt(len(texts))
    assert np.allclose(one.project, table @ (out[:, 1] - out[:, 0]), atol=1e-4)


def test_toxic_rows_go(spark, odd, none):
    docs, labels = shared.table(spark, BIG, "documents"), shared.table(spark, BIG, "labels")
    model = toxicity.fit(docs, labels)
    kept = toxicity.kept(odd, model)
    ids = [r["doc_id"] for r in kept.collect()]
    assert kept.columns == odd.columns and 8 not in ids and len(ids) == 13
    assert toxicity.kept(none, model).count() == 0


def test_language(spark, odd, none):
    docs = shared.table(spark, BIG, "documents")
    sample = language.learn(docs)
    got = language.identify(docs, sample).toPandas().merge(docs.select("doc_id", "lang").toPandas(), on="doc_id")
    out = got[got["doc_id"].map(lambda i: held(i, 4) == 2)]
    assert (out["lang_pred"] == out["lang"]).mean() > 0.97
    found = {r["doc_id"]: r for r in language.identify(odd, sample).collect()}
    assert [i for i in range(12) if found[i]["lang_pred"] == "und"] == [0, 1, 2, 10, 11]
    assert language.identify(none, sample).count() == 0
    assert {r["lang_pred"] for r in language.identify(odd, language.learn(none)).collect()} == {"und"}
    kept = language.kept(odd, sample)
    assert kept.columns == odd.columns and not {0, 1, 2, 10, 11} & {r["doc_id"] for r in kept.collect()}


@pytest.mark.parametrize("dense", [3, 64])
def test_cross_parsing_by_brute_force(dense):
    """Whole texts, some of many segments and some that repeat themselves."""
    sample = {"a": "abra cadabra abracad", "b": "the cat sat on the mat " + "ab" * 900}
    parser = language.Parser(sample, dense)
    rng = np.random.default_rng(2)
    texts = ["".join(rng.choice(list("abcdrthe sz."), rng.integers(1, 60))) for _ in range(200)] + ["", "zzz", "..."]
    texts += ["".join(rng.choice(list("abcdrthe s"), n)) for n in (511, 512, 513, 1500, 4000)] + ["ab" * 2000, "abra" * 700, "the cat sat " * 300]
    got = parser.phrases(parser.symbols(texts), at_once=7)

    def plain(t):
        return re.sub(r"[^a-z]+", " ", t.lower())

    for i, t in enumerate(texts):
        for k, lang in enumerate(parser.langs):
            s, ref, n, at = plain(t), plain(sample[lang]), 0, 0
            while at < len(s):
                end = at + 1
                while end < len(s) and s[at : end + 1] in ref:
                    end += 1
                at, n = end, n + 1
            assert got[i, k] == n


def test_large_alphabets():
    """Four languages of 20 000 signs each stay small and are told apart."""
    rng = np.random.default_rng(6)
    words = [["".join(map(chr, 0x4E00 + rng.integers(5000 * k, 5000 * k + 4900, 3))) for _ in range(9000)] for k in range(4)]
    parser = language.Parser({f"l{k}": "".join(w) for k, w in enumerate(words)})
    assert parser.table.nbytes + parser.rare_keys.nbytes + parser.rare_targets.nbytes < 200 << 20
    lang, score, _ = parser.predict(["".join(w[100:300]) for w in words])
    assert lang == ["l0", "l1", "l2", "l3"] and (score > 0.9).all()


def test_languages_of_long_texts_are_learned(spark):
    long_ = [(i, "ceci est un texte assez long " * 2500, "fr") for i in range(8)]
    rows = [*long_, *[(100 + i, "this is a short text", "en") for i in range(8)], *[(None, f"das ist ein text {i}", "de") for i in range(3)], (300, None, "xx"), (301, "123", "yy")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    sample = language.learn(df)
    assert set(sample) == {"de", "en", "fr"} and len(sample["fr"]) > 70_000


# -- 4 simhash


def plain_fingerprint(text, words=4):
    w = [x for x in re.split(r"[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    if not w:
        return 0
    parts = [" ".join(w[i : i + words]) for i in range(len(w) - words + 1)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(values, radius):
    root = list(range(len(values)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(values):
        for j in range(i):
            if bin(a ^ values[j]).count("1") <= radius:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(values))]


def test_simhash(docs, odd, none):
    for df in (docs, odd):
        rows = [r for r in df.select("doc_id", "text").collect() if r["doc_id"] is not None]
        fps = [plain_fingerprint(r["text"]) for r in rows]
        comp = plain_components(fps, 4)
        low = pd.Series([r["doc_id"] for r in rows]).groupby(comp).transform("min")
        got = {r["doc_id"]: r for r in simhash.near_duplicates(df.filter("doc_id is not null")).collect()}
        for r, f, c in zip(rows, fps, low, strict=True):
            assert got[r["doc_id"]]["fingerprint"] == f"{f:016x}" and got[r["doc_id"]]["component_id"] == c
    assert simhash.near_duplicates(odd).count() == 14 and simhash.near_duplicates(none).count() == 0


@pytest.mark.parametrize(("block", "scheme"), [(16384, simhash.Scheme()), (3, simhash.Scheme()), (20, simhash.Scheme(radius=9, parts=2))])
def test_no_pair_is_missed(spark, block, scheme):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 62, 120, dtype=np.uint64)
    sets = [base]
    for _ in range(4):
        y = base.copy()
        for _ in range(scheme.radius):
            y ^= np.uint64(1) << rng.integers(0, 64, len(y)).astype(np.uint64)
        sets.append(y)
    x = np.unique(np.concatenate(sets))
    s = x.view(np.int64)
    nodes = spark.createDataFrame(pd.DataFrame({"node": s, "fp": s, "c0": 0 * s, "c1": 0 * s, "f1": s[::-1], "f2": 0 * s}))
    got = {r["node"]: r["root"] for r in components.components(simhash.links(nodes, scheme, block)).collect()}
    comp = plain_components([int(v) for v in x], scheme.radius)
    low = pd.Series(s).groupby(comp).transform("min")
    assert all(got.get(int(v), int(v)) == int(m) for v, m in zip(s, low, strict=True))


def test_near_copies_go_and_others_stay(spark):
    rng = np.random.default_rng(4)
    vocab = ["".join(rng.choice(list("abcdefghij"), 5)) for _ in range(3000)]
    texts = []
    for _ in range(40):
        t = list(rng.choice(vocab, 300))
        texts.append(" ".join(t))
        for k in rng.choice(300, 3, replace=False):
            t[k] = "edited"
        texts.append(" ".join(t))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r["doc_id"] for r in simhash.representatives(df).collect()}
    assert set(range(0, 80, 2)) <= kept and len(kept) <= 42


def test_near_copies_with_repeated_identifiers(spark):
    """Rows go by their own text: a copy goes though its identifier occurs again, and the
    other text stays; without identifiers one row of a group stays."""
    text = lambda k: " ".join(f"{k}w{i}" for i in range(200))
    rows = [(3, text("a")), (5, text("a") + " more"), (5, text("b")), (7, text("b") + " more"), (None, text("c")), (None, text("c") + " more"), (None, text("a") + " most"), (9, text("d")), (9, text("d") + " more")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("root", F.lit("x")).withColumn("text_key", F.lit(1))
    kept = simhash.representatives(df)
    assert kept.columns == df.columns
    got = [(r["doc_id"], r["text"]) for r in kept.collect()]
    sure = {(3, text("a")), (5, text("b"))}
    assert sure <= set(got) and len(got) == 4
    for i, k in ((None, "c"), (9, "d")):
        pair = [(i, text(k)), (i, text(k) + " more")]
        first = min(pair, key=lambda r: hashlib.md5(r[1].encode()).digest())
        assert first in got and len(set(pair) & set(got)) == 1


def test_a_hot_identifier_keeps_texts_apart(spark):
    text = lambda k: " ".join(f"{k}w{i}" for i in range(120))
    rows = [(0, text(k)) for k in range(60)] + [(0, text(k) + " more") for k in range(60)] + [(1, text(2) + " most")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [r["text"].split()[0] for r in simhash.representatives(df).collect()]
    assert Counter(got) == {f"{k}w0": 1 for k in range(60)}


def test_large_groups_in_blocks_give_the_same(spark):
    """Chains, unlike members, copies and missing identifiers; blocks of 3, 7 and all."""
    rng = np.random.default_rng(21)
    vocab = ["".join(rng.choice(list("abcdefghij"), 5)) for _ in range(2000)]
    rows, t = [], list(rng.choice(vocab, 120))
    for k in range(30):  # each like the next, the first and the last unlike
        rows.append(" ".join(t))
        t[4 * k : 4 * k + 4] = list(rng.choice(vocab, 4))
    for k in range(6):  # pairs apart from the chain
        u = list(rng.choice(vocab, 90))
        rows += [" ".join(u), " ".join([*u, "more"])]
    rows += ["", "one", "two words"]
    ids = [None if i % 11 == 5 else int(rng.integers(0, 40)) for i in range(len(rows))]
    shape = "root long, doc_id long, text_key binary, text binary"
    of = {1: rows, 2: [x[::-1] for x in rows[:-3]]}  # equal texts are never in two groups
    data = [(r, None if i is None else i + 100 * r, hashlib.md5(x.encode()).digest(), x.encode()) for r, xs in of.items() for i, x in zip(ids, xs, strict=False)]
    members = spark.createDataFrame(data, shape)
    told = lambda df: sorted(((r["doc_id"], bytes(r["text_key"])) for r in df.distinct().collect()), key=str)
    want = told(simhash._beaten(members, 5))
    assert len(want) > 50
    for most in (3, 7, 1000):
        assert told(simhash._beaten_in_blocks(members, 5, most)) == want
    assert simhash._beaten_in_blocks(members.filter("false"), 5, 3).count() == 0


def test_representatives_of_large_groups(spark):
    words = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join([*words, f"end{i}"])) for i in range(40)] + [(100 + i, " ".join(f"{i}x{k}" for k in range(80))) for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in simhash.representatives(df, most=6).collect()) == [0, 100, 101, 102]


def test_only_shingle_similarity_of_08_removes(spark):
    """Against brute-force Jaccard of five-word shingles; scattered and block edits."""
    rng = np.random.default_rng(11)
    vocab = ["".join(rng.choice(list("abcdefghij"), 5)) for _ in range(3000)]
    texts = []
    for k in range(150):
        t = list(rng.choice(vocab, 300))
        texts.append(" ".join(t))
        n = (1, 8, 12, 14, 16)[k % 5]
        at = rng.choice(300, n, replace=False) if k % 2 else np.arange(200, 200 + 5 * n)
        for i in at:
            t[i] = str(rng.choice(vocab))
        texts.append(" ".join(t))
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    same = {2 * k + 1: len(sets[2 * k] & sets[2 * k + 1]) / len(sets[2 * k] | sets[2 * k + 1]) for k in range(150)}
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r["doc_id"] for r in simhash.representatives(df).collect()}
    gone = set(range(300)) - kept
    assert gone <= {i for i, j in same.items() if j >= 0.8}
    assert {i for i, j in same.items() if j >= 0.95} <= gone and sum(0.5 < j < 0.8 for j in same.values()) > 40


def test_recall_near_08(spark):
    """Pairs of a similarity of 0.8 and more by brute force, edited here and there or in
    one place, of all lengths: at least 97 of 100 are found, and none below 0.8."""
    rng = np.random.default_rng(21)
    weight = 1 / np.arange(3, 4003)
    vocab = np.array(["".join(rng.choice(list("abcdefghij"), 5)) for _ in range(4000)])
    texts, same = [], []
    while len(same) < 900:
        n = int(rng.choice([60, 150, 400, 900]))
        t = rng.choice(vocab, n, p=weight / weight.sum())
        u, share = list(t), rng.uniform(0, 0.14)
        if len(same) % 2:
            for i in rng.choice(n, max(1, int(share * n / 5)), replace=False):
                u[i] = str(rng.choice(vocab))
        else:
            k = max(1, int(share * n))
            at = int(rng.integers(0, n - k))
            u[at : at + k] = rng.choice(vocab, int(k * rng.uniform(0.5, 1.5))).tolist()
        sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.tolist(), u)]
        j = len(sets[0] & sets[1]) / len(sets[0] | sets[1])
        if 0.6 < j < 1:
            same.append(j)
            texts += [" ".join(t), " ".join(u)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    gone = set(range(len(texts))) - {r["doc_id"] for r in simhash.representatives(df).collect()}
    same = np.array(same)
    found = np.array([2 * k + 1 in gone for k in range(len(same))])
    assert not found[same < 0.8].any() and all(i % 2 for i in gone)
    for low, high in ((0.8, 0.85), (0.85, 0.9), (0.9, 1.0)):
        assert found[(same >= low) & (same < high)].mean() >= 0.97, (low, found[(same >= low) & (same < high)].mean())


def test_missing_ids_take_part(spark):
    words = " ".join(f"w{i}" for i in range(50))
    df = spark.createDataFrame([(3, words), (None, words), (None, "quite another text"), (None, "x y z")], "doc_id long, text string")
    got = Counter((r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(df).collect())
    assert got == {(3, 3): 1, (None, 3): 1, (None, None): 2}


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 100), (201, 200)], "u long, v long")
    got = {r["node"]: r["root"] for r in components.components(edges).collect()}
    assert got == {**dict.fromkeys(range(61), 0), 200: 200, 201: 200}


def test_thinned_edges_join_the_same_nodes(spark):
    rng = np.random.default_rng(9)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (3000, 2)) // 20 * 20 + rng.integers(0, 3, (3000, 2))]
    df = spark.createDataFrame(edges, "u long, v long")
    want = {r["node"]: r["root"] for r in components.components(df).collect()}
    for at_once in (1 << 20, 500):
        thin = components.thinned(df, at_once)
        assert {r["node"]: r["root"] for r in components.components(thin).collect()} == want
    assert components.thinned(df).count() == len(want) - len(set(want.values()))


# -- 6 pivot index


def test_pivot_index(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(150, 64))
    x = np.concatenate([base, base[:40] + 0.1 * rng.normal(size=(40, 64)), np.repeat(base[:1], 30, 0) + 0.05 * rng.normal(size=(30, 64)), base[:5], -base[:3]])
    x = x.astype(np.float32)
    odd = [None, [0.0] * 64, [float("nan")] * 64, [float("inf")] + [1.0] * 63, [None] + [1.0] * 63, [1.0, 2.0], [2.0, 4.0]]
    rows = [(i, [None if c is None else float(c) for c in v]) for i, v in enumerate(x.tolist())] + [(1000 + i, v) for i, v in enumerate(odd)]
    schema = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType()))])
    df = spark.createDataFrame(rows, schema).withColumn("rep", F.lit("clash"))
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    linked = u @ u.T >= 0.95
    np.fill_diagonal(linked, False)
    for block in (4096, 8):
        got = pivot_index.near_duplicates(df, block=block).toPandas().set_index("vec_id")
        assert len(got) == len(rows)
        n = got["n_links"].reindex(range(len(x))).to_numpy()
        assert (n <= linked.sum(1)).all() and n.sum() >= 0.98 * linked.sum()
        assert (got.loc[1000:1004, "n_links"] == 0).all() and (got.loc[1005:1006, "n_links"] == 1).all()
        assert got.loc[1006, "component_id"] == 1005 and (got["kept"] == (got.index == got["component_id"])).all()
    assert pivot_index.near_duplicates(df.filter("false")).count() == 0


def test_repeated_and_missing_vector_ids(spark):
    vecs = [(5, [1.0, 0.0]), (5, [0.0, 1.0]), (7, [1.0, 1.0]), (None, [3.0, 3.01]), (None, [3.0, 3.01]), (None, [-1.0, 0.2]), (9, [-1.0, 0.2]), (3, None)]
    df = spark.createDataFrame(vecs, "vec_id long, embedding array<float>")
    got = sorted(map(tuple, pivot_index.near_duplicates(df).collect()), key=str)
    want = [(5, 0, 5, True), (5, 0, 5, True), (7, 2, 7, True), (None, 2, 7, False), (None, 2, 7, False), (None, 1, 9, False), (9, 1, 9, True), (3, 0, 3, True)]
    assert got == sorted(want, key=str)
    alone = spark.createDataFrame([(None, [1.0]), (None, [-1.0])], "vec_id long, embedding array<float>")
    assert sorted(map(tuple, pivot_index.near_duplicates(alone).collect())) == [(None, 0, None, True)] * 2


def test_pivot_index_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    want = con.sql(queries.OP6_SQL).df().sort_values("vec_id").reset_index(drop=True)
    got = queries.op6_pivot_index(spark, SF).toPandas().sort_values("vec_id").reset_index(drop=True)
    pd.testing.assert_frame_equal(got[want.columns], want, check_dtype=False)


def test_hot_keys_are_broadcast(spark):
    rows = spark.createDataFrame([(i, 0 if i % 3 else i) for i in range(300)], "i long, k long")
    keyed = shared.materialise(rows.groupBy("k").agg(F.count("i").alias("size")).withColumn("twice", F.col("k") * 2), "keyed")
    for hot in (10, 1000):
        got = shared.by_key(rows, keyed, ["k"], hot=hot)
        assert got.count() == 300 and got.filter("twice != 2 * k").count() == 0


# -- 5 context tree


def test_base_score(spark, docs, odd, none):
    for df in (docs, odd.filter("doc_id is not null")):
        rows = [(r["doc_id"], (r["text"] or "")) for r in df.collect()]
        toks = [[w for w in re.split(rb"[\x20\x09-\x0d]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), t.encode())) if w] for _, t in rows]
        train = [w + [None] for (i, _), w in zip(rows, toks, strict=True) if held(i, 10) != 0]
        c = Counter(x for w in train for x in w)
        n, v = sum(c.values()), len(c)
        want = sorted(
            (i, held(i, 10) == 0, len(w) + 1, sum(c[x] > 0 for x in [*w, None]), n, round(sum(log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in [*w, None]), 4))
            for (i, _), w in zip(rows, toks, strict=True)
        )
        got = context_tree.scored(df, depth=2, top_words=50).collect()
        assert sorted((r[0], r[1], r[2], r[3], r[4], round(r[5], 4)) for r in got) == want
        assert all(r["score"] < 0 for r in got)
    assert context_tree.scored(none, depth=2).count() == 0
    assert context_tree.scored(odd, depth=2).count() == 14


@pytest.mark.parametrize("depth", [2, 5])
def test_context_tree_by_recursion(spark, depth):
    """The folded tree against the definition, on two short texts."""
    from math import exp, lgamma, log, pi

    texts = [b"abracadabra", b"abba"]
    df = spark.createDataFrame([(bytearray(t),) for t in texts], "text binary")
    nodes = context_tree.tree(context_tree.gram_counts(df, depth), depth).collect()
    counts: dict[tuple, list[int]] = {}
    for t in texts:
        data = b"\0" * depth + t + b"\0"
        for at in range(depth, len(data)):
            for d in range(depth + 1):
                ctx = data[at - d : at]
                for j in range(8):
                    prefix = (1 << j) | (data[at] >> (8 - j))
                    counts.setdefault((d, ctx, prefix), [0, 0])[data[at] >> (7 - j) & 1] += 1

    def pe(a, b):
        return lgamma(a + 0.5) + lgamma(b + 0.5) - lgamma(a + b + 1) - log(pi)

    def pw(d, ctx, prefix):
        own = pe(*counts[d, ctx, prefix])
        if d == depth:
            return own
        below = sum(pw(d + 1, k[1], prefix) for k in counts if k[0] == d + 1 and k[2] == prefix and k[1][1:] == ctx)
        return log(0.5) + max(own, below) + log(1 + exp(-abs(own - below)))

    for d in range(depth + 1):
        got = [r for r in nodes if r["d"] == d]
        assert len(got) == sum(k[0] == d for k in counts)
        for r in got:
            ctx, prefix = (r["key"] >> 8).to_bytes(8, "big")[8 - d :] if d else b"", r["key"] & 255
            assert [r["n0"], r["n1"]] == counts[d, ctx, prefix]
            assert r["log_pw"] == pytest.approx(pw(d, ctx, prefix), abs=1e-6)
            if d < depth:
                assert r["stop"] == pytest.approx(0.5 * exp(pe(*counts[d, ctx, prefix]) - pw(d, ctx, prefix)), rel=1e-5)


def test_model_beats_uniform_and_sums_to_one(spark, docs):
    text = docs.select(F.col("text").cast("binary").alias("text"))
    model = context_tree.in_memory(context_tree.tree(context_tree.gram_counts(text, 3), 3), 3)
    for ctx in (b"the", b"qqq", b"\0\0\0"):
        c = np.uint64(int.from_bytes(ctx, "big"))
        p = np.exp(model.log_prob((c << np.uint64(8)) | np.arange(256, dtype=np.uint64)))
        assert p.sum() == pytest.approx(1.0, abs=1e-6)
    scorer = context_tree.Scorer(model)
    t = [b"the and that", b"", b"the and that"]
    s = scorer.score(t)
    assert s[0] == s[2] > -len(t[0]) * log10(256) and s[1] < 0


@pytest.mark.parametrize("depth", [3, 4])
def test_context_tree_scores_by_every_node(spark, docs, depth):
    """Scores against the mixture over counted nodes, with and without looking grams
    up by a join; in a tree of more nodes than 2**19 no context is dropped."""
    rng = np.random.default_rng(5)
    noise = [(1_000_000 + i, "".join(map(chr, rng.integers(33, 127, 4000)))) for i in range(60)]
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame(noise, "doc_id long, text string")).cache()
    rows = [(r["doc_id"], (r["text"] or "").encode()) for r in df.collect()]
    train = spark.createDataFrame([(bytearray(t),) for i, t in rows if held(i, 10) != 0], "text binary")
    found = context_tree.tree(context_tree.gram_counts(train, depth), depth).toPandas()
    nodes = []
    for d in range(depth + 1):
        at = found[found["d"] == d]
        keys, own = zip(at["key"] // 256, at["key"] % 256, strict=True), (at["n1"] + 0.5) / (at["n0"] + at["n1"] + 1)
        nodes.append(dict(zip(keys, zip(own, at["stop"], strict=True), strict=True)))
    assert len(nodes[3]) > 1 << 19

    def score(text):
        data, total = b"\0" * depth + text + b"\0", 0.0
        for at in range(depth, len(data)):
            for j in range(8):
                p, prefix = None, (1 << j) | (data[at] >> (8 - j))
                for d in range(depth, -1, -1):
                    node = nodes[d].get((int.from_bytes(data[at - d : at], "big"), prefix))
                    if node:
                        p = node[0] if p is None else node[1] * node[0] + (1 - node[1]) * p
                total += log10(p if data[at] >> (7 - j) & 1 else 1 - p)
        return total

    some = dict([x for x in rows if held(x[0], 10) == 0][:8] + rows[-3:] + rows[:3])
    want = {i: score(t[:100_000]) for i, t in some.items()}
    for top in (context_tree.TOP_GRAMS, 500):
        got = {r["doc_id"]: r["score"] for r in context_tree.scored(df, depth, top_grams=top).collect()}
        assert len(got) == len(rows) and all(got[i] == pytest.approx(want[i], rel=1e-9) for i in some)


def test_language_of_one_identifier_is_learned(spark):
    """What enters the sample does not hang on identifiers alone."""
    french = [(5, f"le petit chat numéro {i} dort sur la chaise verte", "fr") for i in range(600)]
    english = [(i, "the small cat sleeps on the green chair and dreams", "en") for i in range(100, 120)]
    copies = [(8, "die kleine Katze schläft auf dem grünen Stuhl", "de")] * 500
    for k in (4, 5, 7, 8):
        rows = [(k if x[0] == 5 else x[0], *x[1:]) for x in french] + english + copies
        docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
        held = {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in (k, 8)}
        want = {"en"} | ({"fr"} if not held[k] else set()) | ({"de"} if not held[8] else set())
        assert set(language.learn(docs)) == want


def test_many_languages_share_the_sample(spark):
    rng = np.random.default_rng(1)
    rows = [(3 * i + j, "".join(chr(97 + c) for c in rng.integers(0, 26, 900)), f"l{i:04d}") for i in range(1000) for j in range(3)]
    rows = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 != 2]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language.learn(docs, all_symbols=500_000)
    assert set(got) == {r[2] for r in rows}
    assert sum(map(len, got.values())) <= 1000 * (500 + 901)
