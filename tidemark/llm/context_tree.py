"""Language-model scoring by context-tree weighting.

Bytes are predicted bit by bit.  For every context of 0 to ``depth`` preceding bytes
and every prefix of bits within the next byte there is a node that counts zeros and
ones over all training text; its Krichevsky-Trofimov estimate is mixed with that of
its longer contexts in the proportion that context-tree weighting gives them:

    P_w = 1/2 P_e + 1/2 * product of the children's P_w      (P_w = P_e at full depth)

The weight of stopping at a node is its share of P_e in P_w.  A text's code length is
the sum over its bytes and an end symbol (byte 0); a context never seen passes on the
estimate of the shorter one.

Counting covers all training text: tasks count (context, byte) pairs of their part
and the counts are summed by key in a shuffle.  The distinct pairs are then dealt by
the three most recent bytes of their contexts: a task holds whole subtrees below
these, folds them, and only their roots go on to the levels above, which are sums by
key.  A second deal of the same pairs gives each its probability by the whole tree;
no node is left out.  The ``top_grams`` most frequent pairs are broadcast, the others
are looked up by a join.

The base score is an add-0.1 unigram over words.  The ``top_words`` most frequent
words are broadcast, the others are looked up by a join, so all counts are exact
whatever the vocabulary's size.

Defined results for odd input
    null or empty text   the end symbol (and end token) alone
    null identifier      counts as the empty identifier in the split
    nothing to learn     every bit is 1/2
    repeated rows        one result row each; copies in training count each
    empty table          an empty result with the full schema
    extra columns        ignored
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import bounded_batches, drop_table, give_back, id_bucket, materialise, text_or_empty

HELD_OUT = (10, 0)
DEPTH = 5
TOP_GRAMS = 1 << 21
_BLOCK_BYTES = 1 << 20
_UPPER_TO_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


# -- bytes in context ---------------------------------------------------------------


def grams_of(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(context << 8 | byte) at every position and the end of each text, the most
    recent byte of the context lowest; and the number of positions per text."""
    pad = b"\0" * depth
    data = np.frombuffer(pad + b"".join([t + b"\0" + pad for t in texts]), dtype=np.uint8)
    lengths = np.array([len(t) + 1 for t in texts], dtype=np.int64)
    gram = data[depth:].astype(np.uint64)
    for k in range(1, depth + 1):
        gram |= data[depth - k : len(data) - k].astype(np.uint64) << np.uint64(8 * k)
    keep = np.ones(len(gram), dtype=bool)
    ends = np.cumsum(lengths + depth) - depth
    keep[(ends[:, None] + np.arange(depth)).ravel()] = False
    return gram[keep], lengths


def blocks(batch: pa.Array) -> Iterator[list[bytes]]:
    """The texts of a batch in groups of about ``_BLOCK_BYTES``."""
    group, size = [], 0
    for t in batch:
        raw = t.as_py()
        group.append(raw)
        size += len(raw)
        if size >= _BLOCK_BYTES:
            yield group
            group, size = [], 0
    if group:
        yield group


def gram_counts(texts: DataFrame, depth: int, hold: int = 1_200_000) -> DataFrame:
    """(gram, n) over all rows of ``texts``: a binary column and, if there is a second
    one, whether the row counts (grams of the others alone have n = 0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        size = 0

        def merged() -> pa.Table:
            return pa.concat_tables(held).group_by("gram").aggregate([("n", "sum")]).rename_columns(["gram", "n"])

        def parts(b: pa.RecordBatch) -> Iterator[tuple[pa.Array, int]]:
            if b.num_columns == 1:
                yield b.column(0), 1
            else:
                yield b.column(0).filter(b.column(1)), 1
                yield b.column(0).filter(pc.invert(b.column(1))), 0

        for b in batches:
            for part, weight in parts(b):
                for group in blocks(part):
                    gram, _ = grams_of(group, depth)
                    found = pc.value_counts(pa.array(gram.view(np.int64)))
                    counts = pc.multiply(found.field("counts"), weight)
                    held.append(pa.table({"gram": found.field("values"), "n": counts.cast(pa.int64())}))
                    size += held[-1].num_rows
                    if size > hold:
                        held = [merged()]
                        size = held[0].num_rows
                        if size > hold // 2:
                            yield from held[0].combine_chunks().to_batches()
                            held, size = [], 0
        if held:
            yield from merged().combine_chunks().to_batches()
        held = []
        give_back()

    return texts.mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


# -- the tree -----------------------------------------------------------------------


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """ln Gamma for x >= 1/2: Stirling's series after a shift by six."""
    z = x + 6
    shift = np.log(x * (x + 1) * (x + 2) * (x + 3) * (x + 4) * (x + 5))
    series = 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5)
    return (z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi) + series - shift


def _kt_formula(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    return _log_gamma(n0 + 0.5) + _log_gamma(n1 + 0.5) - _log_gamma(n0 + n1 + 1) - math.log(math.pi)


_FEW = 64
_KT_OF_FEW = _kt_formula(*np.mgrid[0.0:_FEW, 0.0:_FEW])


def kt_log(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov block probability."""
    out = np.empty(len(n0))
    few = (n0 < _FEW) & (n1 < _FEW)
    out[few] = _KT_OF_FEW[n0[few].astype(np.int64), n1[few].astype(np.int64)]
    out[~few] = _kt_formula(n0[~few], n1[~few])
    return out


def weighted(log_pe: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """ln P_w of nodes whose children's ln P_w sum to ``below``, and the weight of
    stopping at them."""
    gap = below - log_pe
    soft = np.maximum(gap, 0) + np.log1p(np.exp(-np.abs(gap)))
    return log_pe + soft - math.log(2), 1 / (1 + np.exp(np.minimum(gap, 700)))


@dataclass
class Nodes:
    """Nodes of one depth that share a number of known bits, in the order of ``key``
    (context << 8 | prefix)."""

    key: np.ndarray
    n0: np.ndarray
    n1: np.ndarray
    log_pw: np.ndarray
    stop: np.ndarray

    def own(self) -> np.ndarray:
        return (self.n1 + 0.5) / (self.n0 + self.n1 + 1)


def _context(key: np.ndarray, d: int) -> np.ndarray:
    """The key with its context cut to the ``d`` most recent bytes."""
    return key & np.uint64((1 << (8 * (d + 1))) - 1)


def nodes_of(grams: np.ndarray, n: np.ndarray, d: int, deeper: list[Nodes] | None) -> list[Nodes]:
    """The nodes of depth ``d``, by number of known bits, of counted grams; ``deeper``
    holds all nodes below them (None: this is the full depth)."""
    gram = _context(grams, d)
    order = np.argsort(gram, kind="stable")
    gram, n = gram[order], n[order]
    ctx, sym, out = gram & ~np.uint64(255), gram & np.uint64(255), []
    for j in range(8):
        key = ctx | np.uint64(1 << j) | sym >> np.uint64(8 - j)
        at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, dtype=np.int64)
        if not len(at):
            out.append(Nodes(key, n, n, n, n))
            continue
        key, total = key[at], np.add.reduceat(n, at)
        n1 = np.add.reduceat(np.where(sym >> np.uint64(7 - j) & np.uint64(1), n, 0.0), at)
        log_pw, stop = kt_log(total - n1, n1), np.ones(len(at))
        if deeper is not None:
            parent = np.searchsorted(key, _context(deeper[j].key, d))
            log_pw, stop = weighted(log_pw, np.bincount(parent, deeper[j].log_pw, len(at)))
        out.append(Nodes(key, total - n1, n1, log_pw, stop))
    return out


def fold(grams: np.ndarray, n: np.ndarray, low: int, high: int) -> list[list[Nodes]]:
    """Nodes of depths ``low`` to ``high`` (the full depth) over all grams of some
    contexts of ``low`` bytes."""
    levels: list[list[Nodes]] = []
    for d in range(high, low - 1, -1):
        levels.append(nodes_of(grams, n, d, levels[-1] if levels else None))
    return levels[::-1]


def _by_context(grams: DataFrame, low: int, use: Callable, schema: str, chunk: int = 50_000) -> DataFrame:
    """``use(grams, n)`` (batches of ``schema``) over ``grams`` dealt by the ``low`` most
    recent bytes of their contexts.  A task holds a chunk of contexts, or one: what
    follows and precedes three bytes has at most 2**24 grams however large the corpus."""

    def of(t: pa.Table) -> Iterator[pa.RecordBatch]:
        yield from use(t["gram"].to_numpy().view(np.uint64), t["n"].to_numpy().astype(np.float64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size, wait = 0, chunk
        for b in batches:
            held.append(b)
            size += b.num_rows
            if size >= wait:
                t = pa.Table.from_batches(held)
                at = t["at"].to_numpy()
                last = len(at) - int((at[::-1] != at[-1]).argmax()) if at[0] != at[-1] else 0
                if last:
                    yield from of(t.slice(0, last))
                held, size = t.slice(last).to_batches(), len(at) - last
                wait = size + max(chunk, size)
        if size:
            yield from of(pa.Table.from_batches(held))
        give_back()

    at = F.shiftrightunsigned("gram", 8).bitwiseAND(F.lit((1 << (8 * low)) - 1)).alias("at")
    rows = grams.select(at, "gram", "n").repartition("at").sortWithinPartitions("at")
    return rows.mapInArrow(run, schema)


NODE_SCHEMA = "d int, key long, n0 double, n1 double, log_pw double, stop double"
NEAR_BYTES = 3


def _node_rows(grams: DataFrame, depth: int, low: int, deepest: int) -> DataFrame:
    """Nodes of depths ``low`` to ``deepest`` as rows."""

    def use(gram: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        for d, level in enumerate(fold(gram, n, low, depth)[: deepest - low + 1], low):
            for x in level:
                cols = [pa.array(np.full(len(x.key), d, dtype=np.int32)), pa.array(x.key.view(np.int64))]
                cols += [pa.array(c) for c in (x.n0, x.n1, x.log_pw, x.stop)]
                yield pa.RecordBatch.from_arrays(cols, names=["d", "key", "n0", "n1", "log_pw", "stop"])

    return _by_context(grams.filter("n > 0"), low, use, NODE_SCHEMA)


def tree(grams: DataFrame, depth: int, deepest: int | None = None) -> DataFrame:
    """The nodes (``NODE_SCHEMA``) of all depths, or of those up to ``deepest``, of
    counted grams.  Contexts of over three bytes are folded where their grams are;
    the shorter ones level by level with DataFrame sums."""
    low = min(NEAR_BYTES, depth)
    found = materialise(_node_rows(grams, depth, low, depth if deepest is None else max(low, deepest)), "nodes")
    now, levels = found.filter(F.col("d") == low), [found]

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n0, n1, below = (b.column(i).to_numpy() for i in (2, 3, 4))
            log_pw, stop = weighted(kt_log(n0, n1), below)
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(log_pw), pa.array(stop)], names=b.schema.names)

    for d in range(low - 1, -1, -1):
        key = F.col("key").bitwiseAND(F.lit((1 << (8 * (d + 1))) - 1))
        sums = [F.sum(c).alias(c) for c in ("n0", "n1", "log_pw")]
        up = now.groupBy(key.alias("key")).agg(*sums).select(F.lit(d).alias("d"), "key", "n0", "n1", "log_pw", F.lit(0.0).alias("stop"))
        now = materialise(up.mapInArrow(finish, NODE_SCHEMA), "nodes")
        levels.append(now)
    whole = levels[0]
    for x in levels[1:]:
        whole = whole.unionByName(x)
    return whole if deepest is None else whole.filter(F.col("d") <= deepest)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


Level = list[tuple[np.ndarray, np.ndarray, np.ndarray]]


def mix_in(p: np.ndarray, grams: np.ndarray, d: int, level: Level) -> None:
    """Mixes the nodes of one depth (by number of known bits: keys in order,
    probability of a one, weight of stopping) into ``p``: eight bits a gram, not a
    number where no longer context was seen."""
    gram = _context(grams, d)
    sym, ctx = gram & np.uint64(255), gram & ~np.uint64(255)
    for j, (keys, own, stop) in enumerate(level):
        if not len(keys):
            continue
        key = ctx | np.uint64(1 << j) | sym >> np.uint64(8 - j)
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        hit = np.flatnonzero(keys[at] == key)
        at, longer = at[hit], p[hit, j]
        p[hit, j] = np.where(np.isnan(longer), own[at], stop[at] * own[at] + (1 - stop[at]) * longer)


def log_of(p: np.ndarray, grams: np.ndarray) -> np.ndarray:
    """Natural log of the probability of each gram's byte, from its bits'."""
    ones = np.unpackbits((grams & np.uint64(255)).astype(np.uint8)[:, None], axis=1).astype(bool)
    p = np.where(np.isnan(p), 0.5, p)
    return np.log(np.where(ones, p, 1 - p)).sum(axis=1)


class Model:
    """Levels of nodes in memory, depth 0 first."""

    def __init__(self, levels: list[Level]) -> None:
        self.levels, self.depth = levels, len(levels) - 1

    def log_prob(self, grams: np.ndarray, p: np.ndarray | None = None) -> np.ndarray:
        """Natural log of the probability of each gram's byte in its context; ``p``
        holds what contexts longer than the model's say."""
        p = np.full((len(grams), 8), np.nan) if p is None else p
        for d in range(self.depth, -1, -1):
            mix_in(p, grams, d, self.levels[d])
        return log_of(p, grams)


def in_memory(nodes: DataFrame, deepest: int) -> Model:
    """The model of ``nodes`` up to a depth, every node of them: for the shortest
    contexts (two bytes: at most 2**16 contexts of 255 nodes), and for whole trees of
    small corpora."""
    own = ((F.col("n1") + 0.5) / (F.col("n0") + F.col("n1") + 1)).alias("own")
    t = nodes.filter(F.col("d") <= deepest).select("d", "key", own, "stop").toArrow()
    key = t["key"].to_numpy().view(np.uint64)
    order = np.argsort(key)
    d, own, stop, key = t["d"].to_numpy()[order], t["own"].to_numpy()[order], t["stop"].to_numpy()[order], key[order]
    bit = np.frexp((key & np.uint64(255)).astype(np.float64))[1] - 1
    levels = []
    for depth in range(deepest + 1):
        picks = [np.flatnonzero((d == depth) & (bit == j)) for j in range(8)]
        levels.append([(key[i], own[i], stop[i]) for i in picks])
    return Model(levels)


def gram_logs(grams: DataFrame, nodes: DataFrame, depth: int) -> DataFrame:
    """gram, n and log_p (natural log of the byte's probability in its context by the
    whole tree) of distinct ``grams`` (gram, n), those with n = 0 included; ``nodes``
    holds the depths below ``NEAR_BYTES``, the others are folded anew."""
    low = min(NEAR_BYTES, depth)
    shared = grams.sparkSession.sparkContext.broadcast(in_memory(nodes, low - 1)) if low else None

    def use(gram: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        seen, p = n > 0, np.full((len(gram), 8), np.nan)
        for d, level in reversed(list(enumerate(fold(gram[seen], n[seen], low, depth), low))):
            mix_in(p, gram, d, [(x.key, x.own(), x.stop) for x in level])
        log_p = shared.value.log_prob(gram, p) if low else log_of(p, gram)
        cols = [pa.array(gram.view(np.int64)), pa.array(n.astype(np.int64)), pa.array(log_p)]
        yield pa.RecordBatch.from_arrays(cols, names=["gram", "n", "log_p"])

    return materialise(_by_context(grams, low, use, "gram long, n long, log_p double"), "gram-logs")


def most_frequent(logs: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray, DataFrame]:
    """The grams of highest n, at most ``most``, with their log_p; and the others."""
    step = F.floor(F.log2(F.col("n") + 1) * 16).cast("int")
    steps = sorted(logs.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n")).collect(), reverse=True)
    total, least = 0, 1 << 30
    for r in steps:
        total += r["n"]
        if total > most:
            break
        least = r["step"]
    t = logs.filter(step >= least).select("gram", "log_p").toArrow()
    return t["gram"].to_numpy().view(np.uint64), t["log_p"].to_numpy(), logs.filter(step < least).select("gram", "log_p")


_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


class GramTable:
    """Values of grams by open addressing; no gram is left out."""

    def __init__(self, grams: np.ndarray, values: np.ndarray) -> None:
        bits = max(4, (2 * len(grams)).bit_length())
        self.shift, self.last = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, _EMPTY), np.zeros(1 << bits)
        left, at = np.arange(len(grams)), self._first(grams)
        while len(left):
            free = self.keys[at] == _EMPTY
            self.keys[at[free]] = grams[left[free]]
            placed = self.keys[at] == grams[left]
            self.values[at[placed]] = values[left[placed]]
            left, at = left[~placed], (at[~placed] + 1) & self.last

    def _first(self, grams: np.ndarray) -> np.ndarray:
        return (_mix(grams) >> self.shift).astype(np.int64)

    def find(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values (0 for grams that are not in the table) and where these are."""
        at = self._first(grams)
        got = self.keys[at]
        left = np.flatnonzero((got != grams) & (got != _EMPTY))
        while len(left):
            at[left] = (at[left] + 1) & self.last
            got = self.keys[at[left]]
            left = left[(got != grams[left]) & (got != _EMPTY)]
        known = self.keys[at] == grams
        return np.where(known, self.values[at], 0.0), np.flatnonzero(~known)


class Scorer:
    """log10 probabilities of texts by a model in memory."""

    def __init__(self, model: Model) -> None:
        self.model = model

    def score(self, texts: list[bytes]) -> np.ndarray:
        gram, lengths = grams_of(texts, self.model.depth)
        new, where = np.unique(gram, return_inverse=True)
        value = self.model.log_prob(new)[where]
        ends = np.cumsum(lengths)
        return np.add.reduceat(value, ends - lengths) / math.log(10) if len(texts) else np.zeros(0)


def score_by(table: GramTable, texts: list[bytes], depth: int) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """Natural log probability of each text by the table, and lists of the distinct
    grams that the table lacks and how often they occur."""
    gram, lengths = grams_of(texts, depth)
    value, lacks = table.find(gram)
    ends = np.cumsum(lengths)
    rare, times = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    of, offsets = np.zeros(0, dtype=np.int64), np.zeros(len(texts) + 1, dtype=np.int32)
    if len(lacks):
        of = np.searchsorted(ends, lacks, side="right")
        order = np.lexsort((gram[lacks], of))
        rare, of = gram[lacks][order], of[order]
        cut = np.flatnonzero(np.concatenate([[True], (rare[1:] != rare[:-1]) | (of[1:] != of[:-1])]))
        times = np.diff(np.concatenate([cut, [len(rare)]]))
        rare, of = rare[cut], of[cut]
        offsets[1:] = np.cumsum(np.bincount(of, minlength=len(texts)))
    lists = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(x)) for x in (rare.view(np.int64), times)]
    return np.add.reduceat(value, ends - lengths), *lists


_tables: dict[int, GramTable] = {}


# -- words --------------------------------------------------------------------------


def word_counts(texts: DataFrame, hold: int = 150_000) -> DataFrame:
    """(word, n) over all rows of ``texts`` (one binary column)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            cols = [pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())]
            return pa.RecordBatch.from_arrays(cols, names=["word", "n"])

        for b in batches:
            for t in b.column(0):
                held.update(t.as_py().translate(_UPPER_TO_LOWER).split())
                if len(held) > hold:
                    yield out()
                    held.clear()
        yield out()
        held.clear()
        give_back()

    return texts.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


# -- scoring ------------------------------------------------------------------------


def scored(
    docs: DataFrame, depth: int = DEPTH, top_words: int = 100_000, id_col: str = "doc_id", text_col: str = "text",
    top_grams: int = TOP_GRAMS,
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of
    every whole text; all counts come from the texts outside the held-out fold."""
    spark = docs.sparkSession
    bounded_batches(spark)
    held = id_bucket(id_col, HELD_OUT[0]) == HELD_OUT[1]
    text = text_or_empty(text_col).cast("binary").alias("text")
    train = docs.filter(~held).select(text)

    words = materialise(word_counts(train), "word-counts")
    in_words, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    n_train = train.count()
    tokens, kinds = int(in_words) + n_train, int(distinct) + (n_train > 0)
    frequent = words.orderBy(F.desc("n"), "word").limit(top_words)
    top = {bytes(r["word"]): math.log10(r["n"] + 0.1) for r in frequent.collect()}

    grams = materialise(gram_counts(docs.select(text, (~held).alias("counts")), depth), "gram-counts")
    nodes = tree(grams, depth, min(NEAR_BYTES, depth) - 1)
    logs = gram_logs(grams, nodes, depth)
    for used in (grams, nodes):
        drop_table(used)
    frequent_grams, frequent_logs, rare_logs = most_frequent(logs, top_grams)

    shared = spark.sparkContext.broadcast((frequent_grams, frequent_logs, top))
    end_log, floor = math.log10(n_train + 0.1), math.log10(tokens + 0.1 * (kinds + 1))
    end_known = int(n_train > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given_grams, given_logs, top = shared.value
        known_grams = _tables.get(id(top))
        if known_grams is None:
            _tables.clear()
            known_grams = _tables[id(top)] = GramTable(given_grams, given_logs)
        known = top.get
        for b in batches:
            n, n_top, base, rare, rare_n = [], [], [], [], []
            for t in b.column(2):
                tokens = t.as_py().translate(_UPPER_TO_LOWER).split()
                logs = list(map(known, tokens))
                hit = [x for x in logs if x is not None]
                others = Counter([w for w, x in zip(tokens, logs, strict=True) if x is None]) if len(hit) < len(logs) else {}
                n.append(len(tokens) + 1)
                n_top.append(len(hit) + end_known)
                base.append(math.fsum(hit) + end_log)
                rare.append(list(others))
                rare_n.append(list(others.values()))
            if not n:
                continue
            scores, grams, times = zip(*(score_by(known_grams, g, depth) for g in blocks(b.column(2))), strict=True)
            cols = [
                b.column(0),
                b.column(1),
                pa.array(n, pa.int64()),
                pa.array(n_top, pa.int64()),
                pa.array(base, pa.float64()),
                pa.array(np.concatenate(scores)),
                pa.array(rare, pa.list_(pa.binary())),
                pa.array(rare_n, pa.list_(pa.int64())),
                pa.concat_arrays(grams),
                pa.concat_arrays(times),
            ]
            names = ["doc_id", "held_out", "n_tokens", "n_top", "base_top", "score_top", "rare", "rare_n", "gram", "gram_n"]
            yield pa.RecordBatch.from_arrays(cols, names=names)
        give_back()

    schema = (
        "doc_id long, held_out boolean, n_tokens long, n_top long, base_top double, score_top double,"
        " rare array<binary>, rare_n array<long>, gram array<long>, gram_n array<long>"
    )
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), held.alias("held_out"), text)
    rows = materialise(given.mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id()), "lm-scores")

    pairs = rows.select("row", F.explode(F.arrays_zip("rare", "rare_n")).alias("x"))
    pairs = pairs.select("row", F.col("x.rare").alias("word"), F.col("x.rare_n").alias("tf"))
    met = pairs.join(words, "word", "left").groupBy("row")
    log_c = F.log10(F.coalesce("n", F.lit(0)) + 0.1)
    met = met.agg(
        F.sum(F.col("tf") * log_c).alias("base_rare"), F.sum(F.when(F.col("n") > 0, F.col("tf"))).alias("n_rare")
    )
    seen = rows.select("row", F.explode(F.arrays_zip("gram", "gram_n")).alias("x"))
    seen = seen.select("row", F.col("x.gram").alias("gram"), F.col("x.gram_n").alias("tf"))
    seen = seen.join(rare_logs, "gram").groupBy("row").agg(F.sum(F.col("tf") * F.col("log_p")).alias("score_rare"))
    return rows.join(met, "row", "left").join(seen, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_top") + F.coalesce("n_rare", F.lit(0))).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base_top") + F.coalesce("base_rare", F.lit(0.0)) - F.col("n_tokens") * F.lit(floor)).alias("base_score"),
        ((F.col("score_top") + F.coalesce("score_rare", F.lit(0.0))) / math.log(10)).alias("score"),
    )
