"""SimHash near-duplicates by covering locality-sensitive hashing.

Fingerprints (64-bit majority over word shingles) that differ in at most ``radius``
bits are linked.  Bit positions carry non-zero vectors of radius + 1 bits; the mask
of a vector v keeps the positions whose vector has odd inner product with v.  The
vectors of any ``radius`` differing positions leave some v orthogonal to them all, so
every pair within the radius agrees on one of the 2**(radius + 1) - 1 masks: no pair
is missed (Pagh, 2016).

A larger radius is covered in parts: of ``parts`` equal runs of positions one differs
in at most radius / parts bits, and the masks of each run cover that many.

Majority bits are a coarse measure: texts whose sets of five-word shingles overlap by
0.8 (Jaccard) differ in some 10 of 64 bits, with a wide spread.  ``NEAR_TEXT`` is the
scheme for that similarity: fingerprints of word pairs, on which an edited word weighs
less (radius 9, two parts), of the whole text and of its first and second half, as
edits that lie in one place leave one half almost as it was; and a check on 128 bits
over the five-word shingles of the whole text, of which such texts differ in 31 at
most but for about one pair in five hundred.

``representatives`` takes these links as candidates only: the texts of each linked
group are brought together and their sets of five-word shingles compared, and only
similarities of ``SIMILAR`` or more (and chains of such) make a group.  A group of over
``GROUP`` texts is compared in blocks: within blocks, then the first of each block's
groups, and then what these leave apart from the largest part against all blocks, so
that no task holds more than two blocks and no similar pair is left out.

Equal fingerprints are merged first.  Within a table's bucket only a spanning forest
of the links leaves the task.  A bucket of over ``BLOCK`` fingerprints is covered once
more over the bits its mask does not fix, which leaves at most about 2**16 possible
fingerprints per group whatever the corpus: an exact way for hot buckets, never a cap.

Defined results for odd input
    null or empty text, white space only   fingerprint zero, linked like any other
    fewer words than a shingle             the whole sequence is the one shingle
    null identifier                        takes part; never the smallest of a component
                                           that has an identifier
    repeated rows                          one result row each, same component
    repeated identifiers                   each row by its own text
    empty table                            an empty result with the full schema
    extra columns                          ignored by ``near_duplicates``, passed
                                           through by ``representatives``
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.components import components, thinned
from tidemark.llm.shared import bounded_batches, by_key, drop_table, give_back, materialise, text_or_empty, without

BITS = 64
BLOCK = 16_384
SEED = 42
SIMILAR = 0.8
#: Linked texts that one task compares at a time, and bytes of them.
GROUP, GROUP_BYTES = 1024, 64 << 20
_UPPER = bytes(range(65, 91))
_LOWER_TABLE = bytes(b + 32 if b in _UPPER else b for b in range(256))


@dataclass(frozen=True)
class Scheme:
    """What is linked: fingerprints over ``words``-word shingles within ``radius``
    bits, with ``halves`` those of the whole or of either half; with ``check_words``,
    also within ``check_radius`` of 128 bits over these."""

    words: int = 4
    radius: int = 4
    parts: int = 1
    check_words: int = 0
    check_radius: int = 128
    halves: bool = False

    def views(self) -> list[str]:
        """Columns of the fingerprints that link."""
        return ["fp", "f1", "f2"] if self.halves else ["fp"]


NEAR_TEXT = Scheme(words=2, radius=9, parts=2, check_words=5, check_radius=31, halves=True)
PRINTS = ["fp", "c0", "c1", "f1", "f2"]


def _majority(joined: bytes, ends: list[int], words: int, seed: int) -> int:
    """Majority bits over the shingles of ``joined``, whose words end at ``ends``
    (counting the space after each)."""
    n = len(ends)
    if n <= words:
        return xxhash.xxh64_intdigest(joined, seed)
    begins = [0, *ends[: n - words]]
    digest = xxhash.xxh64_intdigest
    total, count = np.zeros(BITS, dtype=np.int64), n - words + 1
    for lo in range(0, count, 16_384):
        h = [digest(joined[a : b - 1], seed) for a, b in zip(begins[lo : lo + 16_384], ends[words - 1 + lo :], strict=False)]
        bits = np.unpackbits(np.array(h, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > count, bitorder="little").view("<u8")[0])


def _spread(text: bytes) -> tuple[bytes, list[int]]:
    tokens = text.translate(_LOWER_TABLE).split()
    return b" ".join(tokens), list(accumulate(len(t) + 1 for t in tokens))


def fingerprint(text: bytes, words: int = 4, seed: int = SEED) -> int:
    """64-bit majority fingerprint of a text."""
    joined, ends = _spread(text)
    return _majority(joined, ends, words, seed) if ends else 0


def text_key(text_col: str) -> Column:
    """16 bytes that stand for a whole text."""
    return F.unhex(F.md5(text_or_empty(text_col).cast("binary")))


def fingerprints(docs: DataFrame, scheme: Scheme, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_key and ``PRINTS`` (64 bits each, as signed longs) of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = np.zeros((len(PRINTS), b.num_rows), dtype=np.uint64)
            for i, t in enumerate(b.column(1)):
                joined, ends = _spread(t.as_py())
                if ends:
                    got[0, i] = _majority(joined, ends, scheme.words, SEED)
                    if scheme.check_words:
                        got[1, i] = _majority(joined, ends, scheme.check_words, SEED)
                        got[2, i] = _majority(joined, ends, scheme.check_words, SEED + 1)
                    if scheme.halves:
                        k = (len(ends) + 1) // 2
                        at = ends[k - 1]
                        got[3, i] = _majority(joined[: at - 1], ends[:k], scheme.words, SEED)
                        if len(ends) > 1:
                            got[4, i] = _majority(joined[at:], [e - at for e in ends[k:]], scheme.words, SEED)
            cols = [b.column(0), b.column(2), *(pa.array(x.view(np.int64)) for x in got)]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "text_key", *PRINTS])
        give_back()

    bounded_batches(docs.sparkSession)
    text = text_or_empty(text_col).cast("binary").alias("text")
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), text, text_key(text_col).alias("text_key"))
    return given.mapInArrow(run, "doc_id long, text_key binary, " + ", ".join(f"{c} long" for c in PRINTS))


def all_masks(scheme: Scheme, positions: list[int] | None = None) -> list[int]:
    """Masks that cover the scheme's radius over ``positions``, part by part."""
    positions = list(range(BITS)) if positions is None else positions
    runs = [positions[k :: scheme.parts] for k in range(scheme.parts)]
    return [m for run in runs for m in covering_masks(scheme.radius // scheme.parts, run)]


def covering_masks(radius: int, positions: list[int] | None = None) -> list[int]:
    """The masks over ``positions`` (all 64 by default); vectors are dealt to the
    positions in turn, so all masks keep about half of them."""
    positions = list(range(BITS)) if positions is None else positions
    n = (1 << (radius + 1)) - 1
    vectors = {p: i % n + 1 for i, p in enumerate(positions)}
    return [sum(1 << p for p in positions if bin(vectors[p] & v).count("1") % 2) for v in range(1, n + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def _near(a: np.ndarray, b: np.ndarray, scheme: Scheme) -> np.ndarray:
    """Whether rows (fp, c0, c1) are linked."""
    close = popcount(a[:, 0] ^ b[:, 0]) <= scheme.radius
    if scheme.check_words:
        apart = popcount(a[:, 1] ^ b[:, 1]).astype(np.int16) + popcount(a[:, 2] ^ b[:, 2])
        close &= apart <= scheme.check_radius
    return close


def spanning_links(rows: np.ndarray, scheme: Scheme) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (as row numbers) of the links within one group.

    Breadth-first: each member is compared once with those not reached yet."""
    left, us, vs = np.arange(len(rows)), [], []
    while len(left) > 1:
        root, left = left[0], left[1:]
        frontier = [root]
        while frontier and len(left):
            x = frontier.pop()
            near = _near(rows[left], rows[x : x + 1], scheme)
            if near.any():
                got, left = left[near], left[~near]
                frontier += got.tolist()
                us.append(got)
                vs.append(np.full(len(got), root))
    none = np.zeros(0, dtype=np.int64)
    return np.concatenate([*us, none]), np.concatenate([*vs, none])


def _pairs(rows: np.ndarray, pick: np.ndarray, sizes: np.ndarray, scheme: Scheme) -> tuple[np.ndarray, np.ndarray]:
    """Links of many small groups at once, pair offset by pair offset; ``pick`` holds
    the groups' row numbers one after another."""
    us, vs = [], []
    end = np.repeat(np.cumsum(sizes), sizes)
    for gap in range(1, int(sizes.max(initial=0))):
        at = np.flatnonzero(np.arange(len(pick) - gap) + gap < end[: len(pick) - gap])
        if not len(at):
            break
        a, b = pick[at], pick[at + gap]
        near = _near(rows[a], rows[b], scheme)
        us.append(b[near])
        vs.append(a[near])
    none = np.zeros(0, dtype=np.int64)
    return np.concatenate([*us, none]), np.concatenate([*vs, none])


def _links_of_groups(keys: np.ndarray, rows: np.ndarray, scheme: Scheme) -> tuple[np.ndarray, np.ndarray]:
    """Links (as row numbers) within runs of equal keys."""
    cut = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    sizes = np.diff(np.concatenate([cut, [len(keys)]]))
    us, vs = [], []
    small = (sizes > 1) & (sizes <= 32)
    if small.any():
        u, v = _pairs(rows, np.flatnonzero(np.repeat(small, sizes)), sizes[small], scheme)
        us.append(u)
        vs.append(v)
    for a, n in zip(cut[sizes > 32], sizes[sizes > 32], strict=True):
        u, v = spanning_links(rows[a : a + n], scheme)
        us.append(u + a)
        vs.append(v + a)
    none = np.zeros(0, dtype=np.int64)
    return np.concatenate([*us, none]), np.concatenate([*vs, none])


def _grouped_links(sorted_rows: DataFrame, scheme: Scheme) -> DataFrame:
    """(u, v) from rows that are sorted by bucket within partitions; holds the rows of
    one batch and one group at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = np.zeros((0, 5), dtype=np.int64)

        def out(x: np.ndarray) -> pa.RecordBatch:
            u, v = _links_of_groups(x[:, 0], x[:, 2:].view(np.uint64), scheme)
            return pa.RecordBatch.from_arrays([pa.array(x[u, 1]), pa.array(x[v, 1])], names=["u", "v"])

        for b in batches:
            x = np.concatenate([rest, np.stack([c.to_numpy() for c in b.columns], axis=1)])
            if not len(x):
                continue
            k = x[:, 0]
            last = len(k) - int((k[::-1] != k[-1]).argmax()) if k[0] != k[-1] else 0
            if last:
                yield out(x[:last])
            rest = x[last:]
        if len(rest):
            yield out(rest)
        give_back()

    return sorted_rows.select("bucket", "node", "fp", "c0", "c1").mapInArrow(run, "u long, v long")


def _in_tables(nodes: DataFrame, masks: list[int], views: list[str]) -> DataFrame:
    """Each fingerprint once per view and mask: table, the view's bits as ``fp`` and
    those of them that the mask keeps."""
    options = F.array(*[F.lit(_signed(m)) for m in masks])
    view = F.posexplode(F.array(*views)).alias("view", "bits")
    rows = nodes.select("node", "c0", "c1", view)
    rows = rows.select("node", F.col("bits").alias("fp"), "c0", "c1", "view", F.posexplode(options).alias("table", "mask"))
    return rows.select("node", "fp", "c0", "c1", "view", "table", F.col("fp").bitwiseAND(F.col("mask")).alias("masked"))


def links(nodes: DataFrame, scheme: Scheme, block: int = BLOCK) -> DataFrame:
    """Edges (u, v) between distinct ``nodes`` (node, ``PRINTS``): all linked pairs are
    connected by them, and each edge joins two members of one component."""
    masks, columns, of = all_masks(scheme), ["node", "fp", "c0", "c1"], ["view", "table", "masked"]
    rows = _in_tables(nodes, masks, scheme.views())
    bucket = F.xxhash64(*of).alias("bucket")
    sizes = rows.groupBy(*of).agg(F.count(F.lit(1)).alias("n"))
    hot = materialise(sizes.filter(F.col("n") > block), "hot-buckets")
    keyed = rows
    if hot.head(1):
        keyed = rows.join(hot, of, "left_anti")
        second = rows.join(hot, of, "left_semi")
        inner = [all_masks(scheme, [p for p in range(BITS) if not m >> p & 1]) for m in masks]
        tables = F.array(*[F.array(*[F.lit(_signed(x)) for x in ms]) for ms in inner])
        again = second.select(*columns, *of, F.posexplode(F.get(tables, F.col("table"))).alias("t2", "m2"))
        key = F.xxhash64(*of, "t2", F.col("fp").bitwiseAND(F.col("m2"))).alias("bucket")
        keyed = keyed.select(bucket, *columns).unionByName(again.select(key, *columns))
    else:
        keyed = keyed.select(bucket, *columns)
    return _grouped_links(keyed.repartition("bucket").sortWithinPartitions("bucket"), scheme)


def linked_rows(docs: DataFrame, scheme: Scheme, id_col: str, text_col: str, block: int = BLOCK) -> DataFrame:
    """doc_id, text_key, fp, component_id (smallest doc_id that links lead to) and root (a
    number of the component) of every document."""
    prints = materialise(fingerprints(docs, scheme, id_col, text_col), "fingerprints")
    keys = PRINTS if scheme.check_words or scheme.halves else ["fp"]
    distinct = prints.groupBy(*keys).agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("size"))
    node = F.xxhash64(*keys) if len(keys) > 1 else F.col("fp")
    distinct = distinct.withColumns({c: F.lit(0).cast("long") for c in PRINTS if c not in keys}).withColumn("node", node)
    distinct = materialise(distinct, "distinct-fingerprints")
    roots = components(thinned(links(distinct, scheme, block)))
    placed = distinct.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    placed = materialise(placed.select(*keys, "root", "first_id", F.col("size").alias("docs")), "placed")
    drop_table(distinct)
    first = placed.groupBy("root").agg(F.min("first_id").alias("component_id"), F.count(F.lit(1)).alias("size"))
    of = by_key(placed.select(*keys, "root", "docs"), materialise(first, "roots"), ["root"])
    of = materialise(of.select(*keys, "component_id", "root", F.col("docs").alias("size")), "components")
    return by_key(prints.select("doc_id", "text_key", *keys), of, keys).select("doc_id", "text_key", "fp", "component_id", "root")


def near_duplicates(
    docs: DataFrame, scheme: Scheme = Scheme(), id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK
) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (smallest doc_id that
    links lead to) of every document."""
    found = linked_rows(docs, scheme, id_col, text_col, block)
    return found.select("doc_id", _hex("fp").alias("fingerprint"), "component_id")


def shingle_set(text: bytes, words: int) -> np.ndarray:
    """64-bit hashes of the distinct shingles of a text, in order."""
    joined, ends = _spread(text)
    n, digest = len(ends), xxhash.xxh64_intdigest
    if n <= words:
        return np.array([digest(joined, SEED)], dtype=np.uint64)
    begins = [0, *ends[: n - words]]
    return np.unique(np.array([digest(joined[a : b - 1], SEED) for a, b in zip(begins, ends[words - 1 :], strict=True)], dtype=np.uint64))


def similar_groups(sets: list[np.ndarray], least: float = SIMILAR) -> np.ndarray:
    """A label per set; sets that a chain of Jaccard similarities of ``least`` or more
    joins share it.  Each reached set is compared once with those not reached yet."""
    sizes = np.array([len(x) for x in sets])
    of, label = np.repeat(np.arange(len(sets)), sizes), np.arange(len(sets))
    values, flat = np.unique(np.concatenate(sets), return_inverse=True)
    marked, open_ = np.zeros(len(values), dtype=bool), np.ones(len(sets), dtype=bool)
    mine = np.split(flat, np.cumsum(sizes)[:-1])
    for root in range(len(sets)):
        if not open_[root]:
            continue
        open_[root], frontier = False, [root]
        while frontier and open_.any():
            x = frontier.pop()
            here = open_[of]
            if not here.all():
                flat, of = flat[here], of[here]
            marked[mine[x]] = True
            both = np.bincount(of[marked[flat]], minlength=len(sets))
            marked[mine[x]] = False
            got = np.flatnonzero(open_ & (both >= least * (sizes + sizes[x] - both)))
            open_[got], label[got] = False, root
            frontier += got.tolist()
    return label


def _beaten(members: DataFrame, words: int) -> DataFrame:
    """(doc_id, text_key) of those ``members`` (root, doc_id, text_key, text) whose text is
    similar to that of a smaller one: by identifier, missing ones last, then by text_key.
    A task holds the shingle hashes of one component at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows, sets = None, [], []

        def out() -> pa.RecordBatch:
            label, low = similar_groups(sets).tolist(), {}
            for k, r in zip(label, rows, strict=True):
                low[k] = min(r, low.get(k, r))
            gone = [r for k, r in zip(label, rows, strict=True) if r != low[k]]
            ids = pa.array([None if missing else i for missing, i, _ in gone], pa.int64())
            return pa.RecordBatch.from_arrays([ids, pa.array([t for _, _, t in gone], pa.binary())], names=["doc_id", "text_key"])

        for b in batches:
            for root, i, key, t in zip(*(b.column(k).to_pylist() for k in range(3)), b.column(3), strict=True):
                if rows and root != now:
                    yield out()
                    rows, sets = [], []
                now = root
                rows.append((i is None, i or 0, key))
                sets.append(shingle_set(t.as_py(), words))
        if rows:
            yield out()
        rows, sets = [], []
        give_back()

    given = members.select("root", "doc_id", "text_key", "text").repartition("root").sortWithinPartitions("root")
    return given.mapInArrow(run, "doc_id long, text_key binary")


def _node(prefix: str) -> Column:
    """An order of rows: by identifier, missing ones last, then by text."""
    return F.struct(*[F.col(f"{prefix}_{c}").alias(c) for c in ("missing", "id", "key")])


def _edges(nodes: list[dict], us: list[int], vs: list[int]) -> pa.RecordBatch:
    """Links between ``nodes``, one column per part of a node."""
    cols, names = [], []
    for side, at in (("u", us), ("v", vs)):
        for c, kind in (("missing", pa.bool_()), ("id", pa.int64()), ("key", pa.binary())):
            cols.append(pa.array([nodes[i][c] for i in at], kind))
            names.append(f"{side}_{c}")
    return pa.RecordBatch.from_arrays(cols, names=names)


def _block_links(rows: DataFrame, words: int) -> DataFrame:
    """Links (u, v) within blocks of ``rows`` (node, text, label, probe, root, a, b), one
    block (root, a, b) at a time: without probes a forest of all its similar members, else
    those of each probe with members of other labels, one a label."""

    def linked(nodes: list, sets: list, labels: list, probes: list) -> pa.RecordBatch:
        if not any(probes):
            got = similar_groups(sets)
            us = np.flatnonzero(got != np.arange(len(got)))
            return _edges(nodes, us.tolist(), got[us].tolist())
        sizes, of = np.array([len(x) for x in sets]), np.array(labels)
        values, flat = np.unique(np.concatenate(sets), return_inverse=True)
        owner, mine = np.repeat(np.arange(len(sets)), sizes), np.split(flat, np.cumsum(sizes)[:-1])
        marked, us, vs = np.zeros(len(values), dtype=bool), [], []
        for x in np.flatnonzero(probes):
            marked[mine[x]] = True
            both = np.bincount(owner[marked[flat]], minlength=len(sets))
            marked[mine[x]] = False
            hit = np.flatnonzero((of != of[x]) & (both >= SIMILAR * (sizes + sizes[x] - both)))
            one = hit[np.unique(of[hit], return_index=True)[1]]
            us += [int(x)] * len(one)
            vs += one.tolist()
        return _edges(nodes, us, vs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, nodes, sets, labels, probes = None, [], [], [], []
        for b in batches:
            for i, part in enumerate(zip(*(b.column(k).to_pylist() for k in range(3)), strict=True)):
                if nodes and part != now:
                    yield linked(nodes, sets, labels, probes)
                    nodes, sets, labels, probes = [], [], [], []
                now = part
                nodes.append(b.column(3)[i].as_py())
                sets.append(shingle_set(b.column(4)[i].as_py(), words))
                labels.append(b.column(5)[i].as_py())
                probes.append(b.column(6)[i].as_py())
        if nodes:
            yield linked(nodes, sets, labels, probes)
        nodes, sets, labels, probes = [], [], [], []
        give_back()

    part = ["root", "a", "b"]
    dealt = rows.select(*part, "node", "text", "label", "probe").repartition(*part).sortWithinPartitions(*part)
    flat = ", ".join(f"{side}_missing boolean, {side}_id long, {side}_key binary" for side in "uv")
    return dealt.mapInArrow(run, flat).select(_node("u").alias("u"), _node("v").alias("v"))


def _blocks(rows: DataFrame, most: int, name: str) -> DataFrame:
    """``rows`` (root, node, text) with the number of blocks of their root, as ``n_`` and
    the name, and their own block, as ``name``."""
    n = F.ceil(F.greatest(F.count(F.lit(1)) / most, F.sum(F.octet_length("text")) / GROUP_BYTES))
    counted = rows.groupBy("root").agg(F.greatest(n, F.lit(1)).cast("int").alias(f"n_{name}"))
    return _per_root(rows, counted).withColumn(name, F.pmod(F.xxhash64("node"), F.col(f"n_{name}")).cast("int"))


def _per_root(rows: DataFrame, table: DataFrame) -> DataFrame:
    """``rows`` joined with a row per root: broadcast after counting, as a root is a group
    of many rows, so that no group meets in one task."""
    table = materialise(table, "near-roots")
    return rows.join(F.broadcast(table) if table.limit(200_001).count() <= 200_000 else table, "root")


def _labelled(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """``rows`` with ``label``, a number of the component that ``edges`` put them in."""
    first = components(edges).select("node", F.xxhash64("root").alias("label"))
    return rows.join(first, "node", "left").withColumn("label", F.coalesce("label", F.xxhash64("node")))


def _beaten_in_blocks(members: DataFrame, words: int, most: int) -> DataFrame:
    """What ``_beaten`` gives, of groups of any size; members are compared in blocks.

    First within blocks; then the first of every local group, in blocks again; members
    outside their group's largest part by then are compared with all others that are not
    in their own part.  Near copies of one text are one part after the second step, which
    leaves the third without work; it grows with the members outside times all."""
    node = F.struct(F.isnull("doc_id").alias("missing"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("text_key").alias("key"))
    rows = materialise(_blocks(members.select("root", node.alias("node"), "text").distinct(), most, "a"), "near-blocks")
    plain = {"b": F.lit(0), "label": F.lit(0).cast("long"), "probe": F.lit(False)}
    edges = materialise(_block_links(rows.withColumns(plain), words), "near-edges")
    inner = edges.select(F.col("u").alias("node"))  # all but the first of a local group
    firsts = rows.join(inner.distinct(), "node", "left_anti").select("root", "node", "text")
    between = materialise(_block_links(_blocks(firsts, most, "a").withColumns(plain), words), "near-firsts")
    edges = edges.unionByName(between)
    placed = materialise(_labelled(rows.select("root", "node", "a", "n_a"), edges), "near-parts")
    parts = placed.groupBy("root", "label").agg(F.count(F.lit(1)).alias("n"))
    largest = parts.groupBy("root").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.count(F.lit(1)).alias("parts"))
    apart = materialise(largest.filter("parts > 1"), "near-apart")
    if apart.head(1):
        targets = _per_root(placed, apart).join(rows.select("node", "text"), "node")
        probes = _blocks(targets.filter("label != main").select("root", "node", "text", "label", F.col("n_a").alias("targets")), most, "c")
        left = probes.select("root", "node", "text", "label", F.lit(True).alias("probe"), F.col("c").alias("b"), F.explode(F.sequence(F.lit(0), F.col("targets") - 1)).alias("a"))
        right = _per_root(targets.select("root", "node", "text", "label", F.lit(False).alias("probe"), "a"), probes.groupBy("root").agg(F.max("n_c").alias("n_c")))
        right = right.withColumn("b", F.explode(F.sequence(F.lit(0), F.col("n_c") - 1)))
        edges = edges.unionByName(materialise(_block_links(left.unionByName(right.select(*left.columns)), words), "near-across"))
    gone = components(edges).filter("node != root")
    return gone.select(F.when(~F.col("node.missing"), F.col("node.id")).alias("doc_id"), F.col("node.key").alias("text_key"))


def representatives(docs: DataFrame, scheme: Scheme = NEAR_TEXT, text_col: str = "text", id_col: str = "doc_id", most: int = GROUP) -> DataFrame:
    """The rows of ``docs`` that are the first of their group, all columns: the smallest
    identifier stays, missing ones coming last; of rows that share it the one whose text
    has the smallest md5.  Rows are told apart by identifier and text, so a repeated
    identifier neither saves a near copy nor removes another text; rows with the same
    identifier and text stay or go together.  Groups of over ``most`` rows are compared in
    blocks of about so many, with the same result."""
    found = materialise(linked_rows(docs, scheme, id_col, text_col).select("doc_id", "text_key", "root"), "near-found")
    shared = found.groupBy("root").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    linked = found.join(shared, "root").select(F.col("doc_id").alias("linked_id"), F.col("text_key").alias("linked_key"), "root", "n").distinct()
    linked = materialise(linked, "near-linked")
    given = F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).cast("binary").alias("text"), text_key(text_col).alias("text_key")
    same = F.col("doc_id").eqNullSafe(F.col("linked_id")) & (F.col("text_key") == F.col("linked_key"))
    few = linked.limit(200_001).count() <= 200_000

    def members(which: str) -> DataFrame:
        of = linked.filter(which)
        return docs.select(*given).join(F.broadcast(of) if few else of, same)

    words = scheme.check_words or scheme.words
    gone = _beaten(members(f"n <= {most}"), words)
    if linked.filter(F.col("n") > most).head(1):
        gone = gone.unionByName(_beaten_in_blocks(members(f"n > {most}"), words, most))
    gone = gone.distinct()
    gone = materialise(gone.select(F.col("doc_id").alias("gone_id"), F.col("text_key").alias("gone_key")), "near-gone")
    return without(docs, gone, F.col(id_col).cast("long").eqNullSafe(F.col("gone_id")) & (text_key(text_col) == F.col("gone_key")))


def _hex(col: str) -> Column:
    return F.lower(F.lpad(F.hex(col), 16, "0"))
