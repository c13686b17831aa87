"""Hard negatives by a threshold join in the manner of L2AP.

Components become integers, so scores (inner products) are exact.  Rows lie in blocks;
a block holds an inverted index over groups of dimensions.  Against a threshold a row
is indexed only as far as needed: once the norm of what remains of it times the largest
norm of an anchor is below the threshold, the remaining dimensions are left out, as they
alone can't reach it.  Partial scores are accumulated group by group over the posting
lists; a row leaves them when no anchor can reach its threshold with the norms of the
dimensions to come; what is left at the end is scored in full.

Thresholds start high and are lowered until every anchor has its window full:

1. positives: rows of the anchor's own label until ``positives`` of them are found;
2. negatives: rows of other labels until each positive's window, from ``low`` to
   ``high`` hundredths of its score, has ``negatives`` rows or the threshold has passed
   the window's lower end.

Everything above a threshold is found, so a full window is final.  Anchors (a stated
query set) meet the other rows as pairs of blocks, so a task holds some blocks of
either at a time; pairs of blocks that labels or norms rule out never meet.  What a
pair yields is cut to the best of each window before it is shuffled.

Defined results for odd input
    null label, null or empty vector, null, NaN or infinite component   takes no part
    vectors of different length     never compared
    repeated rows                   rows of their own; a row is not its own positive
    null identifier                 never an anchor; loses ties against identifiers
    ties                            the smaller identifier, then equal rows in any order
    negative positive score         an empty window
    no positives, no negatives      no result rows for that anchor or positive
    empty table                     an empty result with the full schema
    extra columns                   ignored
    components so large that a score could pass 2**53    refused (not exact)
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import bounded_batches, drop_table, materialise

#: Sums below are exact in double precision.
EXACT = 1 << 53
ROWS, ANCHORS, GROUP = 4096, 256, 8
#: Anchors that one task's blocks meet; more of them meet the rows in further tasks.
ANCHORS_AT_ONCE = 65_536
#: Stands for a missing identifier in ties: after all others.
NO_ID = (1 << 63) - 1
#: Thresholds as parts of the largest score an anchor could reach; at last none.
POSITIVE_LEVELS = (0.7, 0.4, 0.1, None)
#: Thresholds as parts of the best positive's score; at last the windows' lower ends.
NEGATIVE_LEVELS = (0.6, 0.45, None)


def usable(vec: str) -> Column:
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vec) > 0) & finite, F.lit(False))


def integer_rows(vectors: DataFrame, scale: int, id_col: str, vec_col: str, label_col: str, relabel: tuple[int, int]) -> DataFrame:
    """r (a row's own number), id, label and vec (integers) of the rows that take part."""
    every, n_labels = relabel
    given = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vec_col).alias("vec"))
    given = given.filter(usable("vec") & F.col("label").isNotNull())
    other = F.when(F.col("id") % every == 0, (F.col("label") + 1) % n_labels).otherwise(F.col("label"))
    whole = F.transform("vec", lambda x: F.floor(x.cast("double") * scale))
    return given.select(F.monotonically_increasing_id().alias("r"), "id", other.alias("label"), whole.alias("vec"))


def dimension_order(rows: DataFrame) -> dict[int, np.ndarray]:
    """Per vector length its dimensions, those with the most energy first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            widths = np.diff(b.column(0).offsets.to_numpy())
            for w in np.unique(widths):
                x = b.column(0).take(pa.array(np.flatnonzero(widths == w))).flatten().to_numpy().astype(float).reshape(-1, w)
                if float(np.abs(x).max()) ** 2 * w >= EXACT:
                    raise ValueError("components too large for exact scores")
                total[int(w)] = total.get(int(w), 0) + (x * x).sum(axis=0)
        for w, e in total.items():
            cols = [pa.array([w] * w, pa.int32()), pa.array(range(w), pa.int32()), pa.array(e)]
            yield pa.RecordBatch.from_arrays(cols, names=["width", "pos", "energy"])

    sums = rows.select("vec").mapInArrow(run, "width int, pos int, energy double").groupBy("width", "pos").agg(F.sum("energy").alias("energy"))
    found = sums.toPandas()
    return {int(w): g.sort_values(["energy", "pos"], ascending=[False, True])["pos"].to_numpy() for w, g in found.groupby("width")}


def in_blocks(rows: DataFrame, order: dict[int, np.ndarray], size: int, ends: str = "", parts: int | None = None) -> DataFrame:
    """Blocks of rows of one width and neighbouring labels: number, width, lowest and
    highest label, largest norm, and the rows' columns one after another.  ``ends``
    names an array of doubles that goes with the rows, led by their thresholds, of which
    the least is kept.  Few rows can be gathered in few ``parts``."""
    cols = ["r", "id", "label", "vec", *([ends] if ends else [])]
    rows = rows.select(F.size("vec").alias("width"), *cols).repartitionByRange("width", "label", F.xxhash64("r"))
    rows = (rows.coalesce(parts) if parts else rows).sortWithinPartitions("width", "label", "r")

    def block(t: pa.Table) -> pa.RecordBatch:
        w = t["width"][0].as_py()
        x = t["vec"].combine_chunks().flatten().to_numpy().astype(np.int32).reshape(-1, w)[:, order[w]]
        label = t["label"].to_numpy()
        norm = float(np.sqrt((x.astype(float) ** 2).sum(axis=1).max()))
        ids = t["id"].combine_chunks().fill_null(NO_ID).to_numpy()
        more = t[ends].combine_chunks().flatten().to_numpy() if ends else np.zeros(len(x))
        parts_ = [t["r"].to_numpy().astype(np.int64), ids.astype(np.int64), label.astype(np.int64), more.astype(float), np.ascontiguousarray(x)]
        head = [w, int(label.min()), int(label.max()), norm, float(more.reshape(len(x), -1)[:, 0].min())]
        got = [pa.array([v], k) for v, k in zip(head, KINDS, strict=True)] + [pa.array([p.tobytes()], pa.binary()) for p in parts_]
        return pa.RecordBatch.from_arrays(got, names=BLOCK_NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for b in batches:
            t = pa.Table.from_batches([b])
            rest = t if rest is None else pa.concat_tables([rest, t])
            while rest.num_rows:
                same = rest["width"].to_numpy() == rest["width"][0].as_py()
                n = len(same) if same.all() else int(same.argmin())
                if n < size and n == rest.num_rows:
                    break
                yield block(rest.slice(0, min(n, size)))
                rest = rest.slice(min(n, size))
        if rest is not None and rest.num_rows:
            yield block(rest)

    return rows.mapInArrow(run, BLOCK).withColumn("number", F.monotonically_increasing_id())


BLOCK = "width int, lo long, hi long, norm double, least double, r binary, id binary, label binary, ends binary, vec binary"
BLOCK_NAMES = [c.split()[0] for c in BLOCK.split(", ")]
KINDS = [pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]


def suffix_norms(x: np.ndarray) -> np.ndarray:
    """Norm of each row from group g of dimensions on (columns g = 0, 1, ..., and 0)."""
    sq = x.astype(float) ** 2
    starts = range(0, x.shape[1], GROUP)
    sums = np.stack([sq[:, s : s + GROUP].sum(axis=1) for s in starts] + [np.zeros(len(x))], axis=1)
    return np.sqrt(sums[:, ::-1].cumsum(axis=1)[:, ::-1])


def above(q: np.ndarray, t: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor and row numbers and scores of all pairs of score ``t`` (one per anchor) or
    more, through the inverted index of ``x``."""
    q, x = q.astype(float), x.astype(float)
    q_rest, x_rest = suffix_norms(q), suffix_norms(x)
    groups = x_rest.shape[1] - 1
    slack = 1 + 1e-9
    # how many groups of a row are indexed: beyond, its rest can't reach any threshold
    reach = x_rest * q_rest[:, 0].max() * slack >= t.min()
    depth = np.where(reach.all(axis=1), groups, np.minimum(reach.argmin(axis=1), groups))
    rows = np.argsort(-depth, kind="stable")
    rows = rows[depth[rows] > 0]
    if t.min() <= 0:  # zeros and below count as well: nothing can be left out
        rows, depth = np.arange(len(x)), np.full(len(x), groups)
    score = np.zeros((len(q), len(rows)), dtype=float)
    for g in range(groups):
        posting = int((depth[rows] > g).sum())
        if not posting:
            break
        cols = slice(g * GROUP, (g + 1) * GROUP)
        score[:, :posting] += q[:, cols] @ x[rows[:posting], cols].T
        if g + 1 < groups and np.isfinite(t).all():
            left = np.minimum(depth[rows], g + 1)
            alive = (score + q_rest[:, left] * x_rest[rows, left] * slack + 1 >= t[:, None]).any(axis=0)
            if 2 * alive.sum() < len(rows):
                rows, score = rows[alive], score[:, alive]
    left = depth[rows]
    a, i = np.nonzero(score + q_rest[:, left] * x_rest[rows, left] * slack + 1 >= t[:, None])
    full = np.empty(len(a), dtype=np.int64)
    for s in range(0, len(a), 1 << 16):
        p = slice(s, s + (1 << 16))
        full[p] = np.einsum("ij,ij->i", q[a[p]], x[rows[i[p]]]) if (left < groups).any() else score[a[p], i[p]]
    keep = full >= t[a]
    return a[keep], rows[i[keep]], full[keep]


def ranked(a: np.ndarray, i: np.ndarray, score: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs by anchor, best score first, ties by the smaller identifier."""
    o = np.lexsort((ids[i], -score, a))
    return a[o], i[o], score[o]


def met(rows: DataFrame, anchors: DataFrame, n_anchors: int, same_label: bool) -> DataFrame:
    """Pairs of blocks of equal width that labels and norms don't rule out.  Keys are
    (part of the row blocks, part of the anchor blocks).  Anchors are copied once for each
    part of the row blocks, of which there are no more than blocks; the copies, far larger
    than Spark takes them for, are always shuffled, as a broadcast passes the driver."""
    spark = rows.sparkSession
    row_parts = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), rows.count()))
    anchor_parts = -(-n_anchors // ANCHORS_AT_ONCE)
    number = F.xxhash64("number")
    r = rows.select(*[F.col(c).alias(f"x_{c}") for c in BLOCK_NAMES], F.pmod(number, F.lit(row_parts)).alias("p"), F.explode(F.sequence(F.lit(0), F.lit(anchor_parts - 1))).alias("s"))
    a = anchors.select(*[F.col(c).alias(f"q_{c}") for c in BLOCK_NAMES], F.pmod(number, F.lit(anchor_parts)).cast("int").alias("s"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(row_parts - 1).cast("long"))).alias("p"))
    can = (F.col("x_width") == F.col("q_width")) & (F.col("x_norm") * F.col("q_norm") * (1 + 1e-9) >= F.col("q_least"))
    if same_label:
        can = can & (F.col("x_lo") <= F.col("q_hi")) & (F.col("x_hi") >= F.col("q_lo"))
    else:
        can = can & ~((F.col("x_lo") == F.col("x_hi")) & (F.col("q_lo") == F.col("q_hi")) & (F.col("x_lo") == F.col("q_lo")))
    return r.join(a.hint("merge"), (r["p"] == a["p"]) & (r["s"] == a["s"]) & can)


def _block(b: pa.RecordBatch, i: int, side: str) -> dict[str, np.ndarray]:
    at = {n: b.column(b.schema.get_field_index(f"{side}_{n}"))[i].as_py() for n in ("width", "r", "id", "label", "ends", "vec")}
    out = {n: np.frombuffer(at[n], dtype=np.int64) for n in ("r", "id", "label")}
    ends = np.frombuffer(at["ends"], dtype=float).reshape(len(out["r"]), -1)
    return out | {"ends": ends, "vec": np.frombuffer(at["vec"], dtype=np.int32).reshape(-1, at["width"])}


FOUND = "a long, place int, score long, id long, r long"


def _best(df: DataFrame, keys: list[str], n: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), "id", "r")
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def best_positives(pairs: DataFrame, most: int) -> DataFrame:
    """Per anchor its best rows of the same label at or above its threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                q, x = _block(b, k, "q"), _block(b, k, "x")
                a, i, score = above(q["vec"], q["ends"][:, 0], x["vec"])
                own = (q["label"][a] == x["label"][i]) & (q["r"][a] != x["r"][i])
                a, i, score = ranked(a[own], i[own], score[own], x["id"])
                first = np.searchsorted(a, a)  # where the anchor's pairs begin
                top = np.arange(len(a)) - first < most
                a, i, score = a[top], i[top], score[top]
                cols = [q["r"][a], np.zeros(len(a), np.int32), score, x["id"][i], x["r"][i]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["a", "place", "score", "id", "r"])

    return _best(pairs.select(*_needed(pairs)).mapInArrow(run, FOUND), ["a"], most)


def best_negatives(pairs: DataFrame, places: int, most: int) -> DataFrame:
    """Per anchor and open window its best rows of other labels.  The ends of an anchor
    are its threshold, the highest end of its windows, and the lower and upper ends of
    all ``places`` windows (upper below lower: not open)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                q, x = _block(b, k, "q"), _block(b, k, "x")
                ends = q["ends"]
                a, i, score = above(q["vec"], ends[:, 0], x["vec"])
                other = (q["label"][a] != x["label"][i]) & (score <= ends[a, 1])
                a, i, score = ranked(a[other], i[other], score[other], x["id"])
                begins = np.searchsorted(a, np.arange(len(q["r"]) + 1))
                out = []
                for n in np.unique(a):
                    down = -score[begins[n] : begins[n + 1]]
                    for p in range(places):
                        lo, hi = ends[n, 2 + p], ends[n, 2 + places + p]
                        if lo <= hi:
                            at = np.searchsorted(down, -hi)
                            end = min(at + most, np.searchsorted(down, -lo, side="right"))
                            out += [(n, p, o) for o in range(begins[n] + at, begins[n] + end)]
                if out:
                    n, p, o = np.array(out).T
                    cols = [q["r"][n], p.astype(np.int32), score[o], x["id"][i[o]], x["r"][i[o]]]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["a", "place", "score", "id", "r"])

    return _best(pairs.select(*_needed(pairs)).mapInArrow(run, FOUND), ["a", "place"], most)


def _needed(pairs: DataFrame) -> list[str]:
    return [f"{s}_{n}" for s in ("q", "x") for n in ("width", "r", "id", "label", "ends", "vec")]


def _blocks_of(anchors: DataFrame, order: dict[int, np.ndarray], n: int) -> DataFrame:
    return materialise(in_blocks(anchors, order, ANCHORS, "ends", max(1, n // ANCHORS)), "anchor-blocks")


def positives_of(blocks: DataFrame, anchors: DataFrame, order: dict[int, np.ndarray], most: int) -> DataFrame:
    """a, place (from 0), score, id and r: the best rows of each anchor's label."""
    left, done = anchors, []
    for level in POSITIVE_LEVELS:
        n = left.count()
        if not n:
            break
        t = F.lit(float("-inf")) if level is None else F.col("reach") * level
        own = _blocks_of(left.withColumn("ends", F.array(t)), order, n)
        pairs = met(blocks, own, n, True)
        found = materialise(best_positives(pairs, most).withColumn("place", F.col("rank") - 1).drop("rank"), "positives")
        drop_table(own)
        if level is None:
            done.append(found)
            break
        full = found.groupBy("a").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= most).select("a")
        done.append(found.join(full, "a", "left_semi"))
        left = materialise(left.join(full, left["r"] == full["a"], "left_anti"), "open-anchors")
    return materialise(_union(done), "positives")


def negatives_of(
    blocks: DataFrame, anchors: DataFrame, order: dict[int, np.ndarray], windows: DataFrame, places: int, most: int
) -> DataFrame:
    """a, place, rank, score and id: the best rows of other labels in each window (a,
    place, score, lo, hi)."""
    left, done = windows, []
    inf = F.lit(float("inf"))
    for level in NEGATIVE_LEVELS:
        ends = [F.max(F.when(F.col("place") == k, F.col(c).cast("double"))).alias(f"{c}{k}") for c in ("lo", "hi") for k in range(places)]
        per = left.groupBy("a").agg(F.max("score").alias("top"), F.min("lo").alias("lowest"), F.max("hi").alias("cap"), *ends)
        t = F.col("lowest").cast("double")
        t = t if level is None else F.greatest(t, F.col("top") * level)
        per = per.withColumn("t", t)
        lows = [F.coalesce(F.greatest(F.col(f"lo{k}"), F.col("t")), inf) for k in range(places)]
        highs = [F.coalesce(F.col(f"hi{k}"), -inf) for k in range(places)]
        per = materialise(per.select("a", "t", F.array("t", F.col("cap").cast("double"), *lows, *highs).alias("ends")), "windows")
        n = per.count()
        if not n:
            break
        with_ends = anchors.join(per.hint("merge"), anchors["r"] == per["a"]).select("r", "id", "label", "vec", "ends")
        own = _blocks_of(with_ends, order, n)
        pairs = met(blocks, own, n, False)
        found = materialise(best_negatives(pairs, places, most), "negatives")
        drop_table(own)
        if level is None:
            done.append(found)
            break
        counted = left.join(per.select("a", "t"), "a").join(
            found.groupBy("a", "place").agg(F.count(F.lit(1)).alias("n")), ["a", "place"], "left"
        )
        state = materialise(counted.withColumn("full", (F.col("t") <= F.col("lo")) | (F.coalesce("n", F.lit(0)) >= most)), "windows")
        done.append(found.join(state.filter("full").select("a", "place"), ["a", "place"], "left_semi"))
        left = state.filter("not full").select("a", "place", "score", "lo", "hi")
    return _union(done)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def mined(
    vectors: DataFrame,
    positives: int = 5,
    negatives: int = 10,
    low: int = 30,
    high: int = 90,
    anchor_every: int = 100,
    relabel: tuple[int, int] = (7, 10),
    scale: int = 256,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id and both scores.  Every ``relabel[0]``-th
    identifier's label is first moved on by one, modulo ``relabel[1]``."""
    spark = vectors.sparkSession
    bounded_batches(spark)
    rows = materialise(integer_rows(vectors, scale, id_col, vec_col, label_col, relabel), "vector-rows")
    order = dimension_order(rows)
    anchors = rows.filter(F.col("id") % anchor_every == 0)
    if not order or not anchors.head(1):
        return spark.createDataFrame([], RESULT)
    blocks = materialise(in_blocks(rows, order, ROWS), "row-blocks")
    largest = blocks.groupBy("width").agg(F.max("norm").alias("largest"))
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    anchors = anchors.withColumn("width", F.size("vec")).join(largest, "width")
    anchors = materialise(anchors.select("r", "id", "label", "vec", (norm * F.col("largest")).alias("reach")), "anchors")
    best = positives_of(blocks, anchors, order, positives)
    ends = [F.expr(f"({low} * score + 99) div 100").alias("lo"), F.expr(f"({high} * score) div 100").alias("hi")]
    windows = best.filter("score >= 0").select("a", "place", "score", *ends)
    hard = negatives_of(blocks, anchors, order, windows, positives, negatives)
    known = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    pos = best.select("a", "place", known("id").alias("positive_id"), F.col("score").alias("positive_score"))
    neg = hard.select("a", "place", "rank", known("id").alias("negative_id"), F.col("score").alias("negative_score"))
    out = pos.join(neg, ["a", "place"]).join(anchors.select(F.col("r").alias("a"), F.col("id").alias("anchor_id")), "a")
    out = materialise(out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"), "hard-negatives")
    for t in (rows, blocks, anchors, best):
        drop_table(t)
    return out
