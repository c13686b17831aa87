"""Best-fit packing by a configuration linear program.

Documents become token ids, then pieces of at most ``capacity`` ids; only longer
documents are cut.  The number of pieces of each length (the histogram, at most
``capacity`` entries however large the corpus) is all that the plan needs:

1.  the configuration LP (fewest sequences whose contents cover the histogram) is
    solved by multiplicative weights: lengths that have been placed less than their
    share grow dearer, and a knapsack dynamic program over the capacity prices the
    configuration worth most at these weights, among those that leave no room empty
    or, where lengths do not add up to the capacity, no more than must be.  The
    weights also give a bound that no packing can be below (the dual program);
2.  its use is rounded as the weights advance: each step is a whole number of copies
    that the histogram still holds, so a corpus whose lengths mostly occur once is
    placed by the program too;
3.  the few pieces that no configuration completes go best-fit, longest first, into
    the fullest sequence that has room, and with them the last sequences of the
    program, which had to take what was left, if that needs fewer.

Pieces find their place by their rank among the pieces of their length; ranks come
from a window over (length, salt) and the counts below it.  A length has as many
salts as its count asks for, so no window group grows with the corpus.

Defined results for odd input
    null text         as empty: one piece that holds the end id alone
    repeated rows     each is packed
    empty table       an empty result with the full schema
    extra columns     ignored
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.chunked_bpe import read_definition
from tidemark.llm.shared import bounded_batches, give_back, materialise, text_or_empty
from tidemark.llm.tokens import shared_encoder

#: Tried in turn until a plan meets its bound: how fast weights follow what lags (high
#: rates stay near the program's solution, low ones leave more short pieces for the last
#: sequences), and whether sequences may leave room.
TRIED = ((8.0, False), (8.0, True), (1.0, True), (0.25, True))

PIECE_SCHEMA = "doc_id long, piece int, start long, length int, ids_crc32 long"


def pieces(
    docs: DataFrame,
    tokenizer_path: str,
    end_id: int = 1,
    capacity: int = 4096,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(read_definition(tokenizer_path))
    end, step = end_id.to_bytes(4, "little"), capacity * 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared_encoder(shared.value)
        for batch in batches:
            rows = [[], [], [], [], []]
            ids, begins = encoder.encode_all(batch.column(1))
            for doc_id, lo, hi in zip(batch.column(0).to_pylist(), begins[:-1].tolist(), begins[1:].tolist(), strict=True):
                raw = ids[lo:hi].tobytes() + end
                for k, at in enumerate(range(0, len(raw), step)):
                    part = raw[at : at + step]
                    for col, x in zip(rows, (doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                        col.append(x)
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64())
            cols = [pa.array(c, t) for c, t in zip(rows, types, strict=True)]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "piece", "start", "length", "ids_crc32"])
        encoder.forget()
        give_back()

    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return given.mapInArrow(run, PIECE_SCHEMA)


@dataclass
class Plan:
    """Groups of equal sequences: ``patterns[g]`` is used ``copies[g]`` times."""

    patterns: list[tuple[int, ...]]
    copies: list[int]
    #: No packing has fewer sequences.
    bound: float = 0.0

    def sequences(self) -> int:
        return sum(self.copies)


def _filled(lengths: np.ndarray, worth: np.ndarray, most: np.ndarray, room: int) -> tuple[np.ndarray, list[tuple]]:
    """Most worth of contents that take exactly 0 ... ``room`` (-inf: none do), each
    length at most ``most`` times, and the steps of the program."""
    best = np.full(room + 1, -np.inf)
    best[0] = 0.0
    steps = []
    for length, value, n in zip(lengths.tolist(), worth.tolist(), most.tolist(), strict=True):
        rest, bundle = min(n, room // length), 1
        while rest > 0:  # bundles of 1, 2, 4 ... of a length make up every number of it
            k = min(bundle, rest)
            got = best[: room + 1 - k * length] + k * value
            steps.append((length, k, got > best[k * length :]))
            np.maximum(best[k * length :], got, out=best[k * length :])
            rest, bundle = rest - k, 2 * bundle
    return best, steps


def price(lengths: np.ndarray, worth: np.ndarray, most: np.ndarray, room: int, spare: int | None = 0) -> list[int] | None:
    """The contents that leave at most ``spare`` of ``room`` empty and are worth most;
    None if there are none.  A ``spare`` of None stands for as little as can be left."""
    best, steps = _filled(lengths, worth, most, room)
    if spare is None:
        spare = room - int(np.flatnonzero(best > -np.inf)[-1])
    empty = int(np.argmax(best[::-1][: spare + 1]))
    at = room - empty
    if best[at] == -np.inf:
        return None
    out = []
    for length, k, better in reversed(steps):
        if at >= k * length and better[at - k * length]:
            out += [length] * k
            at -= k * length
    return out


def dual_bound(lengths: np.ndarray, worth: np.ndarray, need: np.ndarray, capacity: int) -> float:
    """What all pieces are worth over the most that one sequence can be worth: no packing
    has fewer sequences, whatever the worths."""
    most = _filled(lengths, worth, need, capacity)[0].max()
    return float((worth * need).sum() / most) if most > 0 else 0.0


def solve(
    histogram: dict[int, int],
    capacity: int,
    configurations: int = 2048,
    width: int = 24,
    rate: float = 8.0,
    bounds: int = 6,
    leave_room: bool = False,
    share: float = 0.95,
) -> tuple[Plan, dict[int, int]]:
    """Configurations and how often each is used, and the pieces that these leave.

    The program: the fewest sequences whose contents cover the histogram.  Every
    length has a weight, exp(rate * how far its share of placed pieces lies behind the
    share of placed sequences).  A round takes the length whose weight times length is
    highest, prices by ``price`` what completes its sequence over the ``width`` dearest
    other lengths, each up to twice (more, in the end all and as often as they occur,
    while nothing completes it), and uses that configuration by a step of
    1 / ``configurations`` of all sequences.  Steps are rounded: down to whole copies that
    the histogram still holds, one at least.

    A sequence is complete if it leaves no room; with ``leave_room``, no more than rounds
    before have had to leave.  A length that nothing completes is put aside; with
    ``leave_room`` only once ``share`` of the contents is placed.  At ``bounds`` rounds
    the weights give a lower bound."""
    lengths = np.array(sorted(histogram), dtype=np.int64)
    need = np.array([histogram[int(x)] for x in lengths], dtype=np.int64)
    left, usable, spare = need.copy(), np.ones(len(lengths), dtype=bool), 0
    total = float((lengths * need).sum()) / capacity
    step, placed, plan = total / configurations, 0, Plan([], [], total)
    marks = [total * k / bounds for k in range(bounds)]
    while (usable & (left > 0)).any():
        weight = np.exp(rate * (left / need - (1 - placed / total)))
        value = weight * lengths / capacity
        if marks and placed >= marks[0]:
            marks.pop(0)
            plan.bound = max(plan.bound, dual_bound(lengths, value, need, capacity))
        enough = not leave_room or (lengths * left).sum() <= (1 - share) * total * capacity
        dear = weight * (1 + value)
        first = int(np.argmax(np.where(usable & (left > 0), value, -1)))
        room, have = capacity - int(lengths[first]), left.copy()
        have[first] -= 1
        fit = np.flatnonzero((have > 0) & (lengths <= room))
        rest, seen = (None if room else []), width
        while rest is None:
            every = seen >= len(fit)
            pick = fit if every else fit[np.argpartition(-dear[fit], seen)[:seen]]
            rest = price(lengths[pick], value[pick], have[pick] if every else np.minimum(have[pick], 2), room, spare)
            if rest is None and every:
                if enough:
                    break
                rest = price(lengths[pick], value[pick], have[pick], room, None)
                if len(fit) > 4 * width:  # not for want of pieces: others will have to leave as much
                    spare = max(spare, room - sum(rest))
            seen *= 4
        if rest is None:
            usable[first] = False
            continue
        config = tuple(sorted([int(lengths[first]), *rest], reverse=True))
        used, times = np.unique(config, return_counts=True)
        at = np.searchsorted(lengths, used)
        copies = max(1, min(int(step), int((left[at] // times).min())))
        left[at] -= times * copies
        placed += copies
        plan.patterns.append(config)
        plan.copies.append(copies)
    return plan, {int(x): int(n) for x, n in zip(lengths, left, strict=True) if n}


def _best_fit(left: dict[int, int], capacity: int) -> Plan:
    """Longest first into the open sequence with the least room that is enough;
    equal open sequences are handled together."""
    open_: dict[int, dict[tuple[int, ...], int]] = {}
    rooms = np.zeros(capacity + 1, dtype=np.int64)
    for length in sorted((x for x, n in left.items() if n > 0), reverse=True):
        count = left[length]
        while count > 0:
            fit = np.flatnonzero(rooms[length:])
            if len(fit):
                room = int(fit[0]) + length
                group, have = next(iter(open_[room].items()))
                k = min(count, have)
                if have == k:
                    del open_[room][group]
                else:
                    open_[room][group] = have - k
                rooms[room] -= k
            else:
                each = capacity // length
                k = count // each if count >= each else 1
                group, room = (), capacity
                if count >= each:
                    group, room = (length,) * (each - 1), capacity - length * (each - 1)
                    count -= k * (each - 1)
            room -= length
            key = (*group, length)
            slot = open_.setdefault(room, {})
            slot[key] = slot.get(key, 0) + k
            rooms[room] += k
            count -= k
    plan = Plan([], [])
    for room in sorted(open_):
        for group, n in open_[room].items():
            plan.patterns.append(group)
            plan.copies.append(n)
    return plan


def make_plan(histogram: dict[int, int], capacity: int = 4096, configurations: int = 2048) -> Plan:
    given = {int(k): int(v) for k, v in histogram.items() if v}
    whole = given.pop(capacity, 0)
    plan = Plan([(capacity,)], [whole]) if whole else Plan([], [])
    plan.bound = float(whole)
    if given:
        best, bound = None, 0.0
        for rate, leave_room in TRIED:
            solved, left = solve(given, capacity, configurations, rate=rate, leave_room=leave_room)
            bound = max(bound, solved.bound)
            for share in (0.0, 0.03, 0.1, 0.3):
                kept, open_ = _give_back(solved, left, share)
                rest = _best_fit(open_, capacity)
                n = kept.sequences() + rest.sequences()
                if (best is None or n < best[0]) and (leave_room or kept.sequences() >= rest.sequences()):
                    best = n, kept, rest
            if best and best[0] <= np.ceil(bound):  # no packing has fewer
                break
        plan.bound += bound
        for part in best[1:]:
            plan.patterns += part.patterns
            plan.copies += part.copies
    return plan


def _give_back(plan: Plan, left: dict[int, int], share: float) -> tuple[Plan, dict[int, int]]:
    """The plan without the last ``share`` of its sequences, whose contents join
    ``left``: the last pieces are the hardest to place by themselves."""
    spare, copies, left = int(share * plan.sequences()), list(plan.copies), dict(left)
    for k in range(len(copies) - 1, -1, -1):
        n = min(copies[k], spare)
        copies[k] -= n
        spare -= n
        for x in plan.patterns[k] if n else ():
            left[x] = left.get(x, 0) + n
    kept = [(p, n) for p, n in zip(plan.patterns, copies, strict=True) if n]
    return Plan([p for p, _ in kept], [n for _, n in kept]), left


def _intervals(plan: Plan, capacity: int) -> dict[str, np.ndarray]:
    """Per (length, group): the ranks served, the first sequence and the offset of
    the length's first item there; sorted by length and rank."""
    served = np.zeros(capacity + 1, dtype=np.int64)
    rows, base = [], 0
    for pattern, copies in zip(plan.patterns, plan.copies, strict=True):
        offset, i = 0, 0
        while i < len(pattern):
            length, n = pattern[i], 1
            while i + n < len(pattern) and pattern[i + n] == length:
                n += 1
            rows.append((length, served[length], n, base, offset))
            served[length] += n * copies
            offset += n * length
            i += n
        base += copies
    if not rows:
        rows = [(0, 0, 1, 0, 0)]
    table = np.array(rows, dtype=np.int64)
    table = table[np.lexsort((table[:, 1], table[:, 0]))]
    return dict(zip(("length", "rank", "each", "base", "offset"), table.T, strict=True))


def _salts(counts: dict[int, int], rows_per_salt: int) -> dict[int, int]:
    """Groups per length: a length has one for each ``rows_per_salt`` of its pieces."""
    return {length: -(-n // rows_per_salt) for length, n in counts.items()}


def pack(found: DataFrame, capacity: int = 4096, configurations: int = 2048, rows_per_salt: int = 250_000) -> DataFrame:
    """Adds sequence_id and offset to the pieces.

    ``found`` is written to the shared folder, as its ranks and its histogram must
    come from the same rows.  The driver holds the histogram (``capacity`` rows) and a
    count per (length, salt): ``capacity`` rows and one per ``rows_per_salt`` pieces.
    """
    spark = found.sparkSession
    found = materialise(found.withColumn("row_", F.monotonically_increasing_id()), "pieces")
    totals = {r["length"]: r["n"] for r in found.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    salts = _salts(totals, rows_per_salt)
    many = [(length, n) for length, n in sorted(salts.items()) if n > 1]
    salted = found.withColumn("salt", F.lit(0))
    if many:  # one row per length at most
        of = F.broadcast(spark.createDataFrame(many, "length int, salts int"))
        salt = F.pmod(F.xxhash64("row_"), F.coalesce("salts", F.lit(1))).cast("int")  # equal rows spread as well
        salted = found.join(of, "length", "left").withColumn("salt", salt).drop("salts")
    begins = np.zeros(capacity + 2, dtype=np.int64)  # where the salts of each length begin in ``below``
    begins[1:] = np.cumsum([salts.get(x, 0) for x in range(capacity + 1)])
    below = np.zeros(begins[-1] + 1, dtype=np.int64)
    if many:
        hot = salted.filter(F.col("length").isin([length for length, _ in many])) if len(many) < 200 else salted
        for r in hot.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n")).collect():
            if r["salt"] + 1 < salts[r["length"]]:
                below[begins[r["length"]] + r["salt"] + 1] = r["n"]
        for length, n in many:
            at = begins[length]
            below[at : at + n] = np.cumsum(below[at : at + n])
    plan = make_plan(totals, capacity, configurations)
    state = spark.sparkContext.broadcast((_intervals(plan, capacity), begins, below))

    rank = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32", "row_"))
    ranked = salted.withColumn("rank_", rank.cast("long") - 1)
    shift = 40

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, begins, below = state.value
        keys = (where["length"] << shift) | where["rank"]
        for batch in batches:
            length = batch.column("length").to_numpy().astype(np.int64)
            r = batch.column("rank_").to_numpy() + below[begins[length] + batch.column("salt").to_numpy()]
            at = np.searchsorted(keys, (length << shift) | r, side="right") - 1
            copy, place = np.divmod(r - where["rank"][at], where["each"][at])
            cols = [batch.column(i) for i in range(3)] + [pa.array(length), batch.column(4)]
            cols += [pa.array(where["base"][at] + copy), pa.array(where["offset"][at] + place * length)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "salt", "rank_").mapInArrow(run, schema)
