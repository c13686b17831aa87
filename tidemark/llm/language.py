"""Language identification by cross-parsing entropy.

For each language a suffix automaton is built over a bounded sample of labelled
text.  A document is parsed greedily into the longest matches that each automaton
allows; phrases times log2(sample length), per symbol, estimates the cross-entropy,
and the language with the lowest estimate wins (ties: first by name).

Symbols are lower-case letters; any run of other characters is one space.  All
documents of a batch advance through all automata together, one array step per
symbol.  Long texts are parsed in segments of ``SEGMENT`` symbols side by side; a
segment is parsed anew from the state in which the one before it ended until no such
state changes, which is the parse of the whole text.

An automaton has a row of ``DENSE`` transitions per state for the most frequent
symbols of its language; the others, as in scripts of many thousand signs, are kept
as sorted (state, symbol) pairs.

Only the sample texts are broadcast; each worker builds its automata from them once.

Defined results for odd input
    null text, no letter   ``und`` with score 0
    nothing to learn from  every document is ``und``
    long training texts    enter the sample whole; a language always has one
    null or repeated identifiers   take part in learning, told apart by their text
    repeated rows          one result row each
    empty table            an empty result with the full schema
    extra columns          ignored
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import bounded_batches, give_back, id_bucket

HELD_OUT = (4, 2)
SEGMENT = 512
DENSE = 64
SHARPNESS = 6.0
UNKNOWN_LANGUAGE = "und"
#: Bits per symbol beyond which a text is taken for none of the learned languages.
FOREIGN_BITS = 9.0
_NO_LETTER, _STRANGE = 0, 1


def learn(
    docs: DataFrame,
    sample_symbols: int = 40_000,
    docs_per_language: int = 200,
    all_symbols: int = 2_000_000,
    max_languages: int = 10_000,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
) -> dict[str, str]:
    """A sample of training texts per language: the ``docs_per_language`` smallest by a
    hash of identifier and text, and in its order they enter whole until
    ``sample_symbols`` characters are reached (the last text may pass that).  A language
    with any text has one in the sample.

    What workers hold is bounded by ``all_symbols``: where there are more languages than
    that allows, each has an equal share of it, and texts of over twice a share stay out
    unless a language has no shorter one.  Of over ``max_languages`` values of
    ``lang_col`` the most frequent are learned."""
    h = F.xxhash64(F.col(id_col), F.col(text_col))
    open_ = docs.select(
        F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"), h.alias("h")
    )
    letters = F.regexp_like("text", F.lit(r"\p{L}"))
    open_ = open_.filter("lang is not null").filter((id_bucket("doc_id", HELD_OUT[0]) != HELD_OUT[1]) & letters)
    # equal rows are one: no language's sample is taken up by copies
    of = open_.groupBy("lang", "h", F.xxhash64("text", F.lit(1)).alias("of")).agg(F.max(F.length("text")).alias("size"))
    counts = of.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(max_languages).collect()
    if not counts:
        return {}
    session, room = docs.sparkSession, max(1, min(sample_symbols, all_symbols // len(counts)))
    most = max(4, min(docs_per_language, 200_000 // len(counts)))
    langs = F.broadcast(session.createDataFrame([(r["lang"],) for r in counts], "lang string"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "of"))
    seen: dict[str, list[tuple]] = {}
    for r in of.join(langs, "lang").withColumn("rank", rank).filter(F.col("rank") <= most).drop("rank").collect():
        seen.setdefault(r["lang"], []).append((r["h"], r["of"], r["size"]))
    chosen = []
    for lang, rows in seen.items():
        left = room
        for row in sorted(x for x in rows if x[2] <= 2 * room) or [min(rows, key=lambda x: (x[2], x))]:
            if left > 0:
                chosen.append((lang, *row[:2]))
                left -= row[2] + 1
    wanted = F.broadcast(session.createDataFrame(sorted(chosen), "lang string, h long, of long"))
    texts = open_.withColumn("of", F.xxhash64("text", F.lit(1))).join(wanted, ["lang", "h", "of"]).select("lang", "h", "text")
    sample: dict[str, list[str]] = {}
    for r in sorted(texts.distinct().collect()):
        sample.setdefault(r["lang"], []).append(r["text"])
    return {lang: " ".join(parts) for lang, parts in sample.items() if any(c.isalpha() for t in parts for c in t)}


def suffix_automaton(symbols: list[int]) -> tuple[list[dict[int, int]], list[int]]:
    """Transitions of the automaton of all substrings; state 0 is the root."""
    nxt, link, length, last = [{}], [-1], [0], 0
    for c in symbols:
        cur = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                twin = len(nxt)
                nxt.append(dict(nxt[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = twin
                    p = link[p]
                link[q] = link[cur] = twin
        last = cur
    return nxt, length


class Parser:
    """Cross-parses texts against all languages at once."""

    def __init__(self, sample: dict[str, str], dense: int = DENSE) -> None:
        self.langs = sorted(sample)
        letters = sorted({c for t in sample.values() for c in t.lower() if c.isalpha()})
        # symbols: 0 space, 1 letter not in any sample, 2.. letters, last: padding
        self.code = np.full(0x110000, _NO_LETTER, dtype=np.int32)
        for lo in range(0, 0x110000, 0x10000):
            block = [c for c in range(lo, lo + 0x10000) if chr(c).isalpha()]
            self.code[block] = _STRANGE
        for k, c in enumerate(letters):
            self.code[ord(c)] = k + 2
        self.symbols_known = len(letters) + 3
        self.pad = self.symbols_known - 1
        # columns of a state's row: frequent symbols, then these three
        self.alien, self.rare, stay, self.width = dense, dense + 1, dense + 2, dense + 3
        self.column = np.full((len(self.langs), self.symbols_known), self.alien, dtype=np.int16)
        self.column[:, self.pad] = stay
        tables, roots, self.bits, keys, targets, base = [], [], [], [], [], 0
        for k, lang in enumerate(self.langs):
            seq = self.symbols([sample[lang]])[0]
            nxt, _ = suffix_automaton(seq.tolist())
            own, times = np.unique(seq, return_counts=True)
            order = own[np.lexsort((own, -times))].tolist()
            self.column[k, order[dense:]] = self.rare
            self.column[k, order[:dense]] = np.arange(len(order[:dense]))
            column, often = self.column[k].tolist(), set(order[:dense])
            alone = len(nxt)  # one more state: a phrase of one symbol that the sample lacks
            table = np.full((alone + 1, self.width), -1, dtype=np.int32)
            for s, row in enumerate(nxt):
                for c, to in row.items():
                    if c in often:
                        table[s, column[c]] = to
                    else:
                        keys.append((s + base) * self.width * self.symbols_known + c)
                        targets.append((to + base) * self.width)
            restart = table[0].copy()
            restart[restart < 0] = alone
            # a dead end holds ~(state after restarting the phrase with this symbol)
            table = np.where(table >= 0, (table + base) * self.width, ~((restart[None, :] + base) * self.width))
            table[:, stay] = (np.arange(alone + 1) + base) * self.width
            table[0, self.alien] = (alone + base) * self.width
            tables.append(table.astype(np.int32).ravel())
            roots.append(base * self.width)
            self.bits.append(math.log2(max(2, len(seq))))
            base += alone + 1
        self.table = np.concatenate(tables) if tables else np.zeros(0, dtype=np.int32)
        self.roots = np.array(roots, dtype=np.int32)
        keys, targets = np.array(keys, dtype=np.int64), np.array(targets, dtype=np.int32)
        order = np.argsort(keys)
        self.rare_keys, self.rare_targets = keys[order], targets[order]

    def symbols(self, texts: list[str]) -> list[np.ndarray]:
        lower = [t.lower() for t in texts]
        code = self.code[np.frombuffer("\n".join(lower).encode("utf-32-le", "replace"), dtype=np.uint32)]
        out, at = [], 0
        for t in lower:
            own = code[at : at + len(t)]
            at += len(t) + 1
            keep = np.ones(len(own), dtype=bool)
            keep[1:] = (own[1:] != _NO_LETTER) | (own[:-1] != _NO_LETTER)
            out.append(own[keep])
        return out

    def _rare_moves(self, state: np.ndarray, root: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """Moves by symbols that the rows do not hold, as entries of the table."""

        def find(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            key = s.astype(np.int64) * self.symbols_known + symbol
            at = np.minimum(np.searchsorted(self.rare_keys, key), len(self.rare_keys) - 1)
            return self.rare_keys[at] == key, self.rare_targets[at]

        known, to = find(state)
        return np.where(known, to, ~find(root)[1])

    def _advance(self, part: list[np.ndarray], state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Phrases ended in each segment and the states after it, from the states
        before it (languages by segments)."""
        order = np.argsort([-len(s) for s in part], kind="stable")
        lengths = np.array([len(part[j]) for j in order])
        longest = int(lengths[0])
        grid = np.full((longest, len(part)), self.pad, dtype=np.int32)
        for k, j in enumerate(order):
            grid[: len(part[j]), k] = part[j]
        state = state[:, order]
        count = np.zeros(state.shape, dtype=np.int32)
        live = np.searchsorted(-lengths, -np.arange(longest), side="left")
        for step in range(longest):
            n = live[step]
            now, column = state[:, :n], self.column.take(grid[step, :n], axis=1)
            got = self.table.take(now + column)
            if len(self.rare_keys):
                lang, at = np.nonzero(column == self.rare)
                if len(at):
                    got[lang, at] = self._rare_moves(now[lang, at], self.roots[lang], grid[step, at])
            dead = got >> 31
            count[:, :n] -= dead
            state[:, :n] = got ^ dead
        back = np.argsort(order)
        return count[:, back], state[:, back]

    def phrases(self, docs: list[np.ndarray], at_once: int = 4096) -> np.ndarray:
        """Phrases per document and language."""
        segments, owner = [], []
        for i, d in enumerate(docs):
            for at in range(0, len(d), SEGMENT):
                segments.append(d[at : at + SEGMENT])
                owner.append(i)
        total = np.zeros((len(docs), len(self.langs)), dtype=np.int64)
        if not segments:
            return total
        owner = np.array(owner)
        before = np.repeat(self.roots[:, None], len(segments), axis=1)
        count, after = np.zeros(before.shape, dtype=np.int64), before.copy()
        later = np.flatnonzero(owner[1:] == owner[:-1]) + 1
        todo = np.arange(len(segments))
        while len(todo):
            for lo in range(0, len(todo), at_once):
                some = todo[lo : lo + at_once]
                count[:, some], after[:, some] = self._advance([segments[k] for k in some], before[:, some])
            follows = after[:, later - 1]
            todo = later[(follows != before[:, later]).any(axis=0)]
            before[:, later] = follows
        last = np.flatnonzero(np.concatenate([owner[1:] != owner[:-1], [True]]))
        count[:, last] += after[:, last] != self.roots[:, None]
        np.add.at(total, owner, count.T)
        return total

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and bits per symbol of each text."""
        docs = self.symbols(texts)
        n = np.array([len(d) for d in docs], dtype=np.float64)
        letters = np.array([bool((d != _NO_LETTER).any()) for d in docs], dtype=bool)
        if not self.langs:
            return [UNKNOWN_LANGUAGE] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
        bits = self.phrases(docs) * np.array(self.bits) / np.maximum(n, 1)[:, None]
        best = bits.argmin(axis=1)
        low = bits[np.arange(len(texts)), best] if len(texts) else np.zeros(0)
        score = 1 / np.exp(-SHARPNESS * (bits - low[:, None])).sum(axis=1)
        lang = [self.langs[b] if ok else UNKNOWN_LANGUAGE for b, ok in zip(best, letters, strict=True)]
        return lang, np.where(letters, score, 0.0), np.where(letters, low, 0.0)


_parsers: dict[int, Parser] = {}


def shared_parser(sample: dict[str, str]) -> Parser:
    """One parser per Python worker and sample."""
    key = hash(tuple(sorted(sample.items())))
    if key not in _parsers:
        _parsers.clear()
        _parsers[key] = Parser(sample)
    return _parsers[key]


def identify(docs: DataFrame, sample: dict[str, str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score and bits (per symbol) of every whole text."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = shared_parser(shared.value)
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                part = b.slice(lo, 1000)
                lang, score, bits = parser.predict([t or "" for t in part.column(1).to_pylist()])
                cols = [part.column(0), pa.array(lang, pa.string()), pa.array(score), pa.array(bits)]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "lang_pred", "score", "bits"])
        give_back()

    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return given.mapInArrow(run, "doc_id long, lang_pred string, score double, bits double")


def kept(docs: DataFrame, sample: dict[str, str], text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` in one of the learned languages, all columns; those
    without letters or unlike all of them (over ``FOREIGN_BITS``) go."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(sample)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = shared_parser(shared.value)
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                part = b.slice(lo, 1000)
                lang, _, bits = parser.predict([t or "" for t in part.column(at).to_pylist()])
                yield part.filter(pa.array((np.array(lang) != UNKNOWN_LANGUAGE) & (bits <= FOREIGN_BITS)))
        give_back()

    return docs.mapInArrow(run, docs.schema)
