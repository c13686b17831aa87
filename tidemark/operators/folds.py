"""Scans over long series: recursive averages, greedy cooldowns, any fold with a state.

A series is cut into chunks of time, and no step holds more than a chunk of it:

1. every chunk is summarised on its own: what it does to any state it might begin with;
2. the summaries of a series (a row per chunk) are walked through in order, one row at a
   time, which gives the state at the start of every chunk;
3. every chunk is run again from the state it begins with.

Steps 1 and 3 are one task per chunk, so a single instrument uses the whole cluster; they
read the same exchange.  A chunk is a span of the clock, so it needs no row numbers and is
the same in every step and every retry.  Results don't depend on the length of the chunks,
but for rounding of averages (an affine map is applied instead of its steps; where the
values are all equal to the state it is exact).
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Seconds of a chunk: thirty days of minutes are 43 200 rows.
CHUNK_SECONDS = 30 * 86_400


def clock(df: DataFrame, order: str) -> Column:
    """Microseconds (of numbers: millionths) from a fixed origin, in no time zone."""
    kind = df.schema[order].dataType
    if isinstance(kind, T.TimestampNTZType):
        return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', `{order}`)")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(order)
    if isinstance(kind, T.DateType):
        return F.unix_date(order) * F.lit(86_400_000_000)
    return F.col(order) * F.lit(1_000_000)


def with_chunk(df: DataFrame, order: str | list[str], seconds: float = CHUNK_SECONDS) -> DataFrame:
    """Adds ``chunk_``, the number of the row's span of time."""
    first = order if isinstance(order, str) else order[0]
    return df.withColumn("chunk_", F.floor(clock(df, first) / F.lit(round(seconds * 1_000_000))).cast("long"))


def sorted_rows(pdf: pd.DataFrame, order: str | list[str]) -> pd.DataFrame:
    return pdf.sort_values(order, kind="stable").reset_index(drop=True)


@dataclass(frozen=True)
class Fold:
    """``summarise`` a chunk's rows, ``advance`` a state by a summary, from ``start``."""

    start: Any
    summarise: Callable[[pd.DataFrame], Any]
    advance: Callable[[Any, Any], Any]


def starts(summaries: DataFrame, keys: list[str], start: Any, advance: Callable) -> DataFrame:
    """keys, chunk_, state_ (with which the chunk begins) and last_ (no chunk follows),
    from summaries of all chunks.  Holds a batch of summaries at a time."""
    fields = [summaries.schema[k] for k in (*keys, "chunk_")]
    schema = T.StructType([*fields, T.StructField("state_", T.BinaryType()), T.StructField("last_", T.BooleanType())])
    names = schema.names

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, state = None, start
        for pdf in batches:
            out = []
            for row in pdf[[*keys, "chunk_", "summary_"]].itertuples(index=False, name=None):
                key = tuple(None if pd.isna(v) else v for v in row[: len(keys)])
                if held is not None:
                    same = held[0] == key
                    out.append((*held[1], not same))
                    state = state if same else start
                held = key, (*row[:-1], pickle.dumps(state))
                state = advance(state, pickle.loads(row[-1]))
            yield pd.DataFrame(out, columns=names)
        if held is not None:
            yield pd.DataFrame([(*held[1], True)], columns=names)

    return summaries.repartition(*keys).sortWithinPartitions(*keys, "chunk_").mapInPandas(walk, schema)


def scan(
    df: DataFrame,
    keys: list[str],
    order: str | list[str],
    fold: Fold,
    replay: Callable[[pd.DataFrame, Any, bool], pd.DataFrame],
    schema: T.StructType,
    seconds: float = CHUNK_SECONDS,
) -> DataFrame:
    """Rows of ``replay`` (a chunk's rows in order, the state it begins with, whether it
    is its series' last)."""
    by = [*keys, "chunk_"]
    at = with_chunk(df, order, seconds)
    fields = T.StructType([*(at.schema[k] for k in by), T.StructField("summary_", T.BinaryType())])

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = sorted_rows(pdf, order)
        return pdf[by].head(1).assign(summary_=[pickle.dumps(fold.summarise(pdf))])

    def run(pdf: pd.DataFrame, begins: pd.DataFrame) -> pd.DataFrame:
        pdf = sorted_rows(pdf, order).drop(columns="chunk_")
        return replay(pdf, pickle.loads(begins["state_"].iloc[0]), bool(begins["last_"].iloc[0]))

    begins = starts(at.groupBy(*by).applyInPandas(one, fields), keys, fold.start, fold.advance)
    return at.groupBy(*by).cogroup(begins.groupBy(*by)).applyInPandas(run, schema)


def with_columns(
    df: DataFrame, keys: list[str], order: str | list[str], fold: Fold, replay: Callable, added: dict[str, T.DataType], seconds: float
) -> DataFrame:
    """``df`` with the columns that ``replay`` gives for a chunk's rows and state."""
    schema = T.StructType([*df.schema.fields, *(T.StructField(n, t) for n, t in added.items())])
    return scan(df, keys, order, fold, lambda pdf, state, last: pdf.assign(**replay(pdf, state)), schema, seconds)


def together(folds_: list[tuple[Fold, Callable, dict[str, T.DataType]]]) -> tuple[Fold, Callable, dict[str, T.DataType]]:
    """Several folds over the same rows as one: a single pair of passes for all."""
    each = [f for f, _, _ in folds_]
    fold = Fold(
        [f.start for f in each],
        lambda p: [f.summarise(p) for f in each],
        lambda states, sums: [f.advance(s, x) for f, s, x in zip(each, states, sums, strict=True)],
    )
    replay = lambda p, states: {k: v for (_, r, _), s in zip(folds_, states, strict=True) for k, v in r(p, s).items()}
    return fold, replay, {k: v for _, _, a in folds_ for k, v in a.items()}


# -- recursive averages ---------------------------------------------------------------

#: State of an average: its value (NaN: none yet) and the rows without a value since.
EMPTY = (np.nan, 0)


def _averaged(x: np.ndarray, alpha: float) -> np.ndarray:
    """e0 = x0, then e = (b * e + a * x) / (b + a) with b = (1 - a) ** (rows since the
    last value)."""
    return pd.Series(x, dtype=float).ewm(alpha=alpha, adjust=False).mean().to_numpy()


def ewm_step(state: tuple, x: float, alpha: float) -> tuple:
    value, gap = state
    if np.isnan(x):
        return value, gap + 1
    if np.isnan(value) or value == x:
        return x, 0
    old = (1 - alpha) ** (gap + 1)
    return (old * value + alpha * x) / (old + alpha), 0


def ewm_summary(x: np.ndarray, alpha: float) -> tuple:
    """What a chunk does: rows, rows before its first value, that value, the map (factor,
    offset) of all after it, rows after its last value, and its least and largest."""
    at = np.flatnonzero(~np.isnan(x))
    if not len(at):
        return len(x), 0, np.nan, 1.0, 0.0, 0, np.nan, np.nan
    old = (1 - alpha) ** np.diff(at).astype(float)
    zeroed = np.where(np.arange(len(x)) == at[0], 0.0, x)
    return (
        len(x), int(at[0]), float(x[at[0]]), float(np.prod(old / (old + alpha))), float(_averaged(zeroed, alpha)[at[-1]]),
        int(len(x) - 1 - at[-1]), float(x[at].min()), float(x[at].max()),
    )


def ewm_advance(state: tuple, summary: tuple, alpha: float) -> tuple:
    n, lead, first, factor, offset, trail, low, high = summary
    if np.isnan(first):
        return state[0], state[1] + n
    value, _ = ewm_step((state[0], state[1] + lead), first, alpha)
    # an average stays between what it averages
    return min(max(factor * value + offset, min(value, low)), max(value, high)), trail


def ewm_replay(x: np.ndarray, state: tuple, alpha: float) -> np.ndarray:
    value, gap = state
    if np.isnan(value):
        return _averaged(x, alpha)
    return _averaged(np.concatenate([[value], np.full(gap, np.nan), x]), alpha)[1 + gap :]


def span(n: int) -> float:
    return 2 / (n + 1)


def averages_fold(averages: dict[str, tuple[str, float]]) -> tuple[Fold, Callable, dict[str, T.DataType]]:
    plan = list(averages.items())
    values = lambda p, c: p[c].to_numpy(dtype=float)
    fold = Fold(
        [EMPTY] * len(plan),
        lambda p: [ewm_summary(values(p, c), a) for _, (c, a) in plan],
        lambda states, sums: [ewm_advance(s, x, a) for s, x, (_, (_, a)) in zip(states, sums, plan, strict=True)],
    )
    replay = lambda p, states: {n: ewm_replay(values(p, c), s, a) for (n, (c, a)), s in zip(plan, states, strict=True)}
    return fold, replay, {n: T.DoubleType() for n, _ in plan}


def ewm(
    df: DataFrame, averages: dict[str, tuple[str, float]], keys: list[str], order: str | list[str], seconds: float = CHUNK_SECONDS
) -> DataFrame:
    """Adds recursive averages, each of a column with a weight ``alpha`` of the newest
    value; all share the passes."""
    return with_columns(df, keys, order, *averages_fold(averages), seconds)


def _moves(close: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    change = np.diff(close)
    return np.maximum(change, 0), np.maximum(-change, 0)


def rsi_fold(n: int, close: str, name: str) -> tuple[Fold, Callable, dict[str, T.DataType]]:
    """Relative strength index on Wilder averages; null where there were no losses.  The
    state is the last close and both averages."""
    alpha = 1 / n

    def summarise(p: pd.DataFrame) -> tuple:
        c = p[close].to_numpy(dtype=float)
        return c[0], c[-1], [ewm_summary(x, alpha) for x in _moves(c)]

    def advance(state: tuple, summary: tuple) -> tuple:
        before, averages = state
        first, last, sums = summary
        steps = [x[0] for x in _moves(np.array([before, first]))]
        return last, [ewm_advance(ewm_step(s, x, alpha), r, alpha) for s, x, r in zip(averages, steps, sums, strict=True)]

    def replay(p: pd.DataFrame, state: tuple) -> dict:
        before, averages = state
        moves = _moves(np.concatenate([[before], p[close].to_numpy(dtype=float)]))
        gain, loss = (ewm_replay(x, s, alpha) for x, s in zip(moves, averages, strict=True))
        with np.errstate(divide="ignore", invalid="ignore"):
            return {name: np.where(loss != 0, 100 - 100 / (1 + gain / loss), np.nan)}

    return Fold((np.nan, [EMPTY, EMPTY]), summarise, advance), replay, {name: T.DoubleType()}


def rsi(
    df: DataFrame, n: int, keys: list[str], order: str | list[str], close: str = "close", name: str = "rsi", seconds: float = CHUNK_SECONDS
) -> DataFrame:
    """Adds the relative strength index."""
    return with_columns(df, keys, order, *rsi_fold(n, close, name), seconds)


# -- cooldown -------------------------------------------------------------------------


def cooldown(signal: np.ndarray, bars: int, free: int = 0) -> np.ndarray:
    """Keeps a signal, silences the next ``bars`` rows, and so on; the first ``free`` rows
    are silent already."""
    out = np.zeros(len(signal), dtype=np.int8)
    for i in np.flatnonzero(signal):
        if i >= free:
            out[i] = signal[i]
            free = i + bars + 1
    return out


def silence_after(signal: np.ndarray, bars: int) -> np.ndarray:
    """For every number of rows, 0 to ``bars``, that a chunk may have to be silent at its
    start: how many the next one has.

    The next kept signal is a jump pointer of each signal; doubling the pointers leads
    every signal to the last one kept if it is kept itself."""
    n, at = len(signal), np.flatnonzero(signal)
    begin = np.arange(bars + 1)
    if not len(at):
        return np.maximum(begin - n, 0)
    to = np.searchsorted(at, at + bars + 1)
    last = np.where(to < len(at), to, np.arange(len(at)))
    while (last != last[last]).any():
        last = last[last]
    rest = np.maximum(at[last] + bars + 1 - n, 0)
    first = np.searchsorted(at, begin)
    return np.where(first < len(at), rest[np.minimum(first, len(at) - 1)], np.maximum(begin - n, 0))


def cooldown_fold(bars: int, signal: str, name: str) -> tuple[Fold, Callable, dict[str, T.DataType]]:
    fold = Fold(0, lambda p: silence_after(p[signal].to_numpy(), bars), lambda free, to: int(to[free]))
    return fold, lambda p, free: {name: cooldown(p[signal].to_numpy(), bars, free)}, {name: T.ByteType()}


def with_cooldown(
    df: DataFrame, bars: int, keys: list[str], order: str | list[str], signal: str = "signal", seconds: float = CHUNK_SECONDS
) -> DataFrame:
    """Adds ``cooled``; 0 bars leave the signal as it is."""
    return with_columns(df, keys, order, *cooldown_fold(bars, signal, "cooled"), seconds)
