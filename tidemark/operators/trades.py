"""The trade machine on long series: first hits within a chunk, jumps between chunks.

A trade's exit hangs on its entry alone: it is the first later bar at which the price has
gone far enough either way, the holding time is over or the position is opposite.  Within
a chunk the exits of all possible entries are found at once, by binary descent in a table
of block extremes; exit to next entry is then a jump pointer, and doubling the pointers
leads from every entry to the trade that is open at the chunk's end and to what is gained
on the way.

A trade that comes in from an earlier chunk can end only at a new highest or lowest price
of the chunk, at its first long or short position, or when its holding time is over, so a
chunk's summary holds where these few bars lead, and nothing of the others.  Walking
through the summaries (``folds.starts``) gives the trade and the cash with which each
chunk begins; the chunks then write their trades or curves in parallel.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidemark.operators import folds
from tidemark.schema import TRADES

#: Order in which the conditions are tested at a bar.
REASONS = ("TP", "SL", "MAX_HOLD", "SIGNAL_FLIP")


@dataclass(frozen=True)
class Rules:
    """Distances in price units; 0 or None is off."""

    spread: float = 0.0
    take: float | None = None
    stop: float | None = None
    max_hold: int | None = None

    def net(self, side, entry, price):
        """Return of a trade with the spread charged at its exit; 0 on an entry at 0."""
        entry = np.asarray(entry, dtype=float)
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(entry != 0, side * (price - entry) / entry - self.spread / entry, 0.0)

    def distances(self, side: int) -> tuple[float, float]:
        """How far up and down the price must go (inf: any distance will do)."""
        take, stop = self.take or np.inf, self.stop or np.inf
        return (take, stop) if side > 0 else (stop, take)


class Extremes:
    """Highest and lowest price of every block of 2**k bars."""

    def __init__(self, price: np.ndarray):
        self.high, self.low = [price], [price]
        while 2 << (len(self.high) - 1) <= len(price):
            h, l, w = self.high[-1], self.low[-1], 1 << (len(self.high) - 1)
            self.high.append(np.maximum(h[:-w], h[w:]))
            self.low.append(np.minimum(l[:-w], l[w:]))

    def first(self, begin: np.ndarray, entry: np.ndarray, far: np.ndarray, up: bool) -> np.ndarray:
        """First bar from ``begin`` on whose price is at least ``far`` above (or below)
        ``entry``; the number of bars if there is none."""
        levels, n = (self.high if up else self.low), len(self.high[0])
        if not np.isfinite(far).any():
            return np.full(len(begin), n)
        at = begin.copy()
        for k in range(len(levels) - 1, -1, -1):
            fits = at + (1 << k) <= n
            best = levels[k][np.where(fits, at, 0)]
            none = (best - entry < far) if up else (best - entry > -far)
            at = np.where(fits & none, at + (1 << k), at)
        return at


def next_true(flags: np.ndarray) -> np.ndarray:
    """For every bar, and the one after the last, the next bar at which it holds (the
    number of bars: none)."""
    n = len(flags)
    at = np.where(flags, np.arange(n), n)
    return np.concatenate([np.minimum.accumulate(at[::-1])[::-1], [n]]) if n else np.array([0])


class Chunk:
    """Exits and jumps of every possible entry of a chunk's bars."""

    def __init__(self, price: np.ndarray, position: np.ndarray, rules: Rules):
        n = self.n = len(price)
        self.price, self.position, self.rules = price, position, rules
        self.enter = next_true(position != 0)
        to_long, to_short = next_true(position > 0), next_true(position < 0)
        at = np.flatnonzero(position)
        side, entry = position[at], price[at]
        long, short = rules.distances(1), rules.distances(-1)
        extremes, long_side = Extremes(price), side > 0
        up = extremes.first(at + 1, entry, np.where(long_side, long[0], short[0]), True)
        down = extremes.first(at + 1, entry, np.where(long_side, long[1], short[1]), False)
        take, stop = np.where(long_side, up, down), np.where(long_side, down, up)
        hold = np.minimum(at + rules.max_hold, n) if rules.max_hold else np.full(len(at), n)
        flip = np.where(long_side, to_short[at + 1], to_long[at + 1])
        self.exit, self.reason = np.full(n, n), np.zeros(n, dtype=np.int8)
        ways = np.stack([take, stop, hold, flip])
        self.exit[at], self.reason[at] = ways.min(axis=0), ways.argmin(axis=0)
        self.first_long, self.first_short = int(to_long[0]), int(to_short[0])

    def led(self) -> tuple[np.ndarray, np.ndarray]:
        """For every bar at which one is flat (and n): the entry open at the end (n:
        none), and the factor by which cash has grown until then."""
        n = self.n
        inside = np.flatnonzero((self.position != 0) & (self.exit < n))
        jump, gain = np.arange(n + 1), np.ones(n + 1)
        jump[inside] = self.enter[self.exit[inside]]
        gain[inside] = 1 + self.rules.net(self.position[inside], self.price[inside], self.price[self.exit[inside]])
        while (jump != jump[jump]).any():
            gain, jump = gain * gain[jump], jump[jump]
        return jump[self.enter], gain[self.enter]

    def trades(self, bar: int) -> list[tuple[int, int, str]]:
        """(entry, exit, reason) of the trades from being flat at ``bar`` on; the one that
        stays open has exit n."""
        out, j = [], int(self.enter[bar])
        while j < self.n:
            i = int(self.exit[j])
            out.append((j, i, REASONS[self.reason[j]] if i < self.n else ""))
            if i == self.n:
                break
            j = int(self.enter[i])
        return out


@dataclass(frozen=True)
class Summary:
    """Of a chunk under one set of rules.  ``at`` are the bars at which a trade from
    before may end, ``to`` and ``gain`` where each leads; ``flat`` is where being flat at
    the start leads, ``flat_first`` the same for the first bar of a series, at which
    nothing opens."""

    n: int
    rules: Rules
    records: tuple  # bars and prices of new highs, the same of new lows
    firsts: tuple[int, int]
    at: np.ndarray
    price: np.ndarray
    to: np.ndarray
    gain: np.ndarray
    side: np.ndarray
    entry: np.ndarray
    flat: tuple
    flat_first: tuple


def records(price: np.ndarray) -> tuple:
    up = np.flatnonzero(np.concatenate([[True], price[1:] > np.maximum.accumulate(price)[:-1]]))
    down = np.flatnonzero(np.concatenate([[True], price[1:] < np.minimum.accumulate(price)[:-1]]))
    return up, price[up], down, price[down]


def summarised(price: np.ndarray, position: np.ndarray, rules: Rules) -> Summary:
    chunk = Chunk(price, position, rules)
    to, gain = chunk.led()
    n, found = chunk.n, records(price)
    hold = np.arange(min(n, (rules.max_hold or 0) + 1))
    at = np.unique(np.concatenate([found[0], found[2], hold, [k for k in (chunk.first_long, chunk.first_short) if k < n]]).astype(int))
    ends = to[at]
    open_ = np.where(ends < n, ends, 0)

    def leads(bar: int) -> tuple:
        e = int(to[bar])
        return (e, float(gain[bar]), int(position[e]) if e < n else 0, float(price[e]) if e < n else 0.0)

    side, entry = np.where(ends < n, position[open_], 0), np.where(ends < n, price[open_], 0.0)
    return Summary(n, rules, found, (chunk.first_long, chunk.first_short), at, price[at], ends, gain[at], side, entry, leads(0), leads(min(1, n)))


@dataclass(frozen=True)
class Open:
    """State under one set of rules: the open trade (side 0: none), where it began in the
    series, and cash."""

    side: int
    entry: float
    at: int
    cash: float


def exit_of(trade: Open, begin: int, n: int, rules: Rules, found: tuple, firsts: tuple[int, int]) -> tuple[int, str]:
    """Bar of the chunk (which begins at ``begin``) at which a trade from before ends, and
    why; n: it doesn't."""
    far_up, far_down = rules.distances(trade.side)
    up_at, up, down_at, down = found
    reach_up, reach_down = up - trade.entry >= far_up, down - trade.entry <= -far_down
    high = int(up_at[reach_up.argmax()]) if reach_up.any() else n
    low = int(down_at[reach_down.argmax()]) if reach_down.any() else n
    take, stop = (high, low) if trade.side > 0 else (low, high)
    hold = max(trade.at + rules.max_hold - begin, 0) if rules.max_hold else n
    flip = firsts[1] if trade.side > 0 else firsts[0]
    ways = [take, stop, min(hold, n), min(flip, n)]
    best = min(ways)
    return best, REASONS[ways.index(best)]


def advanced(trade: Open, begin: int, s: Summary) -> Open:
    if not trade.side:
        to, gain, side, entry = s.flat if begin else s.flat_first
        return Open(side, entry, begin + to if side else 0, trade.cash * gain)
    bar, _ = exit_of(trade, begin, s.n, s.rules, s.records, s.firsts)
    if bar == s.n:
        return trade
    k = int(np.searchsorted(s.at, bar))
    cash = trade.cash * (1 + float(s.rules.net(trade.side, trade.entry, s.price[k]))) * float(s.gain[k])
    side = int(s.side[k])
    return Open(side, float(s.entry[k]), begin + int(s.to[k]) if side else 0, cash)


@dataclass(frozen=True)
class Machine:
    """All ``variants`` (dicts of spread, take, stop, max_hold in price units, or names of
    columns that hold them, constant within a series) over one signal."""

    variants: tuple
    price: str
    position: str
    capital: float

    def rules(self, pdf: pd.DataFrame) -> list[Rules]:
        value = lambda x: float(pdf[x].iloc[0]) if isinstance(x, str) else x
        return [Rules(**{k: value(v) for k, v in kw.items()}) for kw in self.variants]

    def series(self, pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        return pdf[self.price].to_numpy(dtype=float), pdf[self.position].to_numpy(dtype=int)

    def fold(self) -> folds.Fold:
        def summarise(pdf: pd.DataFrame) -> tuple:
            price, position = self.series(pdf)
            return len(price), float(price[-1]), [summarised(price, position, r) for r in self.rules(pdf)]

        def advance(state: tuple, summary: tuple) -> tuple:
            begin, _, trades = state
            n, last, sums = summary
            return begin + n, last, [advanced(t, begin, s) for t, s in zip(trades, sums, strict=True)]

        return folds.Fold((0, 0.0, [Open(0, 0.0, 0, self.capital)] * len(self.variants)), summarise, advance)

    def closed(self, pdf: pd.DataFrame, state: tuple, v: int) -> tuple[list[tuple], Open | None, int]:
        """Of variant v: (side, entry, entry bar in the series, exit bar in the chunk, net,
        reason) of the trades that end by a rule, and the trade that is open at the end."""
        begin, _, opens = state
        price, position = self.series(pdf)
        rules, trade = self.rules(pdf)[v], opens[v]
        chunk, out, bar = Chunk(price, position, rules), [], 0 if begin else min(1, len(price))
        if trade.side:
            bar, why = exit_of(trade, begin, chunk.n, rules, records(price), (chunk.first_long, chunk.first_short))
            if bar == chunk.n:
                return out, trade, chunk.n
            out.append((trade.side, trade.entry, trade.at, bar, float(rules.net(trade.side, trade.entry, price[bar])), why))
        left = None
        for j, i, why in chunk.trades(bar):
            side, entry = int(position[j]), float(price[j])
            if i == chunk.n:
                left = Open(side, entry, begin + j, 0.0)
            else:
                out.append((side, entry, begin + j, i, float(rules.net(side, entry, price[i])), why))
        return out, left, chunk.n


def run_trades(
    df: DataFrame,
    keys: list[str],
    ts: str | list[str],
    variants: list[dict],
    price: str = "close",
    position: str = "position",
    capital: float = 10_000.0,
    seconds: float = folds.CHUNK_SECONDS,
) -> DataFrame:
    """Trade log of every series and variant; bars count from the series' start.

    On each bar but the first an open trade is tested for target, stop, holding time and
    opposite position, in that order, at the bar's price; then, if flat and the position
    is not 0, a trade opens at the same price.  The spread is charged once, at the exit.
    A trade still open at the end closes on the last bar.  A trade entered at price 0 has
    no return: its gains are null and the cash stays."""
    machine = Machine(tuple(variants), price, position, capital)
    order = [ts] if isinstance(ts, str) else list(ts)
    schema = T.StructType([*(df.schema[k] for k in keys), T.StructField("variant", T.IntegerType()), *T.StructType.fromDDL(TRADES)])
    need = dict.fromkeys([*keys, *order, price, position, *(x for v in variants for x in v.values() if isinstance(x, str))])

    def replay(pdf: pd.DataFrame, state: tuple, last: bool) -> pd.DataFrame:
        begin, _, opens = state
        prices, rules = machine.series(pdf)[0], machine.rules(pdf)
        key, rows = tuple(pdf[k].iloc[0] for k in keys), []
        for v in range(len(variants)):
            closed, left, n = machine.closed(pdf, state, v)
            if left is not None and last:
                net = float(rules[v].net(left.side, left.entry, prices[-1]))
                closed.append((left.side, left.entry, left.at, n - 1, net, "END_OF_DATA"))
            cash = opens[v].cash
            for side, entry, at, i, net, why in closed:
                gained = cash * net
                cash += gained
                pnl = (round(net * 100, 6), round(gained, 4)) if entry else (None, None)
                rows.append((*key, v, at, begin + i, begin + i - at, side, round(entry, 6), round(float(prices[i]), 6), *pnl, why))
        return pd.DataFrame(rows, columns=schema.names)

    return folds.scan(df.select(*need), keys, order, machine.fold(), replay, schema, seconds)


def run_curves(
    df: DataFrame,
    keys: list[str],
    ts: str | list[str],
    kw: dict,
    price: str = "close",
    position: str = "position",
    seconds: float = folds.CHUNK_SECONDS,
) -> DataFrame:
    """Rows with realised equity (parts of the capital; a trade open at the end does not
    show) and the return of each bar."""
    capital = kw.get("capital", 10_000.0)
    machine = Machine(({k: v for k, v in kw.items() if k != "capital"},), price, position, capital)
    base = capital or 1.0

    def replay(pdf: pd.DataFrame, state: tuple) -> dict:
        begin, before, (trade,) = state
        prices = machine.series(pdf)[0]
        closed, left, n = machine.closed(pdf, state, 0)
        cash = trade.cash
        equity, held, returns = np.full(n, cash / base), np.zeros(n), np.zeros(n)
        if left is not None:
            held[max(left.at - begin + 1, 0) :] = left.side
        for side, _, at, i, _, _ in closed:
            held[max(at - begin + 1, 0) : i] = side
        prior = np.concatenate([[before], prices[:-1]])
        some = (held != 0) & (prior != 0)
        returns[some] = held[some] * (prices[some] - prior[some]) / prior[some]
        for _, _, _, i, net, _ in closed:
            cash += cash * net
            equity[i:], returns[i] = cash / base, net
        if not begin:
            equity[0] = 1.0
        return {"equity": equity, "bar_return": returns}

    added = {"equity": T.DoubleType(), "bar_return": T.DoubleType()}
    return folds.with_columns(df, keys, ts, machine.fold(), replay, added, seconds)
