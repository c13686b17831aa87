"""Scalar rules: sessions, labels, scores."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.config import DEFAULT_PIP, DEFAULT_SPREAD, SESSION_HOURS, SPREAD_PIPS, pip_size

# Model shortcodes.
CODE_TYPES = {"lr": "LR", "lstm": "LSTM"}
CODE_SESSIONS = {"gl": "global", "ldn": "london", "ny": "ny", "as": "asia"}


def session_label(hour: Column) -> Column:
    """Session name by UTC hour."""
    return (
        F.when(hour < 7, "Asia").when(hour < 13, "London").when(hour < 17, "Overlap").otherwise("New_York")
    )


def in_session(hour: Column, name: str) -> Column:
    if name not in SESSION_HOURS:
        raise ValueError(f"unknown session: {name}")
    lo, hi = SESSION_HOURS[name]
    return (hour >= lo) & (hour < hi) if lo < hi else (hour >= lo) | (hour < hi)


def _by_pair(pair: Column, values: dict[str, float], other: float) -> Column:
    known = F.create_map(*[F.lit(x) for kv in values.items() for x in kv])
    return F.coalesce(F.try_element_at(known, pair), F.lit(other))


def pip(pair: Column) -> Column:
    """Price units of a pip."""
    return _by_pair(pair, {p: pip_size(p) for p in SPREAD_PIPS}, DEFAULT_PIP)


def typical_spread(pair: Column) -> Column:
    """An instrument's usual spread in pips."""
    return _by_pair(pair, SPREAD_PIPS, DEFAULT_SPREAD)


def three_way(x: Column, band: float) -> Column:
    """1 above the band, -1 below it, 0 within, null for null."""
    return F.when(x > band, 1).when(x < -band, -1).when(x.isNotNull(), 0).cast("tinyint")


def clamp01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def composite_score(n_trades: Column, sharpe: Column, sortino: Column, calmar: Column, max_dd: Column) -> Column:
    """0 to 100; 0 with fewer than ten trades or a drawdown beyond 95 %."""
    total = (
        35 * clamp01(sharpe / 5) + 25 * clamp01(sortino / 5) + 25 * clamp01(calmar / 3)
        + 15 * F.greatest(F.lit(0.0), 1 + max_dd)
    )
    return F.when((n_trades < 10) | (max_dd < -0.95), F.lit(0.0)).otherwise(F.round(total, 2))


def grade(score: Column) -> Column:
    return F.when(score >= 80, "A").when(score >= 60, "B").when(score >= 40, "C").when(score >= 20, "D").otherwise("F")


def model_code(code: Column, pairs: tuple[str, ...] = tuple(SPREAD_PIPS)) -> Column:
    """'eurusd-lr-gl' -> (pair, type, session); null parts where unknown, nothing known
    of a code that has not three parts."""
    part = F.split(F.lower(code), "-")
    maps = [F.create_map(*[F.lit(x) for kv in m.items() for x in kv]) for m in ({p.lower(): p for p in pairs}, CODE_TYPES, CODE_SESSIONS)]
    names = [
        F.when(F.size(part) == 3, F.try_element_at(m, F.coalesce(F.get(part, F.lit(k)), F.lit("")))) for k, m in enumerate(maps)
    ]
    return F.struct(*[c.alias(n) for c, n in zip(names, ("pair", "type", "session"), strict=True)])


def log_gamma(x: Column) -> Column:
    """ln Gamma for x >= 1/2: Stirling's series after a shift by six."""
    z = x + 6
    shift = F.log(x * (x + 1) * (x + 2) * (x + 3) * (x + 4) * (x + 5))
    series = 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * z * z * z * z * z)
    return (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + series - shift


def t_two_sided(t: Column, df: Column, steps: int = 300) -> Column:
    """P(|T| >= |t|) of Student's t with at least one degree; 1 where there is no t.

    With t = sqrt(df) tan(a) the density is cos(a)^(df - 1), integrated by Simpson's rule
    from 0; angles past twelve widths of it add nothing."""
    v = df.cast("double")
    angle = F.least(F.atan(F.abs(t) / F.sqrt(v)), 12 / F.sqrt(v))
    h = angle / steps
    weight = lambda k: F.when((k == 0) | (k == steps), 1.0).when(k % 2 == 1, 4.0).otherwise(2.0)
    term = lambda k: weight(k) * F.pow(F.cos(k * h), v - 1)
    area = F.aggregate(F.sequence(F.lit(0), F.lit(steps)), F.lit(0.0), lambda acc, k: acc + term(k)) * h / 3
    density = F.exp(log_gamma((v + 1) / 2) - log_gamma(v / 2)) / math.sqrt(math.pi)
    p = F.greatest(F.lit(0.0), 1 - 2 * density * area)
    return F.when(t.isNull() | F.isnan(t), F.lit(1.0)).otherwise(p)
