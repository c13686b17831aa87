"""Rule-based signal strategies.

A strategy turns bars into signals in {-1, 0, 1}: events, not positions.  Windowed
rules stay in Catalyst; recursive averages and the cooldown are scans over chunks of time
(``tidemark.operators.folds``).  A rule says what averages it needs and how its signal
follows from them, so that any number of strategies share the scans, the windows' sort and
the cooldowns (``signals_of``).  Indicators begin with the rows given, so a split is cut
first.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidemark.functions import windows as W
from tidemark.operators import folds


@dataclass(frozen=True)
class Rule:
    """``averages`` of close and the ``strength`` period are scanned first; ``line`` is
    (name, column over them, name of its average, alpha), scanned next.  ``flags`` are
    columns over rows and windows, ``cross`` is (up, down) over the flags."""

    flags: Callable[[DataFrame, WindowSpec], dict[str, Column]]
    cross: Callable[[Callable[[str], Column], WindowSpec], tuple[Column, Column]]
    warmup: int
    averages: dict[str, float] = field(default_factory=dict)
    strength: int | None = None
    line: tuple[str, Callable[[], Column], str, float] | None = None


@dataclass(frozen=True)
class Strategy:
    """``rule`` or, for models, ``signal`` (which adds column ``signal`` to bars) gives the
    signal before cooldown; ``family`` is what selection keeps diverse: trend, momentum,
    mean_reversion or breakout."""

    family: str
    warmup: int
    cooldown: int
    params: dict = field(hash=False)
    signal: Callable[[DataFrame, list[str], str], DataFrame] | None = field(repr=False, compare=False, default=None)
    rule: Rule | None = field(repr=False, compare=False, default=None)

    def generate(self, bars: DataFrame, keys: list[str], order: str | list[str] = "ts") -> DataFrame:
        return signals_of(bars, {"signal": self}, keys, order)


def signals_of(bars: DataFrame, named: dict[str, Strategy], keys: list[str], order: str | list[str] = "ts") -> DataFrame:
    """``bars`` with a column of signals per strategy."""
    w = Window.partitionBy(*keys).orderBy(order)
    rules = {n: s.rule for n, s in named.items() if s.rule}
    out = bars.drop(*named)
    averages = {f"{n}_": ("close", a) for r in rules.values() for n, a in r.averages.items()}
    first = [folds.averages_fold(averages)] if averages else []
    first += [folds.rsi_fold(n, "close", f"rsi_{n}_") for n in sorted({r.strength for r in rules.values() if r.strength})]
    if first:
        out = folds.with_columns(out, keys, order, *folds.together(first), folds.CHUNK_SECONDS)
    lines = {r.line[0]: r.line for r in rules.values() if r.line}
    if lines:
        out = out.withColumns({n: c() for n, c, _, _ in lines.values()})
        out = folds.ewm(out, {to: (n, a) for n, _, to, a in (r.line for r in rules.values() if r.line)}, keys, order)
    flags, raw = {}, {}
    for k, (n, r) in enumerate(rules.items()):
        flags |= {f"{f}_{k}_": c for f, c in r.flags(bars, w).items()}
        up, down = r.cross(lambda f, k=k: F.col(f"{f}_{k}_"), w)
        raw[n] = _finish(up, down, r.warmup, w)
    out = out.withColumns(flags).withColumns(raw)
    for n, s in named.items():
        if not s.rule:
            plain = s.signal(out.drop("signal") if n != "signal" else out, keys, order)
            out = plain if n == "signal" else plain.withColumnRenamed("signal", n)
    cooled = {n: s.cooldown for n, s in named.items() if s.cooldown}
    if cooled:
        out = out.select(*[c for c in bars.columns if c not in named], *named)
        parts = [folds.cooldown_fold(bars_, n, f"cooled_{k}_") for k, (n, bars_) in enumerate(cooled.items())]
        out = folds.with_columns(out, keys, order, *folds.together(parts), folds.CHUNK_SECONDS)
        out = out.drop(*cooled).withColumnsRenamed({f"cooled_{k}_": n for k, n in enumerate(cooled)})
    model = [c for c in out.columns if c not in bars.columns and not c.endswith("_") and c not in named]  # what models add
    return out.select(*[c for c in bars.columns if c not in named], *model, *named)


def _finish(up: Column, down: Column, warmup: int, w: WindowSpec) -> Column:
    raw = F.when(up, 1).when(down, -1).otherwise(0)
    return F.when(F.row_number().over(w) > warmup, raw).otherwise(0).cast("tinyint")


def _cross(above: Column, w: WindowSpec) -> tuple[Column, Column]:
    """+1 where ``above`` begins, -1 where it ends; before the series: ended for the
    rise, begun for the fall."""
    return above & ~F.lag(above, 1, False).over(w), ~above & F.lag(above, 1, True).over(w)


def _sure(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def _begins(c: Callable[[str], Column], w: WindowSpec) -> tuple[Column, Column]:
    return W.crossing_up(c("over"), w), W.crossing_up(c("under"), w)


def ma_crossover(fast: int, slow: int, kind: str = "ema", cooldown: int = 0) -> Strategy:
    if not 0 < fast < slow:
        raise ValueError("fast must be below slow")
    if kind not in ("ema", "sma"):
        raise ValueError("kind is ema or sma")
    c = F.col

    def flags(bars: DataFrame, w: WindowSpec) -> dict[str, Column]:
        if kind == "ema":
            return {"above": _sure(c(f"ema_{fast}_") > c(f"ema_{slow}_"))}
        return {"above": _sure(W.rolling_mean(c("close"), fast, w) > W.rolling_mean(c("close"), slow, w))}

    averages = {f"ema_{n}": folds.span(n) for n in (fast, slow)} if kind == "ema" else {}
    rule = Rule(flags, lambda f, w: _cross(f("above"), w), slow - 1, averages)
    return Strategy("trend", slow, cooldown, {"fast": fast, "slow": slow, "kind": kind}, rule=rule)


def momentum(lookback: int, cooldown: int = 0) -> Strategy:
    if lookback < 2:
        raise ValueError("lookback must be at least 2")

    def flags(bars: DataFrame, w: WindowSpec) -> dict[str, Column]:
        x = F.col("close")
        return {"over": _sure(x > W.channel_high(x, lookback, w)), "under": _sure(x < W.channel_low(x, lookback, w))}

    rule = Rule(flags, lambda f, w: (f("over"), f("under")), lookback)
    return Strategy("momentum", lookback, cooldown, {"lookback": lookback}, rule=rule)


def donchian(period: int, cooldown: int = 0) -> Strategy:
    if period < 2:
        raise ValueError("period must be at least 2")

    def flags(bars: DataFrame, w: WindowSpec) -> dict[str, Column]:
        x = F.col("close")
        top, bottom = (F.col(c) if c in bars.columns else x for c in ("high", "low"))
        return {"over": _sure(x > W.channel_high(top, period, w)), "under": _sure(x < W.channel_low(bottom, period, w))}

    return Strategy("breakout", period, cooldown, {"period": period}, rule=Rule(flags, _begins, period))


def rsi_reversion(period: int = 14, low: float = 30, high: float = 70, cooldown: int = 0) -> Strategy:
    if period < 2 or not 0 < low < high < 100:
        raise ValueError("need period >= 2 and 0 < low < high < 100")

    def cross(f: Callable[[str], Column], w: WindowSpec) -> tuple[Column, Column]:
        before = F.lag(f("strength"), 1).over(w)
        return (before <= low) & (f("strength") > low), (before >= high) & (f("strength") < high)

    rule = Rule(lambda bars, w: {"strength": F.coalesce(F.col(f"rsi_{period}_"), F.lit(50.0))}, cross, period, strength=period)
    return Strategy("mean_reversion", period, cooldown, {"period": period, "low": low, "high": high}, rule=rule)


def bollinger(period: int = 20, width: float = 2.0, cooldown: int = 0) -> Strategy:
    if period < 2 or width <= 0:
        raise ValueError("need period >= 2 and width > 0")

    def flags(bars: DataFrame, w: WindowSpec) -> dict[str, Column]:
        x = F.col("close")
        mean, sd = W.rolling_mean(x, period, w), W.rolling_std(x, period, w)
        return {"over": _sure(x > mean + width * sd), "under": _sure(x < mean - width * sd)}

    return Strategy("mean_reversion", period, cooldown, {"period": period, "width": width}, rule=Rule(flags, _begins, period))


def macd_cross(fast: int = 26, slow: int = 65, smooth: int = 9, cooldown: int = 0) -> Strategy:
    if not 0 < fast < slow or smooth < 1:
        raise ValueError("need fast < slow and smooth >= 1")
    warmup = slow + smooth - 1
    line, average = f"line_{fast}_{slow}_", f"line_{fast}_{slow}_{smooth}_"
    rule = Rule(
        lambda bars, w: {"above": _sure(F.col(line) > F.col(average))},
        lambda f, w: _cross(f("above"), w),
        warmup,
        {f"ema_{n}": folds.span(n) for n in (fast, slow)},
        line=(line, lambda: F.col(f"ema_{fast}_") - F.col(f"ema_{slow}_"), average, folds.span(smooth)),
    )
    return Strategy("trend", warmup, cooldown, {"fast": fast, "slow": slow, "smooth": smooth}, rule=rule)


def silent() -> Strategy:
    """Never signals; stands in for a model that is not there."""
    return Strategy("none", 0, 0, {}, lambda bars, keys, order: bars.withColumn("signal", F.lit(0).cast("tinyint")))


# The registered instances (name: parameters, cooldown in bars).
REGISTRY: dict[str, Strategy] = {
    "MACrossover_f20_s50_EMA": ma_crossover(20, 50, "ema", 60),
    "MACrossover_f50_s200_EMA": ma_crossover(50, 200, "ema", 30),
    "MACrossover_f20_s50_SMA": ma_crossover(20, 50, "sma", 60),
    "Momentum_lb60": momentum(60, 60),
    "Momentum_lb120": momentum(120, 30),
    "Donchian_p20": donchian(20, 60),
    "Donchian_p55": donchian(55, 30),
    "RSI_p14_os30_ob70": rsi_reversion(14, 30, 70, 60),
    "RSI_p14_os20_ob80": rsi_reversion(14, 20, 80, 30),
    "BB_p20_std2_0": bollinger(20, 2.0, 60),
    "BB_p60_std2_0": bollinger(60, 2.0, 30),
    "MACD_f26_s65_sig9": macd_cross(26, 65, 9, 60),
    "MACD_f78_s195_sig13": macd_cross(78, 195, 13, 30),
}


#: Prefixes of model strategies; what follows names the training session.
MODEL_PREFIXES = ("LR_", "LSTM_")


def get_strategy(name: str, models: dict[str, Strategy] | None = None, or_silent: bool = False) -> Strategy:
    """A rule by its registered name, or a model (``LR_<session>``, ``LSTM_<session>``)
    among ``models``; one that is not there is refused or, if asked for, silent."""
    if name in REGISTRY:
        return REGISTRY[name]
    if name.startswith(MODEL_PREFIXES):
        if models and name in models:
            return models[name]
        if or_silent:
            return silent()
        raise ValueError(f"model not available: {name}; available: {', '.join(models or ()) or 'none'}")
    raise ValueError(f"unknown strategy: {name}; known: {', '.join(REGISTRY)}")
