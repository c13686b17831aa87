"""Fixed splits, walk-forward folds and purging.

Splits are filters and a column over one table, not copies of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import SESSION_SETS
from tidemark.schema import TableMismatch


def purge_tail(df: DataFrame, n: int, keys: list[str], ts: str) -> DataFrame:
    """Without each group's last ``n`` rows; groups of at most ``n`` rows stay whole."""
    w = Window.partitionBy(*keys)
    from_end = F.row_number().over(w.orderBy(F.desc(ts)))
    df = df.withColumns({"end_": from_end, "all_": F.count(F.lit(1)).over(w)})
    return df.filter((F.col("end_") > n) | (F.col("all_") <= n)).drop("end_", "all_")


def split_of(ts: str, train_end: str, val_end: str) -> Column:
    """train up to and with train_end, then val up to and with val_end, then test."""
    end = lambda d: F.lit(d).cast("timestamp_ntz")
    return F.when(F.col(ts) <= end(train_end), "train").when(F.col(ts) <= end(val_end), "val").otherwise("test")


def fixed_split(df: DataFrame, train_end: str, val_end: str, purge: int, keys: list[str], ts: str) -> DataFrame:
    """Adds ``split``; the tails of train and val are purged, test is whole."""
    df = df.withColumn("split", split_of(ts, train_end, val_end))
    w = Window.partitionBy(*keys, "split")
    from_end = F.row_number().over(w.orderBy(F.desc(ts)))
    df = df.withColumns({"end_": from_end, "all_": F.count(F.lit(1)).over(w)})
    keep = (F.col("split") == "test") | (F.col("end_") > purge) | (F.col("all_") <= purge)
    return df.filter(keep).drop("end_", "all_")


def folds(df: DataFrame, bounds: list[tuple[str, str, str]], purge: int, keys: list[str], ts: str) -> DataFrame:
    """Expanding folds: ``bounds`` holds (train end, validation start, validation end)
    per fold.  Each row appears once per fold and kind it belongs to; train tails are
    purged, validation is not."""
    at = lambda text: F.lit(text).cast("timestamp_ntz")
    x = F.col(ts)
    kinds = [F.when(x <= at(te), "train").when(x.between(at(vs), at(ve)), "val") for te, vs, ve in bounds]
    of = F.array(*[F.struct(F.lit(k).alias("fold"), kind.alias("kind")) for k, kind in enumerate(kinds)])
    df = df.select("*", F.inline(F.filter(of, lambda f: f["kind"].isNotNull())))
    w = Window.partitionBy(*keys, "fold", "kind")
    from_end = F.row_number().over(w.orderBy(F.desc(ts)))
    df = df.withColumns({"end_": from_end, "all_": F.count(F.lit(1)).over(w)})
    keep = (F.col("kind") == "val") | (F.col("end_") > purge) | (F.col("all_") <= purge)
    return df.filter(keep).drop("end_", "all_")


def year_bounds(first_year: int, n: int) -> list[tuple[str, str, str]]:
    end = "{}-12-31 23:59:59"
    return [(end.format(first_year + k), f"{first_year + k + 1}-01-01", end.format(first_year + k + 1)) for k in range(n)]


def date_window(df: DataFrame, ts: str, start: str | None, end: str | None, end_of_day: bool = True) -> DataFrame:
    """Both ends inclusive; a date alone as the end means its last second."""
    if start:
        df = df.filter(F.col(ts) >= F.lit(start).cast("timestamp_ntz"))
    if end:
        if end_of_day and len(end) == 10:
            end += " 23:59:59"
        df = df.filter(F.col(ts) <= F.lit(end).cast("timestamp_ntz"))
    return df


def require_splits(df: DataFrame, names: tuple[str, ...] = ("train", "val", "test")) -> DataFrame:
    have = {r["split"] for r in df.select("split").distinct().collect()}
    if set(names) - have:
        raise TableMismatch(f"empty split: {', '.join(sorted(set(names) - have))}")
    return df


def session_training(df: DataFrame, session: str = "session") -> dict[str, DataFrame]:
    """Training rows of each session set; ``global`` is all of them.  They share the
    scaler of the whole training split."""
    return {"global": df} | {name: df.filter(F.col(session).isin(labels)) for name, labels in SESSION_SETS.items()}


def islands(df: DataFrame, keys: list[str], ts: str, step: str = "1 hour", name: str = "island") -> DataFrame:
    """Adds ``name``: the number (from 1) of the run of rows that a row belongs to; a run
    ends where the next row is more than ``step`` later, as rows between were removed or
    never there."""
    w = Window.partitionBy(*keys).orderBy(ts)
    gap = F.coalesce(F.col(ts) > F.lag(ts).over(w) + F.expr(f"INTERVAL {step}"), F.lit(True))
    return df.withColumn("gap_", gap).withColumn(name, F.count_if("gap_").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("gap_")


def manifest(df: DataFrame, keys: list[str], ts: str, purge: int, bounds: dict[str, str], label: str | None = None) -> DataFrame:
    """One row per instrument over a table with a ``split`` column: rows in all and per
    split, first and last time per split, the bounds configured and, with ``label``, the
    share of each class per split in percent."""
    wanted = [F.count(F.lit(1)).alias("total_rows")]
    for name in ("train", "val", "test"):
        mine = F.col("split") == name
        wanted += [F.count_if(mine).alias(f"{name}_rows"), F.min(F.when(mine, F.col(ts))).alias(f"{name}_start"), F.max(F.when(mine, F.col(ts))).alias(f"{name}_end")]
        if label:
            share = lambda v, mine=mine: F.avg(F.when(mine & F.col(label).isNotNull(), (F.col(label) == v).cast("double"))) * 100
            wanted += [share(v).alias(f"{name}_{n}_pct") for v, n in ((1, "long"), (0, "flat"), (-1, "short"))]
    configured = {f"configured_{k}": F.lit(v) for k, v in bounds.items()}
    return df.groupBy(*keys).agg(*wanted).withColumns(configured | {"purge_rows": F.lit(purge)})


def scaler(df: DataFrame, features: list[str], keys: list[str]) -> DataFrame:
    """One row per group and feature, in order: mean and population deviation with
    nulls as 0; a feature without variance has scale 1."""
    long = df.select(*keys, F.posexplode(F.array(*[F.coalesce(F.col(f), F.lit(0)).cast("double") for f in features])).alias("pos", "x"))
    sd = F.stddev_pop("x")
    flat = F.max("x") == F.min("x")
    out = long.groupBy(*keys, "pos").agg(F.avg("x").alias("mean"), F.when(flat, F.lit(1.0)).otherwise(sd).alias("scale"))
    return out.withColumn("feature", F.get(F.array(*map(F.lit, features)), F.col("pos")))
