"""Resumable stages: a graph of tables, each published whole or not at all.

A stage's output lies in a folder named by a fingerprint of its parameters and of its
inputs' fingerprints (for source files: paths, sizes and times of change), so it is found
again as long as nothing before it has changed, and made anew if anything has.  It is
written beside its place and renamed into it with its manifest, so a run that is killed
leaves finished stages whole and nothing else that counts.

A stage that fails is tried again for one instrument after the other: those that work are
published, the others become rows of the manifest, and later stages go on without them.
The next run tries the failed ones again.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "stage string, pair string, status string, rows long, fingerprint string, error string"


@dataclass(frozen=True)
class Stage:
    """``make`` turns the inputs' tables (by name) into this stage's.  With ``across`` it
    needs all instruments to make one.  ``version`` changes with the code."""

    name: str
    inputs: tuple[str, ...]
    make: Callable[..., DataFrame]
    params: dict = field(default_factory=dict)
    across: bool = False
    version: int = 1


class Files:
    """What the runner needs of a file system that Spark can reach."""

    def __init__(self, spark: SparkSession):
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.conf), p

    def exists(self, path: str) -> bool:
        fs, p = self.at(path)
        return fs.exists(p)

    def publish(self, made: str, path: str) -> None:
        fs, p = self.at(made)
        to = self.jvm.org.apache.hadoop.fs.Path(path)
        fs.mkdirs(to.getParent())
        if not fs.rename(p, to) and not fs.exists(to):
            raise OSError(f"cannot rename {made} to {path}")

    def delete(self, path: str) -> None:
        fs, p = self.at(path)
        fs.delete(p, True)

    def state(self, files: list[str]) -> list[tuple]:
        out = []
        for f in sorted(files):
            fs, p = self.at(f)
            s = fs.getFileStatus(p)
            out.append((f, s.getLen(), s.getModificationTime()))
        return out


def fingerprint(*parts) -> str:
    return hashlib.sha256(json.dumps(parts, sort_keys=True, default=str).encode()).hexdigest()[:20]


def in_order(stages: list[Stage], given: set[str]) -> list[Stage]:
    """Stages after what they need."""
    left, known, out = list(stages), set(given), []
    while left:
        ready = [s for s in left if set(s.inputs) <= known]
        if not ready:
            raise ValueError(f"stages that wait for each other or for what is not there: {', '.join(s.name for s in left)}")
        out += ready
        known |= {s.name for s in ready}
        left = [s for s in left if s.name not in known]
    return out


def run(
    spark: SparkSession, stages: list[Stage], sources: dict[str, DataFrame], folder: str, pair: str = "pair", force: bool = False
) -> tuple[dict[str, DataFrame], DataFrame]:
    """The stages' tables and the manifest: a row per stage and instrument with status
    DONE, PRESENT (made by an earlier run) or ERROR."""
    files, rows = Files(spark), []
    tables = dict(sources)
    prints = {n: fingerprint(files.state(df.inputFiles()), df.schema.json()) for n, df in sources.items()}
    for s in in_order(stages, set(sources)):
        prints[s.name] = fingerprint(s.name, s.version, s.params, [prints[i] for i in s.inputs])
        place = f"{folder}/{s.name}/{prints[s.name]}"
        there = files.exists(f"{place}/manifest")
        known = [r.asDict() for r in spark.read.schema(MANIFEST).json(f"{place}/manifest").collect()] if there else []
        again = force or not there or any(r["status"] == "ERROR" for r in known)
        if again:
            known = _make(spark, files, s, tables, place, prints[s.name], pair)
        rows += [r | {"status": "PRESENT" if r["status"] == "DONE" and not again else r["status"]} for r in known]
        tables[s.name] = spark.read.parquet(f"{place}/data")
    return tables, spark.createDataFrame([tuple(r[c.split()[0]] for c in MANIFEST.split(", ")) for r in rows], MANIFEST)


def _make(spark, files: Files, s: Stage, tables: dict, place: str, mark: str, pair: str) -> list[dict]:
    made = f"{place}.{uuid.uuid4().hex}"
    failed = []
    try:
        s.make(*[tables[i] for i in s.inputs], **s.params).write.parquet(f"{made}/data")
    except Exception as whole:
        files.delete(made)
        pairs = sorted({r[0] for i in s.inputs for r in tables[i].select(pair).distinct().collect()}, key=str)  # instruments: few
        parts = []
        for one in pairs:
            mine = F.col(pair).eqNullSafe(F.lit(one))
            given = [tables[i] if s.across else tables[i].filter(mine) for i in s.inputs]
            try:
                part = s.make(*given, **s.params).filter(mine)
                part.write.parquet(path := f"{made}/parts/{len(parts)}")
                parts.append(path)
            except Exception as e:
                failed.append((one, str(e).strip().splitlines()[0][:300] if str(e).strip() else type(e).__name__))
        if not parts:
            files.delete(made)
            raise RuntimeError(f"stage {s.name} failed for every instrument") from whole
        spark.read.parquet(*parts).write.parquet(f"{made}/data")
        files.delete(f"{made}/parts")
    counted = spark.read.parquet(f"{made}/data").groupBy(pair).agg(F.count(F.lit(1)).alias("n")).collect()
    rows = [{"stage": s.name, "pair": r[pair], "status": "DONE", "rows": r["n"], "fingerprint": mark, "error": None} for r in counted]
    rows += [{"stage": s.name, "pair": p, "status": "ERROR", "rows": 0, "fingerprint": mark, "error": e} for p, e in failed]
    rows.sort(key=lambda r: str(r["pair"]))
    shape = [tuple(r[c.split()[0]] for c in MANIFEST.split(", ")) for r in rows]
    spark.createDataFrame(shape, MANIFEST).coalesce(1).write.json(f"{made}/manifest")
    if files.exists(place):  # failed in part, or not published whole
        files.delete(place)
    files.publish(made, place)
    return rows


def preparation(least_per_day: int, train_end: str, val_end: str, purge: int, band: float, horizon: int, ts: str = "ts") -> list[Stage]:
    """Bars to splits: clean, features, labels, splits."""
    from tidemark.functions import scalars as S
    from tidemark.functions import windows as W
    from tidemark.operators import clean, features, splits

    keys = ["pair"]
    w = lambda: W.series(order=ts)

    def labelled(df: DataFrame, horizon: int, band: float) -> DataFrame:
        df = df.withColumn("future", W.forward_return("close", horizon, w()))
        return df.withColumn("label", S.three_way(F.col("future"), band))

    return [
        Stage("clean", ("bars",), lambda bars, least: clean.clean(bars, least, keys, ts, [ts]), {"least": least_per_day}),
        Stage("features", ("clean",), lambda bars: features.price_features(features.time_features(bars, ts), w())),
        Stage("labels", ("features",), labelled, {"horizon": horizon, "band": band}),
        Stage(
            "splits", ("labels",), lambda df, train_end, val_end, purge: splits.fixed_split(df, train_end, val_end, purge, keys, ts),
            {"train_end": train_end, "val_end": val_end, "purge": purge},
        ),
    ]
