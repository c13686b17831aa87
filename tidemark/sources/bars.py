"""Bar sources: raw CSV, zip archives, Parquet by instrument, ticks."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.schema import CANONICAL, RAW_BARS, TableMismatch, require_columns

LOCAL_ZONE = "America/New_York"


def read_raw_csv(spark: SparkSession, path: str) -> DataFrame:
    """``yyyyMMdd HHmmss;open;high;low;close;volume`` without a header; the file's
    name gives the instrument."""
    df = spark.read.schema(RAW_BARS).option("sep", ";").csv(path)
    return df.withColumn("pair", F.upper(F.regexp_extract(F.col("_metadata.file_name"), r"(?i)([a-z]{6})", 1)))


def read_zips(spark: SparkSession, path: str) -> DataFrame:
    """Raw rows of the first csv or txt member of each archive; archives that are
    not zip files or too small give no rows."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, content in zip(frame["path"], frame["content"], strict=True):
                if len(content) < 100 or not content.startswith(b"PK\x03\x04"):
                    continue
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    inner = next((n for n in z.namelist() if n.lower().endswith((".csv", ".txt"))), None)
                    if inner is None:
                        continue
                    with z.open(inner) as f:
                        rows = pd.read_csv(f, sep=";", header=None, names=[x.name for x in RAW_BARS], dtype={"stamp": str})
                yield rows.assign(archive=name)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "stamp string, open double, high double, low double, close double, volume double, archive string")


def to_utc(local: Column, zone: str = LOCAL_ZONE) -> Column:
    """UTC of a zone's local time (both as timestamps in a UTC session); null where
    the local time does not exist or exists twice."""
    u = F.to_utc_timestamp(local, zone)
    shown = F.from_utc_timestamp(u, zone)
    hour = F.expr("INTERVAL 1 HOUR")
    twice = (F.from_utc_timestamp(u + hour, zone) == local) | (F.from_utc_timestamp(u - hour, zone) == local)
    return F.when((shown == local) & ~twice, u)


def canonical(raw: DataFrame, zone: str = LOCAL_ZONE) -> DataFrame:
    """The eleven canonical columns; rows whose time cannot be read or placed go, and
    of equal times per instrument one row stays."""
    local = F.try_to_timestamp(F.col("stamp"), F.lit("yyyyMMdd HHmmss"))
    df = raw.withColumn("local_", local).filter("local_ is not null").withColumn("timestamp_utc", to_utc(F.col("local_"), zone))
    df = df.filter("timestamp_utc is not null").withColumns(
        {
            "timestamp_est": F.col("local_").cast("timestamp_ntz"),
            "volume": F.coalesce(F.col("volume"), F.lit(0)).cast("long"),
            "year": F.year("timestamp_utc"),
            "month": F.month("timestamp_utc"),
            "session": S.session_label(F.hour("timestamp_utc")),
        }
    )
    from tidemark.operators.clean import OHLC, dedupe_first

    return dedupe_first(df, ["pair", "timestamp_utc"], [*OHLC, "volume"]).select(*CANONICAL)


def read_bars(spark: SparkSession, path: str, pairs: list[str] | None = None, columns: list[str] | None = None) -> DataFrame:
    """Canonical (or later) bars, partitioned by instrument."""
    df = require_columns(spark.read.parquet(path), columns or CANONICAL, path)
    return df.filter(F.col("pair").isin([p.upper() for p in pairs])) if pairs else df


def discover(spark: SparkSession, path: str, pairs: list[str] | None = None) -> DataFrame:
    """(pair, tag, file) of ``<PAIR>_<TAG>`` Parquet files below ``path``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true")
    name = F.regexp_extract("path", r"([^/]+)\.parquet$", 1)
    found = files.load(path).select(
        F.upper(F.regexp_extract(name, r"^([A-Za-z]{6})_", 1)).alias("pair"),
        F.regexp_extract(name, r"^[A-Za-z]{6}_(.+)$", 1).alias("tag"),
        F.col("path").alias("file"),
    ).filter("pair != ''")
    return found.filter(F.col("pair").isin(pairs)) if pairs else found


class Catalog:
    """Splits and folds as lazy views over one table; a name that is not there fails
    before any work starts."""

    def __init__(self) -> None:
        self.views: dict[str, DataFrame] = {}

    def add(self, name: str, df: DataFrame) -> None:
        self.views[name] = df

    def resolve(self, name: str) -> DataFrame:
        if name not in self.views:
            raise ValueError(f"unknown split: {name}; known: {', '.join(sorted(self.views))}")
        return self.views[name]

    def require(self, names: list[str]) -> None:
        missing = [n for n in names if n not in self.views]
        if missing:
            raise TableMismatch(f"missing splits: {', '.join(missing)}")


def resample(ticks: DataFrame, every: str, keys: list[str], ts: str = "ts", price: str | None = None) -> DataFrame:
    """Tumbling OHLCV bars, empty ones left out.  With ``price`` the input is ticks
    and the volume their number; otherwise open, high, low, close and volume are
    aggregated.  min_by and max_by combine partially: no sort, one small shuffle."""
    o, h, lo, c = (price or x for x in ("open", "high", "low", "close"))
    volume = F.count(F.lit(1)) if price else F.sum("volume")
    bars = ticks.groupBy(*keys, F.window(ts, every).alias("w_")).agg(
        F.min_by(o, ts).alias("open"),
        F.max(h).alias("high"),
        F.min(lo).alias("low"),
        F.max_by(c, ts).alias("close"),
        volume.alias("volume"),
    )
    return bars.select(*keys, F.col("w_.start").alias("ts"), "open", "high", "low", "close", "volume")
