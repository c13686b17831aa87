"""Bars in zip archives, one per instrument and year, as a Spark data source.

``<folder>/<instrument>_<year>.zip`` holds one csv member of
``yyyyMMdd HHmmss;open;high;low;close;volume`` rows.  Reading takes one task per archive
and holds a block of it; filters on instrument and year leave the other archives unread.
Writing is published when all tasks are done, so a lost task leaves nothing behind.
"""

from __future__ import annotations

import csv
import io
import re
import time
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import pyarrow as pa
from pyarrow import csv as arrow_csv
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, WriterCommitMessage

from tidemark.schema import RAW_BARS

FORMAT = "bar_archives"
COLUMNS = [f.name for f in RAW_BARS]
_NAME = re.compile(r"([^/_]+)_(\d{4})\.zip")
_TYPES = {c: pa.string() if c == "stamp" else pa.float64() for c in COLUMNS}
_BLOCK = 4 << 20


def _at(path: str) -> tuple[arrow_fs.FileSystem, str]:
    return arrow_fs.FileSystem.from_uri(path) if "://" in path else (arrow_fs.LocalFileSystem(), path)


def retried(work, tries: int, pause: float):
    """``work()``, again after ``pause`` seconds and twice as long each time where it fails
    with an OSError; a missing file is not tried again."""
    for k in range(tries):
        try:
            return work()
        except FileNotFoundError:
            raise
        except OSError:
            if k + 1 == tries:
                raise
            time.sleep(pause * 2**k)


@dataclass
class Archive(InputPartition):
    path: str
    pair: str
    year: int


@dataclass
class Made(WriterCommitMessage):
    names: list[str]


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.folder = options["path"]
        self.tries, self.pause = int(options.get("tries", 3)), float(options.get("pause", 1.0))
        self.skip_damaged = options.get("damaged", "fail") == "skip"
        self.wanted: dict[str, list[set]] = {"pair": [], "year": []}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo | In) and f.attribute in (("pair",), ("year",)):
                self.wanted[f.attribute[0]].append(set(f.value) if isinstance(f, In) else {f.value})
            else:
                yield f

    def partitions(self) -> list[Archive]:
        fs, root = _at(self.folder)
        found = []
        for info in fs.get_file_info(arrow_fs.FileSelector(root)):
            m = _NAME.fullmatch(info.base_name)
            if m and all(m[1] in s for s in self.wanted["pair"]) and all(int(m[2]) in s for s in self.wanted["year"]):
                found.append(Archive(info.path, m[1], int(m[2])))
        return sorted(found, key=lambda a: (a.pair, a.year))

    def read(self, partition: Archive) -> Iterator[pa.RecordBatch]:
        if not isinstance(partition, Archive):  # no archives at all
            return
        fs, _ = _at(self.folder)
        try:
            archive = retried(lambda: zipfile.ZipFile(fs.open_input_file(partition.path)), self.tries, self.pause)
        except (zipfile.BadZipFile, pa.ArrowInvalid) as e:  # the latter where a file is shorter than any archive
            if self.skip_damaged:
                return
            raise zipfile.BadZipFile(f"not a zip archive: {partition.path}") from e
        with archive:
            inner = next((i for i in archive.infolist() if i.filename.lower().endswith((".csv", ".txt"))), None)
            if inner is None or not inner.file_size:
                return
            with archive.open(inner) as member:
                blocks = arrow_csv.open_csv(
                    member,
                    arrow_csv.ReadOptions(column_names=COLUMNS, block_size=_BLOCK),
                    arrow_csv.ParseOptions(delimiter=";"),
                    arrow_csv.ConvertOptions(column_types=_TYPES),
                )
                for b in blocks:
                    of = [pa.array([partition.pair] * len(b), pa.string()), pa.array([partition.year] * len(b), pa.int32())]
                    yield pa.RecordBatch.from_arrays([*b.columns, *of], names=[*COLUMNS, "pair", "year"])


class ArchiveWriter(DataSourceWriter):
    def __init__(self, options: dict[str, str], overwrite: bool) -> None:
        self.folder, self.overwrite = options["path"], overwrite
        self.skip = options.get("present", "error") == "skip"
        self.job = f".job-{uuid.uuid4().hex}"

    def write(self, rows: Iterator) -> Made:
        fs, root = _at(self.folder)
        fs.create_dir(f"{root}/{self.job}", recursive=True)
        made = []
        for (pair, year), group in groupby(rows, key=lambda r: (r["pair"], r["year"])):
            name = f"{pair}_{year:04d}.zip"
            if not _NAME.fullmatch(name):
                raise ValueError(f"not a name of an archive: {name}")
            if not self.overwrite and fs.get_file_info(f"{root}/{name}").type != arrow_fs.FileType.NotFound:
                if not self.skip:
                    raise FileExistsError(f"{self.folder}/{name}")
                for _ in group:
                    pass
                continue
            made.append(f"{uuid.uuid4().hex}/{name}")
            fs.create_dir(f"{root}/{self.job}/{made[-1].split('/')[0]}", recursive=True)
            with fs.open_output_stream(f"{root}/{self.job}/{made[-1]}") as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
                with z.open(f"{pair}_{year:04d}.csv", "w", force_zip64=True) as member, io.TextIOWrapper(member, "utf-8", newline="") as text:
                    csv.writer(text, delimiter=";", lineterminator="\n").writerows([r[c] for c in COLUMNS] for r in group)
        return Made(made)

    def commit(self, messages: list[Made | None]) -> None:
        fs, root = _at(self.folder)
        made = [n for m in messages if m for n in m.names]
        names = [n.split("/")[1] for n in made]
        if len(set(names)) < len(names):
            self.abort(messages)
            raise ValueError("rows of one instrument and year must lie together: write them by write_archives")
        for n in made:
            fs.move(f"{root}/{self.job}/{n}", f"{root}/{n.split('/')[1]}")
        self.abort(messages)

    def abort(self, messages: list[Made | None]) -> None:
        """Deletes what was not published."""
        fs, root = _at(self.folder)
        if fs.get_file_info(f"{root}/{self.job}").type != arrow_fs.FileType.NotFound:
            fs.delete_dir(f"{root}/{self.job}")


class BarArchives(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in RAW_BARS)}, pair string, year int"

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options)

    def writer(self, schema, overwrite: bool) -> ArchiveWriter:
        return ArchiveWriter(self.options, overwrite)


def read_archives(spark: SparkSession, path: str, **options: object) -> DataFrame:
    """Raw rows with ``pair`` and ``year``; ``canonical`` takes them.  Options: ``tries``
    and ``pause`` of opening an archive, ``damaged``: fail or skip."""
    spark.dataSource.register(BarArchives)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format(FORMAT).options(**options).load(path)


def write_archives(raw: DataFrame, path: str, mode: str = "append", present: str = "error") -> None:
    """Raw rows with ``pair`` and ``year`` as archives, in the order of their stamps.

    One task writes an archive (a year of an instrument).  ``present`` says what becomes of
    archives that are there: error, or skip; mode ``overwrite`` replaces those that are
    written anew."""
    spark = raw.sparkSession
    spark.dataSource.register(BarArchives)
    rows = raw.select(*COLUMNS, F.col("pair").cast("string").alias("pair"), F.col("year").cast("int").alias("year"))
    rows = rows.repartition("pair", "year").sortWithinPartitions("pair", "year", "stamp")
    rows.write.format(FORMAT).mode(mode).option("present", present).save(path)
