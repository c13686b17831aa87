"""Sinks: Parquet by instrument, CSV, reports."""

from __future__ import annotations

import html

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def write_bars(df: DataFrame, path: str, ts: str = "timestamp_utc", force: bool = False) -> None:
    """One folder per instrument, rows in time order within files.  Without ``force``
    an output that is there stays."""
    out = df.repartition("pair").sortWithinPartitions("pair", ts)
    out.write.mode("overwrite" if force else "ignore").partitionBy("pair").parquet(path)


def write_csv(df: DataFrame, path: str, force: bool = True) -> None:
    """A small table as one CSV file with a header."""
    df.coalesce(1).write.mode("overwrite" if force else "ignore").option("header", "true").csv(path)


def as_json(df: DataFrame) -> DataFrame:
    """One JSON text per row; NaN and infinities become null."""
    cols = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind in ("double", "float"):
            c = F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)
        cols.append(c.alias(name))
    return df.select(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).alias("json"))


def report_html(title: str, results: DataFrame, most: int = 1000) -> str:
    """A self-contained page of a small result table: its rows as a table and as JSON."""
    rows = results.limit(most)
    data = ",".join(r["json"] for r in as_json(rows).collect()).replace("</", "<\\/")
    head = "".join(f"<th>{html.escape(c)}</th>" for c in rows.columns)
    body = "".join("<tr>" + "".join(f"<td>{html.escape(str(v))}</td>" for v in r) + "</tr>" for r in rows.collect())
    return (
        f"<!doctype html><meta charset=utf-8><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1>"
        f"<table><tr>{head}</tr>{body}</table><script>const results = [{data}];</script>"
    )


def report_text(title: str, df: DataFrame, rows: int = 50) -> str:
    """A fixed-width report of a small result table."""
    got = [r.asDict() for r in df.limit(rows).collect()]
    lines = [title, "=" * len(title)]
    if got:
        width = {k: max(len(k), *(len(str(r[k])) for r in got)) for k in got[0]}
        lines.append("  ".join(k.ljust(w) for k, w in width.items()))
        lines += ["  ".join(str(r[k]).ljust(w) for k, w in width.items()) for r in got]
    return "\n".join(lines)


def write_bundle(tables: dict[str, DataFrame], folder: str) -> None:
    """One CSV per small result table."""
    for name, df in tables.items():
        flat = [F.concat_ws("|", c).alias(c) if kind.startswith("array<string") else F.col(c) for c, kind in df.dtypes]
        write_csv(df.select(*flat), f"{folder}/{name}")


def report_parts(title: str, parts: dict[str, DataFrame], rows: int = 50) -> str:
    """A text report of several parts, one small table each, in the order given."""
    bar = "#" * max(20, len(title))
    texts = [report_text(f"PART {k}: {name}", df, rows) for k, (name, df) in enumerate(parts.items(), 1)]
    return "\n\n".join([f"{bar}\n{title}\n{bar}", *texts])


def comparison_html(title: str, tables: dict[str, DataFrame], most: int = 1000) -> str:
    """A self-contained page with a heading and a table for each small result table."""
    sections = []
    for name, df in tables.items():
        head = "".join(f"<th>{html.escape(c)}</th>" for c in df.columns)
        cell = lambda v: "" if v is None else f"{v:.4f}" if isinstance(v, float) else html.escape(str(v))
        body = "".join("<tr>" + "".join(f"<td>{cell(v)}</td>" for v in r) + "</tr>" for r in df.limit(most).collect())
        sections.append(f"<h2>{html.escape(name)}</h2><table><tr>{head}</tr>{body}</table>")
    return f"<!doctype html><meta charset=utf-8><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1>{''.join(sections)}"
