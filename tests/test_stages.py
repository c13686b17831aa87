"""Stages: nothing finished is made again, nothing half-made counts, failures are rows."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidemark.plans.stages import Stage, in_order, run


@pytest.fixture
def source(spark, tmp_path):
    rows = [("A", i, float(i)) for i in range(5)] + [("B", i, -1.0) for i in range(3)]
    spark.createDataFrame(rows, "pair string, i int, x double").write.parquet(str(tmp_path / "bars"))
    return lambda: {"bars": spark.read.parquet(str(tmp_path / "bars"))}


def told(manifest):
    return sorted((r["stage"], r["pair"], r["status"], r["rows"]) for r in manifest.collect())


def plan(calls, broken=False, factor=2):
    def double(df, factor):
        calls.append("double")
        return df.withColumn("y", F.col("x") * factor)

    def roots(df):
        calls.append("roots")
        if broken:
            raise RuntimeError("killed")
        return df.withColumn("z", F.col("y") + 1)

    # out of order on purpose
    return [Stage("roots", ("double",), roots), Stage("double", ("bars",), double, {"factor": factor})]


def test_a_broken_run_resumes(spark, tmp_path, source):
    calls, folder = [], str(tmp_path / "out")
    with pytest.raises(RuntimeError, match="every instrument"):
        run(spark, plan(calls, broken=True), source(), folder)
    assert calls.count("double") == 1
    tables, manifest = run(spark, plan(calls), source(), folder)
    assert calls.count("double") == 1
    assert told(manifest) == [("double", "A", "PRESENT", 5), ("double", "B", "PRESENT", 3), ("roots", "A", "DONE", 5), ("roots", "B", "DONE", 3)]
    assert tables["roots"].filter("z != 2 * x + 1").count() == 0
    before = len(calls)
    _, manifest = run(spark, plan(calls), source(), folder)
    assert len(calls) == before and {r["status"] for r in manifest.collect()} == {"PRESENT"}


def test_changes_are_seen(spark, tmp_path, source):
    calls, folder = [], str(tmp_path / "out")
    run(spark, plan(calls), source(), folder)
    tables, manifest = run(spark, plan(calls, factor=3), source(), folder)
    assert {r["status"] for r in manifest.collect()} == {"DONE"} and tables["double"].filter("y != 3 * x").count() == 0
    spark.createDataFrame([("C", 0, 1.0)], "pair string, i int, x double").write.mode("append").parquet(str(tmp_path / "bars"))
    _, manifest = run(spark, plan(calls), source(), folder)
    assert ("double", "C", "DONE", 1) in told(manifest)


def test_failed_instruments_are_rows(spark, tmp_path, source):
    checked = F.when(F.col("x") < 0, F.raise_error(F.lit("below zero"))).otherwise(F.col("x"))
    stages = [Stage("check", ("bars",), lambda df: df.withColumn("y", checked.cast("double"))), Stage("next", ("check",), lambda df: df.select("pair", "y"))]
    tables, manifest = run(spark, stages, source(), str(tmp_path / "out"))
    assert told(manifest) == [("check", "A", "DONE", 5), ("check", "B", "ERROR", 0), ("next", "A", "DONE", 5)]
    assert "below zero" in manifest.filter("status = 'ERROR'").first()["error"]
    assert tables["next"].select("pair").distinct().count() == 1


def test_half_made_outputs_do_not_count(spark, tmp_path, source):
    calls, folder = [], tmp_path / "out"
    run(spark, plan(calls), source(), str(folder))
    (place,) = (folder / "double").iterdir()
    (place / "manifest").rename(place / "lost")  # as if it had been killed before publishing
    _, manifest = run(spark, plan(calls), source(), str(folder))
    assert [r["status"] for r in manifest.filter("stage = 'double'").collect()] == ["DONE", "DONE"]
    _, manifest = run(spark, plan(calls), source(), str(folder))
    assert {r["status"] for r in manifest.collect()} == {"PRESENT"}


def test_order():
    a, b = Stage("a", ("b",), None), Stage("b", ("a",), None)
    with pytest.raises(ValueError, match="wait"):
        in_order([a, b], set())
