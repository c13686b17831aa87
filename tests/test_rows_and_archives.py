"""Samples, row numbers, gap-aware windows, the table function and the archive source."""

from __future__ import annotations

import hashlib
import math
import os
import zipfile
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.operators import backtest, evaluate, logs, ml, numbering
from tidemark.sources import archives


def expected_sample(rows, n=None, fraction=None, seed=0):
    by = {}
    for g, i in rows:
        by.setdefault(g, []).append((hashlib.md5(f"{seed}|{'' if i is None else i}".encode()).hexdigest(), i))
    out = []
    for g, found in by.items():
        m = n if n is not None else math.floor(fraction * len(found) + 0.5)
        out += [(g, i) for _, i in sorted(found)[:m]]
    return sorted(out, key=str)


@pytest.mark.parametrize("parts", [1, 7])
@pytest.mark.parametrize("wanted", [{"n": 25}, {"n": 100_000}, {"n": 0}, {"fraction": 0.1}, {"fraction": 1.0}])
def test_sample_is_exact_whatever_the_partitions(spark, parts, wanted):
    rows = [("hot", i) for i in range(6000)] + [("few", i) for i in range(10)] + [(None, i) for i in range(300)]
    df = spark.createDataFrame(rows, "g string, i long").withColumn("rows_extra", F.lit(1)).repartition(parts)
    got = numbering.exact_sample(df, ["g"], ["i"], seed=3, **wanted)
    assert got.columns == ["g", "i", "rows_extra"]
    assert sorted(((r.g, r.i) for r in got.collect()), key=str) == expected_sample(rows, seed=3, **wanted)


def test_sample_odd_input(spark):
    empty = spark.createDataFrame([], "g string, i long")
    assert numbering.exact_sample(empty, ["g"], ["i"], n=5).count() == 0
    same = spark.createDataFrame([("a", 1)] * 40, "g string, i long")
    assert numbering.exact_sample(same, ["g"], ["i"], n=7).count() == 7
    whole = spark.createDataFrame([(i,) for i in range(50)], "i long")
    assert [r.i for r in numbering.exact_sample(whole, [], ["i"], n=20, order=["i"]).collect()] == sorted(
        i for _, i in expected_sample([(0, i) for i in range(50)], n=20)
    )
    with pytest.raises(ValueError):
        numbering.exact_sample(whole, [], ["i"])


@pytest.mark.parametrize("parts", ["1", "5"])
def test_numbers_have_no_gaps(spark, parts):
    rows = [("a", i * 37 % 1009) for i in range(1000)] + [(None, i) for i in range(30)] + [("b", 5)]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        df = spark.createDataFrame(rows, "k string, x long")
        got = numbering.numbered(df, ["k"], ["x"]).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    want = {(k, x): n for key in ("a", None, "b") for n, (k, x) in enumerate(sorted((r for r in rows if r[0] == key), key=lambda r: r[1]))}
    assert {(r.k, r.x): r.position for r in got} == want and len(got) == len(rows)


def test_comparison_by_position_cuts_to_the_shorter(spark):
    t0 = datetime(2024, 1, 1)
    rows = [(1, "a", t0 + timedelta(hours=i), 0.01 * (i % 7)) for i in range(40)]
    rows += [(1, "b", t0 + timedelta(days=9, hours=3 * i), 0.01 * (i % 5)) for i in range(30)]
    returns = spark.createDataFrame(rows, "one int, s string, ts timestamp, r double")
    pairs = spark.createDataFrame([(1, "a_vs_b", "a", "b")], "one int, comparison string, a string, b string")
    (got,) = evaluate.compared_by_position(returns, pairs, ["one"], "s", "ts", "r").collect()
    d = [-0.01 * (i % 7) + 0.01 * (i % 5) for i in range(30)]
    mean = sum(d) / 30
    var = sum((x - mean) ** 2 for x in d) / 29
    assert got.n == 30 and got.stat == pytest.approx(mean / math.sqrt(var / 30), abs=1e-4)


@pytest.mark.parametrize(
    ("t", "df", "p"),
    [(100.0, 1, 2 / math.pi * math.atan(1 / 100)), (1.0, 1, 0.5), (3.0, 2, 1 - 3 / math.sqrt(11)), (-1.959964, 10**7, 0.05), (2.228139, 10, 0.05), (0.0, 5, 1.0), (1e9, 10**6, 0.0)],
)
def test_p_of_students_t(spark, t, df, p):
    (got,) = spark.createDataFrame([(t, df)], "t double, df long").select(S.t_two_sided(F.col("t"), F.col("df"))).first()
    assert got == pytest.approx(p, abs=1e-6)


def test_windows_do_not_cross_gaps(spark):
    t0 = datetime(2024, 1, 1)
    hours = [0, 1, 2, 3, 10, 11, 12, 24]
    df = spark.createDataFrame([("a", t0 + timedelta(hours=h), float(h), "x" if h != 11 else "y") for h in hours], "k string, ts timestamp, v double, session string")
    seen = lambda d: {r.v: r.seq and [x[0] for x in r.seq] for r in d.collect()}
    whole = seen(ml.session_sequences(df, ["v"], 2, ["k"], "ts", step="1 hour"))
    assert whole == {0: None, 1: [0, 1], 2: [1, 2], 3: [2, 3], 10: None, 11: [10, 11], 12: [11, 12], 24: None}
    part = seen(ml.session_sequences(df, ["v"], 2, ["k"], "ts", ["x"], step="1 hour"))
    assert part == {0: None, 1: [0, 1], 2: [1, 2], 3: [2, 3], 10: None, 12: None, 24: None}
    assert seen(ml.session_sequences(df, ["v"], 2, ["k"], "ts", ["x"]))[12] == [10, 12]


def test_table_function_equals_the_simulator(spark):
    price = [100 + 7 * math.sin(i / 3) + (i * 31 % 11) / 5 for i in range(300)]
    position = [[0, 1, 1, -1, 0, -1][i // 9 % 6] for i in range(300)]
    spark.createDataFrame([("s", i, p, h) for i, (p, h) in enumerate(zip(price, position, strict=True))], "series string, at int, price double, position int").createOrReplaceTempView("held")
    logs.register(spark)
    for args in ((0.5, 3.0, 2.0, 8), (0.5, None, None, None), (0.0, 0.0, 4.0, 0)):
        text = ", ".join("null" if a is None else str(a) for a in args)
        got = spark.sql(f"SELECT * FROM trade_log(TABLE(held) PARTITION BY (series) ORDER BY (at), {text}) ORDER BY entry_bar").collect()
        assert [tuple(r)[1:] for r in got] == backtest.simulate(price, position, *args)[0]


def test_worst_fall_for_chunks_of_any_length(spark):
    t0 = datetime(2024, 1, 1)
    values = [50 + 20 * math.sin(i / 9) + (i * 17 % 13) for i in range(400)]
    df = spark.createDataFrame([("a", t0 + timedelta(hours=i), v) for i, v in enumerate(values)] + [("b", t0, 1.0)], "k string, ts timestamp, v double")
    want, peak = 0.0, values[0]
    for v in values:
        peak = max(peak, v)
        want = min(want, (v - peak) / peak)
    for chunk in ("1 hour", "1 day", "10000 days"):
        assert {r.k: r.worst_fall for r in logs.worst_fall(df, ["k"], "ts", "v", chunk).collect()} == {"a": want, "b": 0.0}


RAW = "stamp string, open double, high double, low double, close double, volume double, pair string, year int"


def raw_rows():
    return [
        (f"{y}0102 {h:02d}{m:02d}00", 1.1 + h / 7, 1.5 + h, 0.9, None if m == 3 else 1.2, float(m), p, y)
        for p in ("EURUSD", "USDJPY") for y in (2023, 2024) for h in range(3) for m in range(5)
    ]


def test_archives_round_trip_prune_and_skip(spark, tmp_path):
    rows, path = raw_rows(), str(tmp_path / "zips")
    os.mkdir(path)
    archives.write_archives(spark.createDataFrame(rows, RAW).repartition(5), path)
    assert sorted(os.listdir(path)) == [f"{p}_{y}.zip" for p in ("EURUSD", "USDJPY") for y in (2023, 2024)]
    back = archives.read_archives(spark, path)
    assert sorted(map(tuple, back.collect()), key=str) == sorted(rows, key=str)
    one = back.filter("pair = 'EURUSD' AND year IN (2024)")
    assert one.rdd.getNumPartitions() == 1 and one.count() == 15
    with pytest.raises(Exception, match="EURUSD_2023|FileExists|exist"):
        archives.write_archives(spark.createDataFrame(rows[:1], RAW), path)
    archives.write_archives(spark.createDataFrame([*rows[:1], ("20250101 000000", 1.0, 1.0, 1.0, 1.0, 0.0, "EURUSD", 2025)], RAW), path, present="skip")
    assert archives.read_archives(spark, path).count() == len(rows) + 1
    archives.write_archives(spark.createDataFrame(rows[:2], RAW), path, mode="overwrite")
    assert archives.read_archives(spark, path).filter("pair = 'EURUSD' AND year = 2023").count() == 2
    assert not [n for n in os.listdir(path) if n.startswith(".job")]


def test_damaged_and_empty_archives(spark, tmp_path):
    path = str(tmp_path / "zips")
    os.mkdir(path)
    assert archives.read_archives(spark, path).count() == 0
    (tmp_path / "zips" / "EURUSD_2024.zip").write_bytes(b"not an archive")
    with pytest.raises(Exception, match="not a zip archive"):
        archives.read_archives(spark, path).count()
    assert archives.read_archives(spark, path, damaged="skip").count() == 0
    with zipfile.ZipFile(f"{path}/USDJPY_2024.zip", "w") as z:
        z.writestr("x.csv", "")
    assert archives.read_archives(spark, path, damaged="skip").count() == 0


def test_opening_is_tried_again():
    seen = []

    def work():
        seen.append(1)
        if len(seen) < 3:
            raise OSError("away")
        return "here"

    assert archives.retried(work, 3, 0.0) == "here"
    with pytest.raises(OSError):
        archives.retried(lambda: (_ for _ in ()).throw(OSError("gone")), 2, 0.0)
