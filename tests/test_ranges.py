"""Tables in files by range: a change rewrites the ranges it touches, and commits whole or not at all."""

import pytest
from pyspark.sql import functions as F

from gristmill.operators import ranges, tables
from gristmill.operators.ranges import RangeTable


def made(spark, path, n=100, rows=10):
    return RangeTable.created(spark.range(n).selectExpr("lpad(string(id), 4, '0') AS k", "id AS v", "'body' AS body"), "k", f"file://{path}/t", rows)


def values(table):
    return {r.k: r.v for r in table.rows().collect()}


def test_a_change_rewrites_its_ranges_only(spark, tmp_path):
    first = made(spark, tmp_path)
    assert len(first.files) >= 8 and first.bounds == sorted(first.bounds) and len(first.bounds) == len(first.files) - 1
    second = first.upserted(spark.createDataFrame([("0042", -1, "")], "k string, v long, body string"), keep_if_empty=("body",), body="body")
    assert len(set(second.files) - set(first.files)) == 1 and second.version == 2
    assert values(second) == {f"{i:04}": -1 if i == 42 else i for i in range(100)} and second.rows().where("k = '0042' AND body = 'body'").count() == 1
    # a reader of the version before sees it as it was, and the latest is found by whoever opens the table
    assert values(first)["0042"] == 42 == values(RangeTable.opened(spark, first.path, 1))["0042"] and RangeTable.opened(spark, first.path) == second


def test_rows_outside_all_ranges_patches_and_deletions(spark, tmp_path):
    table = made(spark, tmp_path).upserted(spark.createDataFrame([("", 1, "x"), ("zz", 2, "y")], "k string, v long, body string"))
    assert len(values(table)) == 102 and values(table)[""] == 1
    table = table.patched(spark.createDataFrame([("0001", 7), ("nobody", 8)], "k string, v long")).deleted(spark.createDataFrame([("zz",), ("0000",)], "k string"))
    assert values(table) == {"": 1, **{f"{i:04}": 7 if i == 1 else i for i in range(1, 100)}}
    table = table.replaced(spark.createDataFrame([("0005", 50, "a"), ("0005", 51, "b")], "k string, v long, body string"))
    assert sorted(r.v for r in table.rows().where("k = '0005'").collect()) == [50, 51] and table.rows().count() == 101


def test_a_range_that_loses_all_rows_and_one_that_grows(spark, tmp_path):
    table = made(spark, tmp_path)
    low, high = table.bounds[1], table.bounds[2]
    gone = table.deleted(table.rows().where((F.col("k") >= low) & (F.col("k") < high)).select("k"))
    assert len(gone.files) == len(table.files) and not set(values(gone)) & {k for k in values(table) if low <= k < high}
    more = gone.upserted(spark.range(90).selectExpr("concat('0020-', lpad(string(id), 3, '0')) AS k", "id AS v", "'' AS body"))
    assert len(more.files) > len(gone.files) and more.bounds == sorted(more.bounds)
    assert values(more) == {**values(gone), **{f"0020-{i:03}": i for i in range(90)}}
    again = more.upserted(spark.createDataFrame([("0020-050", -5, "")], "k string, v long, body string"))
    assert len(set(again.files) - set(more.files)) == 1 and values(again)["0020-050"] == -5


def test_a_failed_change_and_a_lost_race_leave_the_version_before(spark, tmp_path):
    table = made(spark, tmp_path)
    with pytest.raises(Exception, match="broken"):
        table.upserted(spark.createDataFrame([("0001", 1, "")], "k string, v long, body string").withColumn("v", F.raise_error(F.lit("broken")).cast("long")))
    assert RangeTable.opened(spark, table.path) == table and values(table)["0001"] == 1
    change = spark.createDataFrame([("0001", 9, "")], "k string, v long, body string")
    table.upserted(change)
    with pytest.raises(ranges.Conflict):
        table.upserted(change.withColumn("v", F.lit(10).cast("long")))
    assert values(RangeTable.opened(spark, table.path))["0001"] == 9


def test_numbers_nulls_and_no_rows(spark, tmp_path):
    empty = RangeTable.created(spark.createDataFrame([], "k long, v long"), "k", f"file://{tmp_path}/e")
    assert empty.rows().count() == 0
    table = empty.upserted(spark.createDataFrame([(3, 1), (None, 2)], "k long, v long"))
    assert {(r.k, r.v) for r in table.rows().collect()} == {(3, 1), (None, 2)}
    rows = spark.createDataFrame([(None,), (-1,), (0,), (5,), (9,), (10,)], "k long")
    assert [r.n for r in rows.select(ranges.place(F.col("k"), [0, 5, 10]).alias("n")).collect()] == [0, 0, 1, 2, 2, 3]
    assert tables.upserted(rows.withColumn("v", F.lit(1)), rows.limit(0).withColumn("v", F.lit(1)), "k").count() == 6


def test_windows_of_unlike_lengths(spark):
    from datetime import datetime, timedelta

    t = datetime(2026, 1, 1)
    hours = {"a": (0, 5), "b": (5, 6), "c": (10, 40)}
    windows = spark.createDataFrame([(n, t + timedelta(hours=s), t + timedelta(hours=e)) for n, (s, e) in hours.items()], "name string, start timestamp, end timestamp")
    rows = spark.createDataFrame([(h, t + timedelta(hours=h)) for h in (-1.0, 0.0, 0.5, 5.0, 5.5, 6.0, 7.0, 10.0, 10.1, 40.0, 41.0)] + [(None, None)], "h double, published_at timestamp")
    got = {r.h: r["name"] for r in ranges.in_windows(rows, windows, "name").collect()}
    assert got == {-1.0: None, 0.0: None, 0.5: "a", 5.0: "a", 5.5: "b", 6.0: "b", 7.0: None, 10.0: None, 10.1: "c", 40.0: "c", 41.0: None, None: None}
    assert ranges.in_windows(rows, windows.limit(0), "name").where("name IS NOT NULL").count() == 0
    with pytest.raises(ValueError, match="overlap"):
        ranges.in_windows(rows, windows.union(spark.createDataFrame([("d", t, t + timedelta(hours=1))], windows.schema)), "name")


def test_strings_of_answers(spark):
    from gristmill.functions.text import strings_of

    answers = ['["a", " a ", 1, null, {"b": "c"}, "", "d", ["e"], true]', '"a"', "no json", None, "{}", "[]"]
    got = spark.createDataFrame([(x,) for x in answers], "x string").select(strings_of(F.col("x")).alias("s")).collect()
    assert [r.s for r in got] == [["a", "d"], [], [], [], [], []]
