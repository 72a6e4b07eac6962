"""Times as pages write them, worked out by hand for a zone eight hours ahead."""

from datetime import datetime

from pyspark.sql import functions as F

from gristmill.functions.times import page_time

WRITTEN = {
    "1726704000": (datetime(2024, 9, 19, 0, 0), True),
    "172670400": (datetime(1975, 6, 22, 12, 0), True),
    "1726704000500": (datetime(2024, 9, 19, 0, 0, 0, 500_000), True),
    "999999999999": (None, False),
    "17267040": (None, False),
    "2026-09-19": (datetime(2026, 9, 18, 16, 0), False),
    "2026-02-30": (None, False),
    "2026年09月19日": (datetime(2026, 9, 18, 16, 0), False),
    "2026年9月19日 8：05": (datetime(2026, 9, 19, 0, 5), True),
    "2026 年 9 月 19 日 08:05:09": (datetime(2026, 9, 19, 0, 5, 9), True),
    "2026-09-19T08:05:09": (datetime(2026, 9, 19, 0, 5, 9), True),
    "2026-09-19 08:05": (datetime(2026, 9, 19, 0, 5), True),
    "2026-09-19T08:05:09Z": (datetime(2026, 9, 19, 8, 5, 9), True),
    "2026-09-19T08:05:09.25+08:00": (datetime(2026, 9, 19, 0, 5, 9, 250_000), True),
    "2026-09-19T08:05:09-0100": (datetime(2026, 9, 19, 9, 5, 9), True),
    "2026/9/19 08:05:09": (datetime(2026, 9, 19, 0, 5, 9), True),
    "2026/09/19 08:05": (datetime(2026, 9, 19, 0, 5), True),
    "2026/09/19": (datetime(2026, 9, 18, 16, 0), False),
    "20260919": (datetime(2026, 9, 18, 16, 0), False),
    " 2026-09-19 ": (datetime(2026, 9, 18, 16, 0), False),
    "3小时前": (None, False),
    "": (None, False),
}


def test_page_times(spark):
    rows = spark.createDataFrame([(k,) for k in WRITTEN], "written string").select("written", page_time(F.col("written")).alias("t")).select("written", "t.*")
    assert {r.written: (r.at, r.has_time) for r in rows.collect()} == WRITTEN
    assert spark.range(1).select(page_time(F.lit(None).cast("string")).alias("t")).first().t.at is None
