import datetime

import pytest
from pyspark.sql import functions as F

from loglens.functions.text import record_text, utc_wall_time
from loglens.operators import words
from tests.conftest import rows


@pytest.mark.parametrize(
    "text, want",
    [
        ("Hello, how are YOU", ["hello", "how", "are", "you"]),
        (" lead", ["", "lead"]),
        ("trail!! ", ["trail"]),
        ("!!!", []),
        ("", [""]),
        ("a\nb\n", ["a", "b"]),
        ("été", ["", "t"]),
        ("x_1-2", ["x_1", "2"]),
        ("one", ["one"]),
        (None, []),
    ],
)
def test_tokens(spark, text, want):
    df = spark.createDataFrame([(1, text)], "id int, text string")
    assert [r["word"] for r in words.tokens(df, "text").collect()] == want


def test_long_run_of_separators(spark):
    df = spark.createDataFrame([(1, "a" + "é" * 2_000_000 + "b" + "!" * 2_000_000)], "id int, text string")
    assert [r["word"] for r in words.tokens(df, "text").collect()] == ["a", "b"]


def test_word_count(spark):
    df = spark.createDataFrame([("a b a",), ("B",), (None,)], "text string")
    assert rows(words.word_count(words.tokens(df, "text"))) == [("a", 2), ("b", 2)]


def test_null_kinds(spark):
    df = spark.createDataFrame([("null",), (None,), ("x",), ("x",)], "v string")
    assert rows(words.null_kinds(df, "v")) == [(False, False, 2), (False, True, 1), (True, False, 1)]


@pytest.mark.parametrize("zone", ["UTC", "America/Los_Angeles", "Asia/Kolkata"])
def test_record_text_in_any_session_zone(spark, zone):
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = spark.sql(
            "select 'k' as k, cast(null as string) as v, 3 as p, 7L as o, timestamp_micros(us) as ts "
            "from values (1704067200000000L), (1720000000123456L) as t(us)"
        )
        utc = utc_wall_time(F.col("ts"), has_zone=True)
        got = df.select(utc.alias("u"), record_text(F.col("k"), F.col("v"), F.col("p"), F.col("o"), utc).alias("t")).collect()
        assert got[0]["u"] == datetime.datetime(2024, 1, 1)
        assert got[1]["u"] == datetime.datetime(2024, 7, 3, 9, 46, 40, 123456)
        head = "Consumer Record:(key: k, value: null, partition: 3, offset: 7, timestamp: "
        assert [r["t"] for r in got] == [
            head + "Sun Dec 31 16:00:00 PST 2023)",
            head + "Wed Jul 03 02:46:40 PDT 2024)",
        ]
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
