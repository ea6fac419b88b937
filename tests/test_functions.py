import datetime as dt

import pytest
from tests.helpers import rows
from pyspark.sql import functions as F
from pyspark.sql import types as T

from touchline.functions.dates import days_between, kickoff_timestamp, midnight, timestamp_of
from touchline.functions.text import (
    blank_to_null,
    contains_ignore_case,
    name_key,
    neutral_flag,
    percent_text,
    query_parameter,
)
from touchline.functions.types import needs_zero_one_check, spark_type, type_matches


def test_kickoff_combines_day_and_clock(spark):
    cases = {
        "4:05AM": dt.datetime(2025, 12, 8, 4, 5),
        "7:30PM": dt.datetime(2025, 12, 8, 19, 30),
        "12:00am": dt.datetime(2025, 12, 8, 0, 0),
        "04:05am": dt.datetime(2025, 12, 8, 4, 5),
        "13:00pm": None,
        "0:30AM": None,
        "7:30 pm": None,
        "TBC": None,
        None: None,
    }
    df = spark.createDataFrame([("2025-12-08", c) for c in cases], "d string, t string")
    out = df.select("t", kickoff_timestamp(timestamp_of(df, "d"), "t").alias("at")).collect()
    assert {r["t"]: r["at"] for r in out} == cases


def test_kickoff_bad_date_is_null(spark):
    df = spark.createDataFrame([("someday", "4:05AM"), (None, "4:05AM")], "d string, t string")
    out = df.select(kickoff_timestamp(timestamp_of(df, "d"), "t").alias("at"))
    assert rows(out) == [(None,), (None,)]


def test_midnight_drops_time_and_coerces(spark):
    df = spark.createDataFrame([("2025-12-08 14:18:52",), ("2025-12-08",), ("nope",), (None,)], "d string")
    out = [r[0] for r in df.select(midnight(timestamp_of(df, "d"))).collect()]
    assert out == [dt.datetime(2025, 12, 8), dt.datetime(2025, 12, 8), None, None]


def test_days_between_is_inclusive_and_rejects_reversed(spark):
    df = spark.createDataFrame([(dt.date(2025, 12, 1), dt.date(2025, 12, 3))], "a date, b date")
    spine = df.select(F.explode(days_between(F.col("a"), F.col("b"))).alias("d")).collect()
    assert [r["d"] for r in spine] == [dt.date(2025, 12, 1), dt.date(2025, 12, 2), dt.date(2025, 12, 3)]
    assert df.select(F.size(days_between(F.col("a"), F.col("a")))).first()[0] == 1
    with pytest.raises(Exception, match="first day lies after the last"):
        df.select(days_between(F.col("b"), F.col("a"))).collect()


def test_name_key_strips_any_whitespace(spark):
    df = spark.createDataFrame([("\t Harbour Park   ",), (None,)], "v string")
    assert [r[0] for r in df.select(name_key("v")).collect()] == ["HARBOUR PARK", None]


def test_blank_to_null(spark):
    df = spark.createDataFrame([("  a ",), (" \t ",), ("",), (None,)], "v string")
    assert [r[0] for r in df.select(blank_to_null("v")).collect()] == ["a", None, None, None]


def test_neutral_flag(spark):
    df = spark.createDataFrame(
        [("France", "Wales", "Italy"), ("France", "Wales", " france "), ("France", "Wales", "WALES"), ("France", "Wales", None), (None, "Wales", "Italy")],
        "h string, a string, c string",
    )
    assert [r[0] for r in df.select(neutral_flag("h", "a", "c")).collect()] == [True, False, False, False, True]


def test_world_cup_flag(spark):
    df = spark.createDataFrame([("Ninth World Cup of Bowls",), ("Six Nations",), (None,)], "c string")
    assert [r[0] for r in df.select(contains_ignore_case("c", "World Cup")).collect()] == [True, False, False]


@pytest.mark.parametrize(
    "link, expected",
    [
        ("https://example.org/match?g=1234", "1234"),
        ("/match?x=1&g=12#top", "12"),
        ("/match?g=&g=5", "5"),
        ("/match?g=a%20b+c", "a b c"),
        ("/match?g=100%", "100%"),
        ("/match?g=a|b c", "a|b c"),
        ("/match?gg=1", None),
        ("/match#?g=1", None),
        ("/match", None),
        (None, None),
    ],
)
def test_query_parameter(spark, link, expected):
    df = spark.createDataFrame([(link,)], "l string")
    assert df.select(query_parameter("l", "g")).first()[0] == expected


def test_percent_text(spark):
    df = spark.createDataFrame([(0.623,), (None,)], "p double")
    assert df.select(percent_text("p")).first()[0] == "62.3%"


def test_type_matching():
    assert type_matches(T.StringType(), "String")
    assert type_matches(T.LongType(), "int") and not type_matches(T.DoubleType(), "int")
    for name in ("float", "double", "numeric", "decimal"):
        assert type_matches(T.DecimalType(10, 2), name) and type_matches(T.IntegerType(), name)
        assert not type_matches(T.BooleanType(), name)
    assert type_matches(T.BooleanType(), "bit") and type_matches(T.LongType(), "bool")
    assert not type_matches(T.StringType(), "bool")
    for name in ("date", "time", "datetime"):
        assert type_matches(T.TimestampType(), name) and type_matches(T.StringType(), name)
        assert not type_matches(T.LongType(), name)
    assert not type_matches(T.StringType(), "mystery") and not type_matches(T.StringType(), None)
    assert needs_zero_one_check(T.LongType(), "bit") and not needs_zero_one_check(T.BooleanType(), "bit")
    assert spark_type("int") == T.LongType() and spark_type("mystery") == T.StringType()
