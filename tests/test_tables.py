import datetime as dt

import pytest
from tests.helpers import rows
from pyspark.sql import types as T

from touchline.operators import quality
from touchline.operators.quality import ColumnRule
from touchline.plans import ingestion
from touchline.session import scratch_path, shared_root
from touchline.sources import catalog, snapshots, tables


@pytest.fixture()
def numbers(spark):
    spark.createDataFrame([(1, "a"), (2, "b"), (3, "it's")], "n int, s string").createOrReplaceTempView("numbers")
    return "numbers"


def test_read_table(spark, numbers):
    assert rows(tables.read_table(spark, numbers, ["s"], "n > :low", {"low": 1})) == [("it's",), ("b",)]
    assert rows(tables.read_table(spark, numbers, None, "s = :s", {"s": "it's"})) == [(3, "it's")]
    assert tables.read_table(spark, numbers).count() == 3
    for empty in ("", "  "):
        with pytest.raises(ValueError):
            tables.read_table(spark, empty)


def test_batch_scope(spark):
    df = spark.createDataFrame([("b1", "s1", 1), ("b1", "s2", 2), ("b2", "s1", 3)], "BATCH_ID string, system_event_id string, v int")
    assert rows(tables.scope_to_batch(df, "b1", "s1"), "v") == [(1,)]
    assert rows(tables.scope_to_batch(df.drop("system_event_id"), "b1", "s1"), "v") == [(1,), (2,)]
    assert tables.scope_to_batch(df.select("v"), "b1", "s1").count() == 3


def test_append_truncate_replace(spark):
    schema = T.StructType.fromDDL("ID bigint, v string, CreatedAt timestamp, extra int")
    tables.create_table(spark, "sink", schema)
    df = spark.createDataFrame([("a",), ("b",)], "v string")
    tables.append_rows(df, "sink")
    tables.append_rows(df, "sink")
    tables.append_rows(df.where("false"), "sink")
    out = spark.table("sink")
    assert out.count() == 4 and out.select("ID").distinct().count() == 4
    assert out.where("CreatedAt is null or extra is not null").count() == 0
    tables.replace_rows(df.limit(1), "sink")
    assert rows(spark.table("sink"), "v") == [("a",)]
    tables.truncate_table(spark, "sink")
    assert spark.table("sink").isEmpty()
    for write in (tables.append_rows, tables.replace_rows):
        with pytest.raises(TypeError):
            write([1], "sink")


def test_active_venues(spark):
    df = spark.createDataFrame([("V", "C", "L", 1), ("W", "C", "L", 0)], "VenueName string, City string, Country string, IsActive int")
    assert rows(tables.active_venues(df)) == [("V", "C", "L")]
    empty = tables.active_venues(df.where("false"))
    assert empty.columns == ["venue", "city", "country"] and empty.isEmpty()


def test_snapshot_round_trip(spark, tmp_path):
    tricky = [("a,b", 1, None), ('say "hi"', 2, " padded "), ("two\nlines", 3, "x")]
    df = spark.createDataFrame(tricky, "t string, n bigint, u string")
    path = snapshots.write_snapshot(df, str(tmp_path), "results", "feed", "day1")
    assert path == f"{tmp_path}/results/feed/day1"
    assert rows(snapshots.read_snapshot(spark, path, df.schema, multi_line=True)) == sorted(tricky, key=repr)
    snapshots.write_snapshot(df.limit(1), str(tmp_path), "results", "feed", "day1")
    assert snapshots.read_snapshot(spark, path).count() == 1


RAW = [("20.0", "1"), ("abc", "0"), ("7", "1"), (None, "true"), (" 8 ", "yes")]


def test_bad_values_reach_validation(spark):
    raw = spark.createDataFrame(RAW, "home_score string, world_cup string")
    rules = [ColumnRule("home_score", "int", True), ColumnRule("world_cup", "bit"), ColumnRule("absent", "date")]
    found = quality.rejected_values(raw, rules)
    assert rows(found) == [("home_score", "int", 1, "abc"), ("world_cup", "bit", 1, "yes")]
    typed = snapshots.parsed(raw, rules)
    assert typed.collect() == [(20, True), (None, False), (7, True), (None, True), (8, None)]
    with pytest.raises(ValueError, match="1 values of column 'home_score' are no int, e.g. 'abc'"):
        quality.validate_source(typed, rules, raw)
    quality.validate_source(typed.where("home_score in (7, 20)"), rules, raw.where("home_score in ('7', '20.0')"))


def test_snapshot_with_a_schema_raises_on_bad_values(spark, tmp_path):
    (tmp_path / "r.csv").write_text("n\n1\nx\n")
    with pytest.raises(Exception, match="n is no bigint: x"):
        snapshots.read_snapshot(spark, str(tmp_path / "r.csv"), spark.createDataFrame([], "n bigint").schema).collect()


def test_new_ids_are_consecutive_over_appends(spark):
    for start in range(3):
        tables.append_rows(spark.range(start * 10, start * 10 + 10, 1, 4).withColumnRenamed("id", "v"), "numbered_table")
    out = spark.table("numbered_table")
    assert sorted(r["ID"] for r in out.collect()) == list(range(1, 31)) and out.where("CreatedAt is null").isEmpty()
    tables.replace_rows(spark.range(0, 5, 1, 3).withColumnRenamed("id", "v"), "numbered_table")
    assert sorted(r["ID"] for r in spark.table("numbered_table").collect()) == [1, 2, 3, 4, 5]


def test_snapshot_schema_by_name(spark, tmp_path):
    (tmp_path / "results.csv").write_text("col2,other,col1\n1,x,2\n3,y,4\n")
    rules = [ColumnRule("col1", "int"), ColumnRule("col2", "float"), ColumnRule("absent", "string")]
    out = snapshots.read_snapshot(spark, str(tmp_path / "results.csv"), snapshots.schema_from_rules(rules))
    assert out.dtypes == [("col1", "bigint"), ("col2", "double")] and rows(out) == [(2, 1.0), (4, 3.0)]
    landed, dataset = snapshots.read_historical(spark, str(tmp_path), "kaggle", "all-results")
    assert landed.count() == 2 and dataset == "all-results"
    assert dict(landed.dtypes)["col1"] == "int"
    with pytest.raises(ValueError):
        snapshots.read_historical(spark, str(tmp_path), "elsewhere", "x")


def test_catalog(spark):
    defined = spark.createDataFrame(
        [(2, "Results", "results", "feed"), (1, "Fixtures", "fixtures", "feed")],
        "id int, table_name string, integration_type string, integration_provider string",
    )
    columns = spark.createDataFrame(
        [(2, "b", "int", True, 2), (2, "a", "string", False, 1), (1, "z", "date", True, 1)],
        "table_id int, column_name string, data_type string, is_required boolean, ordinal_position int",
    )
    found = catalog.catalog_columns(defined, columns, table_name="dbo.Results")
    assert [r["column_name"] for r in found.collect()] == ["a", "b"]
    assert catalog.column_rules(found) == [ColumnRule("a", "string", False), ColumnRule("b", "int", True)]
    both = catalog.catalog_columns(defined, columns, integration_provider="feed")
    assert [r["column_name"] for r in both.collect()] == ["z", "a", "b"]
    assert catalog.catalog_columns(defined, columns, integration_type="results", integration_provider="no").isEmpty()
    with pytest.raises(ValueError):
        catalog.catalog_columns(defined, columns)


def test_fetch_ranges(spark):
    history = spark.createDataFrame(
        [
            ("feed", "results", "ingested", dt.datetime(2025, 12, 1, 5)),
            ("feed", "results", "preprocessed", dt.datetime(2025, 12, 3, 5)),
            ("feed", "results", "failed", dt.datetime(2025, 12, 9, 5)),
            ("feed", "fixtures", "failed", dt.datetime(2025, 12, 9, 5)),
        ],
        "integration_provider string, integration_type string, status string, created_at timestamp",
    )
    ranges = ingestion.fetch_ranges(history, history, dt.date(2025, 12, 5))
    assert rows(ranges, "integration_type", "first_day", "dataset") == [
        ("fixtures", dt.date(2025, 10, 1), "feed_fixtures_2025-10-01_to_2025-12-05"),
        ("results", dt.date(2025, 12, 3), "feed_results_2025-12-03_to_2025-12-05"),
    ]
    as_text = history.withColumn("created_at", history["created_at"].cast("string"))
    assert rows(ingestion.high_water(as_text), "high_water") == [(dt.datetime(2025, 12, 3, 5),)]
    days = ingestion.fetch_days(ranges.where("integration_type = 'results'"))
    assert [r[2].day for r in sorted(days.collect())] == [3, 4, 5]


def test_ingest_pages(spark, tmp_path):
    from tests.test_pages import DAY, dates_of, game, page, pages_of

    found = pages_of(spark, page(game("A", "B", "FT", 1)))
    path = ingestion.ingest_pages(found, "results", "feed", dates_of(spark, DAY), "d1", str(tmp_path))
    assert rows(snapshots.read_snapshot(spark, path), "home_team", "home_score", "match_id") == [("A", 31, 1)]
    with pytest.raises(ValueError, match="gave no results"):
        ingestion.ingest_pages(pages_of(spark, "<p>"), "results", "feed", dates_of(spark, DAY), "d2", str(tmp_path))


def test_scratch_lies_under_the_configured_folder(spark):
    root = spark.conf.get("spark.checkpoint.dir")
    assert shared_root(spark) == root
    assert scratch_path(spark, "x").startswith(root) and scratch_path(spark, "x") != scratch_path(spark, "x")
