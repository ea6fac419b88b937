import datetime as dt
import uuid

import pytest
from pyspark.sql import functions as F
from tests.helpers import rows

from touchline.plans import report
from touchline.sources import partitioned
from touchline.sources.tables import scope_to_batch

SCHEMA = "id int, at timestamp"


def day(n):
    return dt.datetime(2024, 5, n, 23, 59)


def frame(spark, *made):
    return spark.createDataFrame(list(made), SCHEMA)


@pytest.fixture
def table(spark):
    return f"partitioned_{uuid.uuid4().hex}"


def test_a_batch_replaces_itself_only(spark, table):
    partitioned.write_batch(frame(spark, (1, day(1)), (2, day(2)), (3, None)), table, "a", "at")
    partitioned.write_batch(frame(spark, (4, day(1))), table, "b's \\", "at")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        partitioned.write_batch(frame(spark, (5, day(2))).select("at", "id"), table, "a", "at")
        assert spark.conf.get("spark.sql.sources.partitionOverwriteMode").lower() == "dynamic"
    finally:
        spark.conf.unset("spark.sql.sources.partitionOverwriteMode")
    stored = spark.table(table)
    assert rows(stored, "id", "batch_id") == [(4, "b's \\"), (5, "a")]
    assert rows(scope_to_batch(stored, batch_id="a"), "id") == [(5,)]
    partitioned.write_batch(frame(spark), table, "a", "at")
    assert rows(stored.sparkSession.table(table), "id") == [(4,)]


def test_days_are_read_alone(spark, table):
    made = [(n, day(n % 4 + 1) if n % 9 else None) for n in range(40)]
    partitioned.write_batch(frame(spark, *made), table, "a", "at")
    partitioned.write_batch(frame(spark, (100, day(2))), table, "b", "at")
    found = partitioned.read_days(spark, table, dt.date(2024, 5, 2), dt.date(2024, 5, 3))
    assert rows(found, "id") == rows(spark.table(table).where("day(at) in (2, 3)"), "id")
    assert len(found.inputFiles()) < len(spark.table(table).inputFiles())
    one = partitioned.read_days(spark, table, dt.date(2024, 5, 2), dt.date(2024, 5, 2), "b")
    assert rows(one, "id") == [(100,)] and len(one.inputFiles()) == 1
    assert rows(partitioned.read_days(spark, table, partitioned.NO_DAY, partitioned.NO_DAY), "id") == rows(
        spark.table(table).where("at is null"), "id"
    )


def test_listed_days_prune_the_scan(spark, table):
    partitioned.write_batch(frame(spark, *[(n, day(n % 20 + 1)) for n in range(60)]), table, "a", "at")
    wanted = spark.range(40).selectExpr("date_add(DATE'2024-05-03', cast(id % 2 AS int)) AS d", "id").where("id > 7")
    found = partitioned.read_days_of(spark, table, wanted, "d")
    assert rows(found, "id") == rows(spark.table(table).where("day(at) in (3, 4)"), "id")
    assert "dynamicpruning" in found._jdf.queryExecution().executedPlan().toString()


def test_report_reads_one_day(spark, table):
    made = frame(spark, *[(n, day(n % 5 + 1)) for n in range(20)]).select(
        F.lit("c").alias("c"), F.lit("h").alias("h"), F.lit("a").alias("a"), F.lit(0.6).alias("p"), F.col("id").alias("d"),
        F.col("at").alias("ScoredAtUtc"),
    )
    partitioned.write_batch(made, table, "a", "ScoredAtUtc")
    where = report.ScoredTable("t", "c", "h", "a", "p", "d")
    found = report.daily_predictions([(spark.table(table), where)], dt.date(2024, 5, 3))
    assert rows(found, "point_diff") == [(2.0,), (7.0,), (12.0,), (17.0,)] or len(rows(found)) == 4
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(partition_day" in plan and len(found.inputFiles()) < len(spark.table(table).inputFiles())


def test_refusals(spark, table):
    with pytest.raises(ValueError, match="time columns"):
        partitioned.write_batch(frame(spark), table, "a", "absent")
    with pytest.raises(ValueError, match="filled here"):
        partitioned.write_batch(frame(spark).withColumn("Partition_Day", F.lit(1)), table, "a", "at")
    with pytest.raises(ValueError, match="needs an id"):
        partitioned.write_batch(frame(spark), table, "", "at")
    partitioned.write_batch(frame(spark, (1, day(1))), table, "a", "at")
    with pytest.raises(ValueError, match="lacks table columns"):
        partitioned.write_batch(frame(spark).select("at"), table, "a", "at")
    with pytest.raises(ValueError, match="has no columns \\['more'\\]"):
        partitioned.write_batch(frame(spark).withColumn("more", F.lit(1)), table, "a", "at")
