"""Tables in partitions of batch and day: one batch or one day is read without the files of the others.

A batch is written over: running it again replaces its days, also those it no longer has, and no other batch. The
batch is empty while it is written, and stays so if the job is lost, until it runs again;
:mod:`touchline.sources.publish` has commits without that gap.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.operators.quality import require_columns

BATCH, DAY = "batch_id", "partition_day"
# The partition of rows without a time.
NO_DAY = dt.date(9999, 12, 31)


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def write_batch(df: DataFrame, table: str, batch_id: str, time_column: str) -> None:
    """Replace the rows of a batch, creating the table when absent. ``df`` must not read that table.

    Columns go by name and must be those of the table. Rows are dealt by day before writing: small days are
    packed into few tasks and a day of many rows is split over several.
    """
    require_columns(df, [time_column], "time")
    clash = [c for c in df.columns if c.lower() == DAY]
    if clash:
        raise ValueError(f"the partition column {clash[0]!r} is filled here")
    if not batch_id:
        raise ValueError("a batch needs an id")
    spark = df.sparkSession
    day = F.coalesce(F.to_date(F.col(f"`{time_column}`")), F.lit(NO_DAY))
    rows = df.drop(*[c for c in df.columns if c.lower() == BATCH]).withColumn(DAY, day)
    if not spark.catalog.tableExists(table):
        first = rows.withColumn(BATCH, F.lit(batch_id)).limit(0)
        first.write.partitionBy(BATCH, DAY).saveAsTable(table)
    own = [f.name for f in spark.table(table).schema.fields if f.name not in (BATCH, DAY)]
    require_columns(rows, own, "table")
    more = set(rows.columns) - {*own, DAY}
    if more:
        raise ValueError(f"table {table!r} has no columns {sorted(more)}")
    dealt = rows.select(*[f"`{c}`" for c in own], DAY).hint("rebalance", DAY)
    mode = "spark.sql.sources.partitionOverwriteMode"
    before = spark.conf.get(mode)
    spark.conf.set(mode, "static")  # every day of the batch goes, not only those that come back
    try:
        spark.sql(
            f"INSERT OVERWRITE TABLE {table} PARTITION ({BATCH} = {_quoted(batch_id)}, {DAY}) SELECT * FROM {{dealt}}", dealt=dealt
        )
    finally:
        spark.conf.set(mode, before)


def read_days(spark: SparkSession, table: str, first: dt.date, last: dt.date, batch_id: str | None = None) -> DataFrame:
    """Rows of the days from ``first`` to ``last``, of one batch or all: only their files are listed and read."""
    found = spark.table(table).where(F.col(DAY).between(F.lit(first), F.lit(last)))
    return found.where(F.col(BATCH) == batch_id) if batch_id is not None else found


def read_days_of(spark: SparkSession, table: str, wanted: DataFrame, day: str) -> DataFrame:
    """Rows of the days that ``wanted`` lists; the scan is pruned by them when it runs."""
    days = wanted.select(F.col(day).cast("date").alias(DAY)).distinct()
    return spark.table(table).join(days, DAY, "left_semi")
