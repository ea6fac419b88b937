"""Catalog tables: scans with bound parameters, batch scoping, and the write modes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from touchline.operators.quality import NormalisationRules, normalise_types
from touchline.session import scratch_path


def read_table(
    spark: SparkSession,
    table: str,
    columns: Sequence[str] | None = None,
    where: str | None = None,
    params: Mapping[str, Any] | None = None,
) -> DataFrame:
    """Project and filter a table. ``where`` is a SQL condition with ``:name`` parameters.

    Both reach the scan: Spark binds the parameters as literals before planning.
    """
    if not table or not table.strip():
        raise ValueError("table name cannot be empty")
    listed = ", ".join(f"`{c}`" for c in columns) if columns else "*"
    query = f"SELECT {listed} FROM IDENTIFIER(:_table)"
    if where:
        query += f" WHERE {where}"
    return spark.sql(query, args={"_table": table.strip(), **(params or {})})


def scope_to_batch(df: DataFrame, batch_id: str | None = None, system_event_id: str | None = None) -> DataFrame:
    """Filter by batch and system event, each only where the frame has such a column (any case)."""
    actual = {c.lower(): c for c in df.columns}
    scoped = df
    for name, value in (("batch_id", batch_id), ("system_event_id", system_event_id)):
        if name in actual:
            column = actual[name]
            scoped = scoped.where(F.col(column) == F.lit(value).cast(df.schema[column].dataType))
    return scoped


def active_venues(venues: DataFrame) -> DataFrame:
    """venue, city, country of the active venues."""
    return venues.where(F.col("IsActive").cast("boolean")).select(
        F.col("VenueName").alias("venue"), F.col("City").alias("city"), F.col("Country").alias("country")
    )


def read_model_dataset(
    spark: SparkSession,
    table: str,
    columns: Sequence[str],
    rules: NormalisationRules = NormalisationRules(),
) -> DataFrame:
    """Exact projection of a model source followed by type normalisation."""
    return normalise_types(read_table(spark, table, columns), rules)


def create_table(spark: SparkSession, table: str, schema: T.StructType) -> None:
    if not spark.catalog.tableExists(table):
        spark.createDataFrame([], schema).write.saveAsTable(table)


_IN_TASK = (1 << 33) - 1


def _numbered(df: DataFrame, id_col: str, first_id: int) -> DataFrame:
    """``df`` with consecutive ids from ``first_id`` on, without a sort.

    The rows are written to the shared folder with their number inside the task that made them; a
    count for each task then says where its ids start.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "numbered")
    df.withColumn(id_col, F.monotonically_increasing_id()).write.parquet(path)
    rows = spark.read.parquet(path)
    task = F.shiftright(F.col(id_col), 33).cast("int")
    starts = []
    for number, count in rows.groupBy(task.alias("task")).count().orderBy("task").collect():  # one row a task
        starts.append((number, first_id))
        first_id += count
    offsets = F.broadcast(spark.createDataFrame(starts, "_task int, _start bigint"))
    numbered = rows.withColumn("_task", task).join(offsets, "_task")
    own = F.col("_start") + F.col(id_col).bitwiseAND(F.lit(_IN_TASK))
    return numbered.withColumn(id_col, own).select(id_col, *df.columns)


def _fit_to(target: T.StructType, df: DataFrame, first_id: int, id_col: str, stamp_col: str) -> DataFrame:
    """The target's columns by name; a missing id is numbered, a missing creation time stamped."""
    if id_col in target.names and id_col not in df.columns:
        df = _numbered(df, id_col, first_id)
    out = []
    for field in target.fields:
        if field.name in df.columns:
            value = F.col(field.name)
        elif field.name == stamp_col:
            value = F.current_timestamp()
        else:
            value = F.lit(None)
        out.append(value.cast(field.dataType).alias(field.name))
    return df.select(*out)


def _create_from(df: DataFrame, table: str, id_col: str, stamp_col: str) -> None:
    """A new table with the frame's rows, numbered and stamped as later appends will be."""
    if id_col and id_col not in df.columns:
        df = _numbered(df, id_col, 1)
    if stamp_col and stamp_col not in df.columns:
        df = df.withColumn(stamp_col, F.current_timestamp())
    df.write.saveAsTable(table)


def append_rows(df: DataFrame, table: str, id_col: str = "ID", stamp_col: str = "CreatedAt") -> None:
    """Append to a table, creating it when absent. An empty frame adds nothing.

    Columns are matched by name. Frames without the table's id column get consecutive new ids
    above the highest one in use. A table created here gets the id and the creation time as
    columns; pass empty names for a table without them.
    """
    if not isinstance(df, DataFrame):
        raise TypeError(f"append_rows expects a DataFrame, got {type(df).__name__}")
    spark = df.sparkSession
    if not spark.catalog.tableExists(table):
        _create_from(df, table, id_col, stamp_col)
        return
    target = spark.table(table)
    first_id = 0
    if id_col in target.columns and id_col not in df.columns:
        first_id = (target.agg(F.max(id_col)).first()[0] or 0) + 1
    _fit_to(target.schema, df, first_id, id_col, stamp_col).write.mode("append").saveAsTable(table)


def truncate_table(spark: SparkSession, table: str) -> None:
    spark.sql("TRUNCATE TABLE IDENTIFIER(:t)", args={"t": table})


def replace_rows(df: DataFrame, table: str, id_col: str = "ID", stamp_col: str = "CreatedAt") -> None:
    """Full reload in one step. The frame must not read the table it replaces."""
    if not isinstance(df, DataFrame):
        raise TypeError(f"replace_rows expects a DataFrame, got {type(df).__name__}")
    spark = df.sparkSession
    if not spark.catalog.tableExists(table):
        _create_from(df, table, id_col, stamp_col)
        return
    fitted = _fit_to(spark.table(table).schema, df, 1, id_col, stamp_col)
    fitted.write.insertInto(table, overwrite=True)
