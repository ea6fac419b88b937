"""What the operators share: scratch tables, batches of Python values, names that cannot clash."""

from __future__ import annotations

import sys
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

from touchline.session import scratch_path

# Worker functions travel with the job: executors need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Columns an operator adds for itself start with this, so that no column of a caller clashes.
OWN = "__llm_"
# Rows of a batch that are held as Python objects at one time.
SLICE_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` written to the shared folder and read back.

    Cuts the lineage: later jobs read files that every executor reaches, so a lost executor costs
    one task, and ids or samples drawn while writing are the same for every reader.
    """
    path = scratch_path(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_by(df: DataFrame, column: str, tasks: int, purpose: str) -> DataFrame:
    """Like :func:`stored`, in ``tasks`` buckets of ``column``: a join on it leaves these rows where they are.

    The table's name is needed for writing only and is taken back; its files stay in the shared folder.
    """
    spark, name = df.sparkSession, f"touchline_{purpose.replace('-', '_')}_{uuid.uuid4().hex}"
    df.write.bucketBy(tasks, column).option("path", scratch_path(spark, purpose)).saveAsTable(name)
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return table


def shuffle_tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def value_slices(batch: pa.RecordBatch, rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    for start in range(0, batch.num_rows, rows):
        yield batch.slice(start, rows)


def texts_of(column: pa.Array) -> list[str | None]:
    return column.to_pylist()


def bytes_of(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a text column."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()
