"""Vectors in tables: which take part, which are equal, and their bytes inside tasks."""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from touchline.llm.common import OWN

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def usable(vector: Column) -> Column:
    """Not null, not zero, and every component finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def one_per_id(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, vec): the usable vectors of the most frequent length, one for each id that is not null.

    Of rows that repeat an id the smallest usable vector counts.
    """
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vec"))
    rows = rows.where(F.col("id").isNotNull() & usable(F.col("vec")))
    length = rows.groupBy(F.size("vec").alias("length")).count().orderBy(F.desc("count"), "length").first()
    rows = rows.where(F.size("vec") == (length["length"] if length else 0))
    return rows.groupBy("id").agg(F.min("vec").alias("vec"))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column without nulls, in double precision."""
    if not len(column):
        return np.empty((0, 0))
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.sqrt(np.sum(rows * rows, axis=1, keepdims=True)) if len(rows) else rows


def vector_type(df: DataFrame, name: str = "vec") -> T.DataType:
    return df.schema[name].dataType


def own(name: str) -> str:
    return f"{OWN}{name}"
