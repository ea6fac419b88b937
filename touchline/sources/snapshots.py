"""Raw CSV snapshots, laid out as ``<root>/<type>/<provider>/<dataset>``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from touchline.functions.types import logical_of, parse_text, spark_type
from touchline.operators.quality import ColumnRule


def snapshot_path(root: str, kind: str, provider: str, dataset: str) -> str:
    return f"{root.rstrip('/')}/{kind}/{provider}/{dataset}"


# Fixed value: the one provider of historical results.
HISTORICAL_PROVIDER = "kaggle"

# CSV as other tools write and read it: quotes doubled, padding kept, blank means null.
_FORMAT = {
    "header": True,
    "escape": '"',
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
    "emptyValue": "",
}


def write_snapshot(df: DataFrame, root: str, kind: str, provider: str, dataset: str) -> str:
    """Write the frame as header CSV, replacing an earlier snapshot of the same dataset."""
    path = snapshot_path(root, kind, provider, dataset)
    df.write.mode("overwrite").options(**_FORMAT).csv(path)
    return path


def schema_from_rules(rules: Sequence[ColumnRule]) -> T.StructType:
    """Read schema of a source, from its catalog entry."""
    return T.StructType([T.StructField(r.name, spark_type(r.data_type), not r.required) for r in rules])


def read_text(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Every column of a snapshot as text, blanks as null.

    Files are read in parallel pieces. ``multi_line`` allows line breaks inside quotes, at the
    price of one task a file.
    """
    return spark.read.options(**_FORMAT, multiLine=multi_line).csv(path)


def parsed(raw: DataFrame, rules: Sequence[ColumnRule]) -> DataFrame:
    """The rules' columns in their types, matched by name; text that does not parse becomes null.

    Only for text that was checked: see :func:`touchline.operators.quality.rejected_values`.
    """
    return raw.select(*[parse_text(F.col(r.name), r.data_type).alias(r.name) for r in rules if r.name in raw.columns])


def read_snapshot(
    spark: SparkSession, path: str, schema: T.StructType | None = None, multi_line: bool = False
) -> DataFrame:
    """Read a snapshot. With a schema there is one pass; without, types are inferred first.

    The schema is matched to the header by name, so columns may come in any order and extra
    columns of the file are not read. A value that its type cannot hold is an error.
    """
    if schema is None:
        return spark.read.options(**_FORMAT, multiLine=multi_line).option("inferSchema", True).csv(path)
    raw = read_text(spark, path, multi_line)

    def typed(field: T.StructField) -> Column:
        text = F.col(field.name)
        value = parse_text(text, logical_of(field.dataType)).cast(field.dataType)
        message = F.concat(F.lit(f"{field.name} is no {field.dataType.simpleString()}: "), text)
        return F.when(text.isNotNull() & value.isNull(), F.raise_error(message)).otherwise(value).alias(field.name)

    return raw.select(*[typed(f) for f in schema.fields if f.name in raw.columns])


def read_historical(
    spark: SparkSession, landed: str, provider: str, dataset: str, multi_line: bool = False
) -> tuple[DataFrame, str]:
    """The landed historical results file and its dataset name."""
    if provider != HISTORICAL_PROVIDER:
        raise ValueError(f"No historical data is known from provider {provider!r}")
    return read_snapshot(spark, f"{landed.rstrip('/')}/results.csv", multi_line=multi_line), dataset
