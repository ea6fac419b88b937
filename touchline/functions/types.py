"""Logical column types as used by the schema catalog."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from touchline.functions.text import strip

_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_TEMPORAL = (T.DateType, T.TimestampType, T.TimestampNTZType)

# Logical type names of the schema catalog.
NUMERIC_NAMES = ("float", "double", "numeric", "decimal")
BOOLEAN_NAMES = ("bool", "bit")
TEMPORAL_NAMES = ("date", "time", "datetime")


def logical_name(expected: str | None) -> str | None:
    return None if expected is None else str(expected).strip().lower()


def type_matches(actual: T.DataType, expected: str | None) -> bool:
    """Whether a Spark type satisfies a logical type; unknown names never match.

    For ``bool``/``bit`` an integral column is provisionally accepted: its values still
    have to be checked with :func:`needs_zero_one_check`.
    """
    name = logical_name(expected)
    if name == "string":
        return isinstance(actual, (T.StringType, T.VarcharType, T.CharType))
    if name == "int":
        return isinstance(actual, _INTEGRAL)
    if name in NUMERIC_NAMES:
        return isinstance(actual, T.NumericType)
    if name in BOOLEAN_NAMES:
        return isinstance(actual, (T.BooleanType, *_INTEGRAL))
    if name in TEMPORAL_NAMES:
        return isinstance(actual, (*_TEMPORAL, T.StringType))
    return False


def needs_zero_one_check(actual: T.DataType, expected: str | None) -> bool:
    return logical_name(expected) in BOOLEAN_NAMES and isinstance(actual, _INTEGRAL)


def spark_type(expected: str | None) -> T.DataType:
    """The Spark type a logical name is read as (CSV snapshots, empty tables)."""
    name = logical_name(expected)
    if name == "int":
        return T.LongType()
    if name in NUMERIC_NAMES:
        return T.DoubleType()
    if name in BOOLEAN_NAMES:
        return T.BooleanType()
    if name == "datetime":
        return T.TimestampType()
    if name == "date":
        return T.TimestampType()
    return T.StringType()


def number_of(text: Column) -> Column:
    """Text as a double, null where it does not parse.

    ``NaN`` is no value, and the Java literal suffixes (``1d``, ``1f``) are no numbers.
    """
    plain = strip(text)
    value = F.when(~plain.rlike("[0-9.][dDfF]$"), plain.try_cast("double"))
    return F.when(~F.isnan(value), value)


def parse_text(text: Column, expected: str | None) -> Column:
    """Text as the Spark type of a logical name, null where it does not parse.

    ``20.0`` is a whole number; booleans are written 0, 1, false or true.
    """
    name = logical_name(expected)
    if name == "int":
        whole = F.regexp_extract(strip(text), r"^([+-]?[0-9]+)(?:\.0*)?$", 1)
        return F.nullif(whole, F.lit("")).try_cast("bigint")
    if name in NUMERIC_NAMES:
        return number_of(text)
    if name in BOOLEAN_NAMES:
        plain = F.lower(strip(text))
        return F.when(plain.isin("1", "1.0", "true"), True).when(plain.isin("0", "0.0", "false"), False)
    if name in ("date", "datetime"):
        return F.try_to_timestamp(strip(text))
    return text


def logical_of(kind: T.DataType) -> str:
    """The logical name whose texts are read as values of a Spark type."""
    if isinstance(kind, _INTEGRAL):
        return "int"
    if isinstance(kind, T.NumericType):
        return "float"
    if isinstance(kind, T.BooleanType):
        return "bool"
    return "datetime" if isinstance(kind, _TEMPORAL) else "string"
