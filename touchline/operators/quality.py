"""Validation against a logical schema, and column profiling with type normalisation."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from touchline.functions.text import blank_to_null
from touchline.functions.types import needs_zero_one_check, number_of, parse_text, type_matches


@dataclass(frozen=True)
class ColumnRule:
    name: str
    data_type: str | None
    required: bool = False


def validate(df: DataFrame, rules: Sequence[ColumnRule], what: str = "Transformed data") -> None:
    """Raise ValueError unless the frame is non-empty and fits the rules. Extra columns are fine.

    Names and types are compared on the driver; integral columns declared boolean cost one
    aggregate over just those columns.
    """
    if df.isEmpty():
        raise ValueError(f"{what} holds no rows")
    present = {field.name: field.dataType for field in df.schema.fields}
    for rule in rules:
        if rule.required and rule.name not in present:
            raise ValueError(f"{what} lacks the required column {rule.name!r}")
    flags = []
    for rule in rules:
        actual = present.get(rule.name)
        if actual is None or not rule.data_type:
            continue
        if not type_matches(actual, rule.data_type):
            raise ValueError(_mismatch(what, rule, actual))
        if needs_zero_one_check(actual, rule.data_type):
            flags.append(rule)
    if not flags:
        return
    wrong = {r["column_name"] for r in validation_report(df, flags).where("outside_zero_one > 0").collect()}
    for rule in flags:
        if rule.name in wrong:
            raise ValueError(_mismatch(what, rule, present[rule.name]))


def validation_report(df: DataFrame, rules: Sequence[ColumnRule]) -> DataFrame:
    """One row per rule: presence, type match, nulls and values outside {0, 1} for boolean rules."""
    present = {field.name: field.dataType for field in df.schema.fields}

    def line(rule: ColumnRule) -> Column:
        actual = present.get(rule.name)
        known = actual is not None
        flagged = known and needs_zero_one_check(actual, rule.data_type)
        outside = F.count(F.when(~F.col(rule.name).isin(0, 1), 1)) if flagged else F.lit(0)
        nulls = F.count("*") - F.count(rule.name) if known else F.count("*")
        return F.struct(
            F.lit(rule.name).alias("column_name"),
            F.lit(rule.data_type).alias("data_type"),
            F.lit(rule.required).alias("is_required"),
            F.lit(known).alias("is_present"),
            F.lit(known and type_matches(actual, rule.data_type)).alias("type_ok"),
            nulls.alias("nulls"),
            outside.cast("bigint").alias("outside_zero_one"),
        )

    return df.agg(F.array(*[line(r) for r in rules]).alias("report")).select(F.inline("report"))


def _mismatch(what: str, rule: ColumnRule, actual: T.DataType) -> str:
    return (
        f"{what}: column {rule.name!r} is declared {rule.data_type} but holds {actual.simpleString()} values that do not fit"
    )


def rejected_values(raw: DataFrame, rules: Sequence[ColumnRule]) -> DataFrame:
    """One row per rule with a column in ``raw`` (text): how many values do not parse, and one of them."""

    def line(rule: ColumnRule) -> Column:
        text = F.col(rule.name)
        bad = text.isNotNull() & parse_text(text, rule.data_type).isNull()
        return F.struct(
            F.lit(rule.name).alias("column_name"),
            F.lit(rule.data_type).alias("data_type"),
            F.count(F.when(bad, 1)).alias("rejected"),
            F.min(F.when(bad, text)).alias("example"),
        )

    lines = [line(r) for r in rules if r.name in raw.columns]
    empty = "column_name string, data_type string, rejected bigint, example string"
    if not lines:
        return raw.sparkSession.createDataFrame([], empty)
    return raw.agg(F.array(*lines).alias("lines")).select(F.inline("lines"))


def validate_source(df: DataFrame, rules: Sequence[ColumnRule], raw: DataFrame | None = None) -> None:
    """As :func:`validate`; with ``raw``, the text that ``df`` was parsed from, every value must have parsed."""
    if raw is not None:
        for bad in rejected_values(raw, rules).where("rejected > 0").collect():
            raise ValueError(
                f"Source data: {bad['rejected']} values of column {bad['column_name']!r} are no {bad['data_type']}, "
                f"e.g. {bad['example']!r}"
            )
    validate(df, rules, "Source data")


def validate_target(df: DataFrame, rules: Sequence[ColumnRule]) -> None:
    validate(df, rules, "Transformed data")


def require_columns(df: DataFrame, columns: Iterable[str], what: str) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"The frame lacks {what} columns {missing}")


def schema_hash(columns: Sequence[str]) -> str:
    """Order-insensitive fingerprint of a column list."""
    if not columns:
        raise ValueError("a fingerprint needs at least one column")
    return hashlib.sha256("|".join(sorted(columns)).encode("utf-8")).hexdigest()


def schema_fingerprint(names: Column) -> Column:
    """The same fingerprint for an array column of names; an empty list is an error."""
    text = F.concat_ws("|", F.array_sort(names))
    empty = F.raise_error(F.lit("a fingerprint needs at least one column"))
    return F.when(F.size(names) == 0, empty).otherwise(F.sha2(text, 256))


# ---- profiling -------------------------------------------------------------------------


@dataclass(frozen=True)
class NormalisationRules:
    numeric_share: float = 0.95
    max_categories: int = 50
    category_share: float = 0.5


NUMBER, CATEGORY, TEXT = "number", "category", "text"


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def as_number(column: str) -> Column:
    """A text column as a double, null where it does not parse."""
    return number_of(F.col(column))


def distinct_up_to(column: str, most: int) -> Column:
    """Aggregate: the number of distinct non-null texts, exact up to ``most`` and greater than it beyond.

    A theta sketch keeps the smallest 64-bit hashes: all of them until there are more than its size, which is
    above ``most``. Then it estimates, and as it still holds that many hashes of a part of the range, the
    estimate is larger than its size. Sketches merge, so one pass does it with bounded state.
    """
    size = max(4, most.bit_length())
    marked = F.concat(F.lit("="), F.col(f"`{column}`"))  # a sketch passes over empty text
    return F.theta_sketch_estimate(F.theta_sketch_agg(marked, size))


def profile_text_columns(
    df: DataFrame, columns: Sequence[str] | None = None, most: int = NormalisationRules().max_categories
) -> DataFrame:
    """One row per text column: rows, non-null values, parseable numbers, distinct values (exact up to ``most``).

    A single pass, unpivoted afterwards.
    """
    names = list(columns) if columns is not None else text_columns(df)
    per_column = [
        F.struct(
            F.lit(name).alias("column_name"),
            F.count("*").alias("rows"),
            F.count(name).alias("non_null"),
            F.count(as_number(name)).alias("numeric"),
            distinct_up_to(name, most).alias("distinct_values"),
        )
        for name in names
    ]
    return df.agg(F.array(*per_column).alias("profile")).select(F.inline("profile"))


def classify_text_columns(df: DataFrame, rules: NormalisationRules = NormalisationRules()) -> dict[str, str]:
    """number, category or text for every text column of the frame."""
    names = text_columns(df)
    if not names:
        return {}
    kinds = {name: TEXT for name in names}
    for row in profile_text_columns(df, names, rules.max_categories).collect():  # one a column
        distinct = row["distinct_values"] or 0
        if row["numeric"] and row["numeric"] / row["rows"] >= rules.numeric_share:
            kinds[row["column_name"]] = NUMBER
        elif row["non_null"] and distinct <= rules.max_categories and distinct / row["rows"] <= rules.category_share:
            kinds[row["column_name"]] = CATEGORY
    return kinds


def normalise_types(
    df: DataFrame, rules: NormalisationRules = NormalisationRules(), kinds: dict[str, str] | None = None
) -> DataFrame:
    """Decimals to double, dates to timestamps, mostly-numeric text to double, blank text to null.

    Category columns stay text (they are indexed where a model needs it). ``kinds`` skips the
    profiling pass when the classification is already known.
    """
    if kinds is None:
        kinds = classify_text_columns(df, rules)
    changed = {}
    for field in df.schema.fields:
        if isinstance(field.dataType, T.DecimalType):
            changed[field.name] = F.col(field.name).cast("double")
        elif isinstance(field.dataType, T.DateType):
            changed[field.name] = F.col(field.name).cast("timestamp")
        elif kinds.get(field.name) == NUMBER:
            changed[field.name] = as_number(field.name)
        elif kinds.get(field.name) == TEXT:
            changed[field.name] = blank_to_null(field.name)
    return df.withColumns(changed) if changed else df
