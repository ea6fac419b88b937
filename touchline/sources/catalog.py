"""The schema catalog: table and column metadata that drives reads and validation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.operators.quality import ColumnRule

COLUMN_ATTRIBUTES = (
    "column_name",
    "data_type",
    "is_required",
    "ordinal_position",
    "max_length",
    "numeric_precision",
    "numeric_scale",
)


def without_schema(table: str) -> str:
    """``dbo.Name`` -> ``Name``."""
    return table.rsplit(".", 1)[-1]


def catalog_columns(
    tables: DataFrame,
    columns: DataFrame,
    table_name: str | None = None,
    integration_type: str | None = None,
    integration_provider: str | None = None,
) -> DataFrame:
    """Columns of the tables that match every given filter, in catalog order.

    ``tables``: id, table_name, integration_type, integration_provider.
    ``columns``: table_id and the column attributes.
    """
    filters = {
        "table_name": without_schema(table_name) if table_name else None,
        "integration_type": integration_type,
        "integration_provider": integration_provider,
    }
    given = {name: value for name, value in filters.items() if value}
    if not given:
        raise ValueError("at least one of table_name, integration_type, integration_provider is required")
    chosen = tables
    for name, value in given.items():
        chosen = chosen.where(F.col(name) == value)
    chosen = chosen.select("id", *filters)
    present = [c for c in COLUMN_ATTRIBUTES if c in columns.columns]
    return (
        chosen.join(columns.select("table_id", *present), chosen["id"] == columns["table_id"])
        .select(F.col("id").alias("table_id"), *filters, *present)
        .orderBy("table_id", "ordinal_position", "column_name")
    )


def column_rules(catalog: DataFrame) -> list[ColumnRule]:
    """Catalog rows as validation rules (one row per column of one table: driver-sized)."""
    rows = catalog.select("column_name", "data_type", "is_required").collect()
    return [ColumnRule(r["column_name"], r["data_type"], bool(r["is_required"])) for r in rows]
