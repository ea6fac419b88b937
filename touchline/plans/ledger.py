"""Run ledger: append-only status history, current state, work plans, roll-ups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Event states and the roll-up message.
STARTED, RUNNING, SUCCEEDED, FAILED = "started", "running", "succeeded", "failed"
INGESTED, PREPROCESSED, NOT_PREPROCESSED = "ingested", "preprocessed", "failed to preprocess"
BATCH_FAILURE = "Preprocessing failed for some preprocessing events for this batch"

PLAN_COLUMNS = (
    "batch_id",
    "system_event_id",
    "integration_type",
    "integration_provider",
    "container_name",
    "blob_path",
    "source_table",
    "target_table",
    "pipeline_name",
    "execution_order",
)


def with_status(events: DataFrame, status: str, column: str = "status") -> DataFrame:
    return events.where(F.col(column) == status)


def current_state(
    history: DataFrame, key: str = "id", at: str = "at", values: Sequence[str] = ("status", "error_message"),
    tie: str | None = None,
) -> DataFrame:
    """Latest values per event of an append-only history.

    ``max_by`` combines map-side, so an event with a very long history is no hot spot.
    ``tie`` orders entries written at the same instant.
    """
    order: Column = F.struct(at, tie) if tie else F.col(at)
    latest = F.max_by(F.struct(at, *values), order)
    return history.groupBy(key).agg(latest.alias("_latest")).select(key, "_latest.*")


def transition(events: DataFrame, status: str, key: str = "id", error: str | None = None) -> DataFrame:
    """History rows recording that the given events reached a state now."""
    return events.select(
        key,
        F.lit(status).alias("status"),
        F.lit(error).cast("string").alias("error_message"),
        F.current_timestamp().alias("at"),
    )


def work_plan(ingested: DataFrame, mappings: DataFrame) -> DataFrame:
    """Every ingested source with each of its mapped targets.

    One join on (provider, type) in place of a query per source. The order to run in is
    ``execution_order``, ``pipeline_name`` within a source; sort when listing.
    """
    keys = [
        ingested["integration_provider"] == mappings["source_provider"],
        ingested["integration_type"] == mappings["source_type"],
    ]
    return with_status(ingested, INGESTED).join(mappings, keys).select(
        *[mappings[c] if c in mappings.columns else ingested[c] for c in PLAN_COLUMNS]
    )


def plan_events(plan: DataFrame) -> DataFrame:
    """Plan rows as started events with fresh ids. Write before use: ids are drawn per evaluation."""
    return plan.select(
        F.expr("uuid()").alias("id"), *plan.columns, F.lit(STARTED).alias("status"),
        F.lit(None).cast("string").alias("error_message"),
    )


def roll_up(batches: DataFrame, events: DataFrame, key: str = "batch_id", status: str = "status") -> DataFrame:
    """preprocessed when every child event succeeded (or there is none), else failed with a message."""
    outcome = events.groupBy(key).agg(
        F.min(F.coalesce((F.col(status) == SUCCEEDED), F.lit(False)).cast("int")).alias("_all")
    )
    done = F.coalesce(F.col("_all"), F.lit(1)) == 1
    return batches.join(outcome, key, "left").select(
        *batches.columns,
        F.when(done, PREPROCESSED).otherwise(NOT_PREPROCESSED).alias("batch_status"),
        F.when(~done, BATCH_FAILURE).alias("error_message"),
    )
