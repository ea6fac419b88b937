"""The nine table-to-table jobs and the batch run over a work plan."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass
from itertools import groupby
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from touchline.operators.quality import ColumnRule, validate_source, validate_target
from touchline.plans import cleaning, features
from touchline.plans.ledger import (
    FAILED,
    INGESTED,
    RUNNING,
    SUCCEEDED,
    current_state,
    plan_events,
    roll_up,
    with_status,
    work_plan,
)
from touchline.session import ensure_checkpoint_dir
from touchline.sources.catalog import catalog_columns, column_rules
from touchline.sources.publish import PublishedTable
from touchline.sources.snapshots import parsed, read_snapshot, read_text
from touchline.sources.tables import (
    active_venues,
    append_rows,
    create_table,
    read_table,
    replace_rows,
    scope_to_batch,
    truncate_table,
)

HISTORY_SCHEMA = "id string, status string, error_message string, at timestamp, step int"
APPEND, TRUNCATE_FIRST, REPLACE = "append", "truncate first", "replace after validation"


@dataclass(frozen=True)
class Tables:
    """Table names a deployment may change."""

    # Default table names.
    venues: str = "RugbyVenues"
    international_teams: str = "InternationalRugbyTeams"
    league_teams: str = "URCRugbyTeams"
    international_results: str = "InternationalMatchResults"
    league_results: str = "URCMatchResults"
    schema_tables: str = "schema_tables"
    schema_columns: str = "schema_columns"
    ingestion_events: str = "ingestion_events"
    mappings: str = "preprocessing_source_target_mappings"
    events: str = "preprocessing_events"
    history: str = "event_history"
    # A shared folder: with it, jobs publish their targets there batch by batch (see
    # touchline.sources.publish), so a repeated job replaces its batch; without it they write catalog tables.
    published: str = ""


@dataclass(frozen=True)
class Job:
    transform: Callable[[SparkSession, DataFrame, Tables], DataFrame]
    write_mode: str


def _venues(spark: SparkSession, names: Tables) -> DataFrame:
    return active_venues(read_table(spark, names.venues, ["VenueName", "City", "Country", "IsActive"]))


def _with_venues(clean: Callable[[DataFrame, DataFrame], DataFrame]):
    return lambda spark, source, names: clean(source, _venues(spark, names))


def _results(feature_set: features.FeatureSet, teams_of: Callable[[Tables], str]):
    def build(spark: SparkSession, source: DataFrame, names: Tables) -> DataFrame:
        teams, venues = spark.table(teams_of(names)), read_table(spark, names.venues, ["VenueName"])
        return features.results_model_ready(source, teams, venues, feature_set)

    return build


def _fixtures(feature_set: features.FeatureSet, teams_of: Callable[[Tables], str], results_of: Callable[[Tables], str]):
    def build(spark: SparkSession, source: DataFrame, names: Tables) -> DataFrame:
        teams, venues = spark.table(teams_of(names)), read_table(spark, names.venues, ["VenueName"])
        history = spark.table(results_of(names))
        return features.fixtures_model_ready(source, history, teams, venues, feature_set)

    return build


def _international(names: Tables) -> str:
    return names.international_teams


def _league(names: Tables) -> str:
    return names.league_teams


JOBS: dict[str, Job] = {
    "historical_to_international_results": Job(lambda spark, df, names: cleaning.historical_to_results(df), APPEND),
    "scraped_to_international_results": Job(_with_venues(cleaning.scraped_to_international_results), APPEND),
    "scraped_to_international_fixtures": Job(_with_venues(cleaning.scraped_to_international_fixtures), TRUNCATE_FIRST),
    "scraped_to_league_results": Job(_with_venues(cleaning.scraped_to_league_results), APPEND),
    "scraped_to_league_fixtures": Job(_with_venues(cleaning.scraped_to_league_fixtures), TRUNCATE_FIRST),
    "international_results_to_model": Job(_results(features.INTERNATIONAL, _international), REPLACE),
    "international_fixtures_to_model": Job(
        _fixtures(features.INTERNATIONAL, _international, lambda names: names.international_results), TRUNCATE_FIRST
    ),
    "league_results_to_model": Job(_results(features.LEAGUE, _league), REPLACE),
    "league_fixtures_to_model": Job(
        _fixtures(features.LEAGUE, _league, lambda names: names.league_results), TRUNCATE_FIRST
    ),
}


def _rules(spark: SparkSession, names: Tables, **filters: str | None) -> list[ColumnRule]:
    found = catalog_columns(spark.table(names.schema_tables), spark.table(names.schema_columns), **filters)
    return column_rules(found)


def read_source(
    spark: SparkSession, event: Row | dict[str, Any], names: Tables, multi_line: bool = False
) -> tuple[DataFrame, list[ColumnRule], DataFrame | None]:
    """The event's source frame, its rules, and the text it was parsed from if it is a CSV snapshot.

    A batch-scoped table has no such text. ``multi_line`` is for snapshots with line breaks in quotes.
    """
    if event["source_table"]:
        rules = _rules(spark, names, table_name=event["source_table"])
        table = read_table(spark, event["source_table"])
        return scope_to_batch(table, event["batch_id"], event["system_event_id"]), rules, None
    rules = _rules(
        spark,
        names,
        integration_type=event["integration_type"],
        integration_provider=event["integration_provider"],
    )
    path = f"{event['container_name'].rstrip('/')}/{event['blob_path']}"
    if not rules:
        return read_snapshot(spark, path, None, multi_line), rules, None
    raw = read_text(spark, path, multi_line)
    return parsed(raw, rules), rules, raw


def _batch_name(event: Row | dict[str, Any]) -> str:
    """What a repeated run of the same work shares: the job, the batch and where its rows come from."""
    event = event.asDict() if isinstance(event, Row) else event
    return json.dumps([event.get(c) for c in ("pipeline_name", "batch_id", "source_table", "container_name", "blob_path")])


def run_job(
    spark: SparkSession, event: Row | dict[str, Any], names: Tables = Tables(), multi_line: bool = False
) -> int:
    """Read, validate, transform, validate, write. Returns the rows written (0: nothing to do).

    Source values that do not parse fail the validation, so no row is lost to a bad value.

    The transformed frame is validated and written from one cached evaluation. Into published
    tables a job writes under its own batch: run again after a failure, or by mistake, it replaces
    what it wrote before. They replace and truncate in one commit, so no reader sees a gap.
    """
    job = JOBS.get(event["pipeline_name"])
    if job is None:
        raise ValueError(f"There is no job named {event['pipeline_name']!r}")
    target = event["target_table"]
    store = PublishedTable(spark, f"{names.published.rstrip('/')}/{target}") if names.published else None
    if job.write_mode == TRUNCATE_FIRST:
        # Always, so that "no data today" leaves an empty table and no old fixtures.
        if store is None:
            truncate_table(spark, target)
        elif store.state().schema is not None:
            store.clear()
            store.register(target)
    source, source_rules, raw = read_source(spark, event, names, multi_line)
    if source.isEmpty():
        return 0
    validate_source(source, source_rules, raw)
    result = job.transform(spark, source, names).persist()
    try:
        rows = result.count()
        if rows == 0:
            return 0
        validate_target(result, _rules(spark, names, table_name=target))
        if store is not None:
            store.publish(result, _batch_name(event), replace=job.write_mode != APPEND)
            store.register(target)
        else:
            (replace_rows if job.write_mode == REPLACE else append_rows)(result, target)
        return rows
    finally:
        result.unpersist()


def run_batch(spark: SparkSession, names: Tables = Tables()) -> DataFrame:
    """Plan, record and run everything ingested but not yet processed; returns the batch outcomes.

    A failed job is recorded and the others still run. Status changes are appended once for each
    stage (execution order). Only plan rows reach the driver. An
    ingestion event with a recorded outcome is not planned again.
    """
    create_table(spark, names.history, T.StructType.fromDDL(HISTORY_SCHEMA))
    ensure_checkpoint_dir(spark)
    settled = spark.table(names.history).select("id")
    ingested = spark.table(names.ingestion_events).join(settled, "id", "left_anti")
    # Event ids are drawn per evaluation, so the plan is fixed before anything reads it.
    events = plan_events(work_plan(ingested, spark.table(names.mappings))).checkpoint()
    append_rows(events, names.events, id_col="", stamp_col="")
    batches = with_status(ingested, INGESTED).checkpoint()

    planned = events.orderBy("execution_order", "pipeline_name", "id").collect()
    for _, stage in groupby(planned, key=lambda event: event["execution_order"]):
        stage = list(stage)
        _record(spark, names, [(event["id"], RUNNING, None) for event in stage], 1)
        outcomes = []
        for event in stage:
            try:
                run_job(spark, event, names)
                outcomes.append((event["id"], SUCCEEDED, None))
            except Exception as problem:  # recorded; the other jobs still run
                outcomes.append((event["id"], FAILED, str(problem)))
        _record(spark, names, outcomes, 2)

    state = current_state(spark.table(names.history), tie="step").select("id", "status")
    children = events.drop("status").join(state, "id")
    outcome = roll_up(batches.select("id", "batch_id"), children).checkpoint()
    settled_now = outcome.select(
        "id",
        F.col("batch_status").alias("status"),
        "error_message",
        F.current_timestamp().alias("at"),
        F.lit(2).alias("step"),
    )
    append_rows(settled_now, names.history, id_col="", stamp_col="")
    return outcome


def _record(spark: SparkSession, names: Tables, changes: list[tuple[str, str, str | None]], step: int) -> None:
    """One append for all events of a stage."""
    rows = spark.createDataFrame(changes, "id string, status string, error_message string")
    stamped = rows.withColumns({"at": F.current_timestamp(), "step": F.lit(step)})
    append_rows(stamped.coalesce(1), names.history, id_col="", stamp_col="")
