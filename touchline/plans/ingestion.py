"""Incremental ingestion: which dates to fetch, and bronze from stored pages."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.functions.dates import days_between, timestamp_of
from touchline.sources.pages import scrape
from touchline.sources.snapshots import write_snapshot

# Fixed value: first date fetched when nothing has been ingested yet.
BOOTSTRAP = dt.date(2025, 10, 1)
# Ledger states that count as fetched.
FETCHED_STATES = ("ingested", "preprocessed", "preprocessing")


def date_spine(bounds: DataFrame, first: str, last: str) -> DataFrame:
    """One row per date from ``first`` to ``last`` (inclusive) of each row of ``bounds``."""
    return bounds.select(F.explode(days_between(F.col(first), F.col(last))).alias("day"))


def high_water(
    ledger: DataFrame,
    provider: str = "integration_provider",
    kind: str = "integration_type",
    status: str = "status",
    created: str = "created_at",
) -> DataFrame:
    """Newest fetch per (provider, type); a feed without one is absent. Times may be text."""
    newest = F.max(timestamp_of(ledger, created)).alias("high_water")
    return ledger.where(F.col(status).isin(*FETCHED_STATES)).groupBy(provider, kind).agg(newest)


def fetch_ranges(ledger: DataFrame, feeds: DataFrame, today: dt.date, bootstrap: dt.date = BOOTSTRAP) -> DataFrame:
    """provider, type, first and last date to fetch, dataset name, for every feed.

    Starts on the date of the newest fetch, or on ``bootstrap``.
    """
    keys = ["integration_provider", "integration_type"]
    known = feeds.select(*keys).distinct().join(high_water(ledger), keys, "left")
    dated = known.select(
        *keys,
        F.coalesce(F.col("high_water").cast("date"), F.lit(bootstrap)).alias("first_day"),
        F.lit(today).alias("last_day"),
    )
    name = F.concat_ws(
        "_",
        *keys,
        F.date_format("first_day", "yyyy-MM-dd"),
        F.lit("to"),
        F.date_format("last_day", "yyyy-MM-dd"),
    )
    return dated.withColumn("dataset", name)


def fetch_days(ranges: DataFrame) -> DataFrame:
    """Every (provider, type, day) to fetch."""
    days = F.explode(days_between(F.col("first_day"), F.col("last_day"))).alias("day")
    return ranges.select("integration_provider", "integration_type", days)


def ingest_pages(
    pages: DataFrame, kind: str, provider: str, dates: DataFrame, dataset: str, root: str
) -> str:
    """Extract, deduplicate and land one CSV snapshot; nothing found is an error. Returns its path."""
    records = scrape(pages, kind, provider, dates).persist()
    try:
        if records.isEmpty():
            raise ValueError(f"the pages of {provider} gave no {kind}")
        return write_snapshot(records, root, kind, provider, dataset)
    finally:
        records.unpersist()
