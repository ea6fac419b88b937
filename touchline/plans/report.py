"""Daily predictions and the digest view."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.functions.text import percent_text, points_text
from touchline.sources.partitioned import DAY

# Digest columns in order.
DIGEST_COLUMNS = (
    "competition",
    "home_team",
    "away_team",
    "predicted_winner",
    "home_team_win_prob_pct",
    "predicted_margin",
)


@dataclass(frozen=True)
class ScoredTable:
    """Where the shared report columns are found in one results table."""

    table_name: str
    competition_col: str
    home_team_col: str
    away_team_col: str
    home_team_win_prob_col: str
    point_diff_col: str


def scored_tables(details: DataFrame) -> list[ScoredTable]:
    """The configured results tables (one row each)."""
    names = list(ScoredTable.__dataclass_fields__)
    return [ScoredTable(**row.asDict()) for row in details.select(*names).collect()]


def predictions_of(scored: DataFrame, where: ScoredTable, day: dt.date) -> DataFrame:
    """Rows scored on ``day`` in the shared shape.

    The half-open timestamp range reaches the scan; of a table partitioned by the day of ``ScoredAtUtc``
    only that day is read. The text columns are for display; the
    numbers stay beside them. A missing probability counts as an away win.
    """
    start = dt.datetime.combine(day, dt.time())
    end = start + dt.timedelta(days=1)
    if DAY in scored.columns:
        scored = scored.where(F.col(DAY) == F.lit(day))
    shared = scored.where((F.col("ScoredAtUtc") >= F.lit(start)) & (F.col("ScoredAtUtc") < F.lit(end))).select(
        F.lit(where.table_name).alias("table_name"),
        F.col(where.competition_col).alias("competition"),
        F.col(where.home_team_col).alias("home_team"),
        F.col(where.away_team_col).alias("away_team"),
        F.col(where.home_team_win_prob_col).cast("double").alias("home_team_win_prob"),
        F.col(where.point_diff_col).cast("double").alias("point_diff"),
    )
    winner = F.when(F.col("home_team_win_prob") >= 0.5, F.col("home_team")).otherwise(F.col("away_team"))
    return shared.withColumns(
        {
            "predicted_winner": winner,
            "home_team_win_prob_pct": percent_text("home_team_win_prob"),
            "predicted_margin": points_text(F.abs("point_diff")),
        }
    )


def daily_predictions(tables: Iterable[tuple[DataFrame, ScoredTable]], day: dt.date) -> DataFrame:
    """All results tables' predictions of one day."""
    parts = [predictions_of(df, where, day) for df, where in tables]
    if not parts:
        raise ValueError("no scored tables configured")
    return reduce(DataFrame.unionByName, parts)


def digest(predictions: DataFrame) -> DataFrame:
    """The preferred columns that exist, in their fixed order; all columns when none exists."""
    kept = [c for c in DIGEST_COLUMNS if c in predictions.columns]
    leading = ["table_name"] if kept and "table_name" in predictions.columns else []
    return predictions.select(*leading, *kept) if kept else predictions


def digest_sections(predictions: DataFrame) -> DataFrame:
    """Row count per table; tables without rows do not appear."""
    return predictions.groupBy("table_name").agg(F.count("*").alias("rows"))
