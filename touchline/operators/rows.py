"""Row selection: allow-lists, distinct, null dropping, first-wins and latest-wins picks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def keep_allowed(df: DataFrame, column: str, allowed: Sequence[str]) -> DataFrame:
    """Exact, case-sensitive allow-list; reaches the scan as an ``In`` filter."""
    return df.where(F.col(column).isin(list(allowed)))


def distinct_rows(df: DataFrame) -> DataFrame:
    """Full-row distinct. Copies collapse map-side before the shuffle, so a hot group is harmless."""
    return df.dropDuplicates()


def drop_null_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    if not columns:
        raise ValueError("name at least one column that must not be null")
    return df.dropna(subset=list(columns))


def without_columns(df: DataFrame, *columns: str) -> DataFrame:
    """Drop audit or leakage columns; absent names are ignored."""
    return df.drop(*columns)


def keep_first(df: DataFrame, key: str, order: Sequence[Column | str]) -> DataFrame:
    """One row per key, the first by ``order``; null keys count as one key.

    ``row_number() = 1`` lets Spark place a group limit before the shuffle: every map task
    sends at most one row per key, so a key holding a third of the rows stays small.
    """
    ordered = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_pick", F.row_number().over(ordered)).where("_pick = 1").drop("_pick")


def latest_per_key(df: DataFrame, keys: Sequence[str], version: str, tie: Sequence[Column | str] = ()) -> DataFrame:
    """The row with the highest version for every key (same map-side limit as above).

    Equal versions are settled by ``tie``, by default by all other columns that have an order.
    """
    rest = tie or [f.name for f in df.schema.fields if f.name not in (*keys, version) and not isinstance(f.dataType, T.MapType)]
    ordered = Window.partitionBy(*keys).orderBy(F.col(version).desc_nulls_last(), *rest)
    return df.withColumn("_pick", F.row_number().over(ordered)).where("_pick = 1").drop("_pick")


def next_version(df: DataFrame, key: str, version: str, keys: DataFrame | None = None) -> DataFrame:
    """Highest version plus one for every key; keys never seen before start at 1."""
    known = df.groupBy(key).agg(F.max(version).alias("_seen"))
    frame = known if keys is None else keys.select(key).distinct().join(known, key, "left")
    return frame.select(key, (F.coalesce("_seen", F.lit(0)) + 1).cast("long").alias("next_version"))


def keep_timed(df: DataFrame, column: str) -> DataFrame:
    """Rows that carry a kick-off time, i.e. fixtures in a fixtures-plus-results frame."""
    return df.where(F.col(column).isNotNull())


def exclude_completed(df: DataFrame, kind: str = "integration_type", state: str = "state") -> DataFrame:
    """Drop full-time rows from fixture feeds; result feeds keep them."""
    finished_fixture = F.col(kind).eqNullSafe(F.lit("fixtures")) & F.col(state).eqNullSafe(F.lit("FT"))
    return df.where(~finished_fixture)
