"""Reference-table joins: venue geography, canonical names, team attributes.

No broadcast hint is used. A reference table under ``spark.sql.autoBroadcastJoinThreshold``
(checked against statistics, and by AQE against real shuffle sizes) is broadcast by Spark; a
larger one becomes a sort-merge join whose hot keys AQE splits.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.functions.text import name_key

TEAM_FEATURES = ("Home_Tier", "Away_Tier", "Diff_Tier", "Home_Hemisphere", "Away_Hemisphere")


def add_city_and_country(
    df: DataFrame,
    venues: DataFrame,
    venue: str = "venue",
    city: str = "city",
    country: str = "country",
) -> DataFrame:
    """Left lookup of city and country by venue key; unmatched venues get nulls.

    ``venues`` has columns venue, city, country. A key listed twice is an error.
    """
    lookup = (
        venues.groupBy(name_key("venue").alias("_venue_key"))
        .agg(
            F.count("*").alias("_copies"),
            F.max("city").alias(city),
            F.max("country").alias(country),
        )
        .where(F.col("_venue_key").isNotNull())
        .withColumn(
            "_venue_key",
            F.when(
                F.col("_copies") > 1,
                F.raise_error(F.concat(F.lit("venue listed more than once: "), "_venue_key")),
            ).otherwise(F.col("_venue_key")),
        )
        .drop("_copies")
    )
    keyed = df.drop(city, country).withColumn("_venue_key", name_key(venue))
    return keyed.join(lookup, "_venue_key", "left").drop("_venue_key")


def _canonical_keys(reference: DataFrame, name: str, what: str) -> DataFrame:
    if name not in reference.columns or reference.isEmpty():
        raise ValueError(f"the table of {what} needs rows and a {name} column")
    return reference.select(name_key(name).alias("_known")).where("_known is not null")


def keep_canonical(
    df: DataFrame, reference: DataFrame, columns: Sequence[str], name: str, what: str
) -> DataFrame:
    """Keep rows whose every listed column names an entry of the reference table."""
    known = _canonical_keys(reference, name, what)
    kept = df
    for index, column in enumerate(columns):
        side = known.withColumnRenamed("_known", f"_known_{index}")
        kept = kept.join(side, name_key(kept[column]) == side[f"_known_{index}"], "left_semi")
    return kept


def keep_canonical_teams(
    df: DataFrame, teams: DataFrame, home: str = "HomeTeam", away: str = "AwayTeam", name: str = "TeamName"
) -> DataFrame:
    """Keep matches whose both sides are known teams (null teams go too)."""
    return keep_canonical(df, teams, (home, away), name, "teams")


def keep_canonical_venues(
    df: DataFrame, venues: DataFrame, venue: str = "Venue", name: str = "VenueName"
) -> DataFrame:
    """Keep matches at known venues, active or not."""
    return keep_canonical(df, venues, (venue,), name, "venues")


def rejected_names(
    df: DataFrame, reference: DataFrame, columns: Sequence[str], name: str, what: str = "names"
) -> DataFrame:
    """Sorted distinct names of ``columns`` that the reference table does not know."""
    known = _canonical_keys(reference, name, what)
    seen = (
        df.dropna(subset=list(columns))
        .select(F.explode(F.array(*[name_key(c) for c in columns])).alias("rejected"))
        .distinct()
    )
    return seen.join(known, seen["rejected"] == known["_known"], "left_anti").orderBy("rejected")


def team_attributes(
    teams: DataFrame,
    attributes: Sequence[str],
    name: str = "TeamName",
    order: Sequence[str | Column] = (),
) -> DataFrame:
    """One row per team key: the first by ``order`` (default: by name and attributes)."""
    ranking = F.struct(*(order or [F.col(name), *[F.col(a) for a in attributes]]))
    first = F.min_by(F.struct(*attributes), ranking)
    return (
        teams.where(F.col(name).isNotNull())
        .groupBy(name_key(name).alias("_team_key"))
        .agg(first.alias("_first"))
        .select("_team_key", "_first.*")
    )


def add_team_features(
    df: DataFrame,
    teams: DataFrame,
    with_tier: bool,
    home: str = "HomeTeam",
    away: str = "AwayTeam",
    name: str = "TeamName",
    order: Sequence[str | Column] = (),
) -> DataFrame:
    """Home_/Away_ team attributes (and Diff_Tier); never drops rows.

    ``with_tier`` is the international feature set; the league set has the hemisphere only.
    An empty team table leaves the frame as it is.
    """
    if name not in teams.columns or teams.isEmpty():
        return df
    wanted = [c for c in (("Tier", "Hemisphere") if with_tier else ("Hemisphere",)) if c in teams.columns]
    prepared = teams.select(
        name,
        *[o for o in order if isinstance(o, str) and o not in (name, *wanted)],
        *[
            F.col("Tier").try_cast("long").alias("Tier") if c == "Tier" else name_key(c).alias(c)
            for c in wanted
        ],
    )
    attributes = team_attributes(prepared, wanted, name, order)
    out = df.drop(*TEAM_FEATURES)
    for side, column in (("Home", home), ("Away", away)):
        renamed = attributes.select(
            F.col("_team_key").alias(f"_{side}_key"), *[F.col(c).alias(f"{side}_{c}") for c in wanted]
        )
        out = out.join(renamed, name_key(out[column]) == renamed[f"_{side}_key"], "left").drop(f"_{side}_key")
    if "Tier" in wanted:
        out = out.withColumn("Diff_Tier", F.col("Home_Tier") - F.col("Away_Tier"))
    added = [c for c in TEAM_FEATURES if c in out.columns]
    return out.select(*[c for c in df.columns if c not in added], *added)
