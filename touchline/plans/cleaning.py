"""Raw records to clean match tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from touchline.functions.dates import kickoff_timestamp, midnight, timestamp_of
from touchline.functions.text import contains_ignore_case, neutral_flag
from touchline.operators.lookups import add_city_and_country
from touchline.operators.rows import distinct_rows, drop_null_rows, keep_allowed

# Competitions admitted to each match table.
INTERNATIONAL_COMPETITIONS = (
    "Rugby Championship",
    "Internationals",
    "Six Nations",
    "Rugby World Cup",
    "Pacific Nations Cup",
    "Rugby Europe Championship",
)
LEAGUE_COMPETITIONS = ("United Rugby Championship",)

# Columns that must not be null.
HISTORICAL_REQUIRED = (
    "date", "home_team", "away_team", "home_score", "away_score", "competition", "neutral", "world_cup",
)
RESULT_REQUIRED = ("match_date", "home_team", "away_team", "home_score", "away_score", "competition_name")
FIXTURE_REQUIRED = ("kickoff_time_local", "match_date", "home_team", "away_team", "competition_name")


def whole_number(df: DataFrame, name: str) -> Column:
    """As bigint; a fractional value is an error, never truncated."""
    if isinstance(df.schema[name].dataType, T.IntegralType):
        return F.col(name).cast("bigint")
    value = F.col(name).cast("double")
    message = F.concat(F.lit(f"{name} is not a whole number: "), F.col(name).cast("string"))
    return F.when(value != F.floor(value), F.raise_error(message)).otherwise(value.cast("bigint"))


def truth(df: DataFrame, name: str) -> Column:
    """As boolean: numbers by being non-zero, text by its meaning ("False" is false)."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.BooleanType):
        return F.col(name)
    if isinstance(kind, T.NumericType):
        return F.col(name) != 0
    text = F.col(name)
    return F.coalesce(text.try_cast("boolean"), text.try_cast("double") != 0, F.lit(True))


def historical_to_results(source: DataFrame) -> DataFrame:
    """Bulk historical results file to the international results layout."""
    df = drop_null_rows(distinct_rows(source), HISTORICAL_REQUIRED)
    return df.select(
        midnight(timestamp_of(df, "date")).alias("MatchDate"),
        F.upper("home_team").alias("HomeTeam"),
        F.upper("away_team").alias("AwayTeam"),
        whole_number(df, "home_score").alias("HomeScore"),
        whole_number(df, "away_score").alias("AwayScore"),
        F.upper("competition").alias("CompetitionName"),
        F.upper("stadium").alias("Venue"),
        F.upper("city").alias("City"),
        F.upper("country").alias("Country"),
        truth(df, "neutral").alias("Neutral"),
        truth(df, "world_cup").alias("WorldCup"),
    )


def _admitted(source: DataFrame, competitions: Sequence[str], required: Sequence[str]) -> DataFrame:
    return drop_null_rows(distinct_rows(keep_allowed(source, "competition_name", competitions)), required)


def _match_columns(df: DataFrame, with_scores: bool) -> list[Column]:
    scores = (
        [whole_number(df, "home_score").alias("HomeScore"), whole_number(df, "away_score").alias("AwayScore")]
        if with_scores
        else []
    )
    return [
        midnight(timestamp_of(df, "match_date")).alias("MatchDate"),
        F.upper("home_team").alias("HomeTeam"),
        F.upper("away_team").alias("AwayTeam"),
        *scores,
        F.upper("competition_name").alias("CompetitionName"),
        F.upper("venue").alias("Venue"),
        F.upper("city").alias("City"),
        F.upper("country").alias("Country"),
    ]


def _international_flags() -> list[Column]:
    return [
        neutral_flag("home_team", "away_team", "country").alias("Neutral"),
        contains_ignore_case("competition_name", "world cup").alias("WorldCup"),
    ]


def _kickoff(df: DataFrame) -> Column:
    day = timestamp_of(df, "match_date").cast("date")
    return kickoff_timestamp(day, "kickoff_time_local").alias("KickoffTimeLocal")


def scraped_to_international_results(source: DataFrame, venues: DataFrame) -> DataFrame:
    """``venues``: active venues as venue, city, country."""
    df = add_city_and_country(_admitted(source, INTERNATIONAL_COMPETITIONS, RESULT_REQUIRED), venues)
    return df.select(*_match_columns(df, with_scores=True), *_international_flags())


def scraped_to_league_results(source: DataFrame, venues: DataFrame) -> DataFrame:
    df = add_city_and_country(_admitted(source, LEAGUE_COMPETITIONS, RESULT_REQUIRED), venues)
    return df.select(*_match_columns(df, with_scores=True))


def scraped_to_international_fixtures(source: DataFrame, venues: DataFrame) -> DataFrame:
    df = add_city_and_country(_admitted(source, INTERNATIONAL_COMPETITIONS, FIXTURE_REQUIRED), venues)
    return df.select(_kickoff(df), *_match_columns(df, with_scores=False), *_international_flags())


def scraped_to_league_fixtures(source: DataFrame, venues: DataFrame) -> DataFrame:
    df = add_city_and_country(_admitted(source, LEAGUE_COMPETITIONS, FIXTURE_REQUIRED), venues)
    return df.select(_kickoff(df), *_match_columns(df, with_scores=False))
