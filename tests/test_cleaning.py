import datetime as dt

import pytest
from tests.helpers import rows

from touchline.operators import lookups
from touchline.operators.rows import (
    drop_null_rows,
    exclude_completed,
    keep_first,
    latest_per_key,
    next_version,
)
from touchline.plans import cleaning

HISTORICAL = (
    "date string, home_team string, away_team string, home_score bigint, away_score bigint, competition string, "
    "stadium string, city string, country string, neutral string, world_cup bigint"
)
SCRAPED = (
    "match_date string, competition_name string, home_team string, away_team string, home_score bigint, "
    "away_score bigint, venue string, kickoff_time_local string"
)


@pytest.fixture(scope="module")
def venues(spark):
    return spark.createDataFrame(
        [("HARBOUR PARK", "Northport", "Avalon"), ("Stade de France", "Paris", "France")],
        "venue string, city string, country string",
    )


def test_historical(spark):
    good = ("2020-02-01", "France", "Wales", 20, 10, "Six Nations", "Stade de France", "Paris", "France", "False", 0)
    bad = (None, *good[1:])
    out = cleaning.historical_to_results(spark.createDataFrame([good, good, bad], HISTORICAL))
    assert out.columns == [
        "MatchDate", "HomeTeam", "AwayTeam", "HomeScore", "AwayScore", "CompetitionName", "Venue", "City", "Country",
        "Neutral", "WorldCup",
    ]
    assert [tuple(r) for r in out.collect()] == [
        (dt.datetime(2020, 2, 1), "FRANCE", "WALES", 20, 10, "SIX NATIONS", "STADE DE FRANCE", "PARIS", "FRANCE", False, False)
    ]


def test_fractional_scores_are_an_error(spark):
    schema = HISTORICAL.replace("home_score bigint", "home_score double")
    row = ("2020-02-01", "France", "Wales", 20.0, 10, "Six Nations", "S", "P", "F", "True", 0)
    assert cleaning.historical_to_results(spark.createDataFrame([row], schema)).first()["HomeScore"] == 20
    bad = (*row[:3], 20.5, *row[4:])
    with pytest.raises(Exception, match="not a whole number"):
        cleaning.historical_to_results(spark.createDataFrame([bad], schema)).collect()


def test_scraped_results(spark, venues):
    df = spark.createDataFrame(
        [
            ("2025-12-08", "Six Nations", "France", "Wales", 20, 10, " stade de france ", "8:00PM"),
            ("2025-12-08", "Six Nations", "France", "Wales", 20, 10, " stade de france ", "8:00PM"),
            ("2025-12-08", "Club Friendly", "A", "B", 1, 2, "X", "8:00PM"),
            ("2025-12-08", "six nations", "A", "B", 1, 2, "X", "8:00PM"),
            ("2025-12-08", "Internationals", "A", "B", None, 2, "X", "8:00PM"),
        ],
        SCRAPED,
    )
    out = cleaning.scraped_to_international_results(df, venues)
    row = out.first().asDict()
    assert out.count() == 1 and len(out.columns) == 11
    assert (row["City"], row["Country"], row["Neutral"], row["WorldCup"]) == ("PARIS", "FRANCE", False, False)
    assert row["Venue"] == " STADE DE FRANCE "


def test_scraped_fixtures(spark, venues):
    df = spark.createDataFrame(
        [("2025-12-08", "Rugby World Cup", "France", "Wales", None, None, "Harbour Park", "4:05AM")], SCRAPED
    )
    out = cleaning.scraped_to_international_fixtures(df, venues)
    row = out.first().asDict()
    assert len(out.columns) == 10 and row["KickoffTimeLocal"] == dt.datetime(2025, 12, 8, 4, 5)
    assert row["WorldCup"] is True and row["Neutral"] is True


def test_league(spark, venues):
    df = spark.createDataFrame(
        [
            ("2025-12-08", "United Rugby Championship", "Stormers", "Leinster", 20, 18, "Harbour Park", "7:00PM"),
            ("2025-12-08", "Six Nations", "France", "Wales", 1, 2, "X", "7:00PM"),
        ],
        SCRAPED,
    )
    assert rows(cleaning.scraped_to_league_results(df, venues), "HomeTeam", "City") == [("STORMERS", "NORTHPORT")]
    fixtures = cleaning.scraped_to_league_fixtures(df, venues)
    assert fixtures.columns == [
        "KickoffTimeLocal", "MatchDate", "HomeTeam", "AwayTeam", "CompetitionName", "Venue", "City", "Country",
    ]
    none = df.where("competition_name = 'Six Nations'")
    assert cleaning.scraped_to_league_results(none, venues).isEmpty()


def test_geo_lookup_keeps_rows_and_rejects_duplicate_keys(spark, venues):
    df = spark.createDataFrame([(" Harbour Park ",), ("Elsewhere",), (None,)], "venue string")
    out = lookups.add_city_and_country(df, venues)
    assert rows(out) == sorted(
        [(" Harbour Park ", "Northport", "Avalon"), ("Elsewhere", None, None), (None, None, None)], key=repr
    )
    twice = venues.unionByName(venues)
    with pytest.raises(Exception, match="listed more than once"):
        lookups.add_city_and_country(df, twice).collect()


def test_canonical_teams(spark):
    teams = spark.createDataFrame([(" france",), ("Wales",)], "TeamName string")
    df = spark.createDataFrame(
        [("FRANCE", "WALES"), ("FRANCE", "MOON"), ("SUN", "WALES"), (None, "WALES")], "HomeTeam string, AwayTeam string"
    )
    assert rows(lookups.keep_canonical_teams(df, teams)) == [("FRANCE", "WALES")]
    assert rows(lookups.rejected_names(df, teams, ["HomeTeam", "AwayTeam"], "TeamName")) == [("MOON",), ("SUN",)]
    with pytest.raises(ValueError, match="needs rows and a"):
        lookups.keep_canonical_teams(df, teams.where("false"))
    with pytest.raises(ValueError, match="needs rows and a"):
        lookups.keep_canonical_teams(df, teams.withColumnRenamed("TeamName", "Other"))


def test_canonical_venues(spark):
    venues = spark.createDataFrame([("Loftus",)], "VenueName string")
    df = spark.createDataFrame([("LOFTUS ",), ("x",), (None,)], "Venue string")
    assert rows(lookups.keep_canonical_venues(df, venues)) == [("LOFTUS ",)]


def test_team_features(spark):
    teams = spark.createDataFrame(
        [("FRANCE", 1, "nh "), ("Wales", 2, "nh"), (" wales", 9, "zz"), (None, 3, "sh")],
        "TeamName string, Tier int, Hemisphere string",
    )
    df = spark.createDataFrame([(1, "France", "WALES"), (2, "UNKNOWN", "FRANCE")], "ID int, HomeTeam string, AwayTeam string")
    out = lookups.add_team_features(df, teams, with_tier=True, order=["Tier"])
    assert rows(out, "ID", *lookups.TEAM_FEATURES) == [(1, 1, 2, -1, "NH", "NH"), (2, None, 1, None, None, "NH")]
    league = lookups.add_team_features(df, teams, with_tier=False)
    assert "Home_Tier" not in league.columns and league.count() == 2
    assert lookups.add_team_features(df, teams.where("false"), with_tier=True).columns == df.columns


def test_row_picks(spark):
    df = spark.createDataFrame([("a", 1), ("a", 0), (None, 2), (None, 1)], "k string, o int")
    assert rows(keep_first(df, "k", ["o"])) == [("a", 0), (None, 1)]
    assert rows(latest_per_key(df, ["k"], "o")) == [("a", 1), (None, 2)]
    assert rows(next_version(df.dropna(), "k", "o")) == [("a", 2)]
    assert rows(next_version(df, "k", "o", spark.createDataFrame([("new",)], "k string"))) == [("new", 1)]
    with pytest.raises(ValueError):
        drop_null_rows(df, [])
    plan = keep_first(df, "k", ["o"])._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan, "one row per key and task must be kept before the shuffle"


def test_completed_exclusion(spark):
    df = spark.createDataFrame(
        [("fixtures", "FT"), ("fixtures", "KO"), ("fixtures", None), ("results", "FT")], "integration_type string, state string"
    )
    assert rows(exclude_completed(df)) == sorted(
        [("fixtures", "KO"), ("fixtures", None), ("results", "FT")], key=repr
    )
