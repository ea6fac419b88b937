import datetime as dt
import re

import pytest
from tests.helpers import rows

from touchline.operators import ordering
from touchline.plans import features

RESULTS = (
    "ID bigint, MatchDate string, HomeTeam string, AwayTeam string, HomeScore bigint, AwayScore bigint, "
    "CompetitionName string, Venue string, City string, Country string, Neutral boolean, WorldCup boolean, CreatedAt string"
)
FIXTURES = (
    "ID bigint, KickoffTimeLocal timestamp, MatchDate timestamp, HomeTeam string, AwayTeam string, "
    "CompetitionName string, Venue string, City string, Country string, Neutral boolean, WorldCup boolean"
)
PLACE = ("SIX NATIONS", "LOFTUS", "PRETORIA", "SOUTH AFRICA", False, False)


@pytest.fixture(scope="module")
def teams(spark):
    return spark.createDataFrame([("FRANCE", 1, "NH"), ("WALES", 2, "NH")], "TeamName string, Tier int, Hemisphere string")


@pytest.fixture(scope="module")
def venues(spark):
    return spark.createDataFrame([("Loftus",)], "VenueName string")


def result(i, date, home, away, hs, as_, venue="LOFTUS"):
    return (i, date, home, away, hs, as_, PLACE[0], venue, *PLACE[2:], "now")


def test_one_result(spark, teams, venues):
    df = spark.createDataFrame([result(1, "2024-02-01", "FRANCE", "WALES", 10, 7)], RESULTS)
    row = features.results_model_ready(df, teams, venues).first().asDict()
    assert (row["PointDiff"], row["HomeWin"], row["TimeDecayWeight"], row["Diff_Tier"]) == (3, 1, 1.0, -1)
    assert row["Home_FormWinRate"] is None and row["MatchDate"] == dt.datetime(2024, 2, 1)
    assert not {"HomeScore", "AwayScore", "CreatedAt"} & row.keys()


def test_unknown_venue_is_no_history_and_draws_count(spark, teams, venues):
    made = [
        result(1, "2024-02-01", "FRANCE", "WALES", 50, 0, venue="NOWHERE"),
        result(2, "2024-02-02", "FRANCE", "WALES", 12, 12),
        result(3, "2024-02-03", "FRANCE", "WALES", 5, 9),
        result(4, "2024-02-04", "FRANCE", "MOON", 5, 9),
        result(5, "2025-02-03", "WALES", "FRANCE", 8, 8),
    ]
    out = features.results_model_ready(spark.createDataFrame(made, RESULTS), teams, venues)
    got = out.collect()
    assert [r["ID"] for r in got] == [3]
    assert (got[0]["Home_FormDrawRate"], got[0]["Home_FormPointsFor"], got[0]["Home_FormGames"]) == (1.0, 12.0, 1)
    # The newest date is that of the draw, which itself leaves with the targets.
    assert got[0]["TimeDecayWeight"] == pytest.approx(0.5 ** (366 / 365.25 / 10))


def test_fixture_with_a_prior_win(spark, teams, venues):
    history = spark.createDataFrame([result(1, "2024-02-01", "FRANCE", "WALES", 10, 7)], RESULTS)
    upcoming = spark.createDataFrame(
        [(1, dt.datetime(2024, 3, 1, 15), dt.datetime(2024, 3, 1), "FRANCE", "WALES", *PLACE)], FIXTURES
    )
    out = features.fixtures_model_ready(upcoming, history, teams, venues)
    row = out.first().asDict()
    assert out.count() == 1 and row["Home_FormWinRate"] == 1.0 and row["TimeDecayWeight"] == 1.0
    assert "PointDiff" not in row and "HomeWin" not in row and row["KickoffTimeLocal"] == dt.datetime(2024, 3, 1, 15)


def test_league_build_has_no_tier_and_a_shorter_half_life(spark, teams, venues):
    made = [result(1, "2014-02-01", "FRANCE", "WALES", 10, 7), result(2, "2024-02-01", "FRANCE", "WALES", 10, 7)]
    df = spark.createDataFrame(made, RESULTS).drop("Neutral", "WorldCup")
    out = features.results_model_ready(df, teams, venues, features.LEAGUE)
    assert "Home_Tier" not in out.columns and "Home_Hemisphere" in out.columns
    weights = dict(rows(out, "ID", "TimeDecayWeight"))
    assert weights[2] == 1.0 and weights[1] == pytest.approx(0.5 ** (3652 / 365.25 / 5))


def test_builds_in_one_and_many_pieces_agree(spark, teams, venues):
    made = [
        result(i, f"2024-{1 + i % 3:02d}-{1 + i % 9:02d}", *(("FRANCE", "WALES") if i % 2 else ("WALES", "FRANCE")), i % 11, i % 7)
        for i in range(300)
    ]
    df = spark.createDataFrame(made, RESULTS)
    one = features.results_model_ready(df, teams, venues, pieces=1)
    many = features.results_model_ready(df, teams, venues, pieces=30)
    assert rows(one) == rows(many)


def test_more_matches_make_more_tasks_that_fold_them(spark, teams, venues, monkeypatch):
    made = [result(i, f"2024-01-{1 + i % 9:02d}", "FRANCE", "WALES", i % 11, 20) for i in range(100)]
    df = spark.createDataFrame(made, RESULTS)
    few = features.results_model_ready(df, teams, venues)
    monkeypatch.setattr(ordering, "ROWS_PER_PIECE", 25)
    many = features.results_model_ready(df, teams, venues)
    plan = many._jdf.queryExecution().executedPlan().toString()
    assert re.findall(r"hashpartitioning\(_row#\w+, (\d+)\)", plan) == ["8"]
    assert rows(few) == rows(many) and len(rows(many)) == 100


def test_null_and_repeated_ids_lose_no_match(spark, teams, venues):
    made = [result(None, "2024-02-01", "FRANCE", "WALES", 10, 7), result(None, "2024-02-02", "WALES", "FRANCE", 3, 9), result(5, "2024-02-03", "FRANCE", "WALES", 1, 7), result(5, "2024-02-04", "FRANCE", "WALES", 1, 8)]
    assert features.results_model_ready(spark.createDataFrame(made, RESULTS), teams, venues).count() == 4


def test_matches_are_scanned_once(spark, teams, venues, tmp_path):
    """Everything after the canonical matches reads their stored copy."""
    spark.createDataFrame([result(1, "2024-02-01", "FRANCE", "WALES", 10, 7)], RESULTS).write.parquet(str(tmp_path / "raw_results"))
    out = features.results_model_ready(spark.read.parquet(str(tmp_path / "raw_results")), teams, venues)
    assert "raw_results" not in out._jdf.queryExecution().toString()


def test_team_rows_for_a_state_read_stored_matches(spark, teams, venues, tmp_path):
    """The known names are looked up once, however often the state reads its rows."""
    spark.createDataFrame([result(1, "2024-02-01", "FRANCE", "WALES", 10, 7)], RESULTS).write.parquet(str(tmp_path / "raw_results"))
    out = features.results_team_rows(spark.read.parquet(str(tmp_path / "raw_results")), teams, venues)
    assert out.inputFiles() and not any("raw_results" in f for f in out.inputFiles())
    assert [r["Team"] for r in out.collect()] == ["FRANCE", "WALES"]


def test_bad_date_is_an_error(spark, teams, venues):
    df = spark.createDataFrame([result(1, "never", "FRANCE", "WALES", 10, 7)], RESULTS)
    with pytest.raises(Exception, match="invalid MatchDate"):
        features.results_model_ready(df, teams, venues).collect()
