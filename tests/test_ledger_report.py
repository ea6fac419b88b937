import datetime as dt

import pytest
from tests.helpers import rows

from touchline.plans import ledger, report

SCORED = "CompetitionName string, HomeTeam string, AwayTeam string, p double, d double, ScoredAtUtc timestamp"
WHERE = report.ScoredTable("Scores", "CompetitionName", "HomeTeam", "AwayTeam", "p", "d")


def test_roll_up(spark):
    batches = spark.createDataFrame([("good",), ("bad",), ("none",), ("gap",)], "batch_id string")
    events = spark.createDataFrame(
        [("good", "succeeded"), ("good", "succeeded"), ("bad", "succeeded"), ("bad", "failed"), ("gap", None)],
        "batch_id string, status string",
    )
    got = {r[0]: r[1:] for r in rows(ledger.roll_up(batches, events))}
    assert got["good"] == got["none"] == ("preprocessed", None)
    assert got["bad"] == got["gap"] == ("failed to preprocess", ledger.BATCH_FAILURE)


def test_current_state(spark):
    t = dt.datetime(2025, 1, 1)
    history = spark.createDataFrame(
        [("e", "started", None, t, 0), ("e", "running", None, t, 1), ("e", "failed", "boom", t, 2), ("f", "started", None, t, 0)],
        "id string, status string, error_message string, at timestamp, step int",
    )
    got = rows(ledger.current_state(history, tie="step"), "id", "status", "error_message")
    assert got == [("e", "failed", "boom"), ("f", "started", None)]


def test_transition(spark):
    out = ledger.transition(spark.createDataFrame([("e",)], "id string"), ledger.FAILED, error="x").first()
    assert (out["id"], out["status"], out["error_message"]) == ("e", "failed", "x") and out["at"] is not None


def test_work_plan(spark):
    ingested = spark.createDataFrame(
        [("b1", "s1", "results", "feed", "raw", "p1", "ingested"), ("b2", "s2", "results", "feed", "raw", "p2", "preprocessed")],
        "batch_id string, system_event_id string, integration_type string, integration_provider string, "
        "container_name string, blob_path string, status string",
    )
    mappings = spark.createDataFrame(
        [("feed", "results", "T1", "job_a", 1, None), ("feed", "results", "T2", "job_b", 2, "S"), ("x", "results", "T3", "job_c", 1, None)],
        "source_provider string, source_type string, target_table string, pipeline_name string, execution_order int, source_table string",
    )
    plan = ledger.work_plan(ingested, mappings)
    assert tuple(plan.columns) == ledger.PLAN_COLUMNS
    assert rows(plan, "batch_id", "target_table", "execution_order") == [("b1", "T1", 1), ("b1", "T2", 2)]
    events = ledger.plan_events(plan)
    assert {r["status"] for r in events.collect()} == {"started"}


def test_predictions(spark):
    day = dt.date(2025, 6, 1)
    at = dt.datetime(2025, 6, 1, 6, 30)
    scored = spark.createDataFrame(
        [
            ("SIX NATIONS", "A", "B", 0.623, -4.25, at),
            ("SIX NATIONS", "C", "D", 0.5, 3.0, at),
            ("SIX NATIONS", "E", "F", None, None, at),
            ("SIX NATIONS", "G", "H", 0.9, 3.0, at + dt.timedelta(days=1)),
            ("SIX NATIONS", "G", "H", 0.9, 3.0, dt.datetime(2025, 6, 2)),
        ],
        SCORED,
    )
    out = report.daily_predictions([(scored, WHERE)], day)
    got = {r["home_team"]: r for r in out.collect()}
    assert set(got) == {"A", "C", "E"}
    assert (got["A"]["predicted_winner"], got["A"]["home_team_win_prob_pct"], got["A"]["predicted_margin"]) == ("A", "62.3%", "4.3 pts")
    assert got["C"]["predicted_winner"] == "C" and got["E"]["predicted_winner"] == "F"
    assert got["E"]["home_team_win_prob_pct"] is None and got["E"]["predicted_margin"] is None
    assert report.digest(out).columns == ["table_name", *report.DIGEST_COLUMNS]
    assert report.digest(out.select("home_team", "point_diff")).columns == ["home_team"]
    assert report.digest(out.select("point_diff")).columns == ["point_diff"]
    assert rows(report.digest_sections(out)) == [("Scores", 3)]


def test_scored_tables(spark):
    details = spark.createDataFrame([("Scores", "CompetitionName", "HomeTeam", "AwayTeam", "p", "d", "more")], "table_name string, competition_col string, home_team_col string, away_team_col string, home_team_win_prob_col string, point_diff_col string, note string")
    assert report.scored_tables(details) == [WHERE]
    with pytest.raises(ValueError):
        report.daily_predictions([], dt.date(2025, 6, 1))
