"""Published tables: repeated, concurrent and failed writes."""

from concurrent.futures import ThreadPoolExecutor

import pytest

from tests.helpers import rows
from touchline.plans import jobs
from touchline.sources.publish import PublishedTable


@pytest.fixture
def store(spark, tmp_path):
    return PublishedTable(spark, str(tmp_path / "table"))


def numbers(spark, first, last, tasks=3):
    return spark.range(first, last, 1, tasks).selectExpr("id AS v", "cast(id AS string) AS t")


def test_a_batch_is_there_once(spark, store):
    assert store.publish(numbers(spark, 0, 10), "a") == 10 and store.publish(numbers(spark, 10, 15), "b") == 5
    before = {r.v: r.ID for r in store.read().collect()}
    assert sorted(before) == list(range(15)) and sorted(before.values()) == list(range(1, 16))
    store.publish(numbers(spark, 0, 10), "a")
    after = {r.v: r.ID for r in store.read().collect()}
    assert after == before, "the same rows keep their ids"
    store.publish(numbers(spark, 20, 23), "a")  # fewer rows
    assert rows(store.read(), "v") == [(v,) for v in (10, 11, 12, 13, 14, 20, 21, 22)]
    store.publish(numbers(spark, 0, 12), "a")  # more than its ids: a new range
    ids = [r.ID for r in store.read().collect()]
    assert len(ids) == len(set(ids)) == 17 and max(ids) == 27


def test_replace_clear_and_empty_batches(spark, store):
    with pytest.raises(ValueError, match="nothing was published"):
        store.read()
    store.publish(numbers(spark, 0, 4), "a")
    store.publish(numbers(spark, 7, 9), "b", replace=True)
    assert rows(store.read(), "ID", "v") == [(1, 7), (2, 8)]
    assert store.publish(numbers(spark, 0, 0), "c") == 0 and store.read().count() == 2
    store.clear()
    assert store.read().isEmpty() and store.read().columns == ["ID", "v", "t", "CreatedAt"]
    store.publish(numbers(spark, 3, 5), "a")
    assert rows(store.read(), "ID", "v") == [(1, 3), (2, 4)]


def test_columns_go_by_name(spark, store):
    store.publish(numbers(spark, 0, 1), "a")
    store.publish(spark.createDataFrame([("x", 9, 5)], "t string, v int, extra int"), "b")
    store.publish(spark.createDataFrame([(7,)], "v int"), "c")
    assert rows(store.read(), "v", "t") == [(0, "0"), (7, None), (9, "x")]
    with pytest.raises(TypeError):
        store.publish([1], "d")
    with pytest.raises(ValueError):
        store.publish(numbers(spark, 0, 1), "")


def test_two_writers_get_dense_ids(spark, store):
    store.publish(numbers(spark, 0, 3), "first")
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda i: PublishedTable(spark, store.folder).publish(numbers(spark, 10 * i, 10 * i + 5), f"w{i}"), range(1, 7)))
    found = store.read().collect()
    assert sorted(r.ID for r in found) == list(range(1, 34)) and len({r.v for r in found}) == 33
    assert store.state().number == 7


def test_what_was_never_committed_is_not_read(spark, store, monkeypatch):
    store.publish(numbers(spark, 0, 3), "a")
    monkeypatch.setattr(PublishedTable, "_commit", lambda self, state: (_ for _ in ()).throw(RuntimeError("driver lost")))
    with pytest.raises(RuntimeError, match="driver lost"):
        store.publish(numbers(spark, 100, 200), "a")
    monkeypatch.undo()
    assert rows(store.read(), "v") == [(0,), (1,), (2,)]
    store.publish(numbers(spark, 5, 6), "a")
    plan = store.read()._jdf.queryExecution().executedPlan().toString()
    assert rows(store.read(), "v") == [(5,)] and "attempt" in plan


def test_jobs_publish(spark, tmp_path):
    """Every write mode into published tables: append once a batch, replace, truncate first."""
    columns = "date string, home_team string, away_team string, home_score int, away_score int, competition string, stadium string, city string, country string, neutral string, world_cup int"
    old = [(f"20{10 + i:02d}-02-01", "France", "Wales", 10 + i, 15, "Six", "Loftus", "P", "SA", "False", 0, f"b{i % 2}") for i in range(4)]
    spark.createDataFrame(old, columns + ", batch_id string").write.saveAsTable("publish_source")
    spark.createDataFrame([("Loftus", "P", "SA", True)], "VenueName string, City string, Country string, IsActive boolean").write.saveAsTable("publish_venues")
    spark.createDataFrame([("FRANCE", 1, "NH"), ("WALES", 2, "NH")], "TeamName string, Tier int, Hemisphere string").write.saveAsTable("publish_teams")
    defined = [(i, name, None, None) for i, name in enumerate(["publish_source", "publish_results", "publish_model", "publish_due", "publish_due_model"])]
    spark.createDataFrame(defined, "id int, table_name string, integration_type string, integration_provider string").write.saveAsTable("publish_tables")
    known = [(0, "home_team"), (1, "HomeTeam"), (2, "HomeTeam"), (3, "HomeTeam"), (4, "HomeTeam")]
    spark.createDataFrame([(t, c, "string", True, 1) for t, c in known], "table_id int, column_name string, data_type string, is_required boolean, ordinal_position int").write.saveAsTable("publish_columns")
    due = "KickoffTimeLocal timestamp, MatchDate timestamp, HomeTeam string, AwayTeam string, CompetitionName string, Venue string, City string, Country string, Neutral boolean, WorldCup boolean"
    spark.sql("SELECT 1L AS ID, timestamp'2030-01-01 12:00:00' AS KickoffTimeLocal, timestamp'2030-01-01' AS MatchDate, 'FRANCE' AS HomeTeam, 'WALES' AS AwayTeam, 'SIX' AS CompetitionName, 'LOFTUS' AS Venue, 'P' AS City, 'SA' AS Country, false AS Neutral, false AS WorldCup").write.saveAsTable("publish_due")
    names = jobs.Tables(venues="publish_venues", international_teams="publish_teams", international_results="publish_results",
                        schema_tables="publish_tables", schema_columns="publish_columns", published=str(tmp_path / "published"))

    def run(pipeline, source, target, batch):
        return jobs.run_job(spark, {"pipeline_name": pipeline, "source_table": source, "target_table": target, "batch_id": batch, "system_event_id": "s"}, names)

    for batch in ("b0", "b1", "b0"):
        assert run("historical_to_international_results", "publish_source", "publish_results", batch) == 2
    assert rows(spark.table("publish_results"), "HomeScore") == [(10,), (11,), (12,), (13,)]
    assert {r.ID for r in spark.table("publish_results").where("HomeScore in (10, 12)").collect()} == {1, 2}
    for _ in range(2):
        assert run("international_results_to_model", "publish_results", "publish_model", "b") == 4
        assert run("international_fixtures_to_model", "publish_due", "publish_due_model", "b") == 1
    assert spark.table("publish_model").count() == 4 and spark.table("publish_due_model").first().Home_FormGames == 4
    spark.createDataFrame([], "ID bigint, " + due).write.mode("overwrite").saveAsTable("publish_due")
    assert run("international_fixtures_to_model", "publish_due", "publish_due_model", "b") == 0
    assert spark.table("publish_due_model").isEmpty()
