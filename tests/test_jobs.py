import pytest
from tests.helpers import rows
from pyspark.sql import types as T

from touchline.plans import jobs
from touchline.sources import snapshots, tables

RESULT_COLUMNS = (
    "ID bigint, MatchDate timestamp, HomeTeam string, AwayTeam string, HomeScore bigint, AwayScore bigint, "
    "CompetitionName string, Venue string, City string, Country string"
)
FIXTURE_COLUMNS = (
    "ID bigint, KickoffTimeLocal timestamp, MatchDate timestamp, HomeTeam string, AwayTeam string, "
    "CompetitionName string, Venue string, City string, Country string"
)
FLAGS = ", Neutral boolean, WorldCup boolean"
FORM = "FormWinRate double, FormDrawRate double, FormPointsFor double, FormPointsAgainst double, FormPointDiff double, FormGames bigint"
MODEL = ", ".join(f"{side}_{c.strip()}" for side in ("Home", "Away") for c in FORM.split(","))
HEMISPHERES = "Home_Hemisphere string, Away_Hemisphere string"
TIERS = "Home_Tier bigint, Away_Tier bigint, Diff_Tier bigint"
TAIL = "Diff_FormWinRate double, TimeDecayWeight double"
TARGETS = "PointDiff bigint, HomeWin int"

TABLES = {
    "InternationalMatchResults": RESULT_COLUMNS + FLAGS + ", CreatedAt timestamp",
    "URCMatchResults": RESULT_COLUMNS + ", CreatedAt timestamp",
    "InternationalMatchFixtures": FIXTURE_COLUMNS + FLAGS,
    "URCMatchFixtures": FIXTURE_COLUMNS,
    "InternationalResultsModel": f"ID bigint, MatchDate timestamp, HomeTeam string, {TIERS}, {HEMISPHERES}, {MODEL}, {TAIL}, {TARGETS}",
    "URCResultsModel": f"ID bigint, MatchDate timestamp, HomeTeam string, {HEMISPHERES}, {MODEL}, {TAIL}, {TARGETS}",
    "InternationalFixturesModel": f"ID bigint, KickoffTimeLocal timestamp, HomeTeam string, {TIERS}, {MODEL}, {TAIL}",
    "URCFixturesModel": f"ID bigint, KickoffTimeLocal timestamp, HomeTeam string, {HEMISPHERES}, {MODEL}, {TAIL}",
}
LOGICAL = {"bigint": "int", "int": "int", "string": "string", "timestamp": "datetime", "boolean": "bool", "double": "float"}
SOURCES = {
    ("historical_results", "archive"): "date string, home_team string, away_team string, home_score int, away_score int, "
    "competition string, stadium string, city string, country string, neutral string, world_cup int",
    ("results", "feed"): "match_date string, competition_name string, home_team string, away_team string, home_score int, "
    "away_score int, venue string, kickoff_time_local string",
    ("fixtures", "feed"): "match_date string, competition_name string, home_team string, away_team string, venue string, "
    "kickoff_time_local string",
}
# pipeline, source (type, provider), source table, target, order
WORK = [
    ("historical_to_international_results", ("historical_results", "archive"), None, "InternationalMatchResults", 1),
    ("scraped_to_international_results", ("results", "feed"), None, "InternationalMatchResults", 2),
    ("scraped_to_league_results", ("results", "feed"), None, "URCMatchResults", 2),
    ("scraped_to_international_fixtures", ("fixtures", "feed"), None, "InternationalMatchFixtures", 2),
    ("scraped_to_league_fixtures", ("fixtures", "feed"), None, "URCMatchFixtures", 2),
    ("international_results_to_model", ("results", "feed"), "InternationalMatchResults", "InternationalResultsModel", 3),
    ("league_results_to_model", ("results", "feed"), "URCMatchResults", "URCResultsModel", 3),
    ("international_fixtures_to_model", ("fixtures", "feed"), "InternationalMatchFixtures", "InternationalFixturesModel", 4),
    ("league_fixtures_to_model", ("fixtures", "feed"), "URCMatchFixtures", "URCFixturesModel", 4),
    ("unheard_of", ("fixtures", "feed"), None, "URCMatchFixtures", 5),
]


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    """Empty targets, reference tables, catalog, mappings and three landed snapshots."""
    root = str(tmp_path_factory.mktemp("raw"))
    for name, ddl in TABLES.items():
        tables.create_table(spark, name, T.StructType.fromDDL(ddl))
    spark.createDataFrame(
        [("Loftus", "Pretoria", "South Africa", True), ("Rds", "Dublin", "Ireland", True)],
        "VenueName string, City string, Country string, IsActive boolean",
    ).write.saveAsTable("RugbyVenues")
    spark.createDataFrame(
        [("FRANCE", 1, "NH"), ("WALES", 2, "NH")], "TeamName string, Tier int, Hemisphere string"
    ).write.saveAsTable("InternationalRugbyTeams")
    spark.createDataFrame([("BULLS", "SH"), ("LEINSTER", "NH")], "TeamName string, Hemisphere string").write.saveAsTable(
        "URCRugbyTeams"
    )
    defined, columns = [], []
    specs = [(name, None, None, ddl) for name, ddl in TABLES.items()]
    specs += [(None, kind, provider, ddl) for (kind, provider), ddl in SOURCES.items()]
    for number, (name, kind, provider, ddl) in enumerate(specs):
        defined.append((number, name, kind, provider))
        for position, field in enumerate(T.StructType.fromDDL(ddl).fields):
            logical = "bit" if field.name == "world_cup" else LOGICAL[field.dataType.simpleString()]
            columns.append((number, field.name, logical, field.name != "CreatedAt" and field.name != "ID", position))
    spark.createDataFrame(
        defined, "id int, table_name string, integration_type string, integration_provider string"
    ).write.saveAsTable("schema_tables")
    spark.createDataFrame(
        columns, "table_id int, column_name string, data_type string, is_required boolean, ordinal_position int"
    ).write.saveAsTable("schema_columns")
    spark.createDataFrame(
        [(provider, kind, target, pipeline, order, source) for pipeline, (kind, provider), source, target, order in WORK],
        "source_provider string, source_type string, target_table string, pipeline_name string, execution_order int, source_table string",
    ).write.saveAsTable("preprocessing_source_target_mappings")

    old = [(f"20{10 + i:02d}-02-01", "France", "Wales", 10 + i, 12, "Six Nations", "Loftus", "P", "SA", "False", 0) for i in range(5)]
    new = [
        ("2024-02-01", "Six Nations", "France", "Wales", 20, 10, "loftus", "7:00PM"),
        ("2024-02-02", "United Rugby Championship", "Bulls", "Leinster", 20, 10, "Rds", "7:00PM"),
        ("2024-02-09", "United Rugby Championship", "Leinster", "Bulls", 20, 10, "Rds", "7:00PM"),
        ("2024-02-02", "Club Friendly", "X", "Y", 20, 10, "Rds", "7:00PM"),
    ]
    due = [
        ("2024-03-01", "Six Nations", "Wales", "France", "Loftus", "7:00PM"),
        ("2024-03-02", "United Rugby Championship", "Bulls", "Leinster", "Rds", "7:30PM"),
    ]
    ingested = []
    for (kind, provider), frame in {
        ("historical_results", "archive"): (old, 11), ("results", "feed"): (new, 8), ("fixtures", "feed"): (due, 6),
    }.items():
        df = spark.createDataFrame(frame[0], SOURCES[(kind, provider)])
        path = snapshots.write_snapshot(df, root, kind, provider, "d1")
        ingested.append((f"e-{kind}", f"b-{kind}", "s1", kind, provider, root, path[len(root) + 1 :], "ingested"))
    spark.createDataFrame(
        ingested,
        "id string, batch_id string, system_event_id string, integration_type string, integration_provider string, "
        "container_name string, blob_path string, status string",
    ).write.saveAsTable("ingestion_events")
    return root


def test_batch_runs_all_nine_jobs(spark, world):
    outcome = {r["batch_id"]: r["batch_status"] for r in jobs.run_batch(spark).collect()}
    assert outcome == {
        "b-historical_results": "preprocessed",
        "b-results": "preprocessed",
        "b-fixtures": "failed to preprocess",
    }
    failed = spark.table("event_history").where("status = 'failed'").collect()
    assert [r["error_message"] for r in failed] == ["There is no job named 'unheard_of'"]

    results = spark.table("InternationalMatchResults")
    assert results.count() == 6 and results.select("ID").distinct().count() == 6
    assert results.where("CreatedAt is null").isEmpty()
    assert rows(spark.table("URCMatchResults"), "HomeTeam", "City") == [("BULLS", "DUBLIN"), ("LEINSTER", "DUBLIN")]
    model = spark.table("InternationalResultsModel")
    assert model.count() == 5, "one historical draw leaves"
    newest = model.orderBy("MatchDate", ascending=False).first()
    assert (newest["HomeWin"], newest["Home_FormGames"], newest["Home_Tier"]) == (1, 5, 1)
    assert spark.table("URCResultsModel").count() == 2
    fixture = spark.table("InternationalFixturesModel").first()
    assert fixture["HomeTeam"] == "WALES" and fixture["Home_FormGames"] == 6
    league = spark.table("URCFixturesModel").first()
    assert league["Home_FormWinRate"] == 0.5 and league["Home_Hemisphere"] == "SH"


def event(**changes):
    base = {
        "id": "x", "batch_id": "b", "system_event_id": "s", "integration_type": "fixtures", "integration_provider": "feed",
        "container_name": "", "blob_path": "", "source_table": None, "target_table": "", "pipeline_name": "",
    }
    return {**base, **changes}


def test_truncate_first_even_without_data(spark, world):
    tables.create_table(spark, "EmptyFixtures", T.StructType.fromDDL(FIXTURE_COLUMNS))
    assert not spark.table("URCFixturesModel").isEmpty()
    done = jobs.run_job(
        spark, event(pipeline_name="league_fixtures_to_model", source_table="EmptyFixtures", target_table="URCFixturesModel")
    )
    assert done == 0 and spark.table("URCFixturesModel").isEmpty()


def test_replace_keeps_rows_when_there_is_nothing_new(spark, world):
    tables.create_table(spark, "EmptyResults", T.StructType.fromDDL(RESULT_COLUMNS))
    before = spark.table("URCResultsModel").count()
    done = jobs.run_job(
        spark, event(pipeline_name="league_results_to_model", source_table="EmptyResults", target_table="URCResultsModel")
    )
    assert done == 0 and spark.table("URCResultsModel").count() == before == 2


def test_invalid_source_is_refused(spark, world):
    df = spark.createDataFrame([("2024-02-01", "Six Nations")], "match_date string, competition_name string")
    snapshots.write_snapshot(df, world, "results", "feed", "broken")
    before = spark.table("URCMatchResults").count()
    with pytest.raises(ValueError, match="lacks the required column"):
        jobs.run_job(
            spark,
            event(pipeline_name="scraped_to_league_results", integration_type="results", container_name=world,
                  blob_path="results/feed/broken", target_table="URCMatchResults"),
        )
    assert spark.table("URCMatchResults").count() == before


def test_values_that_do_not_parse_are_refused(spark, world):
    df = spark.createDataFrame([("2024-02-01", "Six Nations", "France", "Wales", "20.0", "x1", "loftus", "7:00PM")],
                               "match_date string, competition_name string, home_team string, away_team string, home_score string, "
                               "away_score string, venue string, kickoff_time_local string")
    snapshots.write_snapshot(df, world, "results", "feed", "unreadable")
    before = spark.table("InternationalMatchResults").count()
    with pytest.raises(ValueError, match="1 values of column 'away_score' are no int, e.g. 'x1'"):
        jobs.run_job(
            spark,
            event(pipeline_name="scraped_to_international_results", integration_type="results", container_name=world,
                  blob_path="results/feed/unreadable", target_table="InternationalMatchResults"),
        )
    assert spark.table("InternationalMatchResults").count() == before


def test_second_run_finds_nothing_to_do(spark, world):
    before = spark.table("event_history").count()
    assert jobs.run_batch(spark).isEmpty()
    assert spark.table("event_history").count() == before
    assert spark.table("preprocessing_events").count() == 10
