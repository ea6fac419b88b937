"""One query per operator, each over whole test tables. Dates are returned as text."""

from __future__ import annotations

import dataclasses
import datetime as dt
import uuid
from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.ml.feature import SQLTransformer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.functions.dates import days_between, kickoff_timestamp, midnight, timestamp_of
from touchline.functions.text import blank_to_null, contains_ignore_case, name_key, neutral_flag, query_parameter
from touchline.functions.windows import lagged_mean, lagged_sum
from touchline.operators import form, form_state, lookups, metrics, ordering, quality, rows
from touchline.operators.quality import ColumnRule
from touchline.plans import cleaning, features, ingestion, jobs, ledger, modelling, report
from touchline.queries import views
from touchline.session import scratch_path
from touchline.sources import catalog, pages, partitioned, publish, snapshots, tables
from touchline.streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

TODAY = dt.date(2024, 3, 15)
REPORT_DAY = dt.date(1998, 6, 1)


def query(build: Query) -> Query:
    QUERIES[build.__name__] = build
    return build


def day_text(column: str, alias: str | None = None):
    return F.date_format(column, "yyyy-MM-dd").alias(alias or column)


def second_text(column: str, alias: str | None = None):
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss").alias(alias or column)


def with_text_dates(df: DataFrame) -> DataFrame:
    """Timestamps as text so that both engines return the same values."""
    shown = {"MatchDate": "yyyy-MM-dd", "KickoffTimeLocal": "yyyy-MM-dd HH:mm:ss"}
    return df.withColumns({c: F.date_format(c, f) for c, f in shown.items() if c in df.columns})


# ---- scans -----------------------------------------------------------------------------


@query
def table_scan_filter(spark, sf_dir):
    views.table(spark, sf_dir, "orders").createOrReplaceTempView("scan_orders")
    return tables.read_table(
        spark,
        "scan_orders",
        ["o_orderkey", "o_custkey", "o_totalprice"],
        "o_totalprice > :floor AND o_orderpriority = :priority",
        {"floor": 250000.0, "priority": "2-HIGH"},
    )


@query
def batch_scoped_scan(spark, sf_dir):
    events = views.ledger(spark, sf_dir).drop("system_event_id").withColumnRenamed("batch_id", "Batch_ID")
    scoped = tables.scope_to_batch(events, batch_id="42", system_event_id="7")
    return scoped.select("id", "Batch_ID", "status")


@query
def active_venues(spark, sf_dir):
    return tables.active_venues(views.venues(spark, sf_dir))


@query
def csv_snapshot(spark, sf_dir):
    """Write the scraped feed as a raw snapshot, read it back by schema, clean it."""
    feed = views.scraped(spark, sf_dir).drop("record", "page_id", "pos")
    path = snapshots.write_snapshot(feed, scratch_path(spark, "snapshot"), "results", "feed", "scraped")
    back = snapshots.read_snapshot(spark, path, feed.schema)
    return with_text_dates(
        cleaning.scraped_to_league_results(back, tables.active_venues(views.venues(spark, sf_dir)))
    )


def _raw_orders(spark, sf_dir) -> DataFrame:
    """Orders as text columns: a 0/1 flag and whole numbers written with decimals among them."""
    return views.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("order_id"),
        (F.col("o_custkey") % 2).cast("string").alias("odd"),
        F.concat(F.col("o_custkey").cast("string"), F.lit(".0")).alias("customer"),
        F.col("o_totalprice").cast("string").alias("price"),
        day_text("o_orderdate", "day"),
        F.when(F.col("o_custkey") % 7 > 0, F.col("o_orderpriority")).alias("priority"),
    )


_ORDER_RULES = [
    ColumnRule("order_id", "int", True),
    ColumnRule("odd", "bit", True),
    ColumnRule("customer", "int", True),
    ColumnRule("price", "decimal"),
    ColumnRule("day", "date"),
    ColumnRule("priority", "string"),
]


@query
def typed_snapshot(spark, sf_dir):
    """All orders through a CSV snapshot: written, read as text, validated and parsed by catalog types."""
    path = snapshots.write_snapshot(_raw_orders(spark, sf_dir), scratch_path(spark, "snapshot"), "orders", "feed", "all")
    raw = snapshots.read_text(spark, path)
    typed = snapshots.parsed(raw, _ORDER_RULES)
    quality.validate_source(typed, _ORDER_RULES, raw)
    return typed.withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query
def rejected_values(spark, sf_dir):
    """Values of all orders that do not parse: flags other than 0 and 1, broken numbers and days."""
    orders = views.table(spark, sf_dir, "orders")
    raw = orders.select(
        (F.col("o_custkey") % 3).cast("string").alias("odd"),
        F.when(F.col("o_custkey") % 5 == 0, F.concat(F.lit("no "), F.col("o_custkey").cast("string")))
        .otherwise(F.col("o_custkey").cast("string"))
        .alias("customer"),
        F.when(F.col("o_orderkey") % 9 == 0, F.lit("2001-02-30")).otherwise(day_text("o_orderdate")).alias("day"),
        F.col("o_orderpriority").alias("priority"),
    )
    rules = [ColumnRule("odd", "bit"), ColumnRule("customer", "int"), ColumnRule("day", "date"), ColumnRule("priority", "string")]
    return quality.rejected_values(raw, rules)


def _fresh(name: str) -> str:
    """A table name of its own for every call."""
    return f"{name}_{uuid.uuid4().hex}"


@query
def appended_table(spark, sf_dir):
    """All orders appended in three parts, the first creating the table: ids stay consecutive."""
    orders = views.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    name = _fresh("appended")
    for part in range(3):
        tables.append_rows(orders.where(F.col("o_orderkey") % 3 == part), name)
    return spark.table(name).agg(
        F.count("*").alias("rows"),
        F.sum("o_orderkey").alias("keys"),
        F.count("CreatedAt").alias("stamped"),
        F.min("ID").alias("first_id"),
        F.max("ID").alias("last_id"),
        F.countDistinct("ID").alias("ids"),
    )


@query
def published_table(spark, sf_dir):
    """Orders published in four batches, one of them three times and then smaller: single rows, dense ids."""
    orders = views.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    store = publish.PublishedTable(spark, scratch_path(spark, "published"))
    for part in (0, 1, 1, 2, 3, 1):
        store.publish(orders.where(F.col("o_orderkey") % 4 == part), f"batch {part}")
    return store.read().agg(
        F.count("*").alias("rows"),
        F.sum("o_orderkey").alias("keys"),
        F.count("CreatedAt").alias("stamped"),
        F.min("ID").alias("first_id"),
        F.max("ID").alias("last_id"),
        F.countDistinct("ID").alias("ids"),
    )


@query
def rerun_job(spark, sf_dir):
    """An append job run twice over the same batch, and once over another: every batch is there once."""
    names = jobs.Tables(
        schema_tables=_fresh("schema_tables"), schema_columns=_fresh("schema_columns"), published=scratch_path(spark, "published")
    )
    source, target = _fresh("historical"), _fresh("results")
    views.historical(spark, sf_dir).withColumn("batch_id", F.when(F.col("home_team") < "NATION_2", "b1").otherwise("b2")).write.saveAsTable(source)
    spark.createDataFrame(
        [(1, source, None, None), (2, target, None, None)],
        "id int, table_name string, integration_type string, integration_provider string",
    ).write.saveAsTable(names.schema_tables)
    known = [(1, "home_score", "float"), (1, "home_team", "string"), (2, "HomeScore", "int"), (2, "MatchDate", "datetime")]
    spark.createDataFrame(
        [(table, column, kind, True, at) for at, (table, column, kind) in enumerate(known)],
        "table_id int, column_name string, data_type string, is_required boolean, ordinal_position int",
    ).write.saveAsTable(names.schema_columns)
    job = {"pipeline_name": "historical_to_international_results", "source_table": source, "target_table": target, "system_event_id": "s"}
    for batch in ("b1", "b2", "b1"):
        jobs.run_job(spark, {**job, "batch_id": batch}, names)
    results = spark.table(target)
    return results.agg(
        F.count("*").alias("rows"),
        F.countDistinct("ID").alias("ids"),
        F.max("ID").alias("last_id"),
        F.sum("HomeScore").alias("home_points"),
        F.sum("AwayScore").alias("away_points"),
        F.sum(F.col("Neutral").cast("long")).alias("neutral"),
    )


@query
def replaced_table(spark, sf_dir):
    """A table filled with one half of the orders, truncated, and replaced by the other half."""
    orders = views.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ID"), "o_orderstatus")
    name = _fresh("replaced")
    tables.replace_rows(orders.where("ID % 2 = 0"), name)
    tables.truncate_table(spark, name)
    tables.append_rows(orders.where("ID % 5 = 0"), name)
    tables.replace_rows(orders.where("ID % 2 = 1"), name)
    return spark.table(name).select("ID", "o_orderstatus")


@query
def model_dataset(spark, sf_dir):
    """A stored, loosely typed table read as a model source: exact projection and normalised types."""
    name = _fresh("loose")
    _loosely_typed(spark, sf_dir).write.saveAsTable(name)
    return tables.read_model_dataset(spark, name, ["c_custkey", "account", "half_numeric", "segment", "name"])


@query
def job_results_to_model(spark, sf_dir):
    """The job from clean results to the model table over all matches: read, validate, build, validate, write."""
    names = jobs.Tables(
        venues=_fresh("venues"), international_teams=_fresh("teams"), schema_tables=_fresh("schema_tables"), schema_columns=_fresh("schema_columns")
    )
    source, target = _fresh("results"), _fresh("model")
    views.matches(spark, sf_dir).write.saveAsTable(source)
    views.teams(spark, sf_dir).write.saveAsTable(names.international_teams)
    views.venues(spark, sf_dir).write.saveAsTable(names.venues)
    spark.createDataFrame(
        [(1, source, None, None), (2, target, None, None)],
        "id int, table_name string, integration_type string, integration_provider string",
    ).write.saveAsTable(names.schema_tables)
    known = [(1, "HomeScore", "int"), (1, "HomeTeam", "string"), (2, "PointDiff", "int"), (2, "TimeDecayWeight", "float")]
    spark.createDataFrame(
        [(table, column, kind, True, at) for at, (table, column, kind) in enumerate(known)],
        "table_id int, column_name string, data_type string, is_required boolean, ordinal_position int",
    ).write.saveAsTable(names.schema_columns)
    job = {"pipeline_name": "international_results_to_model", "source_table": source, "target_table": target}
    jobs.run_job(spark, {**job, "batch_id": "b", "system_event_id": "s"}, names)
    return _model_ready(spark.table(target).drop("CreatedAt"))


@query
def date_spine(spark, sf_dir):
    bounds = (
        views.table(spark, sf_dir, "orders")
        .groupBy("o_orderpriority")
        .agg(F.min("o_orderdate").alias("first_day"), F.max("o_orderdate").alias("last_day"))
    )
    spine = bounds.select("o_orderpriority", F.explode(days_between(F.col("first_day"), F.col("last_day"))).alias("day"))
    return spine.select("o_orderpriority", day_text("day"))


@query
def incremental_range(spark, sf_dir):
    history = views.ledger(spark, sf_dir)
    ranges = ingestion.fetch_ranges(history, history, TODAY, dt.date(2024, 1, 1))
    return ranges.select("integration_provider", "integration_type", day_text("first_day"), day_text("last_day"), "dataset")


@query
def fetch_days(spark, sf_dir):
    history = views.ledger(spark, sf_dir)
    days = ingestion.fetch_days(ingestion.fetch_ranges(history, history, TODAY, dt.date(2024, 1, 1)))
    return days.select("integration_provider", "integration_type", day_text("day"))


# ---- extraction ------------------------------------------------------------------------


@query
def url_param(spark, sf_dir):
    return views.table(spark, sf_dir, "pages").select(
        "page_id", query_parameter("url", "page").alias("page"), query_parameter("url", "ref").alias("ref")
    )


@query
def extract_pages(spark, sf_dir):
    wanted = views.matches(spark, sf_dir).where("HomeScore > 25").select(F.col("MatchDate").cast("date").alias("day"))
    tasks = spark.sparkContext.defaultParallelism  # the test tables are single files
    return pages.extract_games(views.game_pages(spark, sf_dir), "fixtures", "feed", wanted, tasks).drop("pos")


@query
def streamed_pages(spark, sf_dir):
    """Two runs of the page stream; the second finds all games again, under other page ids, and keeps the unseen."""
    folder, target, state = (scratch_path(spark, name) for name in ("pages", "games", "stream"))
    found = views.game_pages(spark, sf_dir).select("page_id", F.lit("u").alias("url"), "html")
    for run in (found.where("page_id % 3 <> 0"), found.withColumn("page_id", F.col("page_id") + 1_000_000_000)):
        run.repartition(spark.sparkContext.defaultParallelism).write.mode("append").parquet(folder)
        ingest.ingest_new_pages(ingest.page_stream(spark, folder), "fixtures", "feed", target, state).awaitTermination()
    return spark.read.parquet(target)


@query
def requested_dates(spark, sf_dir):
    """Keep feed records whose date was asked for (semi-join with a date spine)."""
    records = views.scraped(spark, sf_dir).select("record", "match_date", "home_team")
    asked = views.table(spark, sf_dir, "events").select(
        F.add_months(F.col("ts").cast("date"), -12 * 25).alias("day")
    )
    bounds = asked.agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"))
    spine = ingestion.date_spine(bounds, "first_day", "last_day").select(day_text("day", "match_date"))
    return records.join(spine, "match_date", "left_semi")


@query
def completed_exclusion(spark, sf_dir):
    return rows.exclude_completed(views.scraped(spark, sf_dir)).select("record", "integration_type", "state")


@query
def dedup_keep_first(spark, sf_dir):
    records = views.scraped(spark, sf_dir).select("match_id", "page_id", "pos", "record", "home_team")
    return rows.keep_first(records, "match_id", ["page_id", "pos", "record"])


# ---- cleaning --------------------------------------------------------------------------


@query
def allow_list(spark, sf_dir):
    kept = rows.keep_allowed(views.scraped(spark, sf_dir), "competition_name", cleaning.INTERNATIONAL_COMPETITIONS)
    return kept.select("record", "competition_name")


@query
def distinct_rows(spark, sf_dir):
    whole = views.table(spark, sf_dir, "documents").select("text", "lang", "source", "n_chars")
    return rows.distinct_rows(whole).select(F.md5("text").alias("text_md5"), "lang", "source", "n_chars")


@query
def drop_nulls(spark, sf_dir):
    kept = rows.drop_null_rows(views.scraped(spark, sf_dir), ["match_date", "home_score", "match_id"])
    return kept.select("record", "match_date", "home_score", "match_id")


@query
def kickoff_ts(spark, sf_dir):
    feed = views.scraped(spark, sf_dir)
    at = kickoff_timestamp(timestamp_of(feed, "match_date"), "kickoff_time_local")
    return feed.select("record", at.alias("at")).select("record", second_text("at", "kickoff"))


@query
def midnight_dates(spark, sf_dir):
    events = views.table(spark, sf_dir, "events").withColumn(
        "text", F.when(F.col("event_type") == "error", F.lit("not a date")).otherwise(F.col("ts").cast("string"))
    )
    return events.select("event_id", midnight(timestamp_of(events, "text")).alias("at")).select(
        "event_id", second_text("at", "day")
    )


@query
def name_keys(spark, sf_dir):
    feed = views.scraped(spark, sf_dir)
    return feed.select("record", name_key("home_team").alias("team_key"), name_key("venue").alias("venue_key"))


@query
def blank_text(spark, sf_dir):
    padded = views.table(spark, sf_dir, "part").withColumn(
        "text", F.when(F.col("p_size") > 25, F.lit(" \t ")).otherwise(F.concat(F.lit("  "), "p_name", F.lit("\n")))
    )
    return padded.select("p_partkey", blank_to_null("text").alias("clean"))


@query
def neutral_matches(spark, sf_dir):
    located = lookups.add_city_and_country(
        views.scraped(spark, sf_dir), tables.active_venues(views.venues(spark, sf_dir))
    )
    return located.select("record", "country", neutral_flag("home_team", "away_team", "country").alias("neutral"))


@query
def contains_flag(spark, sf_dir):
    feed = views.scraped(spark, sf_dir)
    return feed.select("record", contains_ignore_case("competition_name", "world cup").alias("world_cup"))


@query
def geo_lookup(spark, sf_dir):
    located = lookups.add_city_and_country(
        views.scraped(spark, sf_dir), tables.active_venues(views.venues(spark, sf_dir))
    )
    return located.select("record", "venue", "city", "country")


def _active(spark, sf_dir):
    return tables.active_venues(views.venues(spark, sf_dir))


@query
def historical_results(spark, sf_dir):
    return with_text_dates(cleaning.historical_to_results(views.historical(spark, sf_dir)))


@query
def international_results(spark, sf_dir):
    feed = views.scraped(spark, sf_dir)
    return with_text_dates(cleaning.scraped_to_international_results(feed, _active(spark, sf_dir)))


@query
def league_results(spark, sf_dir):
    feed = views.scraped(spark, sf_dir)
    return with_text_dates(cleaning.scraped_to_league_results(feed, _active(spark, sf_dir)))


@query
def international_fixtures(spark, sf_dir):
    feed = views.scraped(spark, sf_dir)
    return with_text_dates(cleaning.scraped_to_international_fixtures(feed, _active(spark, sf_dir)))


@query
def league_fixtures(spark, sf_dir):
    feed = views.scraped(spark, sf_dir)
    return with_text_dates(cleaning.scraped_to_league_fixtures(feed, _active(spark, sf_dir)))


# ---- names, attributes, form -----------------------------------------------------------


@query
def team_filter(spark, sf_dir):
    kept = lookups.keep_canonical_teams(views.matches(spark, sf_dir), views.teams(spark, sf_dir))
    return kept.select("ID", "HomeTeam", "AwayTeam")


@query
def venue_filter(spark, sf_dir):
    kept = lookups.keep_canonical_venues(views.matches(spark, sf_dir), views.venues(spark, sf_dir))
    return kept.select("ID", "Venue")


@query
def rejected_names(spark, sf_dir):
    return lookups.rejected_names(
        views.scraped(spark, sf_dir), views.teams(spark, sf_dir), ["home_team", "away_team"], "TeamName", "teams"
    )


@query
def team_attrs(spark, sf_dir):
    added = lookups.add_team_features(views.matches(spark, sf_dir), views.teams(spark, sf_dir), with_tier=True)
    return added.select("ID", "HomeTeam", "AwayTeam", *lookups.TEAM_FEATURES)


@query
def league_attrs(spark, sf_dir):
    added = lookups.add_team_features(views.matches(spark, sf_dir), views.teams(spark, sf_dir), with_tier=False)
    return added.select("ID", "Home_Hemisphere", "Away_Hemisphere")


@query
def union_fixtures(spark, sf_dir):
    both = form.union_fixtures(views.fixtures(spark, sf_dir), views.results(spark, sf_dir), "origin")
    return with_text_dates(both.select("ID", "origin", "KickoffTimeLocal", "HomeScore", "AwayScore"))


@query
def long_format(spark, sf_dir):
    both = form.union_fixtures(views.fixtures(spark, sf_dir), views.results(spark, sf_dir))
    return with_text_dates(form.to_team_rows(both, context=["CompetitionName", "Nowhere"]))


@query
def lagged_windows(spark, sf_dir):
    """Rolling mean and sum of the previous three values per user, nulls skipped."""
    events = views.table(spark, sf_dir, "events")
    gaps = events.withColumn("amount", F.when(F.col("event_type") != "error", F.floor("value")))
    summed = ordering.lagged(
        gaps,
        ["user_id"],
        [F.col("ts"), F.col("event_id")],
        3,
        lambda w: {"mean_3": lagged_mean("amount", w, 3), "sum_3": lagged_sum("amount", w, 3)},
    )
    return summed.select("event_id", "mean_3", "sum_3")


@query
def rolling_form(spark, sf_dir):
    both = form.union_fixtures(views.fixtures(spark, sf_dir), views.results(spark, sf_dir))
    long = form.to_team_rows(both, context=["KickoffTimeLocal"])
    return form.rolling_form(long).select("ID", "Team", "IsHome", *form.FORM_COLUMNS)


def _season(spark, sf_dir) -> DataFrame:
    return views.matches(spark, sf_dir).where(F.col("MatchDate") >= F.lit(views.SEASON_START).cast("timestamp_ntz"))


@query
def form_increment(spark, sf_dir):
    """Form of the newest season from stored tails: the history is absorbed in two batches, the second of them twice."""
    history = form.to_team_rows(views.results(spark, sf_dir))
    early = F.col("MatchDate") < F.lit(dt.datetime(1998, 1, 1))
    state = form_state.FormState(spark, scratch_path(spark, "form-state"))
    state.absorb(history.where(early), "to 1997")
    for _ in range(2):
        state.absorb(history.where(~early), "to 2000")
    out = state.form(form.to_team_rows(_season(spark, sf_dir)), "2001")
    return out.select("ID", "Team", "IsHome", *form.FORM_COLUMNS, "Restated")


@query
def fixtures_increment(spark, sf_dir):
    """The fixtures build from a stored tail of the results."""
    teams, venues = views.teams(spark, sf_dir), views.venues(spark, sf_dir)
    state = form_state.FormState(spark, scratch_path(spark, "form-state"))
    state.absorb(features.results_team_rows(views.results(spark, sf_dir), teams, venues), "results")
    return _model_ready(features.fixtures_from_tail(views.fixtures(spark, sf_dir), state.before("fixtures"), teams, venues))


@query
def attach_form(spark, sf_dir):
    played = views.matches(spark, sf_dir)
    with_form = form.attach_form(played, form.rolling_form(form.to_team_rows(played)))
    return with_form.drop("MatchDate", "CompetitionName", "Venue")


@query
def attach_form_gaps(spark, sf_dir):
    """Form of all matches when some sides are unknown: the known side keeps its own."""
    played = views.matches(spark, sf_dir).withColumns(
        {
            "HomeTeam": F.when(F.col("ID") % 11 > 0, F.col("HomeTeam")),
            "AwayTeam": F.when(F.col("ID") % 13 > 0, F.col("AwayTeam")),
        }
    )
    with_form = form.attach_form(played, form.rolling_form(form.to_team_rows(played)))
    return with_form.drop("MatchDate", "CompetitionName", "Venue")


@query
def targets(spark, sf_dir):
    return form.add_targets(views.matches(spark, sf_dir)).select("ID", "PointDiff", "HomeWin")


@query
def time_decay(spark, sf_dir):
    weighted = form.add_time_decay(views.matches(spark, sf_dir), half_life_years=5.0)
    return weighted.select("ID", F.round("TimeDecayWeight", 9).alias("weight"))


def _model_ready(df: DataFrame) -> DataFrame:
    return with_text_dates(df.withColumn("TimeDecayWeight", F.round("TimeDecayWeight", 9)))


@query
def results_model_ready(spark, sf_dir):
    return _model_ready(
        features.results_model_ready(
            views.matches(spark, sf_dir), views.teams(spark, sf_dir), views.venues(spark, sf_dir), features.INTERNATIONAL
        )
    )


@query
def fixtures_model_ready(spark, sf_dir):
    return _model_ready(
        features.fixtures_model_ready(
            views.fixtures(spark, sf_dir),
            views.results(spark, sf_dir),
            views.teams(spark, sf_dir),
            views.venues(spark, sf_dir),
            features.INTERNATIONAL,
        )
    )


@query
def league_model_ready(spark, sf_dir):
    return _model_ready(
        features.results_model_ready(
            views.matches(spark, sf_dir), views.teams(spark, sf_dir), views.venues(spark, sf_dir), features.LEAGUE
        )
    )


@query
def league_fixtures_model_ready(spark, sf_dir):
    return _model_ready(
        features.fixtures_model_ready(
            views.fixtures(spark, sf_dir),
            views.results(spark, sf_dir),
            views.teams(spark, sf_dir),
            views.venues(spark, sf_dir),
            features.LEAGUE,
        )
    )


# ---- catalog, validation, profiling ----------------------------------------------------


@query
def schema_catalog(spark, sf_dir):
    return catalog.catalog_columns(
        views.catalog_tables(spark, sf_dir),
        views.catalog_columns(spark, sf_dir),
        integration_type="LARGE",
        integration_provider="Brand#17",
    )


@query
def schema_hash(spark, sf_dir):
    """Column fingerprint of every order line, reading its values as column names."""
    lines = views.table(spark, sf_dir, "lineitem")
    names = F.array(*[F.concat(F.lit(f"{c}_"), F.col(c)) for c in ("l_partkey", "l_suppkey", "l_returnflag")])
    return lines.select("l_orderkey", "l_linenumber", quality.schema_fingerprint(names).alias("schema_hash"))


@query
def type_check(spark, sf_dir):
    judged = views.table(spark, sf_dir, "orders").join(
        views.table(spark, sf_dir, "labels"), F.col("o_orderkey") == F.col("doc_id"), "left"
    )
    rules = [
        ColumnRule("o_orderkey", "int", True),
        ColumnRule("o_totalprice", "decimal", True),
        ColumnRule("o_orderdate", "date"),
        ColumnRule("o_orderpriority", "int"),
        ColumnRule("quality", "bit"),
        ColumnRule("o_custkey", "bool"),
        ColumnRule("o_orderstatus", "unheard of"),
        ColumnRule("absent", "string", True),
    ]
    return quality.validation_report(judged, rules)


def _loosely_typed(spark, sf_dir) -> DataFrame:
    """Customers with numbers as text, blanks and padding."""
    account = F.when(F.col("c_custkey") % 40 == 0, F.lit(" ")).otherwise(F.col("c_acctbal").cast("string"))
    half = F.when(F.col("c_custkey") % 2 == 0, F.lit("n/a")).otherwise(F.col("c_custkey").cast("string"))
    padded = F.when(F.col("c_custkey") % 3 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" "), "c_name", F.lit(" ")))
    return views.table(spark, sf_dir, "customer").select(
        "c_custkey",
        account.alias("account"),
        half.alias("half_numeric"),
        F.col("c_mktsegment").alias("segment"),
        padded.alias("name"),
    )


@query
def profile_columns(spark, sf_dir):
    loose = _loosely_typed(spark, sf_dir)
    kinds = quality.classify_text_columns(loose)
    kind = F.element_at(F.create_map(*[F.lit(v) for pair in kinds.items() for v in pair]), F.col("column_name"))
    return quality.profile_text_columns(loose).select("column_name", "rows", "non_null", "numeric", kind.alias("kind"))


@query
def normalise_types(spark, sf_dir):
    return quality.normalise_types(_loosely_typed(spark, sf_dir))


# ---- ledger ----------------------------------------------------------------------------


@query
def status_filter(spark, sf_dir):
    return ledger.with_status(views.ledger(spark, sf_dir), "ingested").select("id", "batch_id", "status")


@query
def plan_expansion(spark, sf_dir):
    plan = ledger.work_plan(
        views.ledger(spark, sf_dir).withColumns({"container_name": F.lit("raw"), "blob_path": F.lit("x")}),
        views.mappings(spark, sf_dir),
    )
    return plan.select("system_event_id", "batch_id", "target_table", "pipeline_name", "execution_order")


@query
def plan_persist(spark, sf_dir):
    plan = ledger.work_plan(
        views.ledger(spark, sf_dir).withColumns({"container_name": F.lit("raw"), "blob_path": F.lit("x")}),
        views.mappings(spark, sf_dir),
    )
    events = ledger.plan_events(plan)
    return events.select("batch_id", "pipeline_name", "status", (F.length("id") == 36).alias("has_id"))


@query
def high_water(spark, sf_dir):
    marks = ingestion.high_water(views.ledger(spark, sf_dir))
    return marks.select("integration_provider", "integration_type", second_text("high_water"))


@query
def latest_version(spark, sf_dir):
    artifacts = views.ledger(spark, sf_dir).select(
        F.col("batch_id").alias("model_key"), F.col("status").alias("trainer_key"), F.col("id").alias("version"), "error_message"
    )
    return rows.latest_per_key(artifacts, ["model_key", "trainer_key"], "version")


@query
def next_version(spark, sf_dir):
    artifacts = views.table(spark, sf_dir, "lineitem").select("l_partkey", "l_linenumber")
    wanted = views.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"))
    return rows.next_version(artifacts, "l_partkey", "l_linenumber", wanted)


@query
def batch_rollup(spark, sf_dir):
    events = views.table(spark, sf_dir, "events")
    children = events.select(
        F.floor(F.col("event_id") / 4).alias("batch_id"),
        F.when(F.col("event_type") == "error", F.lit("failed")).otherwise("succeeded").alias("status"),
    )
    batches = events.select(F.floor(F.col("event_id") / 2).alias("batch_id")).distinct()
    return ledger.roll_up(batches, children)


@query
def ledger_state(spark, sf_dir):
    state = ledger.current_state(
        views.ledger(spark, sf_dir), key="batch_id", at="created_at", values=("status", "error_message"), tie="id"
    )
    return state.select("batch_id", second_text("created_at", "at"), "status", "error_message")


# ---- metrics, models, report -----------------------------------------------------------


@query
def time_split(spark, sf_dir):
    split = modelling.time_split(views.matches(spark, sf_dir), "MatchDate", "ID", 0.2, "is_validation")
    return split.select("ID", "is_validation")


@query
def binary_metrics(spark, sf_dir):
    found = metrics.binary_metrics(views.scores(spark, sf_dir), "HomeWin", "home_win", "weight")
    return found.select(*[F.round(c, 9).alias(c) for c in found.columns])


@query
def auc(spark, sf_dir):
    area = metrics.area_under_roc(views.scores(spark, sf_dir), "HomeWin", "home_win", "weight")
    return spark.createDataFrame([(area,)], "auc double").select(F.round("auc", 9).alias("auc"))


@query
def regression_metrics(spark, sf_dir):
    found = metrics.regression_metrics(views.scores(spark, sf_dir), "PointDiff", "point_diff", "weight")
    return found.select(*[F.round(c, 9).alias(c) for c in found.columns])


def _given_scores() -> tuple[modelling.GroupSpec, dict[str, PipelineModel]]:
    """Two models whose scores are columns of the frame."""
    spec = dataclasses.replace(_model_group(), entities=("ID", "HomeTeam"), results_table=_fresh("scored"))
    keys = {"homewin_v1": "home_win", "pointdiff_v1": "point_diff"}
    models = tuple(dataclasses.replace(m, prediction_type="regression") for m in spec.models)
    pipelines = {
        key: PipelineModel([SQLTransformer(statement=f"SELECT *, {column} AS prediction FROM __THIS__")]) for key, column in keys.items()
    }
    return dataclasses.replace(spec, models=models), pipelines


@query
def wide_scores(spark, sf_dir):
    wide = modelling.score_group(views.scores(spark, sf_dir), *_given_scores())
    return wide.withColumn("homewin_v1", F.round("homewin_v1", 9))


@query
def stored_scores(spark, sf_dir):
    """The results table after a run with scores; before it, a run without any emptied older rows."""
    spec, pipelines = _given_scores()
    scored = modelling.score_group(views.scores(spark, sf_dir), spec, pipelines)
    rules = [ColumnRule("ID", "int", True), ColumnRule("homewin_v1", "float", True)]
    modelling.save_scores(scored.where("ID % 2 = 0"), spark, spec, "run 1", rules)
    modelling.save_scores(None, spark, spec, "run 2", rules)
    emptied = spark.table(spec.results_table).count()
    modelling.save_scores(scored, spark, spec, "run 3", rules)
    out = spark.table(spec.results_table).where(F.lit(emptied == 0))
    return out.select(
        "ID", F.round("homewin_v1", 9).alias("homewin_v1"), "pointdiff_v1", "SystemEventId", "ModelGroupKey",
        F.col("ScoredAtUtc").isNotNull().alias("stamped"),
    )


@query
def training_rows(spark, sf_dir):
    """Rows with a label and every feature, and which of them validate."""
    made = views.matches(spark, sf_dir).withColumns(
        {"AwayScore": F.when(F.col("ID") % 7 > 0, F.col("AwayScore")), "Venue": F.when(F.col("ID") % 5 > 0, F.col("Venue"))}
    )
    complete = modelling.drop_incomplete(made, "AwayScore", ["HomeScore", "Venue"])
    return modelling.time_split(complete, "MatchDate", "ID", 0.25, "is_validation").select("ID", "is_validation")


@query
def model_metrics(spark, sf_dir):
    """Metrics of three models in every competition: one row a model and competition."""
    scored = views.scores(spark, sf_dir)
    models = {"logistic": F.col("home_win"), "coarse": F.round("home_win", 1), "contrary": 1 - F.col("home_win")}
    entries = [F.struct(F.lit(key).alias("model_key"), value.alias("score")) for key, value in models.items()]
    long = scored.select("CompetitionName", "HomeWin", "weight", F.inline(F.array(*entries)))
    out = metrics.grouped_binary_metrics(long, ["model_key", "CompetitionName"], "HomeWin", "score", "weight")
    return out.select("model_key", "CompetitionName", *[F.round(c, 9).alias(c) for c in ("accuracy", "f1", "logloss", "auc")])


def _gap_group(key: str, **trainer) -> modelling.GroupSpec:
    parameters = {"n_estimators": 12, "max_depth": 3, "learning_rate": 0.5, "seed": 7, "early_stopping_rounds": 3}
    specs = [
        modelling.ModelSpec(f"{key} {target}", "trees", target, kind, "weight", "MatchDate", parameters, trainer)
        for target, kind in (("HomeWin", "binary"), ("PointDiff", "regression"))
    ]
    return modelling.GroupSpec(key, "", "", None, tuple(specs), ("ID",), ("HomeScore", "AwayScore"), ("HomeWin", "PointDiff"), "weight")


def _with_gaps(spark, sf_dir) -> DataFrame:
    """Matches whose home score is unknown when the home side lost by a lot, and of a few others."""
    scored = views.scores(spark, sf_dir).join(views.matches(spark, sf_dir).select("ID", "HomeScore", "AwayScore"), "ID")
    unknown = (F.col("PointDiff") < -20) | (F.col("ID") % 11 == 0)
    return scored.withColumn("HomeScore", F.when(~unknown, F.col("HomeScore")))


@query
def boosting_checks(spark, sf_dir):
    """What must hold of trained trees with and without rows that have nulls: the rows that train, the round of least
    loss within the patience, and scores better than the best constant, also on the rows with nulls alone."""
    data, made = _with_gaps(spark, sf_dir).persist(), []
    try:
        for key, trainer in (("complete", {}), ("gaps", {"dropna": False})):
            spec = _gap_group(key, **trainer)
            for model in spec.models:
                one = modelling.train(data, model, spec)
                least = one.losses[one.rounds - 1] == min(one.losses[: one.rounds + 3])
                scored = modelling.add_score(data, one.pipeline, model.prediction_type, "score")
                label = F.col(model.target_column)
                mean = data.agg(F.avg(label)).first()[0]
                gained = scored.withColumn("gain", (F.lit(mean) - label) ** 2 - (F.col("score") - label) ** 2)
                gains = gained.groupBy(F.col("HomeScore").isNull().alias("gap")).agg(F.sum("gain").alias("gain")).collect()  # two rows
                gain_of = {row["gap"]: row["gain"] for row in gains}
                on_gaps = gain_of[True] > 0 if key == "gaps" else True
                made.append((model.model_key, one.train_rows, one.rounds >= 1 and least, gain_of[False] > 0, on_gaps))
    finally:
        data.unpersist()
    return spark.createDataFrame(
        made, "model_key string, train_rows bigint, least_loss boolean, beats_constant boolean, beats_constant_on_gaps boolean"
    )


@query
def stored_models(spark, sf_dir):
    """Train, store twice, load the newest version by fingerprint and score: nothing may differ from the model in memory."""
    data, spec = _with_gaps(spark, sf_dir), _gap_group("stored", dropna=False)
    root, name = scratch_path(spark, "artifacts"), f"artifacts_{uuid.uuid4().hex}"
    trained = modelling.train_group(data, spec)
    for one, found in [*trained, *trained]:
        modelling.save_artifact(spark, root, name, one, found, "run")
    artifacts = spark.table(name)
    fingerprint, _ = modelling.prepare_scoring(data, spec)
    loaded = {m.model_key: modelling.load_artifact(artifacts, m, fingerprint) for m in spec.models}
    held = {one.spec.model_key: one.pipeline for one, _ in trained}
    keys = [m.model_key for m in spec.models]
    both = [modelling.score_group(data, spec, pipelines).select("ID", F.struct(*[F.col(f"`{k}`") for k in keys]).alias(side))
            for pipelines, side in ((held, "in_memory"), (loaded, "loaded"))]
    compared = both[0].join(both[1], "ID").agg(
        F.count("*").alias("scored_rows"), F.count_if(~F.col("in_memory").eqNullSafe(F.col("loaded"))).alias("differing_rows")
    ).first()
    return modelling.latest_artifacts(artifacts).select(
        F.col("ModelKey").alias("model_key"), F.col("ArtifactVersion").alias("version"),
        F.col("Metrics").contains("null").alias("lacks_metrics"),
        *[F.lit(compared[c]).cast("long").alias(c) for c in ("scored_rows", "differing_rows")],
    )


def _model_group() -> modelling.GroupSpec:
    feature_columns = (
        "Home_Tier", "Away_Tier", "Home_Hemisphere", "Away_Hemisphere", "Home_FormWinRate", "Away_FormWinRate",
        "Diff_FormPointDiff",
    )
    parameters = {"n_estimators": 5, "max_depth": 3, "random_state": 7}
    common = {"sample_weight_column": None, "time_column": "MatchDate", "model_parameters": parameters}
    return modelling.GroupSpec(
        key="international",
        training_source="results",
        scoring_source="fixtures",
        results_table=None,
        models=(
            modelling.ModelSpec("homewin_v1", "classifier_v1", "HomeWin", "classification", **common),
            modelling.ModelSpec("pointdiff_v1", "regressor_v1", "PointDiff", "regression", **common),
        ),
        entities=("ID",),
        features=feature_columns,
        targets=("HomeWin", "PointDiff"),
        weight="TimeDecayWeight",
    )


@query
def train_score(spark, sf_dir):
    """Train both models on the results build and score the fixtures build."""
    spec = _model_group()
    teams, venues = views.teams(spark, sf_dir), views.venues(spark, sf_dir)
    training = features.results_model_ready(views.results(spark, sf_dir), teams, venues)
    upcoming = features.fixtures_model_ready(views.fixtures(spark, sf_dir), views.results(spark, sf_dir), teams, venues)
    trained = modelling.train_group(training.select(modelling.dataset_columns(spec, "training")), spec)
    pipelines = {one.spec.model_key: one.pipeline for one, _ in trained}
    return modelling.score_group(upcoming.select(modelling.dataset_columns(spec, "scoring")), spec, pipelines)


@query
def train_score_checks(spark, sf_dir):
    """What holds for any training: every fixture once, a probability, a finite margin, no constant scores."""
    out = train_score(spark, sf_dir)
    varied = [F.max(c) > F.min(c) for c in ("homewin_v1", "pointdiff_v1")]
    varies = out.agg((varied[0] & varied[1]).alias("varies")).scalar()
    finite = F.col("pointdiff_v1").isNotNull() & ~F.isnan("pointdiff_v1") & (F.abs("pointdiff_v1") < float("inf"))
    return out.select("ID", F.col("homewin_v1").between(0, 1).alias("is_probability"), finite.alias("is_finite"), varies.alias("scores_vary"))


def _scored(spark, sf_dir) -> list[tuple[DataFrame, report.ScoredTable]]:
    scored = views.scores(spark, sf_dir)
    scored = scored.withColumns({c: F.when(F.col("ID") % 4 > 0, F.col(c)) for c in ("home_win", "point_diff")})
    league = F.col("CompetitionName") == "UNITED RUGBY CHAMPIONSHIP"
    columns = ("CompetitionName", "HomeTeam", "AwayTeam", "home_win", "point_diff")
    return [
        (scored.where(~league), report.ScoredTable("InternationalScores", *columns)),
        (scored.where(league), report.ScoredTable("LeagueScores", *columns)),
    ]


def _predictions(spark, sf_dir) -> DataFrame:
    return report.daily_predictions(_scored(spark, sf_dir), REPORT_DAY)


@query
def daily_predictions(spark, sf_dir):
    return _predictions(spark, sf_dir).withColumn("home_team_win_prob", F.round("home_team_win_prob", 9))


@query
def digest(spark, sf_dir):
    return report.digest(_predictions(spark, sf_dir))


@query
def digest_sections(spark, sf_dir):
    return report.digest_sections(_predictions(spark, sf_dir))


@query
def partitioned_predictions(spark, sf_dir):
    """The day's predictions from tables in partitions of batch and day; the later batch ran before, with all its days shifted."""
    made, new = [], F.col("ScoredAtUtc") >= F.lit(dt.datetime(1997, 1, 1))
    for scored, one in _scored(spark, sf_dir):
        name = _fresh("scored")
        shifted = scored.where(new).withColumn("ScoredAtUtc", F.col("ScoredAtUtc") + F.expr("INTERVAL 1 DAY"))
        for batch, rows_of_batch in (("new", shifted), ("old", scored.where(~new)), ("new", scored.where(new))):
            partitioned.write_batch(rows_of_batch, name, batch, "ScoredAtUtc")
        made.append((spark.table(name), one))
    return report.daily_predictions(made, REPORT_DAY).withColumn("home_team_win_prob", F.round("home_team_win_prob", 9))


@query
def wide_category_checks(spark, sf_dir):
    """Trees on the part of an order line as text, which has too many values for categories: the rows that train, an error
    below half of the constant's on all rows, and the same scores from the stored model."""
    lines = views.table(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("ID"),
        F.concat(F.lit("part "), "l_partkey").alias("part"),
        F.col("l_quantity").cast("double").alias("quantity"),
        F.col("l_shipdate").cast("timestamp").alias("shipped"),
        (F.crc32(F.col("l_partkey").cast("string").cast("binary")) % 100 + F.col("l_quantity") / 10).cast("double").alias("amount"),
    ).persist()
    made = []
    try:
        for key, time in (("by day", "shipped"), ("by fold", None)):
            trainer, parameters = {"max_categories": 50}, {"n_estimators": 8, "max_depth": 4, "random_state": 7}
            model = modelling.ModelSpec(key, "trainer", "amount", "regression", None, time, parameters, trainer)
            spec = modelling.GroupSpec("lines", "", "", None, (model,), ("ID",), ("part", "quantity"), ("amount",), None)
            one = modelling.train(lines, model, spec)
            root = scratch_path(spark, "artifacts")
            one.pipeline.write().save(root)
            scored = modelling.add_score(lines, one.pipeline, "regression", "score")
            scored = modelling.add_score(scored, PipelineModel.load(root), "regression", "loaded")
            mean = lines.agg(F.avg("amount")).first()[0]
            found = scored.agg(
                F.count("*").alias("rows"),
                F.sum((F.col("score") - F.col("amount")) ** 2).alias("error"),
                F.sum((F.lit(mean) - F.col("amount")) ** 2).alias("constant"),
                F.count_if(F.abs(F.col("score") - F.col("loaded")) > 1e-9).alias("differing_rows"),
            ).first()
            made.append((key, one.train_rows, found["rows"], found["error"] < 0.5 * found["constant"], found["differing_rows"]))
    finally:
        lines.unpersist()
    return spark.createDataFrame(
        made, "model_key string, train_rows bigint, scored_rows bigint, beats_constant boolean, differing_rows bigint"
    )
