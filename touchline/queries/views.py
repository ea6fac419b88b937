"""Match-shaped views of the test tables.

The test tables hold no matches, so orders are read as matches: the customer decides the home
side and the venue, customer and order the away side. Every view is a lazy projection or join
of whole tables.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SEASON_START = dt.datetime(2001, 1, 1)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _team(number: Column, prefix: str = "NATION_") -> Column:
    return F.concat(F.lit(prefix), number.cast("string"))


def _sides() -> tuple[Column, Column]:
    customer, order = F.col("o_custkey"), F.col("o_orderkey")
    return customer % 25, (F.floor(customer / 25) + order) % 25


def _venue_name() -> Column:
    return F.concat(F.lit("Supplier#"), F.lpad((F.col("o_custkey") % 120).cast("string"), 9, "0"))


def _competition() -> Column:
    # Order priority read as a competition.
    names = {
        "1-URGENT": "Rugby World Cup",
        "2-HIGH": "Six Nations",
        "3-MEDIUM": "United Rugby Championship",
        "4-NOT SPECIFIED": "Internationals",
    }
    value = F.lit("Club Friendly")
    for priority, name in names.items():
        value = F.when(F.col("o_orderpriority") == priority, name).otherwise(value)
    return value


def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean results: one row per order whose two sides differ."""
    home, away = _sides()
    return (
        table(spark, sf_dir, "orders")
        .where(home != away)
        .select(
            F.col("o_orderkey").alias("ID"),
            F.col("o_orderdate").alias("MatchDate"),
            _team(home).alias("HomeTeam"),
            _team(away).alias("AwayTeam"),
            (F.floor("o_totalprice") % 50).alias("HomeScore"),
            ((F.col("o_orderkey") * 13) % 50).alias("AwayScore"),
            F.upper(_competition()).alias("CompetitionName"),
            _venue_name().alias("Venue"),
        )
    )


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches before the season in progress."""
    return matches(spark, sf_dir).where(F.col("MatchDate") < F.lit(SEASON_START).cast("timestamp_ntz"))


def fixtures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches of the season in progress, unplayed, with a kick-off time."""
    season = matches(spark, sf_dir).where(F.col("MatchDate") >= F.lit(SEASON_START).cast("timestamp_ntz"))
    kickoff = F.col("MatchDate") + F.make_interval(hours=(F.col("ID") % 12).cast("int"))
    return season.withColumn("KickoffTimeLocal", kickoff).drop("HomeScore", "AwayScore")


def scraped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw feed records: padded lower-case venues, text dates and times, gaps and exact copies."""
    home, away = _sides()
    order, customer, status = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderstatus")
    clock = F.format_string("%d:%02d", order % 12 + 1, customer % 60)
    kickoff = (
        F.when(status == "O", F.concat(clock, F.lit("PM"))).when(status == "F", F.concat(clock, F.lit("am"))).otherwise("TBC")
    )
    played = status != "O"
    raw = (
        table(spark, sf_dir, "orders")
        .where(home != away)
        .select(
            order.alias("record"),
            F.when(order % 2 == 0, F.lit("fixtures")).otherwise("results").alias("integration_type"),
            F.when(customer % 97 != 0, F.date_format("o_orderdate", "yyyy-MM-dd")).alias("match_date"),
            _competition().alias("competition_name"),
            _team(home, "Nation_").alias("home_team"),
            _team(away, "Nation_").alias("away_team"),
            F.when(played, F.floor("o_totalprice") % 50).alias("home_score"),
            F.when(played, (order * 13) % 50).alias("away_score"),
            F.concat(F.lit(" "), F.lower(_venue_name()), F.lit(" ")).alias("venue"),
            kickoff.alias("kickoff_time_local"),
            F.when(status == "F", F.lit("FT")).when(status == "O", F.lit("KO")).alias("state"),
            F.when(status != "P", customer.cast("string")).alias("match_id"),
            F.floor(order / 100).alias("page_id"),
            (order % 100).alias("pos"),
        )
    )
    # Finished games appear twice in the feed.
    copies = F.when(F.col("state") == "FT", F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return raw.withColumn("_copy", F.explode(copies)).drop("_copy")


def historical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scraped records in the layout of the historical file."""
    return scraped(spark, sf_dir).select(
        F.col("match_date").alias("date"),
        "home_team",
        "away_team",
        F.col("home_score").cast("double").alias("home_score"),
        F.col("away_score").cast("double").alias("away_score"),
        F.col("competition_name").alias("competition"),
        F.col("venue").alias("stadium"),
        F.lower("home_team").alias("city"),
        F.lower("away_team").alias("country"),
        F.when(F.col("state") == "FT", F.lit("True")).otherwise("False").alias("neutral"),
        F.col("competition_name").contains("World Cup").cast("int").alias("world_cup"),
    )


def teams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical teams; two nations are missing, so that names get rejected."""
    hemisphere = F.when(F.col("n_regionkey") % 2 == 0, F.lit(" Northern ")).otherwise("southern")
    return (
        table(spark, sf_dir, "nation")
        .where(~F.col("n_nationkey").isin(3, 17))
        .select(F.col("n_name").alias("TeamName"), F.col("n_regionkey").alias("Tier"), hemisphere.alias("Hemisphere"))
    )


def venues(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    supplier = table(spark, sf_dir, "supplier")
    return supplier.join(nation, supplier["s_nationkey"] == nation["n_nationkey"]).select(
        F.col("s_name").alias("VenueName"),
        F.concat(F.lit("City of "), F.col("s_name")).alias("City"),
        F.col("n_name").alias("Country"),
        (F.col("s_acctbal") > 0).alias("IsActive"),
    )


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ingestion events: the user is the batch, the event type the state."""
    # Event type read as a ledger state.
    states = {
        "purchase": "ingested",
        "signup": "preprocessed",
        "view": "preprocessing",
        "click": "succeeded",
        "error": "failed",
    }
    status = F.lit(None).cast("string")
    for event_type, state in states.items():
        status = F.when(F.col("event_type") == event_type, state).otherwise(status)
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.col("user_id").alias("batch_id"),
        F.floor(F.col("event_id") / 4).alias("system_event_id"),
        F.concat(F.lit("provider_"), F.col("user_id") % 5).alias("integration_provider"),
        F.when(F.col("user_id") % 2 == 0, F.lit("results")).otherwise("fixtures").alias("integration_type"),
        status.alias("status"),
        F.col("ts").alias("created_at"),
        F.col("value").cast("string").alias("error_message"),
    )


def mappings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source-to-target mappings, one per nation and feed type."""
    nation = table(spark, sf_dir, "nation")
    return nation.select(
        F.concat(F.lit("provider_"), F.col("n_regionkey")).alias("source_provider"),
        F.when(F.col("n_nationkey") % 2 == 0, F.lit("results")).otherwise("fixtures").alias("source_type"),
        F.lit(None).cast("string").alias("source_table"),
        F.concat(F.lit("target_"), F.col("n_name")).alias("target_table"),
        F.concat(F.lit("job_"), F.col("n_nationkey") % 9).alias("pipeline_name"),
        (F.col("n_nationkey") % 3).cast("bigint").alias("execution_order"),
    )


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches with a win probability, a predicted and an actual margin, and a scoring time."""
    probability = 1 / (1 + F.exp(-(F.col("HomeScore") - 25) / 10))
    margin = F.col("HomeScore") - F.col("AwayScore")
    return matches(spark, sf_dir).select(
        "ID",
        "MatchDate",
        "CompetitionName",
        "HomeTeam",
        "AwayTeam",
        probability.alias("home_win"),
        (F.col("HomeScore") - 25).cast("double").alias("point_diff"),
        margin.alias("PointDiff"),
        (margin > 0).cast("int").alias("HomeWin"),
        (1.0 + F.col("ID") % 7).alias("weight"),
        F.col("MatchDate").cast("timestamp").alias("ScoredAtUtc"),
    )


def game_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored pages, plus one results page per match built from the match itself.

    A built page holds the match under its date header and a second block whose header is no
    date, which extraction has to skip.
    """

    def div(css: str, *content: Column | str) -> Column:
        parts = [F.lit(c) if isinstance(c, str) else c for c in content]
        return F.concat(F.lit(f'<div class="{css}">'), *parts, F.lit("</div>"))

    def logo(side: str, team: str) -> Column:
        return div(f"logo {side}", F.concat(F.lit('<img alt=" '), F.col(team), F.lit('"/>')))

    state = F.when(F.col("HomeScore") > F.col("AwayScore"), F.lit("FT")).otherwise("8:00pm")
    game = div(
        "game",
        div("time", div("state", state), div("venue", F.col("Venue"))),
        logo("home", "HomeTeam"),
        logo("away", "AwayTeam"),
        div("game-time", "8:00PM"),
        div("round", "Round &amp; ", (F.col("ID") % 9).cast("string")),
        div("score home", F.col("HomeScore").cast("string")),
        div("score away", " ", F.col("AwayScore").cast("string"), " "),
        F.concat(F.lit('<a class="link-box" href="https://example.org/match?x=1&amp;g='), F.col("ID"), F.lit('"></a>')),
    )
    competition = F.concat(
        F.lit('<div class="comp" data-id="'), F.length("CompetitionName"), F.lit('"><h2>'), F.col("CompetitionName"), F.lit("</h2>"),
        div("games", game), F.lit("</div>"),
    )
    header = F.date_format("MatchDate", "EEE MMM d, yyyy")
    html = F.concat(
        F.lit('<html><body><br><section class="games-list">'),
        div("games-list-item", div("date", header), competition),
        div("games-list-item", div("date", "Date to be confirmed"), competition),
        F.lit("</section></body></html>"),
    )
    built = matches(spark, sf_dir).select(F.col("ID").alias("page_id"), html.alias("html"))
    stored = table(spark, sf_dir, "pages").select((-1 - F.col("page_id")).alias("page_id"), "html")
    return built.unionByName(stored)


def catalog_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts read as tables of a catalog."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"),
        F.col("p_name").alias("table_name"),
        F.col("p_type").alias("integration_type"),
        F.col("p_brand").alias("integration_provider"),
    )


def catalog_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines read as columns of those tables."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("table_id"),
        F.concat(F.lit("col_"), F.col("l_orderkey")).alias("column_name"),
        F.when(F.col("l_returnflag") == "A", F.lit("int")).otherwise("string").alias("data_type"),
        (F.col("l_linestatus") == "F").alias("is_required"),
        F.col("l_linenumber").cast("bigint").alias("ordinal_position"),
    )
