"""Clean match tables to model-ready tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.functions.dates import midnight, timestamp_of
from touchline.operators.form import (
    FORM_COLUMNS,
    FORM_DIFFERENCES,
    SIDE_FORM,
    add_targets,
    add_time_decay,
    folded_form,
    latest_date,
    rolling_form,
    to_team_rows,
    union_fixtures,
    with_differences,
)
from touchline.operators.form_state import form_increment
from touchline.operators.lookups import add_team_features, keep_canonical_teams, keep_canonical_venues
from touchline.operators.ordering import dealt
from touchline.operators.rows import drop_null_rows, without_columns
from touchline.session import scratch_path

AUDIT_COLUMNS = ("CreatedAt",)
SCORES = ("HomeScore", "AwayScore")
FORM_WINDOW = 10
# Tells fixture ids from result ids, which are numbered per table.
SOURCE = "_source"
ROW = "_row"


@dataclass(frozen=True)
class FeatureSet:
    """What differs between the international and the league build."""

    with_tier: bool
    half_life_years: float


INTERNATIONAL = FeatureSet(with_tier=True, half_life_years=10.0)
LEAGUE = FeatureSet(with_tier=False, half_life_years=5.0)


def _canonical(matches: DataFrame, teams: DataFrame, venues: DataFrame) -> DataFrame:
    """Matches between known teams at known venues.

    Names are filtered before form is computed: a match at an unknown venue is no history.
    """
    return keep_canonical_venues(keep_canonical_teams(without_columns(matches, *AUDIT_COLUMNS), teams), venues)


def _stored_canonical(matches: DataFrame, teams: DataFrame, venues: DataFrame) -> DataFrame:
    """Canonical matches, written once: the newest date, the cuts of the order and the form read them."""
    # Numbered while written: the number tells matches apart even where ids are null or repeat.
    known = _canonical(matches, teams, venues).withColumn(ROW, F.monotonically_increasing_id())
    path = scratch_path(known.sparkSession, "canonical")
    known.write.parquet(path)
    return known.sparkSession.read.schema(known.schema).parquet(path)


def _with_form(
    known: DataFrame,
    teams: DataFrame,
    features: FeatureSet,
    wanted: Column,
    pieces: int | None,
    tail: DataFrame | None = None,
) -> DataFrame:
    """Form and team attributes on the ``wanted`` matches, from the history in ``known`` and before it in ``tail``.

    The match travels with its home row and the two rows are folded back by row number, so the matches are
    not joined again. Attributes are looked up for wanted matches only.
    """
    match = F.struct(*[c for c in known.columns if c != ROW])
    long = to_team_rows(known.withColumn("_match", match), context=[ROW, "KickoffTimeLocal", "_match"])
    long = long.withColumns({"_wanted": wanted, "_match": F.when(F.col("IsHome") == 1, F.col("_match"))})
    if tail is None:
        form = rolling_form(long, FORM_WINDOW, pieces=pieces)
    else:
        form = form_increment(tail, long, FORM_WINDOW, pieces=pieces).where("not Restated")
    sides = form.where("_wanted").select(ROW, "_match", "IsHome", *FORM_COLUMNS)
    folded = (
        dealt(sides, [ROW], like=long.where("_wanted"))  # ``long`` reads the stored matches, no window
        .groupBy(ROW)
        .agg(F.first("_match", ignorenulls=True).alias("_match"), *folded_form())
        .select("_match.*", *SIDE_FORM)
    )
    out = with_differences(add_team_features(folded, teams, features.with_tier))
    form_columns = [*SIDE_FORM, *[f"Diff_{c}" for c in FORM_DIFFERENCES]]
    return out.select(*[c for c in out.columns if c not in form_columns], *form_columns)


def results_model_ready(
    results: DataFrame,
    teams: DataFrame,
    venues: DataFrame,
    features: FeatureSet = INTERNATIONAL,
    pieces: int | None = None,
) -> DataFrame:
    """Played matches with pre-match features, decay weight and targets; scores removed.

    Draws still count for form and for the newest date; they leave with the targets.
    """
    known = _stored_canonical(results, teams, venues)
    wanted = F.col("PointsFor").isNotNull() & F.col("PointsAgainst").isNotNull()
    played = _with_form(known, teams, features, wanted, pieces)
    reference = latest_date(drop_null_rows(known, SCORES), "MatchDate")
    weighted = add_time_decay(played, "MatchDate", features.half_life_years, reference)
    final = without_columns(add_targets(weighted), *SCORES)
    return final.withColumn("MatchDate", midnight(timestamp_of(final, "MatchDate")))


def fixtures_model_ready(
    fixtures: DataFrame,
    results: DataFrame,
    teams: DataFrame,
    venues: DataFrame,
    features: FeatureSet = INTERNATIONAL,
    pieces: int | None = None,
) -> DataFrame:
    """Upcoming matches with the features the results build gives, from all history.

    Fixtures are the matches with a kick-off time. They are picked out after they took part in the
    ordering, and before anything is folded or looked up.
    """
    known = _stored_canonical(union_fixtures(fixtures, results, SOURCE), teams, venues)
    with_form = _with_form(known, teams, features, F.col("KickoffTimeLocal").isNotNull(), pieces)
    weighted = add_time_decay(with_form, "MatchDate", features.half_life_years, latest_date(known, "MatchDate"))
    final = without_columns(weighted, *SCORES, SOURCE)
    return final.withColumn("MatchDate", midnight(timestamp_of(final, "MatchDate")))


def results_team_rows(results: DataFrame, teams: DataFrame, venues: DataFrame) -> DataFrame:
    """Canonical results, written once, as the team rows that a stored form state counts and absorbs."""
    return to_team_rows(_stored_canonical(results, teams, venues))


def fixtures_from_tail(
    fixtures: DataFrame,
    tail: DataFrame,
    teams: DataFrame,
    venues: DataFrame,
    features: FeatureSet = INTERNATIONAL,
    pieces: int | None = None,
) -> DataFrame:
    """What :func:`fixtures_model_ready` gives, from the tail of :func:`results_team_rows` in place of all results.

    A daily run reads the fixtures and a few rows a team. A fixture older than the tail can tell is an
    error. Columns that only results have are not among the result's.
    """
    absent = {c: F.lit(None).cast("long") for c in SCORES if c not in fixtures.columns}
    known = _stored_canonical(fixtures.withColumns(absent) if absent else fixtures, teams, venues)
    with_form = _with_form(known, teams, features, F.col("KickoffTimeLocal").isNotNull(), pieces, tail)
    newest = F.greatest(latest_date(known, "MatchDate"), tail.agg(F.max("Newest")).scalar())
    final = without_columns(add_time_decay(with_form, "MatchDate", features.half_life_years, newest), *SCORES)
    return final.withColumn("MatchDate", midnight(timestamp_of(final, "MatchDate")))
