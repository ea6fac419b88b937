"""Match features: long format, rolling form, attachment, targets and decay weights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from touchline.functions.dates import decay_weight, timestamp_of
from touchline.functions.windows import lagged_mean, lagged_sum
from touchline.operators.ordering import dealt, lagged

FORM_MEANS = {
    "FormWinRate": "Win",
    "FormDrawRate": "Draw",
    "FormPointsFor": "PointsFor",
    "FormPointsAgainst": "PointsAgainst",
    "FormPointDiff": "PointDiff",
}
FORM_COLUMNS = (*FORM_MEANS, "FormGames")
FORM_DIFFERENCES = ("FormWinRate", "FormPointDiff", "FormPointsFor", "FormPointsAgainst")


def to_team_rows(
    matches: DataFrame,
    id_col: str = "ID",
    date_col: str = "MatchDate",
    home: str = "HomeTeam",
    away: str = "AwayTeam",
    home_score: str = "HomeScore",
    away_score: str = "AwayScore",
    context: Sequence[str] = (),
) -> DataFrame:
    """Two rows per match, one from each side's view, from a single scan.

    Win/Draw/Loss are null unless both scores are known. Context columns that do not exist
    are skipped.
    """
    kept = [c for c in context if c in matches.columns]

    def side(team: str, opponent: str, own: str, other: str, is_home: int) -> Column:
        return F.struct(
            F.col(team).alias("Team"),
            F.col(opponent).alias("Opponent"),
            F.col(own).alias("PointsFor"),
            F.col(other).alias("PointsAgainst"),
            F.lit(is_home).alias("IsHome"),
        )

    sides = F.array(side(home, away, home_score, away_score, 1), side(away, home, away_score, home_score, 0))
    long = matches.select(
        id_col,
        timestamp_of(matches, date_col).alias(date_col),
        *kept,
        F.inline(sides),
    ).withColumn("PointDiff", F.col("PointsFor") - F.col("PointsAgainst"))
    played = F.col("PointDiff").isNotNull()
    outcome = {"Win": F.col("PointDiff") > 0, "Draw": F.col("PointDiff") == 0, "Loss": F.col("PointDiff") < 0}
    return long.withColumns({name: F.when(played, test.cast("long")) for name, test in outcome.items()})


def rolling_form(
    team_rows: DataFrame,
    window_rows: int = 10,
    date_col: str = "MatchDate",
    id_col: str = "ID",
    tie_break: Sequence[str] = ("KickoffTimeLocal",),
    pieces: int | None = None,
) -> DataFrame:
    """Form over each team's previous ``window_rows`` rows, ordered by (date nulls last, id, kick-off).

    The frame counts rows, so an unplayed fixture takes a slot, while means skip its nulls.
    ``FormGames`` counts the played rows in the frame; it is null on a team's first row. Rows
    without a team get no form, and are no history of a team with an empty name.

    All six aggregates share one window. The order runs through ``pieces`` tasks (see
    :func:`touchline.operators.ordering.lagged`), so a team of any size is spread.
    """
    keyed = by_team(team_rows)
    order = form_order(keyed, date_col, id_col, tie_break)
    form = lagged(keyed, ["_named", "_team"], order, window_rows, lambda ordered: form_aggregates(ordered, window_rows), pieces)
    return form.drop("_named", "_team")


def by_team(team_rows: DataFrame) -> DataFrame:
    """Keys without nulls: a missing team is told from an empty name."""
    return team_rows.withColumns({"_named": F.col("Team").isNotNull(), "_team": F.coalesce("Team", F.lit(""))})


def form_order(team_rows: DataFrame, date_col: str, id_col: str, tie_break: Sequence[str]) -> list[Column]:
    """The ascending order of a team's rows; the home side comes first where a team meets itself."""
    extra = [c for c in tie_break if c in team_rows.columns]
    return [
        F.col(date_col),
        F.col(id_col),
        *[F.coalesce(F.col(c).cast("timestamp"), F.col(date_col).cast("timestamp")) for c in extra],
        *([-F.col("IsHome")] if "IsHome" in team_rows.columns else []),
    ]


def form_aggregates(ordered: WindowSpec, window_rows: int) -> dict[str, Column]:
    played = (F.col("PointsFor").isNotNull() & F.col("PointsAgainst").isNotNull()).cast("long")
    form = {name: lagged_mean(source, ordered, window_rows) for name, source in FORM_MEANS.items()}
    form["FormGames"] = lagged_sum(played, ordered, window_rows)
    has_team = F.col("Team").isNotNull()
    return {name: F.when(has_team, value) for name, value in form.items()}


def attach_form(
    matches: DataFrame,
    form_rows: DataFrame,
    id_cols: Sequence[str] = ("ID",),
) -> DataFrame:
    """Home_*, Away_* and Diff_* form columns on every match; row count is preserved.

    The two long rows of a match are folded into one row per id first, so the match table is
    shuffled once, not once per side. ``id_cols`` must identify a match; either side's name may be
    null, the other keeps its form. More form rows make more tasks, for the fold and for the join.
    """
    sides = form_rows.select(*id_cols, "IsHome", *FORM_COLUMNS)
    folded = dealt(sides, id_cols).groupBy(*id_cols).agg(*folded_form())
    # Both sides have one row per match, so neither is ever worth broadcasting.
    joined = with_differences(matches.join(folded.hint("merge"), list(id_cols), "left"))
    return joined.select(*matches.columns, *SIDE_FORM, *[f"Diff_{c}" for c in FORM_DIFFERENCES])


SIDE_FORM = tuple(f"{side}_{c}" for side in ("Home", "Away") for c in FORM_COLUMNS)


def folded_form() -> list[Column]:
    """Aggregates that turn the two long rows of a match into its Home_* and Away_* form."""
    at_home = F.col("IsHome") == 1
    return [
        F.max(F.when(side, F.col(c))).alias(f"{name}_{c}") for name, side in (("Home", at_home), ("Away", ~at_home)) for c in FORM_COLUMNS
    ]


def with_differences(df: DataFrame) -> DataFrame:
    return df.withColumns({f"Diff_{c}": F.col(f"Home_{c}") - F.col(f"Away_{c}") for c in FORM_DIFFERENCES})


def add_targets(
    df: DataFrame, home_score: str = "HomeScore", away_score: str = "AwayScore", drop_draws: bool = True
) -> DataFrame:
    """PointDiff and HomeWin; draws are removed unless asked for."""
    out = df.withColumn("PointDiff", F.col(home_score) - F.col(away_score))
    out = out.withColumn("HomeWin", F.coalesce((F.col("PointDiff") > 0).cast("int"), F.lit(0)))
    return out.where(~F.coalesce(F.col("PointDiff") == 0, F.lit(False))) if drop_draws else out


def latest_date(df: DataFrame, date_col: str) -> Column:
    """The newest date of the frame as a scalar subquery; any unparseable date raises."""
    moment = timestamp_of(df, date_col)
    bad = F.count("*") - F.count("_moment")
    checked = F.when(
        bad > 0, F.raise_error(F.concat(bad.cast("string"), F.lit(f" rows have invalid {date_col} values")))
    ).otherwise(F.max("_moment"))
    return df.select(moment.alias("_moment")).agg(checked.alias("reference")).scalar()


def add_time_decay(
    df: DataFrame,
    date_col: str = "MatchDate",
    half_life_years: float = 10.0,
    reference: Column | None = None,
    target: str = "TimeDecayWeight",
) -> DataFrame:
    """Exponential age weight. ``reference`` defaults to the frame's newest date."""
    newest = latest_date(df, date_col) if reference is None else reference
    return df.withColumn(target, decay_weight(timestamp_of(df, date_col), newest, half_life_years))


def union_fixtures(fixtures: DataFrame, results: DataFrame, source: str | None = None) -> DataFrame:
    """Fixtures followed by all results, absent columns null.

    ``source`` adds a column telling the two apart: ids are numbered per table, so a fixture
    and a result may carry the same id.
    """
    if source is not None:
        fixtures = fixtures.withColumn(source, F.lit("fixture"))
        results = results.withColumn(source, F.lit("result"))
    return fixtures.unionByName(results, allowMissingColumns=True)
