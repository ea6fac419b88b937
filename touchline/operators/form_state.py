"""Rolling form kept up by increments: the last rows of every team stand in for its history.

A tail holds the last ``keep`` rows of each team, with how many rows the team has had (``Seen``) and
its newest date (``Newest``). The form of new rows needs nothing else, and the tail after a batch is
the tail before it merged with the batch, so the work of a run grows with its batch and the number of
teams, not with the history.

Rows may come late. A row that sorts among the stored ones gets its place there, and the stored rows
whose frames reach back to it are returned once more. What ``keep`` leaves beyond the frame bounds how
late: a row whose frame would leave the tail of a longer history is an error, never a wrong value.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from touchline.operators.form import FORM_COLUMNS, FORM_MEANS, by_team, form_aggregates, form_order
from touchline.operators.ordering import dealt, lagged
from touchline.sources.publish import PublishedTable

KEEP = 40
# What form is computed from, scores first.
_SOURCES = tuple(dict.fromkeys(["PointsFor", "PointsAgainst", *FORM_MEANS.values()]))
_NEW, _CUT, _BEFORE, _REACHED = "_new", "_cut", "_before", "_reached"


def _tail_columns(rows: DataFrame, date_col: str, id_col: str, tie_break: Sequence[str]) -> list[str]:
    optional = [c for c in (*tie_break, "IsHome") if c in rows.columns]
    return ["Team", date_col, id_col, *optional, *_SOURCES]


def form_tail(
    team_rows: DataFrame,
    tail: DataFrame | None = None,
    keep: int = KEEP,
    date_col: str = "MatchDate",
    id_col: str = "ID",
    tie_break: Sequence[str] = ("KickoffTimeLocal",),
) -> DataFrame:
    """The last ``keep`` rows of every team in ``team_rows`` and, when given, in the ``tail`` before them.

    Rows without a team are no history and leave. The rows are dealt out to more tasks when there are more
    of them, and each task hands on at most ``keep`` rows a team, so no team is a hot key. A team without new rows keeps its tail. ``keep`` must not shrink below the frame of
    the form it is to serve; rows that agree in the whole order are taken in any order.
    """
    named = team_rows.where(F.col("Team").isNotNull())
    fresh = named.select(*_tail_columns(team_rows, date_col, id_col, tie_break))
    fresh = dealt(fresh, fresh.columns)
    counted = named.groupBy("Team").agg(F.count(F.lit(1)).alias("Seen"), F.max(date_col).alias("Newest"))
    if tail is not None:
        before = tail.groupBy("Team").agg(F.max("Seen").alias("Seen"), F.max("Newest").alias("Newest"))
        counted = counted.unionByName(before).groupBy("Team").agg(F.sum("Seen").alias("Seen"), F.max("Newest").alias("Newest"))
        fresh = fresh.unionByName(tail.drop("Seen", "Newest"), allowMissingColumns=True)
    backwards = [c.desc_nulls_first() for c in form_order(fresh, date_col, id_col, tie_break)]
    place = F.row_number().over(Window.partitionBy("Team").orderBy(*backwards))
    last = fresh.withColumn("_place", place).where(F.col("_place") <= keep).drop("_place")
    return last.join(counted, "Team")


def form_increment(
    tail: DataFrame,
    new_rows: DataFrame,
    window_rows: int = 10,
    date_col: str = "MatchDate",
    id_col: str = "ID",
    tie_break: Sequence[str] = ("KickoffTimeLocal",),
    pieces: int | None = None,
) -> DataFrame:
    """Form of the new team rows, and of the stored ones that they change, as a build of everything gives it.

    ``Restated`` tells a stored row; columns that the tail does not hold are null there. The new rows go
    through the same pieces as in :func:`touchline.operators.form.rolling_form`, so a team that holds most
    of a batch is spread. Fails when a frame reaches beyond the tail of a team with a longer history.
    """
    held = tail.groupBy("Team").agg((F.max("Seen") > F.count(F.lit(1))).alias(_CUT))  # one row a team
    both = new_rows.withColumn(_NEW, F.lit(True)).unionByName(
        tail.drop("Seen", "Newest").withColumn(_NEW, F.lit(False)), allowMissingColumns=True
    )
    keyed = by_team(both.join(held, "Team", "left"))

    def aggregates(ordered):
        frame = ordered.rowsBetween(-window_rows, -1)
        return {
            **form_aggregates(ordered, window_rows),
            _BEFORE: F.count(F.lit(1)).over(frame),
            _REACHED: F.coalesce(F.max(_NEW).over(frame), F.lit(False)),
        }

    order = form_order(keyed, date_col, id_col, tie_break)
    form = lagged(keyed, ["_named", "_team"], order, window_rows, aggregates, pieces)
    wanted = F.col(_NEW) | (F.col(_REACHED) & F.col("Team").isNotNull())
    beyond = wanted & F.coalesce(F.col(_CUT), F.lit(False)) & (F.col(_BEFORE) < window_rows)
    message = F.concat(F.lit("a row of team "), F.col("Team"), F.lit(" is later than its tail can tell: build from history"))
    return form.where(F.when(beyond, F.raise_error(message).cast("boolean")).otherwise(wanted)).select(
        *new_rows.columns, *FORM_COLUMNS, (~F.col(_NEW)).alias("Restated")
    )


class FormState:
    """Tails in a published table, one a batch, so that a batch can run again.

    A batch starts from the tail its predecessor left. Running the newest batch again replaces its tail; an
    older one is refused, since the tails after it rest on it. Only one tail is read a run.
    """

    def __init__(self, spark: SparkSession, folder: str, keep: int = KEEP, **columns):
        self.spark, self.keep, self.columns = spark, keep, columns
        self.table = PublishedTable(spark, folder, id_col="_row", stamp_col="")

    def before(self, batch: str) -> DataFrame | None:
        """The tail that ``batch`` starts from; None when it is the first."""
        done = list(self.table.state().batches)
        if batch in done[:-1]:
            raise ValueError(f"batch {batch!r} is followed by others and cannot run again")
        earlier = [b for b in done if b != batch]
        return self.table.read(earlier[-1:]).drop("_row") if earlier else None

    def absorb(self, team_rows: DataFrame, batch: str) -> None:
        """Make the tail after ``batch`` the newest."""
        self.table.publish(form_tail(team_rows, self.before(batch), self.keep, **self.columns), batch)

    def form(self, team_rows: DataFrame, batch: str, window_rows: int = 10, pieces: int | None = None) -> DataFrame:
        """Form of the batch's rows (see :func:`form_increment`), the same before and after it is absorbed."""
        tail = self.before(batch)
        if tail is None:
            tail = self.spark.createDataFrame([], form_tail(team_rows, keep=self.keep, **self.columns).schema)
        return form_increment(tail, team_rows, window_rows, pieces=pieces, **self.columns)
