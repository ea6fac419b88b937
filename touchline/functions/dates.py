"""Date parsing, kick-off times, decay weights and date spines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DAYS_PER_YEAR = 365.25
SECONDS_PER_DAY = 86400


def timestamp_of(df: DataFrame, name: str) -> Column:
    """The column as a timestamp, unparseable text as null.

    Text goes through ``try_to_timestamp`` because ANSI casts raise on bad input. Columns
    that already are dates or timestamps are passed through so that filters still push down.
    """
    kind = df.schema[name].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.col(name)
    if isinstance(kind, T.DateType):
        return F.col(name).cast("timestamp")
    return F.try_to_timestamp(F.col(name).cast("string"))


def midnight(value: Column) -> Column:
    """Drop the time of day, keeping a timestamp."""
    return value.cast("date").cast("timestamp")


def kickoff_timestamp(day: Column, clock: Column | str) -> Column:
    """Match day plus a 12-hour clock text such as ``4:05AM``; null when either part is unusable."""
    clock = F.col(clock) if isinstance(clock, str) else clock
    text = F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit(" "), clock)
    return F.try_to_timestamp(text, F.lit("yyyy-MM-dd h:ma"))


def decay_weight(moment: Column, reference: Column, half_life_years: float) -> Column:
    """``0.5 ** (age / half life)`` with the age in whole days over 365.25."""
    seconds = reference.cast("timestamp").cast("double") - moment.cast("timestamp").cast("double")
    age_years = F.floor(seconds / SECONDS_PER_DAY) / F.lit(DAYS_PER_YEAR)
    return F.pow(F.lit(0.5), age_years / F.lit(float(half_life_years)))


def days_between(first: Column, last: Column) -> Column:
    """Array of every date from first to last, both included; a reversed range raises."""
    checked = F.when(
        first > last, F.raise_error(F.lit("the first day lies after the last day"))
    ).otherwise(last)
    return F.sequence(first.cast("date"), checked.cast("date"), F.expr("interval 1 day"))
