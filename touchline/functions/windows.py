"""Lagged rolling aggregates: the frame always ends on the previous row."""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F


def lagged_frame(ordered: WindowSpec, rows: int) -> WindowSpec:
    return ordered.rowsBetween(-rows, -1)


def lagged_mean(value: Column | str, ordered: WindowSpec, rows: int) -> Column:
    """Mean of the previous ``rows`` rows; nulls are skipped but still take a slot."""
    return F.avg(value).over(lagged_frame(ordered, rows))


def lagged_sum(value: Column | str, ordered: WindowSpec, rows: int) -> Column:
    return F.sum(value).over(lagged_frame(ordered, rows))
