"""Ordered computation without a hot task.

A window over (group, time) puts a whole group in one task; a global rank puts everything in one.
Here the rows are range-partitioned by (group, order) instead, and written once to the shared
folder with the number of their piece. A piece is one task's share of the order: a group of any
size runs through as many pieces as it needs, whatever the types of time and tie-break are, and
however many rows share a day. What a piece needs from the ones before it is little: how many rows
there are (a count for each piece) and, for lagged frames, the last few rows of its first group.

The pieces are the buckets of a table, so a window within a piece reads them where they are: the
range partitioning is the only shuffle of the rows. The last rows that a later piece needs are
added to its bucket. There are more pieces for more rows, so what one task holds does not grow until
there are ``MOST_PIECES``; from then on it grows with the rows, by one share of so many.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from touchline.session import scratch_path

PIECE, BUCKET = "_piece", "_bucket"
# A piece is sorted by one task; beyond this many rows on average there are more pieces than shuffle partitions.
ROWS_PER_PIECE = 250_000
# A shuffle to at most this many tasks (Spark's bypassMergeThreshold) is written row by row; for one to more of them
# a task first gathers all rows it read in its memory, and how many these are is up to the caller's input.
MOST_PIECES = 200


@lru_cache(maxsize=64)
def _bucket_keys(pieces: int) -> tuple[int, ...]:
    """For every bucket a number that Spark hashes into it, so that each piece has a bucket of its own."""
    spark, found, tries = SparkSession.active(), [], 16 * pieces + 64
    while len(found) < pieces:
        numbers = spark.range(0, tries, 1, 1).select(F.col("id").cast("int").alias("key"))
        by_bucket = numbers.groupBy(F.pmod(F.hash("key"), F.lit(pieces)).alias("bucket")).agg(F.min("key").alias("key"))
        found, tries = by_bucket.orderBy("bucket").collect(), 4 * tries  # one row a piece
    return tuple(row["key"] for row in found)


def _bucket_of(piece: Column, pieces: int) -> Column:
    return F.element_at(F.lit(list(_bucket_keys(pieces))), piece + 1)


def _pieces_for(df: DataFrame) -> int:
    """As many pieces as shuffle partitions, or the multiple of them that keeps a piece at ``ROWS_PER_PIECE``.

    The multiple stays within ``MOST_PIECES``; with that many, pieces grow with the rows.
    """
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    wanted = -(-df.count() // (least * ROWS_PER_PIECE))
    return least * max(1, min(wanted, MOST_PIECES // least))


def dealt(df: DataFrame, keys: Sequence[str], like: DataFrame | None = None) -> DataFrame:
    """``df`` hash-partitioned by ``keys`` into as many tasks as it would have pieces.

    For groupings of few rows a key: the rows are counted first, so a task's share stays small for many rows.
    ``like`` is a frame of as many rows that is cheaper to count.
    """
    return df.repartition(_pieces_for(df if like is None else like), *keys)


class _Pieces:
    """A table of consecutive pieces of an order, one bucket each. Its files stay in the shared folder."""

    def __init__(self, df: DataFrame, order: Sequence[Column], pieces: int | None):
        self.spark = df.sparkSession
        self.count = pieces or _pieces_for(df)
        self.name, self.path = f"touchline_pieces_{uuid.uuid4().hex}", scratch_path(self.spark, "ordered")
        ranged = df.repartitionByRange(self.count, *_sorted(order)).withColumn(PIECE, F.spark_partition_id())
        self.add(ranged.withColumn(BUCKET, _bucket_of(F.col(PIECE), self.count)))

    def add(self, rows: DataFrame) -> None:
        writer = rows.write.mode("append").bucketBy(self.count, BUCKET).option("path", self.path)
        writer.saveAsTable(self.name)

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def let_go(self) -> None:
        """Take the name back; frames that were read keep the files."""
        self.spark.sql(f"DROP TABLE {self.name}")


def in_pieces(df: DataFrame, order: Sequence[Column], pieces: int | None = None) -> DataFrame:
    """``df`` in consecutive pieces of the ascending order (nulls last), numbered in ``_piece``.

    Written to the shared folder: every reader sees the same cuts. ``pieces`` defaults to the
    number of shuffle partitions, or a multiple of it for many rows, which are counted first. Rows that agree in the whole order lie in one piece. A window or
    grouping that has ``_bucket``, the piece's key, among its columns shuffles nothing.
    """
    table = _Pieces(df, order, pieces)
    cut = table.read()
    table.let_go()
    return cut


def _sorted(order: Sequence[Column]) -> list[Column]:
    return [c.asc_nulls_last() for c in order]


def lagged(
    df: DataFrame,
    groups: Sequence[str],
    order: Sequence[Column],
    rows_back: int,
    aggregates: Callable[[WindowSpec], dict[str, Column]],
    pieces: int | None = None,
) -> DataFrame:
    """Window aggregates over frames that reach at most ``rows_back`` rows back, for groups of any size.

    ``order`` lists ascending values, nulls last; use a negative value for a descending one.
    ``aggregates`` builds the columns for a given ordered window, e.g.
    ``lambda w: {"m": lagged_mean("x", w, 10)}``. ``groups`` must not be null.
    """
    table = _Pieces(df.withColumn("_context", F.lit(False)), [*map(F.col, groups), *order], pieces)
    cut = table.read()
    in_group = Window.partitionBy(*groups).orderBy("_piece")
    whole = Window.partitionBy(*groups)
    parts = cut.groupBy(*groups, PIECE, BUCKET).agg(F.count("*").alias("_n")).withColumn("_parts", F.count("*").over(whole))
    parts = parts.where("_parts > 1").select(
        *groups,
        "_piece",
        "_n",
        F.coalesce(F.sum("_n").over(in_group.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"),
    )
    # A later part needs a row of this one when the row is among the last before its start.
    later = F.collect_list(F.struct(F.col("_piece").alias("piece"), F.col("_start").alias("start")))
    parts = parts.withColumn("_later", later.over(in_group.rowsBetween(1, rows_back)))
    # Only the first and the last group of a piece can be cut: at most two rows a piece.
    backwards = Window.partitionBy(*groups, PIECE, BUCKET).orderBy(*[c.desc_nulls_first() for c in order])
    tails = (
        cut.join(F.broadcast(parts), [*groups, PIECE])
        .withColumn("_from_end", F.row_number().over(backwards))
        .where(F.col("_from_end") <= rows_back)
    )
    place = F.col("_start") + F.col("_n") - F.col("_from_end")
    needing = F.filter("_later", lambda part: part["start"] - place <= rows_back)
    context = tails.withColumn("_piece", F.explode(F.transform(needing, lambda part: part["piece"])))
    context = context.withColumns({BUCKET: _bucket_of(F.col(PIECE), table.count), "_context": F.lit(True)})
    # At most ``rows_back`` rows a piece. They are shuffled: fewer tasks without a shuffle would sort many pieces each.
    table.add(context.select(*cut.columns).repartition(BUCKET))
    ordered = Window.partitionBy(*groups, PIECE, BUCKET).orderBy(*_sorted(order))
    whole = table.read()
    table.let_go()
    return whole.withColumns(aggregates(ordered)).where("not _context").drop(PIECE, BUCKET, "_context")


def global_rank(df: DataFrame, order: Sequence[Column], rank: str, pieces: int | None = None) -> DataFrame:
    """Add the exact 1-based position in the ascending order (nulls last) over the whole frame."""
    cut = in_pieces(df, order, pieces)
    before, starts = 0, []
    for piece, rows in cut.groupBy(PIECE, BUCKET).count().drop(BUCKET).orderBy(PIECE).collect():  # one row a piece
        starts.append((piece, before))
        before += rows
    offsets = df.sparkSession.createDataFrame(starts, "_piece int, _before long")
    in_piece = Window.partitionBy(PIECE, BUCKET).orderBy(*_sorted(order))
    return (
        cut.join(F.broadcast(offsets), "_piece")
        .withColumn(rank, F.row_number().over(in_piece) + F.col("_before"))
        .drop(PIECE, BUCKET, "_before")
    )
