"""Text features of many values as the mean label of each value, learned without a row's own label.

A training row gets the mean over rows of its value that it may know of: those of earlier days, or, where there is
no time, those of the other folds. Later rows get the mean over all training rows. A mean is drawn towards the mean
of all labels, the more the fewer rows it has; values not seen in training get that mean. Null is a value like any
other. Rows count alike, whatever their weights.

Rows are summed by value once, map-side; that is the table of means, which is looked up and is stored beside the model.
Where time tells what a training row may know of, rows travel once to the other rows of their value and a window gives
them their mean. A value that more than ``ROWS_PER_PIECE`` rows hold is no large group: for the window its rows are
summed by (value, day) and joined, and where means are looked up, its rows stay where they are. Of all values only
those, at most one a ``ROWS_PER_PIECE`` rows, come to the driver. The rows of a lookup are not ordered when a task's
share of the means is small; they travel by the text itself, so models one after another share one shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Transformer
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from touchline.operators.ordering import ROWS_PER_PIECE
from touchline.session import scratch_path

# So many rows with the mean of all labels are added to those of a value.
STRENGTH = 10.0
FOLDS = 5
# The day of rows without a time: after all others.
NO_DAY = 2**31 - 1


def _key(column: str) -> Column:
    """Never null, and different for null and empty text."""
    return F.coalesce(F.concat(F.lit("="), F.col(f"`{column}`")), F.lit(""))


def _mean(total: Column, rows: Column, prior: float) -> Column:
    return (total + F.lit(prior * STRENGTH)) / (rows + F.lit(STRENGTH))


def _hash_join_fits(table: DataFrame) -> bool:
    """Whether ``table`` is too large to be broadcast by its statistics and a task's share of it small enough to be hashed."""
    spark = table.sparkSession
    size = int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size <= spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold():
        return False
    return table.count() <= ROWS_PER_PIECE * int(spark.conf.get("spark.sql.shuffle.partitions"))


def _looked_up(df: DataFrame, column: str, table: DataFrame, value: str, output: str, most: int = ROWS_PER_PIECE) -> DataFrame:
    """``df`` with ``output``, what ``table`` (key, n, ``value``) has for the text in ``column``, or null.

    Rows are joined by the text; those of the values of more than ``most`` training rows, which are few values, are
    not moved.
    """
    n = F.col("n") if "n" in table.columns else F.lit(0)
    known = table.where((n > most) | (F.col("key") == "")).select("key", n.alias("n"), value).collect()
    frequent = [row["key"] for row in known if row["n"] > most]
    of_null = next((row[value] for row in known if row["key"] == ""), None)

    text, key = f"{output}_text", f"{output}_key"
    rare = table.where("key <> ''").select(F.expr("substring(key, 2)").alias(text), F.col(value).alias(output))
    rare = rare.hint("shuffle_hash") if _hash_join_fits(rare) else rare
    held = _key(column).isin(frequent)
    rows = df.where(~held) if frequent else df
    found = rows.join(rare, F.col(f"`{column}`") == F.col(text), "left").drop(text)
    if of_null is not None:
        found = found.withColumn(output, F.when(F.col(f"`{column}`").isNull(), F.lit(of_null)).otherwise(F.col(output)))
    if frequent:
        few = F.broadcast(table.where(n > most).select(F.col("key").alias(key), F.col(value).alias(output)))
        found = found.unionByName(df.where(held).withColumn(key, _key(column)).join(few, key).drop(key))
    return found


class _Writer(MLWriter):
    def __init__(self, means: ValueMeans):
        super().__init__()
        self.means = means

    def saveImpl(self, path: str) -> None:
        one = self.means
        extra = {"column": one.column, "output": one.output, "prior": one.prior}
        DefaultParamsWriter.saveMetadata(one, path, self.sparkSession, extraMetadata=extra)
        one.table.write.parquet(f"{path.rstrip('/')}/means")


class _Reader(MLReader):
    def load(self, path: str) -> ValueMeans:
        known = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        table = self.sparkSession.read.parquet(f"{path.rstrip('/')}/means")
        loaded = ValueMeans(known["column"], known["output"], known["prior"], table)
        loaded._resetUid(known["uid"])
        return loaded


class ValueMeans(Transformer, MLWritable, MLReadable):
    """Adds ``output``, the mean of the value in ``column``, from ``table`` (key, n, mean); a stage of a pipeline."""

    def __init__(self, column: str, output: str, prior: float, table: DataFrame):
        super().__init__()
        self.column, self.output, self.prior, self.table = column, output, prior, table

    def _transform(self, df: DataFrame) -> DataFrame:
        found = _looked_up(df, self.column, self.table, "mean", self.output)
        return found.withColumn(self.output, F.coalesce(self.output, F.lit(self.prior)))

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader()


def output_of(position: int) -> str:
    return f"_mean_{position}"


def _stored(df: DataFrame, spark: SparkSession) -> DataFrame:
    path = scratch_path(spark, "value-means")
    df.write.parquet(path)
    return spark.read.parquet(path)


def _known_by_rows(rows: DataFrame, column: str, label: str) -> DataFrame:
    """What each row knows of earlier days, as ``_n`` rows and their ``_total``: a value's rows are ordered in one task.

    They are ordered by the hash of the value first, so its text mostly need not be compared.
    """
    of_value = Window.partitionBy("_hash", F.col(f"`{column}`")).orderBy("_period")
    earlier = of_value.rangeBetween(Window.unboundedPreceding, -1)
    n, total = F.count(label).over(earlier), F.coalesce(F.sum(label).over(earlier), F.lit(0))
    hashed = rows.withColumn("_hash", F.xxhash64(F.col(f"`{column}`")))
    return hashed.select("*", n.alias("_n"), total.alias("_total")).drop("_hash")


def _known_by_sums(rows: DataFrame, column: str, label: str) -> DataFrame:
    """What :func:`_known_by_rows` gives, from one row a value and day, joined: no task has all rows of a value."""
    keyed = rows.withColumn("_key", _key(column))
    sums = keyed.groupBy("_key", "_period").agg(F.count(label).alias("n"), F.sum(label).alias("total"))
    sums = _stored(sums, rows.sparkSession)
    earlier = Window.partitionBy("_key").orderBy("_period").rowsBetween(Window.unboundedPreceding, -1)
    n, total = (F.coalesce(F.sum(c).over(earlier), F.lit(0)) for c in ("n", "total"))
    return keyed.join(sums.select("_key", "_period", n.alias("_n"), total.alias("_total")), ["_key", "_period"]).drop("_key")


def learn_means(
    training: DataFrame, wide: Sequence[str], label: str, time: str | None, without: Sequence[str] = (), most: int = ROWS_PER_PIECE
) -> tuple[DataFrame, list[ValueMeans]]:
    """The training rows with ``output_of(i)`` for each feature of ``wide``, and the stages for all other rows.

    ``time`` is a timestamp column; rows of one day do not know of each other, and rows without a time come last.
    Without ``time``, equal rows are in one fold. Every row has a label. Columns of ``without`` are not returned, and
    values of more than ``most`` rows are not gathered in one task.
    """
    spark = training.sparkSession
    if time:
        period = F.coalesce(F.unix_date(F.to_date(time)), F.lit(NO_DAY))
    else:
        period = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in training.columns]), F.lit(FOLDS)).cast("int")
    rows = training.withColumn("_period", period)
    parts = [] if time else [F.when(F.col("_period") == i, F.col(label)) for i in range(FOLDS)]
    parts = [f(part).alias(f"{name}_{i}") for i, part in enumerate(parts) for name, f in (("n", F.count), ("total", F.sum))]
    whole = [
        _stored(rows.groupBy(_key(c).alias("key")).agg(F.count("*").alias("n"), F.sum(label).alias("total"), *parts), spark)
        for c in wide
    ]
    prior = whole[0].agg(F.sum("total") / F.sum("n")).first()[0]
    stages = []
    for i, (column, sums) in enumerate(zip(wide, whole)):
        output, n, total = output_of(i), F.col("n"), F.col("total")
        if time:
            frequent = [row["key"] for row in sums.where(n > most).select("key").collect()]
            held = _key(column).isin(frequent)
            known = _known_by_rows(rows.where(~held) if frequent else rows, column, label)
            if frequent:
                known = known.unionByName(_known_by_sums(rows.where(held), column, label))
            rows = known.withColumn(output, _mean(F.col("_total"), F.col("_n"), prior)).drop("_total", "_n")
        else:
            others = [_mean(total - F.coalesce(f"total_{j}", F.lit(0)), n - F.col(f"n_{j}"), prior) for j in range(FOLDS)]
            known = _looked_up(rows, column, sums.withColumn("means", F.array(*others)), "means", output, most)
            rows = known.withColumn(output, F.get(output, "_period"))
        stages.append(ValueMeans(column, output, prior, sums.select("key", "n", _mean(total, n, prior).alias("mean"))))
    return _stored(rows.drop("_period", *without), spark), stages
