"""Weighted model metrics as aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.operators.ordering import BUCKET, PIECE, in_pieces

THRESHOLD = 0.5
# Fixed value: probabilities are clipped by the double epsilon before the logarithm.
EPSILON = 2.220446049250313e-16


def _weight(weight: str | None) -> Column:
    return F.lit(1.0) if weight is None else F.col(weight).cast("double")


def binary_metrics(
    df: DataFrame, label: str, probability: str, weight: str | None = None, groups: Sequence[str] = ()
) -> DataFrame:
    """accuracy, f1 (positive class) and logloss in one pass; rows without a label are ignored.

    f1 is 0 when nothing is positive; logloss is null when only one class is present. One row for
    each of ``groups`` with a label, or a single row without them.
    """
    p = F.col(probability).cast("double")
    y = F.col(label).cast("int")
    w = _weight(weight)
    predicted = (p >= THRESHOLD).cast("int")
    clipped = F.greatest(F.lit(EPSILON), F.least(F.lit(1 - EPSILON), p))
    loss = -F.when(y == 1, F.log(clipped)).otherwise(F.log(1 - clipped))
    sums = df.where(F.col(label).isNotNull()).groupBy(*groups).agg(
        F.sum(w).alias("w"),
        F.sum(F.when(predicted == y, w).otherwise(0.0)).alias("hit"),
        F.sum(F.when((predicted == 1) & (y == 1), w).otherwise(0.0)).alias("tp"),
        F.sum(F.when((predicted == 1) & (y == 0), w).otherwise(0.0)).alias("fp"),
        F.sum(F.when((predicted == 0) & (y == 1), w).otherwise(0.0)).alias("fn"),
        F.sum(w * loss).alias("loss"),
        F.countDistinct(y).alias("classes"),
    )
    denominator = 2 * F.col("tp") + F.col("fp") + F.col("fn")
    return sums.select(
        *groups,
        F.try_divide("hit", "w").alias("accuracy"),
        F.when(F.col("w").isNotNull(), F.coalesce(F.try_divide(2 * F.col("tp"), denominator), F.lit(0.0))).alias("f1"),
        F.when(F.col("classes") == 2, F.try_divide("loss", "w")).alias("logloss"),
    )


def area_under_roc(df: DataFrame, label: str, probability: str, weight: str | None = None) -> float | None:
    """Exact weighted ROC area (ties count half); None unless both classes are present.

    MLlib combines equal scores map-side, range-sorts the distinct scores and accumulates per
    partition, so no task sees the whole ordering. ``numBins=0`` switches its down-sampling off.
    """
    scored = df.where(F.col(label).isNotNull()).select(
        F.col(label).cast("double").alias("label"),
        (F.col(probability).cast("double") + 0.0).alias("score"),  # one zero: MLlib tells -0.0 from 0.0
        _weight(weight).alias("weight"),
    )
    if scored.agg(F.countDistinct("label").alias("classes")).first()["classes"] != 2:
        return None
    evaluator = BinaryClassificationEvaluator(
        rawPredictionCol="score", labelCol="label", weightCol="weight", metricName="areaUnderROC", numBins=0
    )
    return float(evaluator.evaluate(scored))


def grouped_area_under_roc(
    df: DataFrame, groups: Sequence[str], label: str, probability: str, weight: str | None = None, pieces: int | None = None
) -> DataFrame:
    """Exact weighted ROC area (ties count half) of every group in one go; null unless both classes are present.

    The area is the weight of pairs in which a positive outscores a negative. Equal scores are combined
    map-side, the distinct ones ordered in pieces by (group, score); the negative weight below a score is
    that of the pieces before plus a running sum, so a group of any size is spread. Groups must not be
    null; rows without a label or a score are ignored, and a group without any is absent.
    """
    positive = F.col(label).cast("int") == 1
    known = df.where(F.col(label).isNotNull() & F.col(probability).isNotNull())
    score = (F.col(probability).cast("double") + 0.0).alias("_score")
    combined = known.withColumn("_w", _weight(weight)).groupBy(*groups, score).agg(
        F.sum(F.when(positive, F.col("_w")).otherwise(0.0)).alias("_for"),
        F.sum(F.when(positive, 0.0).otherwise(F.col("_w"))).alias("_against"),
        F.bool_or(positive).alias("_has_for"),
        F.bool_or(~positive).alias("_has_against"),
    )
    cut = in_pieces(combined, [*map(F.col, groups), F.col("_score")], pieces)
    in_piece = Window.partitionBy(*groups, PIECE, BUCKET).orderBy("_score").rowsBetween(Window.unboundedPreceding, -1)
    running = cut.withColumn("_below", F.coalesce(F.sum("_against").over(in_piece), F.lit(0.0)))
    by_piece = running.groupBy(*groups, PIECE, BUCKET).agg(
        F.sum(F.col("_for") * (F.col("_below") + F.col("_against") / 2)).alias("_won"),
        *[F.sum(c).alias(c) for c in ("_for", "_against")],
        *[F.bool_or(c).alias(c) for c in ("_has_for", "_has_against")],
    )
    before = Window.partitionBy(*groups).orderBy(PIECE).rowsBetween(Window.unboundedPreceding, -1)  # one row a piece
    met = F.col("_won") + F.col("_for") * F.coalesce(F.sum("_against").over(before), F.lit(0.0))
    totals = by_piece.withColumn("_won", met).groupBy(*groups).agg(
        *[F.sum(c).alias(c) for c in ("_won", "_for", "_against")],
        (F.bool_or("_has_for") & F.bool_or("_has_against")).alias("_both"),
    )
    area = F.try_divide("_won", F.col("_for") * F.col("_against"))
    return totals.select(*groups, F.when(F.col("_both"), area).alias("auc"))


def grouped_binary_metrics(
    df: DataFrame, groups: Sequence[str], label: str, probability: str, weight: str | None = None, pieces: int | None = None
) -> DataFrame:
    """accuracy, f1, logloss and auc, one row a group."""
    # One row a group on both sides.
    areas = grouped_area_under_roc(df, groups, label, probability, weight, pieces)
    return binary_metrics(df, label, probability, weight, groups).join(areas, list(groups), "left")


def regression_metrics(
    df: DataFrame, label: str, prediction: str, weight: str | None = None, groups: Sequence[str] = ()
) -> DataFrame:
    """rmse, mae and r2; rows without a label are ignored.

    r2 of a constant label is 1 for a perfect prediction and 0 otherwise. One row for each of
    ``groups`` with a label, or a single row without them.
    """
    y = F.col(label).cast("double")
    w = _weight(weight)
    error = y - F.col(prediction).cast("double")
    known = df.where(F.col(label).isNotNull())
    # Centred on the mean: sum(y^2) - n*mean^2 cancels badly for labels far from zero.
    mean = F.try_divide(F.sum(w * y), F.sum(w)).alias("_mean")
    if groups:
        known = known.join(known.groupBy(*groups).agg(mean), list(groups))
        centred = known.withColumn("_from_mean", y - F.col("_mean"))
    else:
        centred = known.withColumn("_from_mean", y - known.agg(mean).scalar())
    sums = centred.groupBy(*groups).agg(
        F.sum(w).alias("w"),
        F.sum(w * error * error).alias("squares"),
        F.sum(w * F.abs(error)).alias("absolute"),
        F.sum(w * F.col("_from_mean") * F.col("_from_mean")).alias("spread"),
        (F.min(y) == F.max(y)).alias("constant"),
    )
    return sums.select(
        *groups,
        F.sqrt(F.try_divide("squares", "w")).alias("rmse"),
        F.try_divide("absolute", "w").alias("mae"),
        F.when(F.col("constant"), F.when(F.col("squares") == 0, 1.0).otherwise(0.0))
        .otherwise(1 - F.try_divide("squares", "spread"))
        .alias("r2"),
    )


def grouped_regression_metrics(
    df: DataFrame, groups: Sequence[str], label: str, prediction: str, weight: str | None = None
) -> DataFrame:
    """rmse, mae and r2, one row a group."""
    return regression_metrics(df, label, prediction, weight, groups)
