import math
import random

import pytest
from pyspark.sql import functions as F

from touchline.operators import metrics


def test_binary(spark):
    made = [(1, 0.9, 1.0), (0, 0.5, 2.0), (1, 0.2, 1.0), (0, 0.1, 3.0), (None, 0.9, 5.0)]
    df = spark.createDataFrame(made, "y int, p double, w double")
    got = metrics.binary_metrics(df, "y", "p", "w").first()
    assert got["accuracy"] == pytest.approx(4 / 7)
    assert got["f1"] == pytest.approx(2 * 1 / (2 * 1 + 2 + 1))
    loss = -(math.log(0.9) + 2 * math.log(0.5) + math.log(0.2) + 3 * math.log(0.9)) / 7
    assert got["logloss"] == pytest.approx(loss)
    unweighted = metrics.binary_metrics(df, "y", "p").first()
    assert unweighted["accuracy"] == pytest.approx(0.5)


def test_binary_corner_cases(spark):
    schema = "y int, p double"
    ones = spark.createDataFrame([(1, 0.9), (1, 1.0)], schema)
    got = metrics.binary_metrics(ones, "y", "p").first()
    assert (got["accuracy"], got["f1"], got["logloss"]) == (1.0, 1.0, None)
    assert metrics.area_under_roc(ones, "y", "p") is None
    none_positive = spark.createDataFrame([(0, 0.1), (0, 0.2)], schema)
    assert metrics.binary_metrics(none_positive, "y", "p").first()["f1"] == 0.0
    certain = spark.createDataFrame([(1, 0.0), (0, 1.0)], schema)
    assert math.isfinite(metrics.binary_metrics(certain, "y", "p").first()["logloss"])
    empty = metrics.binary_metrics(ones.where("false"), "y", "p").first()
    assert tuple(empty) == (None, None, None)


def test_area_under_roc_with_ties_and_weights(spark):
    made = [(1, 0.8, 2.0), (0, 0.8, 1.0), (1, 0.3, 1.0), (0, 0.3, 3.0), (0, 0.1, 2.0), (1, 0.9, 1.0)]
    df = spark.createDataFrame(made, "y int, p double, w double")
    pairs = total = 0.0
    for y1, p1, w1 in made:
        for y0, p0, w0 in made:
            if y1 == 1 and y0 == 0:
                total += w1 * w0
                pairs += w1 * w0 * (1.0 if p1 > p0 else 0.5 if p1 == p0 else 0.0)
    assert metrics.area_under_roc(df, "y", "p", "w") == pytest.approx(pairs / total)


def test_area_under_roc_is_not_binned(spark):
    made = [((i * 7919) % 2, i / 5000) for i in range(5000)]
    df = spark.createDataFrame(made, "y int, p double")
    below, area = 0, 0
    for y, _ in made:
        if y == 1:
            area += below
        else:
            below += 1
    assert metrics.area_under_roc(df, "y", "p") == pytest.approx(area / (below * (5000 - below)), abs=1e-12)


def test_regression(spark):
    df = spark.createDataFrame([(3.0, 2.0, 1.0), (-1.0, 0.0, 2.0), (2.0, 2.0, 1.0), (None, 9.0, 9.0)], "y double, f double, w double")
    got = metrics.regression_metrics(df, "y", "f", "w").first()
    mean = (3 - 2 + 2) / 4
    spread = (3 - mean) ** 2 + 2 * (-1 - mean) ** 2 + (2 - mean) ** 2
    assert got["rmse"] == pytest.approx(math.sqrt(3 / 4))
    assert got["mae"] == pytest.approx(3 / 4)
    assert got["r2"] == pytest.approx(1 - 3 / spread)


def test_regression_far_from_zero_and_constant(spark):
    schema = "y double, f double"
    far = spark.createDataFrame([(1e9 + 1, 1e9 + 1), (1e9 + 2, 1e9 + 2.5), (1e9 + 3, 1e9 + 3)], schema)
    assert metrics.regression_metrics(far, "y", "f").first()["r2"] == pytest.approx(1 - 0.25 / 2)
    constant = spark.createDataFrame([(1.0, 1.0), (1.0, 1.0)], schema)
    assert metrics.regression_metrics(constant, "y", "f").first()["r2"] == 1.0
    missed = spark.createDataFrame([(1.0, 2.0), (1.0, 1.0)], schema)
    assert metrics.regression_metrics(missed, "y", "f").first()["r2"] == 0.0


def grouped_rows(spark, n=600, seed=3):
    rng = random.Random(seed)
    made = []
    for i in range(n):
        group = "hot" if rng.random() < 0.8 else rng.choice(["few", "one class", "no label"])
        label = None if group == "no label" or rng.random() < 0.1 else 1 if group == "one class" else rng.randrange(2)
        made.append((group, label, rng.choice([rng.random(), round(rng.random(), 1), -0.0, 0.0]), 0.5 + rng.random(), rng.gauss(0, 1)))
    return spark.createDataFrame(made, "g string, y int, p double, w double, v double")


@pytest.mark.parametrize("pieces", [1, 9])
def test_grouped_metrics_are_those_of_each_group(spark, pieces):
    df = grouped_rows(spark)
    got = {r["g"]: r for r in metrics.grouped_binary_metrics(df, ["g"], "y", "p", "w", pieces).collect()}
    assert set(got) == {"hot", "few", "one class"}
    for group, row in got.items():
        own = df.where(F.col("g") == group)
        alone = metrics.binary_metrics(own, "y", "p", "w").first()
        for name in ("accuracy", "f1", "logloss"):
            assert row[name] == (None if alone[name] is None else pytest.approx(alone[name]))
        area = metrics.area_under_roc(own, "y", "p", "w")
        assert row["auc"] == (None if area is None else pytest.approx(area))


def test_grouped_area_is_the_share_of_won_pairs(spark):
    df = grouped_rows(spark, 150, 8)
    got = {r["g"]: r["auc"] for r in metrics.grouped_area_under_roc(df, ["g"], "y", "p", "w", 5).collect()}
    made = [r for r in df.collect() if r["y"] is not None]
    for group in ("hot", "few"):
        for_, against = ([r for r in made if r["g"] == group and r["y"] == y] for y in (1, 0))
        won = sum(a["w"] * b["w"] * ((a["p"] > b["p"]) + (a["p"] == b["p"]) / 2) for a in for_ for b in against)
        assert got[group] == pytest.approx(won / sum(a["w"] * b["w"] for a in for_ for b in against))
    assert metrics.grouped_area_under_roc(df.where("false"), ["g"], "y", "p").isEmpty()


def test_grouped_regression_metrics(spark):
    df = grouped_rows(spark).withColumn("y", F.when(F.col("g") == "few", 2.0).otherwise(F.col("y") + F.col("v")))
    got = {r["g"]: r for r in metrics.grouped_regression_metrics(df, ["g"], "y", "p", "w").collect()}
    for group, row in got.items():
        alone = metrics.regression_metrics(df.where(F.col("g") == group), "y", "p", "w").first()
        assert all(row[c] == pytest.approx(alone[c]) for c in ("rmse", "mae", "r2"))
    assert got["few"]["r2"] == 0.0
