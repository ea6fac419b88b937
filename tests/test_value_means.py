import datetime as dt
import random

import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from touchline.plans import modelling, value_means
from touchline.plans.value_means import STRENGTH, learn_means, output_of

DAY = dt.datetime(2024, 1, 1)
SCHEMA = "id bigint, a string, b string, y double, t timestamp"


def made(spark, n=200, seed=3):
    rng = random.Random(seed)
    texts = [None, "", "x", "x", "x", "y"]
    rows = []
    for i in range(n):
        time = None if i % 17 == 0 else DAY + dt.timedelta(hours=rng.randrange(24 * 9))
        rows.append((i, rng.choice(texts), f"v{rng.randrange(60)}", float(rng.randrange(2)), time))
    return rows, spark.createDataFrame(rows, SCHEMA)


def drawn(labels, prior):
    return (sum(labels) + prior * STRENGTH) / (len(labels) + STRENGTH)


@pytest.mark.parametrize("column,position", [(1, 0), (2, 1)])
def test_rows_know_of_earlier_days_only(spark, column, position):
    rows, df = made(spark)
    encoded, stages = learn_means(df, ["a", "b"], "y", "t")
    prior = sum(r[3] for r in rows) / len(rows)
    got = {r["id"]: r[output_of(position)] for r in encoded.collect()}

    def day(r):
        return r[4].date() if r[4] else dt.date.max

    assert len(got) == len(rows)
    for r in rows:
        earlier = [o[3] for o in rows if o[column] == r[column] and day(o) < day(r)]
        assert got[r[0]] == pytest.approx(drawn(earlier, prior))
    later = {r["id"]: r[output_of(position)] for r in stages[position].transform(df).collect()}
    for r in rows:
        assert later[r[0]] == pytest.approx(drawn([o[3] for o in rows if o[column] == r[column]], prior))
    unseen = spark.createDataFrame([(1, "new", "new", 0.0, DAY)], SCHEMA)
    assert stages[position].transform(unseen).first()[output_of(position)] == pytest.approx(prior)


def test_rows_without_time_know_of_other_folds(spark):
    rows, df = made(spark)
    encoded, _ = learn_means(df, ["b"], "y", None)
    fold = F.pmod(F.xxhash64(*df.columns), F.lit(5))
    folds = {r["id"]: r["fold"] for r in df.select("id", fold.alias("fold")).collect()}
    prior = sum(r[3] for r in rows) / len(rows)
    for r in encoded.collect():
        others = [o[3] for o in rows if o[2] == r["b"] and folds[o[0]] != folds[r["id"]]]
        assert r[output_of(0)] == pytest.approx(drawn(others, prior))


def test_one_value_that_says_nothing(spark):
    """A value of one row must not tell the row its own label."""
    df = spark.createDataFrame([(i, f"only{i}", "b", float(i % 2), DAY + dt.timedelta(days=i)) for i in range(30)], SCHEMA)
    for time in ("t", None):
        encoded, _ = learn_means(df, ["a"], "y", time)
        assert encoded.where(F.abs(F.col(output_of(0)) - 0.5) > 1e-12).isEmpty()


@pytest.mark.parametrize("time", ["t", None])
def test_frequent_values_are_not_gathered(spark, time):
    """Means are the same whether a value's rows meet in one task or, being more than ``most``, do not; null is frequent too."""
    rows, df = made(spark, 400)
    by_rows, stages = learn_means(df, ["a", "b"], "y", time)
    got = {r["id"]: (r[output_of(0)], r[output_of(1)]) for r in by_rows.collect()}
    by_sums, _ = learn_means(df, ["a", "b"], "y", time, without=("a", "b"), most=20)
    assert not {"a", "b", "_period"} & set(by_sums.columns) and by_sums.count() == len(rows) == len(got)
    for r in by_sums.collect():
        assert (r[output_of(0)], r[output_of(1)]) == pytest.approx(got[r["id"]])
    means = {r["key"]: r["mean"] for r in stages[0].table.collect()}
    for most in (0, 70, 1_000):
        found = value_means._looked_up(df, "a", stages[0].table, "mean", "m", most).collect()
        assert len(found) == len(rows)
        assert all(r["m"] == means["" if r["a"] is None else f"={r['a']}"] for r in found)


def test_models_one_after_another_move_rows_once(spark, monkeypatch):
    """Two lookups of one text share a shuffle of the rows and order none of them; a large table is still ordered."""
    _, df = made(spark)
    _, stages = learn_means(df, ["b"], "y", None)
    monkeypatch.setattr(value_means, "ROWS_PER_PIECE", 1_000)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        twice = stages[0].transform(stages[0].transform(df).withColumnRenamed(output_of(0), "first"))
        assert twice.where(F.abs(F.col("first") - F.col(output_of(0))) > 0).isEmpty() and twice.count() == df.count()
        plan = twice._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning(b#") == 1 and plan.count("ShuffledHashJoin") == 2 and "Sort " not in plan
        monkeypatch.setattr(value_means, "ROWS_PER_PIECE", 1)
        assert "SortMergeJoin" in stages[0].transform(df)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("time", ["t", None])
def test_wide_feature_trains_and_is_stored(spark, time, tmp_path):
    """15,000 values of four rows each: far above the limit, learned, stored, loaded and scored alike."""
    value = F.concat(F.lit("v"), F.pmod(F.xxhash64("id"), F.lit(15_000)))
    df = spark.range(60_000).select(
        "id", value.alias("wide"), F.lit("k").alias("few"), F.timestamp_seconds(F.col("id") * 3600).alias("t")
    )
    df = df.withColumn("y", F.pmod(F.crc32("wide"), F.lit(100)) + F.pmod(F.xxhash64("id", "t"), F.lit(10)).cast("double"))
    one = modelling.ModelSpec("m", "trainer", "y", "regression", None, time, {"n_estimators": 6, "random_state": 1})
    group = modelling.GroupSpec("g", "", "", None, (one,), ("id",), ("wide", "few"), ("y",), None)
    trained = modelling.train(df, one, group)
    assert trained.train_rows == 60_000
    scored = modelling.add_score(df, trained.pipeline, "regression", "score")
    mean = df.agg(F.avg("y")).first()[0]
    errors = scored.agg(F.count("*"), F.avg((F.col("score") - F.col("y")) ** 2), F.avg((F.lit(mean) - F.col("y")) ** 2)).first()
    assert errors[0] == 60_000 and errors[1] < 0.5 * errors[2]
    trained.pipeline.write().overwrite().save(str(tmp_path / "model"))
    loaded = PipelineModel.load(str(tmp_path / "model"))
    again = modelling.add_score(df, loaded, "regression", "again")
    both = scored.join(again.select("id", "again"), "id")
    assert both.where("abs(score - again) > 1e-9 or score is null").isEmpty() and both.count() == 60_000
