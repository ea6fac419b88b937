import hashlib
from decimal import Decimal

import pytest
from tests.helpers import rows
from pyspark.sql import functions as F

from touchline.operators import quality
from touchline.operators.quality import ColumnRule


def test_validation(spark):
    df = spark.createDataFrame([(1, "x", 0)], "a bigint, b string, flag bigint")
    rules = [ColumnRule("a", "int", True), ColumnRule("b", "date"), ColumnRule("flag", "bit"), ColumnRule("gone", "int")]
    quality.validate_target(df, rules)
    with pytest.raises(ValueError, match="Transformed data holds no rows"):
        quality.validate_target(df.where("false"), rules)
    with pytest.raises(ValueError, match="Source data lacks the required column 'gone'"):
        quality.validate_source(df, [ColumnRule("gone", "int", True)])
    with pytest.raises(ValueError, match="column 'b' is declared int but holds string"):
        quality.validate_target(df, [ColumnRule("b", "int")])
    with pytest.raises(ValueError, match="column 'flag'"):
        quality.validate_target(df.withColumn("flag", F.lit(2)), [ColumnRule("flag", "bit")])
    with pytest.raises(ValueError, match="column 'a'"):
        quality.validate_target(df, [ColumnRule("a", "mystery")])
    quality.validate_target(df.withColumn("flag", F.lit(None).cast("int")), [ColumnRule("flag", "bit")])


def test_schema_hash():
    expected = hashlib.sha256(b"a|b").hexdigest()
    assert quality.schema_hash(["b", "a"]) == quality.schema_hash(["a", "b"]) == expected
    with pytest.raises(ValueError):
        quality.schema_hash([])


def test_schema_fingerprint(spark):
    df = spark.createDataFrame([(["b", "a"],), (["c"],)], "names array<string>")
    got = [r[0] for r in df.select(quality.schema_fingerprint(F.col("names"))).collect()]
    assert got == [quality.schema_hash(["a", "b"]), quality.schema_hash(["c"])]
    with pytest.raises(Exception, match="a fingerprint needs at least one column"):
        spark.createDataFrame([([],)], "names array<string>").select(quality.schema_fingerprint(F.col("names"))).collect()


def test_require_columns(spark):
    with pytest.raises(ValueError, match="lacks feature columns"):
        quality.require_columns(spark.range(1), ["id", "x"], "feature")


def test_normalise_types(spark):
    n = 200
    made = [
        (
            Decimal("1.50"),
            " 12.5 " if i % 50 else "oops",
            f"label{i % 3}",
            f" text {i} " if i % 4 else "  ",
            "7" if i % 2 else "n/a",
            None,
        )
        for i in range(n)
    ]
    df = spark.createDataFrame(
        made, "dec decimal(10,2), mostly string, label string, words string, half string, nothing string"
    )
    assert quality.classify_text_columns(df) == {
        "mostly": "number", "label": "category", "words": "text", "half": "category", "nothing": "text",
    }
    out = quality.normalise_types(df)
    kinds = dict(out.dtypes)
    assert (kinds["dec"], kinds["mostly"], kinds["label"], kinds["words"]) == ("double", "double", "string", "string")
    assert out.where("mostly is null").count() == 4
    assert out.where("words is null").count() == 50
    assert rows(out.where("words is not null").limit(1).select(F.col("words") == F.trim("words"))) == [(True,)]


def test_numeric_text_is_strict(spark):
    df = spark.createDataFrame([("1d",), ("2f",), ("NaN",), ("1e3",), ("inf",), (" 4 ",), ("",)], "v string")
    assert [r[0] for r in df.select(quality.as_number("v")).collect()] == [None, None, None, 1000.0, float("inf"), 4.0, None]


def test_category_limits(spark):
    many = spark.createDataFrame([(f"v{i % 51}",) for i in range(500)], "v string")
    few = spark.createDataFrame([(f"v{i % 50}",) for i in range(500)], "v string")
    thin = spark.createDataFrame([(f"v{i}",) for i in range(10)], "v string")
    assert quality.classify_text_columns(many) == {"v": "text"}
    assert quality.classify_text_columns(few) == {"v": "category"}
    assert quality.classify_text_columns(thin) == {"v": "text"}
    assert quality.classify_text_columns(few.where("false")) == {"v": "text"}


def test_distinct_values_are_exact_up_to_the_limit(spark):
    """One pass counts exactly up to the limit, and beyond it never comes back under."""
    made = [("" if i % n == 0 else f"v{i % n}", n) for n in (1, 49, 50, 51, 63, 64, 65, 130, 4000) for i in range(n)]
    df = spark.createDataFrame(made * 2 + [(None, 1)], "v string, n int").repartition(7)
    got = {r["n"]: r["found"] for r in df.groupBy("n").agg(quality.distinct_up_to("v", 50).alias("found")).collect()}
    assert all(got[n] == n for n in (1, 49, 50)) and all(got[n] > 50 for n in got if n > 50)
    nothing = spark.createDataFrame([(None,)], "v string").agg(quality.distinct_up_to("v", 50))
    assert nothing.first()[0] in (0, None)


def test_profile_reads_the_frame_once(spark):
    df = spark.range(100).selectExpr("concat('v', id % 3) AS a", "cast(id AS string) AS b")
    plan = quality.profile_text_columns(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Range (") == 1 and "Expand" not in plan
