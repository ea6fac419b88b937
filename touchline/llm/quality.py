"""Quality by co-training of two views.

One classifier sees what a text says (words, symbols, repetition), the other what its page says
about it (source, language, size, lines). In each round either view labels all unlabelled documents
that it is sure of, and the other view learns from these. At the end both views are
calibrated on labelled rows neither has seen and combined as independent evidence; every document
is scored by the whole text.

Labelled rows are a bounded sample (``max_labelled``), drawn by a hash of the id; the pool is every
document without one of these labels, its features written once.
"""

from __future__ import annotations

import math
import re
import sys
from collections import Counter
from dataclasses import dataclass
from operator import eq

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from touchline.llm.common import OWN, bytes_of, stored

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MAX_LABELLED = 20_000
ROUNDS = 3
SURE = 0.95
PSEUDO_WEIGHT = 0.5
# Categories of a page column with a weight of their own, most frequent over all rows first; beyond them values share cells.
MAX_CATEGORIES = 200
REST_CELLS = 64

_WORD = re.compile(r"[^\W\d_]+")
_UPPER = bytes(range(ord("A"), ord("Z") + 1))
_LOWER = bytes(range(ord("a"), ord("z") + 1))
_DIGITS = b"0123456789"
_SENTENCE = b".,;:?'\"()-"
_SYMBOLS = b"!#$%&*+/<=>@[\\]^_`{|}~"


def _share(text: bytes, members: bytes, size: int) -> float:
    return (len(text) - len(text.translate(None, members))) / size


def content_features(text: bytes) -> list[float]:
    size = max(1, len(text))
    words = _WORD.findall(text.decode("utf-8", "replace").lower())
    counts = Counter(words)
    total = max(1, len(words))
    after = words[1:]
    repeats = sum(map(eq, words, after)) / total
    pairs = set(zip(words, after))
    return [
        _share(text, _UPPER, size),
        _share(text, _LOWER, size),
        _share(text, _DIGITS, size),
        _share(text, _SENTENCE, size),
        _share(text, _SYMBOLS, size),
        text.count(b"!") / size,
        text.count(b"|") / size,
        text.count(b" ") / size,
        len(counts) / total,
        len(pairs) / total,
        repeats,
        max(counts.values(), default=0) / total,
        sum(map(len, words)) / total,
        math.sqrt(len(counts)) / 100,
    ]


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def _content(texts: pa.Array) -> pa.Array:
    return pa.array([content_features(text or b"") for text in bytes_of(texts)], pa.list_(pa.float64()))


@dataclass(frozen=True)
class Categories:
    """Values of a column, and whether there are more."""

    values: tuple[str, ...]
    more: bool

    def cells(self, value: Column) -> list[Column]:
        """1 in the value's own cell; if the column has more values than listed, they share hashed cells."""
        value = F.coalesce(value.cast("string"), F.lit(""))
        own = [(value == known).cast("double") for known in self.values]
        if not self.more:
            return own
        cell = F.when(~value.isin(*self.values), F.pmod(F.xxhash64(value), F.lit(REST_CELLS)))
        return own + [F.coalesce((cell == i).cast("double"), F.lit(0.0)) for i in range(REST_CELLS)]


def learn_categories(rows: DataFrame, column: str, most: int = MAX_CATEGORIES) -> Categories:
    """The ``most`` most frequent values over all rows; null counts as the empty text, ties go to the smaller value."""
    counts = rows.groupBy(F.coalesce(F.col(column).cast("string"), F.lit("")).alias("value")).count()
    found = [r["value"] for r in counts.orderBy(F.desc("count"), "value").limit(most + 1).collect()]
    return Categories(tuple(sorted(found[:most])), len(found) > most)


def _page(text: Column, source: Column, lang: Column, n_chars: Column, categories: tuple[Categories, Categories]) -> Column:
    whole = F.coalesce(text, F.lit(""))
    lines = F.length(whole) - F.length(F.replace(whole, F.lit("\n"), F.lit(""))) + 1
    size = F.coalesce(n_chars.cast("double"), F.length(whole).cast("double"))
    numbers = [F.log1p(size), F.log1p(lines), F.log1p(size / lines), F.pow(F.log1p(size), F.lit(2.0)) / 10]
    return F.array(*numbers, *categories[0].cells(source), *categories[1].cells(lang))


VIEWS = ("content", "page")


def _p(view: str) -> str:
    return f"{OWN}p_{view}"


def _with_views(docs: DataFrame, columns: tuple[str, ...], categories: tuple[Categories, Categories]) -> DataFrame:
    text_col = columns[0]
    page = _page(*map(F.col, columns), categories)
    return docs.withColumns({f"{OWN}content": array_to_vector(_content(F.col(text_col))), f"{OWN}page": array_to_vector(page)})


def _fit(view: str, rows: DataFrame) -> LogisticRegressionModel:
    fitter = LogisticRegression(
        featuresCol=f"{OWN}{view}", labelCol="label", weightCol="weight", probabilityCol=_p(view),
        rawPredictionCol=f"{OWN}raw", predictionCol=f"{OWN}class", regParam=1e-4, maxIter=40,
    )
    return fitter.fit(rows)


def _probability(view: str, model: LogisticRegressionModel, rows: DataFrame) -> DataFrame:
    scored = model.transform(rows).drop(f"{OWN}raw", f"{OWN}class")
    return scored.withColumn(_p(view), vector_to_array(_p(view))[1])


@dataclass(frozen=True)
class QualityModel:
    """``views`` is empty when the labels hold one class only: ``prior`` is the score."""

    views: dict[str, LogisticRegressionModel]
    scales: dict[str, IsotonicRegressionModel]
    prior: float
    columns: tuple[str, str, str, str]
    categories: tuple[Categories, Categories] | None = None

    def score(self, docs: DataFrame) -> DataFrame:
        """``docs`` with score (0 to 1, higher is better) and predicted (1 from 0.5 on); such columns are replaced.

        Null and empty texts are scored by the same models, whole texts however long; nulls in the page
        columns count as the empty value, values not seen in fitting have no weight. Rows that repeat an
        id are scored once each; an empty table comes back empty.
        """
        if not self.views:
            return docs.withColumn("score", F.lit(self.prior)).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
        out = _with_views(docs, self.columns, self.categories)
        odds = F.lit(-math.log(self.prior / (1 - self.prior)))
        for view in VIEWS:
            out = self.scales[view].transform(_probability(view, self.views[view], out))
            level = F.least(F.greatest(F.col(f"{OWN}level_{view}"), F.lit(1e-3)), F.lit(1 - 1e-3))
            odds = odds + F.log(level / (1 - level))
        out = out.withColumn("score", 1 / (1 + F.exp(-odds))).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
        return out.drop(*(f"{OWN}{c}" for v in VIEWS for c in (v, f"p_{v}", f"level_{v}")))


def _drawn(rows: DataFrame, id_col: str, most: int, total: int, salt: str) -> DataFrame:
    share = F.pmod(F.xxhash64(F.col(id_col), F.lit(salt)), F.lit(1_000_000)) < 1_000_000 * most // max(1, total)
    return rows.where(share) if total > most else rows


def fit_quality(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    source_col: str = "source",
    lang_col: str = "lang",
    size_col: str = "n_chars",
    rounds: int = ROUNDS,
    max_labelled: int = MAX_LABELLED,
) -> QualityModel:
    """Three quarters of the drawn labelled rows train the views, one quarter calibrates them.

    An id with several labels takes the highest; null ids and labels are left out. Documents that
    repeat an id count once each. Without labels of both classes, or without documents, the score is
    a constant. Each source and language has a weight of its own up to ``MAX_CATEGORIES`` of them.
    """
    columns = (text_col, source_col, lang_col, size_col)
    known = (
        labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
        .groupBy(F.col(id_col).alias(f"{OWN}id"))
        .agg((F.max(label_col) > 0).cast("double").alias(f"{OWN}label"))
    )
    known = F.broadcast(_drawn(known, f"{OWN}id", max_labelled, known.count(), "labelled"))  # bounded
    needed = docs.select(F.col(id_col).alias("id"), *(F.col(c).alias(f"{OWN}{i}") for i, c in enumerate(columns)))
    inner = tuple(f"{OWN}{i}" for i in range(4))
    categories = tuple(learn_categories(needed, inner[i]) for i in (1, 2))
    views = [f"{OWN}{v}" for v in VIEWS]
    drawn = needed.join(known, F.col("id") == F.col(f"{OWN}id")).withColumn("label", F.col(f"{OWN}label"))
    fold = F.pmod(F.xxhash64("id", F.lit("fold")), F.lit(4)) == 0
    rows = stored(_with_views(drawn, inner, categories).select("label", F.lit(1.0).alias("weight"), fold.alias("calibrates"), *views), "quality-rows")
    sizes = {(r["calibrates"], r["label"]): r["count"] for r in rows.groupBy("calibrates", "label").count().collect()}
    good, bad = (sum(n for (_, label), n in sizes.items() if label == wanted) for wanted in (1.0, 0.0))
    if not good or not bad:
        return QualityModel({}, {}, float(good > 0), columns, categories)

    def part(calibrates: bool) -> DataFrame:
        whole = all(sizes.get((calibrates, label)) for label in (0.0, 1.0))
        return rows.where(F.col("calibrates") == calibrates) if whole else rows

    base = part(False).select("label", "weight", *views)
    pool = needed.join(known, F.col("id") == F.col(f"{OWN}id"), "left_anti")
    pool = stored(_with_views(pool, inner, categories).select(*views), "quality-pool")
    train = {view: base for view in VIEWS}
    models = {view: _fit(view, train[view]) for view in VIEWS}
    for _ in range(rounds):
        for teacher, pupil in (VIEWS, VIEWS[::-1]):
            p = F.col(_p(teacher))
            sure = _probability(teacher, models[teacher], pool).where((p >= SURE) | (p <= 1 - SURE))
            told = sure.select((p >= 0.5).cast("double").alias("label"), F.lit(PSEUDO_WEIGHT).alias("weight"), *views)
            train[pupil] = base.unionByName(told)
        models = {view: _fit(view, train[view]) for view in VIEWS}
    scales = {
        view: IsotonicRegression(featuresCol=_p(view), labelCol="label", predictionCol=f"{OWN}level_{view}").fit(
            _probability(view, models[view], part(True))
        )
        for view in VIEWS
    }
    return QualityModel(models, scales, good / (good + bad), columns, categories)
