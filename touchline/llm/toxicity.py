"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

A lexicon is learned from labelled rows by the log-odds of words and word beginnings. Every text
becomes a short dense vector: densities of strong and weak lexicon words, their nearness to
second-person words, capitals, punctuation, disguised words. Trees are fitted on labelled rows
the lexicon has not seen, and calibrated on rows the trees have not seen.

Only labelled rows are sampled (``max_labelled``, a bound of the fit); every text is scored whole.
"""

from __future__ import annotations

import math
import re
import sys
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from touchline.llm.common import OWN, bytes_of, stored, value_slices

cloudpickle.register_pickle_by_value(sys.modules[__name__])

THRESHOLD = 0.7
MAX_LABELLED = 40_000
MAX_TERMS = 4_000
PREFIXES = (4, 5)
LEAST_TOXIC_TEXTS = 3
WEAK, STRONG = 2.0, 4.0
NEAR_WORDS = 6

_WORD = re.compile(r"[^\W\d_]+")
# Starts only where a run of letters does and never gives letters back: linear in texts without breaks.
_DISGUISED = re.compile(r"(?<![^\W\d_])[^\W\d_]++(?:[@$!*|.\-_0134578]++[^\W\d_]++)+")
_PLAIN = str.maketrans({"@": "a", "4": "a", "3": "e", "1": "i", "!": "i", "|": "l", "0": "o", "5": "s", "$": "s", "7": "t", "8": "b"})
_FILLERS = re.compile(r"[*.\-_]+")
# Second-person words of the languages at hand (fixed values).
_YOU = frozenset(
    "you your yours yourself u ur du dich dir dein deine euch ihr sie tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros".split()
)
_UPPER = bytes(range(ord("A"), ord("Z") + 1))
_PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

FEATURES = (
    "strong_density", "strong_count", "weak_density", "weak_count", "highest", "near_second_person",
    "capitals", "capital_words", "exclamations", "punctuation", "disguised", "disguised_hits", "length",
)


def _terms(word: str) -> list[str]:
    return [word, *(word[:n] + "*" for n in PREFIXES if len(word) > n)]


class Weights(dict):
    """Weight of a word: the highest of its own log-odds and those of its beginnings."""

    LIMIT = 300_000

    def __init__(self, lexicon: dict[str, float]):
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, word: str) -> float:
        if len(self) >= self.LIMIT:
            self.clear()
        weight = self[word] = max((self.lexicon.get(term, 0.0) for term in _terms(word)), default=0.0)
        return weight


def features_of(text: bytes, weights: Weights) -> list[float]:
    plain = text.decode("utf-8", "replace")
    found = _WORD.findall(plain)
    strong: list[int] = []
    weak = 0
    highest = 0.0
    shouted = 0
    second_person: list[int] = []
    for at, word in enumerate(found):
        low = word.lower()
        weight = weights[low]
        if weight >= WEAK:
            highest = max(highest, weight)
            if weight >= STRONG:
                strong.append(at)
            else:
                weak += 1
        if low in _YOU:
            second_person.append(at)
        if word is not low and len(word) > 1 and word.isupper():
            shouted += 1
    near = next_you = 0
    for at in strong:
        while next_you < len(second_person) and second_person[next_you] < at - NEAR_WORDS:
            next_you += 1
        near += next_you < len(second_person) and second_person[next_you] <= at + NEAR_WORDS
    disguised = hits = 0
    for match in _DISGUISED.finditer(plain):
        disguised += 1
        hits += weights[_FILLERS.sub("", match.group().lower().translate(_PLAIN))] >= STRONG
    words, size = max(1, len(found)), max(1, len(text))
    return [
        len(strong) / words,
        math.log1p(len(strong)),
        weak / words,
        math.log1p(weak),
        highest,
        near / max(1, len(strong)),
        (len(text) - len(text.translate(None, _UPPER))) / size,
        shouted / words,
        text.count(b"!") / size,
        (len(text) - len(text.translate(None, _PUNCTUATION))) / size,
        disguised / words,
        math.log1p(hits),
        math.log1p(len(found)),
    ]


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, label) → texts of either label that hold each word or beginning, summed per batch."""
    for batch in batches:
        seen: tuple[Counter, Counter] = Counter(), Counter()
        for piece in value_slices(batch):
            for text, label in zip(bytes_of(piece.column(0)), piece.column(1).to_pylist()):
                words = set(_WORD.findall((text or b"").decode("utf-8", "replace").lower()))
                seen[label].update({term for word in words for term in _terms(word)})
        terms = list(seen[0].keys() | seen[1].keys())
        yield pa.RecordBatch.from_arrays(
            [pa.array(terms, pa.string()), *(pa.array([seen[label][t] for t in terms], pa.int64()) for label in (1, 0))],
            names=["term", "toxic", "clean"],
        )


def _features(lexicon: dict[str, float]):
    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def vector(texts: pa.Array) -> pa.Array:
        weights = Weights(lexicon)
        out = [features_of(text or b"", weights) for text in bytes_of(texts)]
        return pa.array(out, pa.list_(pa.float64()))

    return vector


@dataclass(frozen=True)
class ToxicityModel:
    """``trees`` and ``scale`` are None when the labels hold one class only: ``constant`` is the score."""

    lexicon: dict[str, float]
    trees: GBTClassificationModel | None
    scale: IsotonicRegressionModel | None
    constant: float = 0.0
    threshold: float = THRESHOLD

    def score(self, docs: DataFrame, text_col: str = "text") -> DataFrame:
        """``docs`` with score (0 to 1) and predicted (1 from the threshold on); columns of these names are replaced.

        Null and empty texts have no lexicon word and are scored by the same model. Texts are scored
        whole, in time linear in their length, also without any break between words. Rows that repeat
        an id are scored once each, equal texts alike.
        """
        if self.trees is None:
            scored = docs.withColumn("score", F.lit(self.constant))
        else:
            raw = docs.withColumn(f"{OWN}vector", array_to_vector(_features(self.lexicon)(F.col(text_col))))
            scored = self.scale.transform(_raw_score(self.trees, raw))
            scored = scored.withColumn("score", F.least(F.greatest(F.col(f"{OWN}level"), F.lit(0.0)), F.lit(1.0)))
        scored = scored.drop(*(f"{OWN}{c}" for c in ("vector", "raw", "probability", "class", "level")))
        return scored.withColumn("predicted", (F.col("score") >= self.threshold).cast("int"))


def _raw_score(trees: GBTClassificationModel, vectors: DataFrame) -> DataFrame:
    out = trees.transform(vectors)
    return out.withColumn(f"{OWN}probability", vector_to_array(f"{OWN}probability")[1])


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, most: int) -> DataFrame:
    """(id, text, label) of about ``most`` labelled rows, drawn by a hash of the id.

    An id with several labels takes the highest. The drawn labels are bounded by ``most``, so they
    are broadcast and the texts stay where they are.
    """
    known = (
        labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
        .groupBy(F.col(id_col).alias(f"{OWN}id"))
        .agg((F.max(label_col) > 0).cast("int").alias("label"))
    )
    total = known.count()
    if total > most:
        known = known.where(F.pmod(F.xxhash64(F.col(f"{OWN}id"), F.lit("sample")), F.lit(1_000_000)) < 1_000_000 * most // total)
    return docs.join(F.broadcast(known), F.col(id_col) == F.col(f"{OWN}id")).select(
        F.col(id_col).alias("id"), F.col(text_col).alias("text"), "label"
    )


def fit_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    max_labelled: int = MAX_LABELLED,
    threshold: float = THRESHOLD,
    trees: int = 20,
    depth: int = 3,
    max_terms: int = MAX_TERMS,
) -> ToxicityModel:
    """Fit on labelled rows: half for the lexicon, a quarter for the trees, a quarter for calibration.

    Without labels, or with one class only, the model scores every text with that class (0 if none).
    A part that lacks a class falls back to all drawn rows. The lexicon, which goes to every task, is
    the ``max_terms`` words and beginnings of highest log-odds among those in three toxic texts or more.
    """
    drawn = stored(labelled_sample(docs, labels, id_col, text_col, label_col, max_labelled), "toxicity-labelled")
    part = F.pmod(F.xxhash64(F.col("id"), F.lit("part")), F.lit(4))
    drawn = drawn.withColumn("part", F.when(part < 2, 0).otherwise(part - 1))
    sizes = {(r["part"], r["label"]): r["count"] for r in drawn.groupBy("part", "label").count().collect()}
    of_class = [sum(n for (_, label), n in sizes.items() if label == wanted) for wanted in (0, 1)]
    if not all(of_class):
        return ToxicityModel({}, None, None, float(of_class[1] > 0), threshold)

    def rows(number: int) -> DataFrame:
        whole = all(sizes.get((number, label)) for label in (0, 1))
        return drawn.where(F.col("part") == number) if whole else drawn

    split = all(sizes.get((0, label)) for label in (0, 1))
    clean, toxic = (sizes[0, label] if split else of_class[label] for label in (0, 1))
    lexicon = _learn_lexicon(rows(0), toxic, clean, max_terms)
    vectors = drawn.select("part", F.col("label").cast("double").alias("label"), array_to_vector(_features(lexicon)(F.col("text"))).alias(f"{OWN}vector"))
    vectors = stored(vectors, "toxicity-vectors")

    def part_of(number: int) -> DataFrame:
        whole = all(sizes.get((number, label)) for label in (0, 1))
        return vectors.where(F.col("part") == number) if whole else vectors

    booster = GBTClassifier(
        featuresCol=f"{OWN}vector", labelCol="label", predictionCol=f"{OWN}class", maxIter=trees, maxDepth=depth,
        minInstancesPerNode=3, stepSize=0.2, seed=7,
    )
    booster = booster.setProbabilityCol(f"{OWN}probability").setRawPredictionCol(f"{OWN}raw")
    boosted = booster.fit(part_of(1).coalesce(4))
    scale = IsotonicRegression(featuresCol=f"{OWN}probability", labelCol="label", predictionCol=f"{OWN}level").fit(
        _raw_score(boosted, part_of(2))
    )
    return ToxicityModel(lexicon, boosted, scale, threshold=threshold)


def _learn_lexicon(rows: DataFrame, toxic: int, clean: int, max_terms: int) -> dict[str, float]:
    counts = rows.select("text", "label").mapInArrow(_term_counts, "term string, toxic long, clean long")
    odds: Column = F.log((F.col("toxic") + 0.5) / (toxic + 1.0)) - F.log((F.col("clean") + 0.5) / (clean + 1.0))
    best = (
        counts.groupBy("term")
        .agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        .where(F.col("toxic") >= LEAST_TOXIC_TEXTS)
        .select("term", odds.alias("weight"))
        .where(F.col("weight") >= WEAK)
        .orderBy(F.desc("weight"), "term")
        .limit(max_terms)
    )
    return {r["term"]: r["weight"] for r in best.collect()}
