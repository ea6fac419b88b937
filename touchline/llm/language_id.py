"""Language identification by rank-order profiles.

A language's profile is the ranking of its most frequent letter n-grams (words padded with a blank
on both sides). A document's own ranking is compared with every profile: each n-gram adds how far
out of place it is, an n-gram the profile lacks adds the most. The nearest profile wins.

Learning counts words per language over all rows given, and n-grams over the distinct words.
"""

from __future__ import annotations

import re
import sys
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from touchline.llm.common import SLICE_ROWS, value_slices

cloudpickle.register_pickle_by_value(sys.modules[__name__])

UNKNOWN = "und"
SIZES = (1, 2, 3)
PROFILE = 400
# The profiles are sent to every task: languages times profile size, checked against this.
MAX_LANGUAGES = 10_000
# Longer texts are counted in pieces of so many characters.
PIECE_CHARS = 1 << 20
_BITS, _BLANK = 21, ord(" ")

_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    """Letter runs, lower-cased."""
    return _WORD.findall(text.lower())


def grams_of(word: str) -> list[str]:
    """N-grams of one padded word."""
    padded = f" {word} "
    return [padded[i : i + n] for n in SIZES for i in range(len(padded) - n + 1) if padded[i : i + n] != " "]


def _has_letter(word: str) -> bool:
    return word[0].isalpha() or any(map(str.isalpha, word))


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts: dict[str, Counter] = {}
        for piece in value_slices(batch):
            for text, lang in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist()):
                counts.setdefault(lang, Counter()).update(words_of(text))
        rows = [(lang, word, n) for lang, words in counts.items() for word, n in words.items() if _has_letter(word)]
        columns = zip(*rows) if rows else [()] * 3
        kinds = (pa.string(), pa.string(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["lang", "word", "n"])


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts: Counter = Counter()
        for lang, word, n in zip(*(batch.column(c).to_pylist() for c in ("lang", "word", "n"))):
            for gram in grams_of(word):
                counts[lang, gram] += n
        langs, grams = zip(*counts) if counts else ((), ())
        yield pa.RecordBatch.from_arrays(
            [pa.array(langs, pa.string()), pa.array(grams, pa.string()), pa.array(counts.values(), pa.int64())],
            names=["lang", "gram", "n"],
        )


@dataclass(frozen=True)
class Profiles:
    """Grams of all profiles, and their rank in each language (``size`` where a profile lacks one)."""

    languages: tuple[str, ...]
    grams: tuple[str, ...]
    ranks: np.ndarray  # grams x languages
    size: int

    def nearest(self, grams: np.ndarray, counts: np.ndarray, known: tuple[np.ndarray, np.ndarray]) -> tuple[str, float]:
        """Language and score of a text's n-grams; the score is 1 less the share of the largest possible distance."""
        if not len(grams) or not self.languages:
            return UNKNOWN, 0.0
        order = np.argsort(-counts.astype(np.int16 if counts.max() < 32_768 else np.int64), kind="stable")[: self.size]
        chosen, (codes, ranks) = grams[order], known
        at = np.minimum(np.searchsorted(codes, chosen), len(codes) - 1)
        held = np.where((codes[at] == chosen)[:, None], ranks[at], self.size)
        apart = np.where(held < self.size, np.abs(held - np.arange(len(chosen))[:, None]), self.size)
        distance = apart.sum(axis=0)
        best = int(np.argmin(distance))
        return self.languages[best], float(1.0 - distance[best] / (self.size * len(chosen)))

    def known(self) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the profiles' n-grams, ascending, and their ranks."""
        codes = np.array([gram_code(g) for g in self.grams], dtype=np.int64)
        order = np.argsort(codes)
        return codes[order], self.ranks[order]


def gram_code(gram: str) -> int:
    """Up to three code points in 63 bits; codes are in the alphabetical order of the n-grams."""
    return sum(ord(c) << _BITS * (len(SIZES) - 1 - i) for i, c in enumerate(gram))


def _letters() -> np.ndarray:
    """Per code point: 1 for a letter, 2 for what else words are made of, 0 for what stands between words."""
    points = "".join(map(chr, range(0xD800))) + " " * 0x800 + "".join(map(chr, range(0xE000, 0x110000)))
    kinds = np.zeros(len(points), dtype=np.uint8)
    for run in _WORD.finditer(points):
        kinds[run.start() : run.end()] = [1 if c.isalpha() else 2 for c in run.group()]
    return kinds


def text_grams(text: str, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of a text's n-grams, ascending, and how often each occurs: those of all its padded words.

    Counted straight on the code points, as the words of a text are mostly new: every letter gives
    itself, the pair and the triple it stands last or in the middle of, and the pair with a blank after it.
    """
    low = text.lower()
    points = np.frombuffer(low.encode("utf-32-le"), dtype="<u4")
    kind = kinds[points]
    if (kind == 2).any():  # words without any letter do not count
        low = _WORD.sub(lambda word: word.group() if _has_letter(word.group()) else " " * len(word.group()), low)
        points = np.frombuffer(low.encode("utf-32-le"), dtype="<u4")
        kind = kinds[points]
    padded = np.full(len(points) + 2, _BLANK, dtype=np.int64)
    padded[1:-1] = np.where(kind > 0, points, _BLANK)
    grams, counts = [], []
    for first in range(1, len(padded) - 1, PIECE_CHARS):
        at = first + np.flatnonzero(padded[first : min(first + PIECE_CHARS, len(padded) - 1)] != _BLANK)
        before, here, after = padded[at - 1] << 2 * _BITS, padded[at], padded[at + 1]
        last = after == _BLANK
        codes = np.concatenate(
            [here << 2 * _BITS, before | here << _BITS, here[last] << 2 * _BITS | after[last] << _BITS, before | here << _BITS | after]
        )
        codes.sort()
        starts = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else np.empty(0, dtype=np.int64)
        grams.append(codes[starts])
        counts.append(np.diff(np.append(starts, len(codes))))
    if len(grams) == 1:
        return grams[0], counts[0]
    distinct, place = np.unique(np.concatenate(grams or [np.empty(0, dtype=np.int64)]), return_inverse=True)
    return distinct, np.bincount(place, weights=np.concatenate(counts or [np.empty(0)]), minlength=len(distinct)).astype(np.int64)


def learn_profiles(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", size: int = PROFILE) -> Profiles:
    """Profiles of every language among the rows whose text and language are not null."""
    known = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    words = known.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    words = words.mapInArrow(_word_counts, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    grams = words.mapInArrow(_gram_counts, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    ranked = grams.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < size)
    rows = ranked.limit(MAX_LANGUAGES * size + 1).collect()
    if len(rows) > MAX_LANGUAGES * size:
        raise ValueError(f"more than {MAX_LANGUAGES} languages: their profiles are too many to send to every task")
    languages = tuple(sorted({r["lang"] for r in rows}))
    all_grams = tuple(sorted({r["gram"] for r in rows}))
    ranks = np.full((len(all_grams), len(languages)), size, dtype=np.int64)
    column = {lang: i for i, lang in enumerate(languages)}
    line = {gram: i for i, gram in enumerate(all_grams)}
    for r in rows:
        ranks[line[r["gram"]], column[r["lang"]]] = r["rank"]
    return Profiles(languages, all_grams, ranks, size)


def _predict(shared) -> Callable[[pa.Array], pa.Array]:
    kept = []  # of a task, over its batches

    def run(texts: pa.Array) -> pa.Array:
        profiles = shared.value
        if not kept:
            kept.append((profiles.known(), _letters()))
        known, kinds = kept[0]
        langs, scores = [], []
        for first in range(0, len(texts), SLICE_ROWS):
            for text in texts.slice(first, SLICE_ROWS).to_pylist():
                lang, score = profiles.nearest(*text_grams(text or "", kinds), known)
                langs.append(lang)
                scores.append(score)
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "score"])

    return run


def identify(docs: DataFrame, profiles: Profiles, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score (0 to 1); columns of these names are replaced.

    A text that is null or has no letters is ``und`` with score 0, and so is every text when no
    language was learned. Equal distances go to the first language in alphabetical order,
    equally frequent n-grams are ranked alphabetically, as in the profiles. Texts are read whole, however long. Rows that
    repeat an id come back once each; an empty table comes back empty.
    """
    kind = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(profiles)
    predict = F.arrow_udf(_predict(shared), kind)
    found = docs.withColumn("__llm_found", predict(F.col(text_col)))
    return found.withColumns({c: F.col(f"__llm_found.{c}") for c in ("lang_pred", "score")}).drop("__llm_found")
