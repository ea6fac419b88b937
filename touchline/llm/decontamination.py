"""Benchmark decontamination: test passages found in training texts, and taken out of them.

The windows of all benchmark items (runs of ten words; a shorter item is one window) are hashed into
a table that is broadcast as a hash set and joined with the windows of every document. A hit counts
only once its words were compared with the window's. Texts stay where they were read: a window is
hashed and looked up in the task that split the text, and only verified hits are shuffled.

The main path is Spark expressions alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import OWN, stored

WINDOW = 10
# A broadcast hash set holds about so many windows (100 bytes each); a larger benchmark takes more passes.
WINDOWS_PER_PASS = 500_000

# What stands between words (fixed by the contract): ASCII but for letters and digits.
_BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
_INSIDE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_ID, _PART, _WORDS, _START, _LENGTH, _KEY, _WINDOW, _NUMBER, _ITEM, _COVERED, _OWN_PART = (
    f"{OWN}{name}" for name in ("id", "part", "words", "start", "length", "key", "window", "number", "item", "covered", "own_part")
)


def _lowered(text: Column) -> Column:
    """A-Z lower-cased and nothing else; ``lower`` does just that to a text of ASCII."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"{_BETWEEN}+"), "")


def _part(text_col: str) -> Column:
    """Rows that share an id and this hash of the text share one result."""
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def _cut() -> Column:
    return F.slice(F.col(_WORDS), F.col(_START), F.col(_LENGTH))


def benchmark_windows(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", size: int = WINDOW) -> DataFrame:
    """The distinct (item, length, window) of every item; an item without words has none."""
    words = benchmark.select(F.col(item_col).alias(_ITEM), _words(_lowered(F.col(text_col))).alias(_WORDS)).where(F.size(_WORDS) > 0)
    sized = words.withColumn(_LENGTH, F.least(F.size(_WORDS), F.lit(size)))
    starts = sized.withColumn(_START, F.explode(F.sequence(F.lit(1), F.size(_WORDS) - F.col(_LENGTH) + 1)))
    return starts.select(_ITEM, _LENGTH, F.array_join(_cut(), " ").alias(_WINDOW)).distinct()  # no word holds a blank


def _hits(docs: DataFrame, windows: DataFrame, lengths: list[int], id_col: str, text_col: str) -> DataFrame:
    """(id, part, start, length, number) of every verified occurrence of a window."""
    split = docs.select(F.col(id_col).alias(_ID), _part(text_col).alias(_PART), _words(_lowered(F.col(text_col))).alias(_WORDS))
    count = F.size(_WORDS)
    # explode_outer: for explode the optimizer would split every text a second time, to drop empty ones.
    starts = split.withColumn(_START, F.explode_outer(F.when(count > 0, F.sequence(F.lit(1), count))))
    sized = starts.withColumn(_LENGTH, F.explode_outer(F.array(*map(F.lit, lengths))) if len(lengths) > 1 else F.lit(lengths[0]))
    whole = sized.where(F.col(_START) + F.col(_LENGTH) <= count + 1).withColumn(_KEY, F.xxhash64(_cut()))
    found = whole.join(F.broadcast(windows), _KEY).where(F.array_join(_cut(), " ") == F.col(_WINDOW))
    return found.select(_ID, _PART, _START, _LENGTH, _NUMBER)


def contaminated_spans(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    size: int = WINDOW,
) -> DataFrame:
    """(id, part, covered, items) of every document with a hit.

    ``covered`` lists the words inside occurrences (from 1, ascending), ``items`` the ids of the items
    as sorted text, ``part`` is the hash of the text, as rows may repeat an id.
    """
    pairs = stored(benchmark_windows(benchmark, item_col, item_text_col, size), "benchmark-pairs")
    windows = stored(
        pairs.select(_LENGTH, _WINDOW).distinct().select("*", F.monotonically_increasing_id().alias(_NUMBER)), "benchmark-windows"
    )
    lengths = sorted(row[0] for row in windows.select(_LENGTH).distinct().collect())  # at most ``size`` of them
    passes = -(-windows.count() // WINDOWS_PER_PASS)
    keyed = windows.withColumn(_KEY, F.xxhash64(F.split(_WINDOW, " "))).drop(_LENGTH)
    hits = None
    for turn in range(passes):
        mine = keyed.where(F.pmod(F.xxhash64(_NUMBER), F.lit(passes)) == turn)
        some = _hits(docs, mine, lengths, id_col, text_col)
        hits = some if hits is None else hits.unionByName(some)
    if hits is None:  # no benchmark
        hits = _hits(docs.limit(0), keyed, [size], id_col, text_col)
    hits = stored(hits, "benchmark-hits")
    inside = F.transform(F.collect_set(F.struct(_START, _LENGTH)), lambda s: F.sequence(s[_START], s[_START] + s[_LENGTH] - 1))
    covered = hits.groupBy(_ID, _PART).agg(F.array_sort(F.array_distinct(F.flatten(inside))).alias(_COVERED))
    named = pairs.join(windows, [_LENGTH, _WINDOW]).select(_NUMBER, F.col(_ITEM).cast("string").alias(_ITEM))
    items = hits.select(_ID, _PART, _NUMBER).distinct().join(named, _NUMBER)
    items = items.groupBy(_ID, _PART).agg(F.array_sort(F.collect_set(_ITEM)).alias("items"))
    same = covered[_ID].eqNullSafe(items[_ID]) & (covered[_PART] == items[_PART])
    return covered.join(items, same).select(
        covered[_ID].alias("id"), covered[_PART].alias("part"), F.col(_COVERED).alias("covered"), "items"
    )


def count_words(text: Column) -> Column:
    return F.size(_words(text)).cast("long")


def mark(docs: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with n_words, n_hit, n_items, items, covered and contaminated; columns of these names are replaced.

    ``spans`` comes from :func:`contaminated_spans` on the same documents. Words are runs of ASCII
    letters, digits and anything outside ASCII, compared with A-Z lower-cased. A null or empty text
    has no words and is never contaminated, nor is any document beside an empty benchmark or one
    whose texts hold no words. Texts are read whole, however long. Rows that repeat an id come back
    once each, every one with the hits of its own text; a null id is an id like others. An item of
    fewer than ``size`` words counts where all its words occur in a row; items with equal windows
    all count; item ids that repeat count once.
    """
    found = spans.select(
        F.col("id").alias(_ID), F.col("part").alias(_PART), F.col("covered").alias(_COVERED), F.col("items").alias(_ITEM)
    )
    # Counted and hashed before the join: it carries the texts only for callers who read them afterwards.
    counted = docs.withColumns({"n_words": count_words(F.col(text_col)), _OWN_PART: _part(text_col)})
    joined = counted.join(found, F.col(id_col).eqNullSafe(F.col(_ID)) & (F.col(_OWN_PART) == F.col(_PART)), "left")
    covered = F.coalesce(F.col(_COVERED), F.array().cast("array<int>"))
    items = F.coalesce(F.col(_ITEM), F.array().cast("array<string>"))
    return joined.withColumns(
        {
            "n_hit": F.size(covered).cast("long"),
            "n_items": F.size(items).cast("long"),
            "items": items,
            "covered": covered,
            "contaminated": F.size(covered) > 0,
        }
    ).drop(_ID, _PART, _OWN_PART, _COVERED, _ITEM)


def _without(text: Column, covered: Column) -> Column:
    """``text`` without the covered words and what stands right before each of them."""
    pieces = F.regexp_extract_all(text, F.lit(f"({_BETWEEN}*{_INSIDE}+)"), F.lit(1))
    first = F.array_except(covered, F.transform(covered, lambda p: p + 1))
    last = F.array_except(covered, F.transform(covered, lambda p: p - 1))
    begin = F.concat(F.array(F.lit(1)), F.transform(last, lambda p: p + 1))
    end = F.concat(F.transform(first, lambda p: p - 1), F.array(F.size(pieces)))
    kept = F.zip_with(begin, end, lambda a, b: F.array_join(F.slice(pieces, a, F.greatest(b - a + 1, F.lit(0))), ""))
    tail = F.substr(text, F.length(F.array_join(pieces, "")) + 1)
    return F.concat(F.array_join(kept, ""), tail)


def remove(marked: DataFrame, what: str = "spans", text_col: str = "text", most_share: float = 1.0) -> DataFrame:
    """``marked`` documents (see :func:`mark`) without what is contaminated.

    ``what="documents"`` drops every contaminated row. ``what="spans"`` cuts the covered words out of
    the text, each with what stands right before it, and drops rows of which more than ``most_share``
    of the words are covered. Clean rows, null texts among them, come back unchanged.
    """
    if what == "documents":
        return marked.where(~F.col("contaminated"))
    if what != "spans":
        raise ValueError("what must be 'spans' or 'documents'")
    rest = marked.where(F.col("n_hit") <= most_share * F.col("n_words"))
    cleaned = F.when(F.col("contaminated"), _without(F.col(text_col), F.col("covered"))).otherwise(F.col(text_col))
    return rest.withColumn(text_col, cleaned)
