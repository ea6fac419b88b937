"""Audit of how filters interact: what every order of a set of filters removes, step by step.

A document is its mask of failed filters. Documents are counted by (part, mask) in Spark; there are
2^k masks, whatever the number of documents. The step at which an order removes a mask is a min-plus
product: the mask matrix holds 0 where a filter fails and infinity where it passes, the position
matrix holds the step of each filter in each order (the inverse permutation); their sum, minimised
over the filters, is the step of removal. Counts are scattered to (order, step) cells with the masks'
weights, so every figure of a part is one integer product of its counts with a fixed table.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import OWN

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Orders are k!, masks 2^k: the tables of 7 filters take 5,040 x 7 cells of 128 masks.
MOST_FILTERS = 7
FIGURES = ("kept", "removed", "redundant", "unique_fails")
_PART, _MASK, _COUNTS = f"{OWN}part", f"{OWN}mask", f"{OWN}counts"


def removal_steps(fails: np.ndarray, positions: np.ndarray) -> np.ndarray:
    """Min-plus product: for every mask (rows of 0 or infinity) and order the step that removes it."""
    steps = np.full((len(fails), len(positions)), np.inf)
    for f in range(fails.shape[1]):
        np.minimum(steps, fails[:, f, None] + positions[None, :, f], out=steps)
    return steps


@dataclass(frozen=True)
class Orders:
    """All orders of the filters ``letters`` and, per mask, what happens to it at each step of each."""

    letters: str

    def __post_init__(self):
        if not 1 <= len(self.letters) <= MOST_FILTERS or len(set(self.letters)) < len(self.letters):
            raise ValueError(f"1 to {MOST_FILTERS} filters with different one-letter names are needed")

    @property
    def orders(self) -> list[tuple[int, ...]]:
        return list(permutations(range(len(self.letters))))

    def names(self) -> list[str]:
        return ["".join(self.letters[f] for f in order) for order in self.orders]

    def tables(self) -> dict[str, np.ndarray]:
        """Per figure a (masks, orders x steps) table of 0 and 1; ``filter`` is the filter of a cell."""
        k = len(self.letters)
        orders = np.array(self.orders)
        positions = np.argsort(orders, axis=1) + 1  # step of each filter
        masks = np.arange(1 << k)
        failed = (masks[:, None] >> np.arange(k)) & 1
        gone = removal_steps(np.where(failed == 1, 0.0, np.inf), positions)[:, :, None]
        step = np.arange(1, k + 1)[None, None, :]
        fails_it = failed[:, orders] == 1  # masks x orders x steps
        cells = {
            "kept": gone > step,
            "removed": gone == step,
            "redundant": fails_it & (gone < step),
            "unique_fails": fails_it & (failed.sum(axis=1) == 1)[:, None, None],
        }
        flat = {name: np.ascontiguousarray(cell.reshape(len(masks), -1)).astype(np.int64) for name, cell in cells.items()}
        return flat | {"filter": orders.reshape(-1)}


def mask_of(filters: Mapping[str, Column]) -> Column:
    """Bit i is set when the i-th failure condition holds; a condition that is null does not hold."""
    mask = F.lit(0)
    for bit, fails in enumerate(filters.values()):
        mask = mask + F.when(fails, F.lit(1 << bit)).otherwise(F.lit(0))
    return mask


def _audited(letters: str, weights: tuple[str, ...], schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        orders = Orders(letters)
        tables, k, names = orders.tables(), len(letters), orders.names()
        cells, masks = len(names) * k, 1 << k
        for batch in batches:
            for row in range(batch.num_rows):
                part, entries = batch.column(0)[row].as_py(), batch.column(1)[row].as_py()
                counts = np.zeros((1 + len(weights), masks), dtype=np.int64)
                for entry in entries:
                    counts[:, entry["mask"]] = [entry["n"], *(entry[w] for w in weights)]
                figures = {name: counts[0] @ tables[name] for name in FIGURES}
                figures |= {f"{w}_lost": counts[1 + i] @ tables["removed"] for i, w in enumerate(weights)}
                of_filter = np.zeros(k, dtype=np.int64)
                np.add.at(of_filter, tables["filter"], figures["removed"])
                figures["shapley"] = of_filter[tables["filter"]]
                columns = {
                    "part": pa.array([part] * cells, pa.string()),
                    "filter_order": pa.array([n for n in names for _ in range(k)], pa.string()),
                    "step": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(names))),
                } | {name: pa.array(values) for name, values in figures.items()}
                yield pa.RecordBatch.from_arrays([columns[f.name] for f in schema], schema=schema)

    return run


def audit(rows: DataFrame, filters: Mapping[str, Column], part: Column, weights: Mapping[str, Column] | None = None) -> DataFrame:
    """One row for every part, order of the filters and step, zeros included.

    ``filters`` maps one-letter names to failure conditions on ``rows``; ``weights`` maps names to
    conditions whose rows are counted as ``<name>_lost`` where they are removed. A condition that is
    null does not hold; a null part counts as the empty text. Every row counts, whether or not it
    repeats another. A part is present when ``rows`` holds it, so an empty frame gives no rows.

    part string, filter_order string (applied from the left), step int (from 1), and as long: kept
    (after the step), removed (at it), redundant (failing its filter, removed before), unique_fails
    (failing its filter only), ``<name>_lost``, shapley (rows its filter removes, summed over all orders).
    """
    weights = dict(weights or {})
    letters = "".join(filters)
    Orders(letters)  # refuses too many
    named = rows.select(
        F.coalesce(part.cast("string"), F.lit("")).alias(_PART),
        mask_of(filters).alias(_MASK),
        *(F.when(c, 1).otherwise(0).cast("long").alias(f"{OWN}{w}") for w, c in weights.items()),
    )
    counted = named.groupBy(_PART, _MASK).agg(F.count("*").alias("n"), *(F.sum(f"{OWN}{w}").alias(w) for w in weights))
    # At most 2^k entries a part.
    parts = counted.groupBy(_PART).agg(F.collect_list(F.struct(F.col(_MASK).alias("mask"), "n", *weights)).alias(_COUNTS))
    longs = [*FIGURES, *(f"{w}_lost" for w in weights), "shapley"]
    schema = pa.schema([("part", pa.string()), ("filter_order", pa.string()), ("step", pa.int32())] + [(n, pa.int64()) for n in longs])
    kinds = "part string, filter_order string, step int, " + ", ".join(f"`{n}` long" for n in longs)
    return parts.mapInArrow(_audited(letters, tuple(weights), schema), kinds)


# -- document filters -------------------------------------------------------------------------------

_BLANK = r"[\x20\x09-\x0D]+"
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def text_conditions(text: Column) -> dict[str, Column]:
    """Failure conditions of a text (null: empty) on its own.

    A: under 50 words; B: under 65 % of the words are distinct; C: over 5 % of the code points are
    A-Z; D: holds any of ``#$%&*|``. Words are runs without white space, compared as they are.
    """
    text = F.coalesce(text, F.lit(""))
    words = F.array_remove(F.split(text, _BLANK), "")
    n = F.size(words)
    capitals = F.char_length(text) - F.char_length(F.translate(text, LETTERS, ""))
    return {
        "A": n < 50,
        "B": 100 * F.size(F.array_distinct(words)) < 65 * n,
        "C": 100 * capitals > 5 * F.char_length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def document_flags(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(id, part, A, B, C, D, E, good, toxic) of every document row, without its text.

    E: a smaller id holds the identical text (null and empty texts are identical). A null id is
    neither smaller nor larger than another, and has no labels. Rows that repeat an id come back once
    each and do not make each other fail. Equal texts are told by their SHA-256. good and toxic hold when
    any label row of the id says quality 1, or toxic 1.

    Copies of one text, however many, meet only as one smallest id a task; the rows themselves are
    joined by (id, text), which no group of copies makes hot.
    """
    digest = F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256))
    own = docs.select(
        F.col(id_col).alias("id"),
        F.col(part_col).cast("string").alias("part"),
        digest.alias("digest"),
        *(fails.alias(letter) for letter, fails in text_conditions(F.col(text_col)).items()),
    )
    return _with_firsts(own, labels, id_col)


def _with_firsts(own: DataFrame, labels: DataFrame, id_col: str) -> DataFrame:
    named = own.where(F.col("id").isNotNull())
    firsts = named.groupBy("digest").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    marks = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id"))
    marks = marks.agg(F.max((F.col("quality") == 1)).alias("good"), F.max((F.col("toxic") == 1)).alias("toxic"))
    flagged = named.join(firsts, ["id", "digest"], "left").join(marks, "id", "left")
    columns = ["id", "part", *"ABCD"]
    known = flagged.select(*columns, F.col("first").isNull().alias("E"), *(F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")))
    unnamed = own.where(F.col("id").isNull())  # apart: as a join key null would be hot
    return known.unionByName(unnamed.select(*columns, *(F.lit(False).alias(c) for c in ("E", "good", "toxic"))))


def audit_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """:func:`audit` of the filters A to E over documents, with good_lost and toxic_lost from ``labels``."""
    flags = document_flags(docs, labels, id_col, text_col, part_col)
    return audit(flags, {c: F.col(c) for c in "ABCDE"}, F.col("part"), {"good": F.col("good"), "toxic": F.col("toxic")})
