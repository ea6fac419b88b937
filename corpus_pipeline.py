"""A corpus pipeline over ``documents``: five stages, each written as Parquet and read again.

toxicity      documents predicted toxic go (trees fitted on labelled rows outside the held-out third)
line_dedup    lines that a smaller document holds go; a document may become empty, none is lost
ngram_jaccard one document of each group of near copies (Jaccard similarity of five-word shingles
              at least 0.8) stays, the one with the smallest id
pii           validated personal values become pseudonyms
packing       the texts as token sequences, mixed over sources

A stage works on every row its predecessor kept and hands on the columns it was given. Where the
text changes, ``n_chars`` follows it. Rows with null or empty texts pass through to the packing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.llm import line_dedup, ngram_jaccard, packing, pii, toxicity
from touchline.llm.common import OWN, stored, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
ROW = f"{OWN}row"
# Near copies of the corpus: five-word shingles, similarity 0.8. The default rule is the contract of op4 alone.
NEAR_COPIES = ngram_jaccard.Rule(width=5, num=80, den=100)


def _carried(docs: DataFrame) -> DataFrame:
    """Id and text beside the whole row, so that no column of the row can clash with an operator's."""
    return docs.select(F.struct("*").alias(ROW), "doc_id", "text")


def _with_text(carried: DataFrame, text: str) -> DataFrame:
    """The rows with a new text; a null text stays null."""
    new = F.when(F.col(f"{ROW}.text").isNotNull(), F.col(text))
    row = F.col(ROW).withField("text", new)
    if "n_chars" in carried.schema[ROW].dataType.names:
        row = row.withField("n_chars", F.coalesce(F.length(new).cast("long"), F.col(f"{ROW}.n_chars")))
    return carried.select(row.alias(ROW)).select(f"{ROW}.*")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    model = toxicity.fit_toxicity(docs.select("doc_id", "text"), table(spark, sf_dir, "labels").where(~held_out))
    return model.score(_carried(docs)).where("predicted = 0").select(f"{ROW}.*")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _with_text(line_dedup.dedup_lines(_carried(docs)), "kept_text")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_jaccard.keep_one(docs, rule=NEAR_COPIES)


def hide_personal_values(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _with_text(pii.pseudonymise(_carried(docs)), "text")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, packing.json_ranks(packing.public_path("byte_bpe_50k.json")), end_id=1)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("ngram_jaccard", drop_near_copies),
    ("pii", hide_personal_values),
    ("packing", pack_sequences),
]

# Learned scores and sketches: SQL cannot express the stages. The tests hold them against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
