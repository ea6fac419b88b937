"""The registered queries of the operators, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from touchline.llm import (
    bpe,
    bpe_codec,
    decontamination,
    embedding_dedup,
    filter_audit,
    hilbert_search,
    language_id,
    line_dedup,
    ngram_jaccard,
    packing,
    pii,
    quality,
    toxicity,
    whitening,
)
from touchline.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(build: Query) -> Query:
    QUERIES[build.__name__] = build
    return build


@query
def op1_line_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = line_dedup.dedup_lines(docs)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


@query
def op7_embedding_near_dedup(spark, sf_dir):
    found = embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return found.withColumnRenamed("id", "vec_id")


@query
def op8_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    model = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels").where(~held_out))
    return model.score(docs).select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", "predicted")


@query
def op2_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    profiles = language_id.learn_profiles(docs.where(~held_out))
    found = language_id.identify(docs.select("doc_id", "text"), profiles)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query
def op3_bpe(spark, sf_dir):
    ranks = bpe.rank_file(bpe.public_path("byte_bpe_multi_50k.tiktoken"))
    coded = bpe_codec.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), ranks)
    return coded.select(
        F.col("id").alias("doc_id"),
        F.size("ids").cast("long").alias("n_tokens"),
        bpe_codec.ids_sha256("ids").alias("ids_sha256"),
        F.sha2(bpe_codec.decode(spark, F.col("ids"), ranks), 256).alias("decoded_sha256"),
    )


@query
def op4_ngram_jaccard_join(spark, sf_dir):
    found = ngram_jaccard.jaccard_components(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


@query
def op5_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    model = quality.fit_quality(docs, table(spark, sf_dir, "labels").where(~held_out))
    return model.score(docs).select("doc_id", held_out.alias("held_out"), "score", "predicted")


@query
def op6_pii(spark, sf_dir):
    return pii.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op9_packing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    pieces = packing.pack(docs, packing.json_ranks(packing.public_path("byte_bpe_50k.json")), end_id=1)
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


@query
def op10_nearest_neighbours(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return hilbert_search.search(vectors, vectors.where("vec_id % 20 = 0"), 20)


@query
def op11_whitening(spark, sf_dir):
    rows = whitening.whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return rows.withColumnRenamed("id", "vec_id").withColumn("deviation", F.expr("try_cast(deviation AS long)"))


@query
def op12_decontamination(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    spans = decontamination.contaminated_spans(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))
    marked = decontamination.mark(docs, spans)
    items = F.sha2(F.array_join("items", ","), 256).alias("items_sha256")
    return marked.select("doc_id", "n_words", "n_hit", "n_items", items, "contaminated")


@query
def op13_filter_audit(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return filter_audit.audit_documents(docs, table(spark, sf_dir, "labels"))


@query
def pipeline(spark, sf_dir):
    return corpus_pipeline.run(spark, sf_dir)
