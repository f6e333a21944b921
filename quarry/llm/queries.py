"""One registered query for each training-data operator, with its production
parameters over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import alignment, bpe, byte_bpe, conversation_repair, fingerprint, html_text, jaccard, packing, pii, pipeline, pivot_topk, quality, sql, toxicity, url_filter
from quarry.llm.common import fold, materialize, table
from quarry.llm.pipeline import TOKENIZER

ALIGNED = (public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
BYTE_RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
URL_RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]


def op1_pivot_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivot_topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op2_url_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op3_scaled_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fingerprint.with_edited(fingerprint.fingerprints(table(spark, sf_dir, "documents")))
    return rows.select(
        F.col("id").alias("doc_id"),
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint.as_text(F.col("sketch")).alias("fingerprint"),
        fingerprint.as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
    )


def op4_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = lambda c: fold(F.col(c), 5) == 0
    measured = quality.measured(table(spark, sf_dir, "documents"))
    model = quality.fit(measured, quality.positives(table(spark, sf_dir, "labels"), ~held_out("doc_id")))
    rows = measured.select(F.col("id").alias("doc_id"), held_out("id").alias("held_out"), quality.score_of(F.col("x"), model).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op5_ftrl_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents").select("doc_id", "text"), fold(F.col("doc_id"), 4) == 2
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").where(~held_out).select("doc_id", "toxic"))
    rows = toxicity.score(docs, model)
    return rows.select("doc_id", held_out.alias("held_out"), F.col("toxic_score").alias("score"), (F.col("toxic_score") >= 0.3).cast("int").alias("predicted"))


def op6_weak_supervision_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = materialize(pii.candidates(table(spark, sf_dir, "documents")).select("doc_id", "candidates"), "pii-candidates")
    spans = pii.spans(pii.fit(found))
    base = F.filter("spans", lambda x: x["base"])
    rows = found.select("doc_id", spans.alias("spans"))
    counts = [F.size(F.filter(base, _of_kind(k))).cast("long").alias(f"n_{kind}") for k, kind in enumerate(pii.KINDS)]
    return rows.select("doc_id", *counts, F.sha2(pii.as_text(base).cast("binary"), 256).alias("base_sha256"), pii.as_text(F.col("spans")).alias("spans"))


def _of_kind(k: int):
    return lambda x: x["kind"] == k


def op7_bpe_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.roundtrip(table(spark, sf_dir, "documents"), TOKENIZER)


def op8_jaccard_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"), shingle=3, similarity=90)


def op9_text_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = html_text.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return texts.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op10_hilbert_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), TOKENIZER)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"), *ALIGNED)


def op12_glr_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair_conversations(table(spark, sf_dir, "conversations"))


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.roundtrip(table(spark, sf_dir, "documents"), BYTE_RANKS)


QUERIES = {
    "op1_pivot_topk": op1_pivot_topk,
    "op2_url_aliases": op2_url_aliases,
    "op3_scaled_sketch": op3_scaled_sketch,
    "op4_pu_quality": op4_pu_quality,
    "op5_ftrl_toxicity": op5_ftrl_toxicity,
    "op6_weak_supervision_pii": op6_weak_supervision_pii,
    "op7_bpe_trie": op7_bpe_trie,
    "op8_jaccard_components": op8_jaccard_components,
    "op9_text_density": op9_text_density,
    "op10_hilbert_packing": op10_hilbert_packing,
    "op11_token_alignment": op11_token_alignment,
    "op12_glr_repair": op12_glr_repair,
    "op13_byte_bpe": op13_byte_bpe,
    "pipeline": pipeline.run,
}

SQL: dict[str, str] = {
    "op1_pivot_topk": sql.TOP_K,
    "op2_url_aliases": sql.url_aliases(URL_RULES),
    "op8_jaccard_components": sql.JACCARD_COMPONENTS,
    "op12_glr_repair": sql.CONVERSATION_REPAIR,
}
