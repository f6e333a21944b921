"""The corpus pipeline's stages: documents in, packed training sequences out.

STAGES are applied in order. Each takes the documents that the one before kept, and all
but the last return the columns of documents, and further ones that these have, whatever
their names. A document whose stage would meet nulls or empty texts is treated as that
stage's operator says; none is dropped for being empty."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import jaccard, packing, pii, quality, toxicity
from quarry.llm.common import fold, materialize, table, unused

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
#: Documents scored below are rejected, as are those at or above for toxicity.
LEAST_QUALITY, LEAST_TOXIC = 0.3, 0.3


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    trusted = quality.positives(table(spark, sf_dir, "labels"), fold(F.col("doc_id"), 5) != 0)
    score = unused(docs, "_score")
    scored = quality.score(docs, quality.fit(quality.measured(docs), trusted), out_col=score)
    return scored.where(F.col(score) >= LEAST_QUALITY).select(docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier does not reject."""
    labels = table(spark, sf_dir, "labels").where(fold(F.col("doc_id"), 4) != 2).select("doc_id", "toxic")
    score = unused(docs, "_score")
    scored = toxicity.score(docs, toxicity.fit(docs, labels), out_col=score)
    return scored.where(F.col(score) < LEAST_TOXIC).select(docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, 0.8 alike) one document, of
    the least id; where that id has several rows, the one of the least text. Rows of a null
    id stay."""
    groups = materialize(jaccard.jaccard_components(docs.select("doc_id", "text"), shingle=5, similarity=80).select("doc_id", "component_id"), "pipeline-groups")
    gone = groups.where("component_id < doc_id").select("doc_id").distinct()
    kept = docs.join(gone, "doc_id", "left_anti").select(docs.columns)
    several = materialize(groups.where("component_id = doc_id").groupBy("doc_id").count().where("count > 1").select("doc_id"), "pipeline-several")
    if not several.limit(1).count():
        return kept
    whole = F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(docs.columns)])
    one = kept.join(several, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(whole, F.coalesce("text", F.lit(""))).alias("row"))
    return kept.join(several, "doc_id", "left_anti").select(docs.columns).union(one.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns)]))


def redact_personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind in brackets; n_chars follows."""
    candidates, spans = unused(docs, "_candidates"), unused(docs, "_spans")
    found = materialize(pii.candidates(docs, out_col=candidates), "pipeline-candidates")
    rows = found.withColumn(spans, pii.spans(pii.fit(found, candidates), candidates))
    text, some = pii.redact(F.coalesce("text", F.lit("")), F.col(spans)), F.size(spans) > 0
    rows = rows.withColumn("text", F.when(some, text).otherwise(F.col("text")))
    return rows.withColumn("n_chars", F.when(some, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences."""
    pieces = packing.pack(docs.select("doc_id", "text"), TOKENIZER)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality", keep_quality),
    ("toxicity", drop_toxic),
    ("near_duplicates", one_of_each_group),
    ("personal_data", redact_personal),
    ("packing", pack),
]

#: The stages learn models and walk graphs, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
