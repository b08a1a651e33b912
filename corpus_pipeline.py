"""Corpus pipeline: classified, deduplicated, decontaminated, masked, packed.

Every stage takes documents with null ids and texts, empty and very long texts, repeated rows, no rows at all, and further columns
of any name; all but the last return just the columns they got.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm.common import shared_folder, stored, table
from waymark.llm.decontaminate import clean
from waymark.llm.ngram_join import join
from waymark.llm.packing import pack
from waymark.llm.quality import ADDED, select
from waymark.llm.secrets import mask


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go. Null and empty texts rank with clean text; repeated rows draw alike, and of those that tie at the
    threshold the first by doc_id and text stay."""
    judged = select(docs, table(spark, sf_dir, "labels")).where("kept")
    return judged.select(*[F.col(f"`{'own_' + c if c in ADDED else c}`").alias(c) for c in docs.columns])


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one document stays, the one with the least doc_id (null ids come last; of rows with that id
    any one). Texts without words are in no group: each such document stays. Repeated rows are copies and become one."""
    n, ids, known = docs.agg(F.count(F.lit(1)), F.countDistinct("doc_id"), F.count("doc_id")).first()
    if n == ids == known:
        kept = join(docs).where("doc_id = component_id").select(F.col("doc_id").alias("_kept"))
        held = docs.select(F.col("doc_id").cast("long").alias("_kept"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_own"))
        return held.join(kept, "_kept", "left_semi").select("_own.*")
    # Ids don't tell rows apart: numbers do, which hold over rows that are written once.
    held = docs.select(F.monotonically_increasing_id().alias("_row"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_own"))
    held = stored(held, shared_folder(spark, "numbered"))
    found = join(held.select(F.col("_row").alias("doc_id"), F.col("_own.text").alias("text"))).select(F.col("doc_id").alias("_row"), "component_id")
    order = F.struct(F.col("_own.doc_id").isNull().alias("last"), F.col("_own.doc_id").cast("long").alias("id"), F.col("_row").alias("row"))
    kept = held.select("_row", order.alias("order")).join(found, "_row").groupBy("component_id").agg(F.min("order").alias("first")).select(F.col("first.row").alias("_row"))
    return held.join(kept, "_row", "left_semi").select("_own.*")


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go, each judged by its own text; null and empty texts stay."""
    return clean(docs, table(spark, sf_dir, "benchmark"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the text; n_chars follows where there is one. Every document stays."""
    masked = mask(docs)
    if "n_chars" in docs.columns:
        masked = masked.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"]))
    return masked.select(*[F.col(f"`{c}`") for c in docs.columns])


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document stands in which sequence of 4,096 tokens. A null or empty text is one piece of one token."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), lean=True)


STAGES = [
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("benchmark decontamination", benchmark_decontamination),
    ("secret scans", secret_scans),
    ("best-fit packing", best_fit_packing),
]
#: Classifier, join and tokenizer go beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each written as Parquet and reread as the next one's input."""
    docs, folder = table(spark, sf_dir, "documents"), shared_folder(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        docs = stored(stage(spark, docs, sf_dir), f"{folder}/{k}")
    return docs
