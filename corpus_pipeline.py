"""The corpus pipeline: quality rules, toxicity, near-dedup, packing.

STAGES are applied to ``documents`` in order. Each takes (spark, docs, sf_dir) and works on all
rows that its predecessor kept; all but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm import labelled, neardup, packing, quality_rules, toxicity
from marlstone.llm.queries import SAMPLE, SAMPLE_CHARS, TOKENIZER
from marlstone.llm.shared import discard, settle


def by_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the threshold table keeps."""
    return quality_rules.keep(docs)


def by_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled ones among them, scores under 0.5."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    examples, weights = labelled.weighted(docs, labels, "toxic", F.lit(True), SAMPLE, chars=SAMPLE_CHARS)
    scored = toxicity.scored(docs, toxicity.train(examples, weights=weights), out_col="toxicity score")
    return scored.where(F.col("toxicity score") < 0.5).select(*docs.columns)


def by_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the least id: candidates by SimHash and by minimum hashes, links at Jaccard 0.8 (five-word shingles)."""
    return neardup.deduplicate(docs)


def into_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of 4096-token sequences."""
    pieces = packing.pack(docs, public_tokenizers.path(TOKENIZER))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality rules", by_quality_rules),
    ("toxicity", by_toxicity),
    ("near-dedup", by_near_duplicates),
    ("packing", into_sequences),
]

#: A trained classifier and fingerprint components have no SQL; tests hold run() against plain code.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table, each written to the shared folder and reread."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = settle(docs, f"pipeline-{k}")
            if before is not None:
                discard(before)  # the stage after it has been written
            before = docs
    return docs
