"""The corpus pipeline: each stage works on all rows that the one before it kept.

Documents that the quality classifier rejects go; of each group of near copies one stays; documents
with a benchmark window go; secrets are blotted out; what is left is encoded as tokens, and the
texts that decode from them are the result.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinbase.llm import bpe, decontaminate, quality, secrets, simhash
from skeinbase.llm.common import bounded, table


#: Its stages follow one another in the same executors, whose heaps are large by then: half as much to a batch.
BATCH = "8m"


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from all labelled ones, thinks rather good than bad."""
    labels = table(spark, sf_dir, "labels")
    bounded(spark, BATCH)
    return quality.drop_rejected(docs, labels)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of smallest id, of each group of near copies."""
    bounded(spark, BATCH)
    return simhash.drop_near_copies(docs, shingle=5, similarity=0.8)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of ten words of a benchmark item."""
    benchmark = table(spark, sf_dir, "benchmark")
    bounded(spark, BATCH)
    return decontaminate.drop_contaminated(docs, benchmark)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets blotted out; n_chars is that of the new text."""
    bounded(spark, BATCH)
    return secrets.redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with the number and the ids of their tokens, and the text that they decode to."""
    bounded(spark, BATCH)
    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    tokens = bpe.encode_texts(docs, path, pattern, keep=("lang", "source"))
    found = bpe.decode_ids(tokens, path, pattern)
    return found.select(F.col("id").alias("doc_id"), F.col("decoded").cast("string").alias("text"), "lang", "source", (F.length("ids") / 4).cast("long").alias("n_tokens"), "ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_classifier),
    ("SimHash near-dedup", simhash_near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("secret scans", secret_scan),
    ("byte-level BPE", byte_bpe),
]
#: SQL can express none of the first two stages; the tests hold each stage against a brute-force one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
