"""One query for each operator, over its whole table, and SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, codes, decontaminate, html, images, lines, media, ngram, oracles, quality, secrets, simhash, substrings, tokencount, whitening
from .common import crc_mod_col, lean, slices, table


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document: fixed patterns, and formats inferred from what they label."""
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"] != "format")

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    return found.select(
        F.col("id").alias("doc_id"), *(count(k).alias(f"n_{k}") for k in ("assign", "access", "hex")),
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), count("format").alias("n_format"),
    )


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash components of all documents: 3-word shingles, links at 3 differing bits or fewer."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, radius=3)
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op3_media_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of copies among the pictures of all embeddings, which stand in for a media column."""

    def pictures(batches):
        for batch in slices(batches):
            drawn = [images.pgm(images.mosaic(np.array(v.as_py() or [], np.float64))) for v in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(drawn, pa.binary())], ["id", "image"])

    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>"))
    found = media.copies(vectors.mapInArrow(lean(pictures), "id long, image binary"))
    return found.select(F.col("id").alias("vec_id"), "copy_class", "n_links")


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learned from the labels of two thirds of them."""
    found = quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), crc_mod_col("id", 3) != 1)
    return found.select(F.col("id").alias("doc_id"), (crc_mod_col("id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram tokens of every document."""
    pieces = tokencount.zipf_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    found = tokencount.count_tokens(table(spark, sf_dir, "documents"), pieces)
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_tokens", "score")


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that windows of ten words of any benchmark item cover."""
    found = decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        F.col("id").alias("doc_id"), "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of every document, and the bytes that they decode to."""
    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    found = bpe.decode_ids(bpe.encode_texts(table(spark, sf_dir, "documents"), path, pattern), path, pattern)
    return found.select(F.col("id").alias("doc_id"), (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document that a string of 100 bytes which also starts earlier covers."""
    found = substrings.remove_repeats(table(spark, sf_dir, "documents"))
    n_removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(F.col("id").alias("doc_id"), "n_bytes", n_removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op9_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-probabilities of all documents under the base model and the interpolated one."""
    found = ngram.score_texts(table(spark, sf_dir, "documents"), *ngram.by_crc(5, out=1, held=2))
    return found.select(F.col("id").alias("doc_id"), (crc_mod_col("id", 5) == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    found = html.extract_text(table(spark, sf_dir, "pages"), keep=("url",))
    return found.select(F.col("id").alias("page_id"), "url", "text", F.length("text").cast("long").alias("n_chars"))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that every document loses because one of a smaller id has them."""
    found = lines.dedup_lines(table(spark, sf_dir, "documents"), min_chars=10)
    return found.select(F.col("id").alias("doc_id"), "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding along the first four principal components, whitened."""
    found = whitening.whiten(table(spark, sf_dir, "embeddings"), components=4)
    return found.select(F.col("id").alias("vec_id"), "component", "n", "deviation", "whitened", "explained", "identity_error")


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding as eight indexes into learned codebooks."""
    found, books = codes.compress(table(spark, sf_dir, "embeddings"))
    return found.select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(codes.digest(books)).alias("codebooks_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_secret_scan, op2_simhash_near_dedup, op3_media_copies, op4_quality_classifier, op5_token_counts, op6_benchmark_decontamination, op7_byte_bpe, op8_suffix_array_dedup, op9_deleted_interpolation, op10_html_extraction, op11_line_dedup, op12_embedding_whitening, op13_vector_codes)}


def oracle_sql() -> dict[str, str]:
    return {"op6_benchmark_decontamination": oracles.DECONTAMINATION, "op11_line_dedup": oracles.LINES, "op13_vector_codes": oracles.CODES}
