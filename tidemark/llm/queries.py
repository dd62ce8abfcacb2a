"""Queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .sql import ORACLES  # noqa: F401


def _fold(n: int):
    """Remainder of the checksum of doc_id as text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % n


def op1_brown_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .brown import class_scores

    return class_scores(table(spark, sf_dir, "documents"), _fold(7) == 2)


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import score_toxicity

    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").where(_fold(3) != 1)
    scored = score_toxicity(table(spark, sf_dir, "documents").select("doc_id", "text"), labels)
    return scored.select("doc_id", (_fold(3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import dedup_lines

    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_lines", "n_removed", "text")


def op5_vector_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .vector_pairs import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .parsing import parse_documents

    return parse_documents(table(spark, sf_dir, "documents"))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import scan_licenses

    return scan_licenses(table(spark, sf_dir, "documents"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import extract_pii

    return extract_pii(table(spark, sf_dir, "documents"))


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix_sources

    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"))


def op11_routed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .routed_search import nearest

    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .merkle import lower_ascii, verify_rows

    tampered = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    return verify_rows(table(spark, sf_dir, "documents"), lower_ascii(F.col("text")), tampered)


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .hard_negatives import mine_negatives

    v = table(spark, sf_dir, "embeddings")
    v = v.select("vec_id", "embedding", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"))
    return mine_negatives(v, F.col("vec_id") % 50 == 0)


def mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op9 returns but for the copies, which its offsets decide."""
    from .mixing import mix_sources

    x = mix_sources(table(spark, sf_dir, "documents"))
    return x.select("doc_id", "size", "source_size", F.round("target", 3).alias("target"))


def license_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op7 returns of its fixed phrases."""
    from .licenses import scan_licenses

    return scan_licenses(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def unigram_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op1 returns but for the class model's score, which needs no classes."""
    from .brown import base_scores

    x = base_scores(table(spark, sf_dir, "documents"), _fold(7) == 2)
    return x.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 6).alias("base_score"))


def pii_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op8 counts of its fixed patterns."""
    return op8_pii(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone")


QUERIES = {
    f.__name__: f
    for f in (
        op1_brown_scores, op2_jaccard_join, op3_toxicity, op4_line_dedup, op5_vector_pairs,
        op6_fingerprints, op7_licenses, op8_pii, op9_mix_sources, op10_pack, op11_routed_search, op12_merkle_manifest, op13_hard_negatives, mix_targets, license_phrases, unigram_scores, pii_counts,
    )
}
