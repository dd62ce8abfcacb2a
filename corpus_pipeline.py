"""A corpus pipeline of five stages, each over all that the one before kept.

All stages but the last return the columns of their input, extra ones included, whatever their names. Null and empty texts are
texts without words: they are not toxic, have no lines to lose, are in no group, and the mix takes none of their
words. Texts of any length are taken whole. Repeated rows: equal rows are scored alike, lose the same lines, and one of them stays in
the Jaccard join; the mix takes each as a row. Null doc_ids are documents of their own. Empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import cut, table
from tidemark.llm.line_dedup import dedup_lines
from tidemark.llm.mixing import take_mix
from tidemark.llm.ngram_join import jaccard_components
from tidemark.llm.packing import pack_documents
from tidemark.llm.queries import _fold
from tidemark.llm.toxicity import score_toxicity
from tidemark.session import ship

#: Documents of at least this score go.
TOXIC = 0.7


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the classifier rejects; null and empty texts have the score of texts without any vote and stay."""
    ship(spark)
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").where(_fold(3) != 1)
    # a column of the documents that is named score is set aside
    names = [f"kept_{c}" if c == "score" else c for c in docs.columns]
    scored = score_toxicity(docs.toDF(*names), labels).where(F.col("score") < TOXIC)
    return scored.select(*[F.col(f"`{n}`").alias(c) for n, c in zip(names, docs.columns)])


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove line runs that occur earlier; documents of which nothing stays go, n_chars is that of the text kept."""
    ship(spark)
    # columns that have the names of the operator's own are set aside
    names, own = docs.columns, ("n_lines", "n_removed")
    out = dedup_lines(docs.select(*[F.col(f"`{c}`").alias(f"kept_{c}" if c in own else c) for c in names]))
    out = out.where((F.col("n_removed") == 0) | (F.length(F.trim("text")) > 0))
    n_chars = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.select(*[n_chars.alias(c) if c == "n_chars" else F.col(f"`kept_{c}`").alias(c) if c in own else F.col(f"`{c}`") for c in names])


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group of near-duplicates, the one of the smallest doc_id, nulls last; of its ties that of the least hash, then the row whose JSON is least.

    Rows are told apart by doc_id and text, not by doc_id alone. Texts without words are in no group and stay.
    """
    ship(spark)
    key = F.xxhash64(F.col("doc_id").isNull(), "doc_id", "text")
    keyed = docs.select(key.alias("key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))  # columns of any name keep to themselves
    groups = jaccard_components(docs.select(key.alias("doc_id"), "text")).where("n_shingles > 0")
    groups = groups.groupBy(F.col("doc_id").alias("key")).agg(F.first("component_id").alias("component"), F.count(F.lit(1)).alias("n"))
    ids = keyed.groupBy("key").agg(F.min("row.doc_id").alias("doc_id"))
    members = cut(groups.join(ids, "key"), "members")
    first = F.min_by(F.struct("key", "n"), F.struct(F.col("doc_id").isNull(), "doc_id", "key"))
    chosen = cut(members.groupBy("component").agg(first.alias("x")).select("x.*"), "chosen")
    # chosen rows that occur once stay as they are; of those that repeat, the least is taken
    single = chosen.where("n = 1").select("key")
    kept = keyed.join(members.select("key").join(single, "key", "left_anti"), "key", "left_anti").select("row")
    repeats = keyed.join(chosen.where("n > 1").select("key"), "key", "left_semi")
    # as JSON, since rows with maps have no order
    least = repeats.groupBy("key").agg(F.min_by("row", F.to_json("row")).alias("row")).select("row")
    return kept.union(least).select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take each document as often as its source's target weight asks."""
    ship(spark)
    return take_mix(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the documents into sequences of token ids."""
    ship(spark)
    return pack_documents(docs)


STAGES = [("toxicity", toxicity), ("line dedup", line_dedup), ("n-gram Jaccard join", jaccard_join), ("mixing", mixing), ("packing", packing)]

#: Tokens, trained scores and fingerprints have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
