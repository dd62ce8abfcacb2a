"""Streams over the test tables: keyed, ordered, with the events' lexicon and positions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lexicon import SCHEMA, contribution, lookup
from ..sources.positions import position_asof
from ..sources.tokens import tokenize, tokenize_turns

#: Weights of event types; views are not in the lexicon.
EVENT_WEIGHTS = [("error", -0.9, 0.9, 0.8, -0.7), ("purchase", 0.6, 0.85, 0.4, 0.8), ("signup", 0.6, 0.8, 0.6, 0.7), ("click", 0.3, 0.8, 0.8, 0.5)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_lexicon(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(EVENT_WEIGHTS, SCHEMA).coalesce(1)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, user_id, token, t_us, value."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", "user_id", F.col("event_type").alias("token"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t_us"), "value")


def weighted_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup(events(spark, sf_dir), event_lexicon(spark), bounded=True).select("*", *contribution())


def event_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views as position snapshots."""
    v = events(spark, sf_dir).where("token = 'view'")
    return v.select(
        "event_id", "user_id", ((F.col("value") - 50) / 100).alias("net_position"), F.lit(1.0).alias("position_limit"),
        (-F.col("value") / 10).alias("pnl"), F.lit(-10.0).alias("pnl_limit"),
    )


def positioned_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return position_asof(weighted_events(spark, sf_dir), event_positions(spark, sf_dir), "user_id", "event_id")


def document_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenize(table(spark, sf_dir, "documents"), "doc_id")


def conversation_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenize_turns(table(spark, sf_dir, "conversations"), "conv_id", "turn")


def latencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    return e.select("event_id", "user_id", "t_us", F.floor(F.col("value") * 100).cast("long").alias("latency_us"))


def order_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as tag=value messages: reports for P, buys for F, else sells; seq is their order in time per customer."""
    soh = F.lit("\x01")
    o = table(spark, sf_dir, "orders")
    amount = F.format_string("%.2f", F.col("o_totalprice"))
    body = F.when(F.col("o_orderstatus") == "P", F.concat(F.lit("35=AP"), soh, F.lit("702="), amount, soh, F.lit("703=0"), soh)).otherwise(
        F.concat(F.lit("35=8"), soh, F.lit("54="), F.when(F.col("o_orderstatus") == "F", "1").otherwise("2"), soh, F.lit("32="), amount, soh)
    )
    seq = F.struct(F.col("o_orderdate"), F.col("o_orderkey"))
    return o.select("o_custkey", "o_orderkey", seq.alias("seq"), body.alias("body"))
