"""Token sources: text tables, text files, replayed lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import words


def tokenize(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, seq, token): the words of each row, numbered from 0. A null text has none."""
    return df.select(F.col(key), F.posexplode(words(F.col(text))).alias("seq", "token")).select(key, F.col("seq").cast("long").alias("seq"), "token")


def tokenize_turns(df: DataFrame, key: str, turn: str, text: str = "text") -> DataFrame:
    """(key, seq, token): words of each key's rows in the order of ``turn``, numbered from 0 within the key.

    Only the turns' word counts are summed over a window; words are numbered in their own rows.
    """
    from pyspark.sql import Window as W

    x = df.select(key, turn, words(F.coalesce(F.col(text), F.lit(""))).alias("w"))
    ahead = F.sum(F.size("w")).over(W.partitionBy(key).orderBy(turn).rowsBetween(W.unboundedPreceding, -1))
    x = x.withColumn("ahead", F.coalesce(ahead, F.lit(0)))
    return x.select(key, "ahead", F.posexplode("w").alias("pos", "token")).select(key, (F.col("ahead") + F.col("pos")).cast("long").alias("seq"), "token")


def read_token_file(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, pos, token) of text files; fails if there is no such file."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line"))
    return lines.select("file", "line", F.posexplode(words(F.col("value"))).alias("pos", "token"))


def replay(spark: SparkSession, tokens: list[str], n: int) -> DataFrame:
    """(seq, token): the list over and over, ``n`` rows from seq 0. An empty list gives no rows."""
    if not tokens:
        return spark.createDataFrame([], "seq long, token string")
    listed = F.array(*[F.lit(t) for t in tokens])
    return spark.range(n).select(F.col("id").alias("seq"), F.element_at(listed, (F.col("id") % len(tokens) + 1).cast("int")).alias("token"))


def replay_table(tokens: DataFrame, key: str, order: str, times: int, token: str = "token") -> DataFrame:
    """(key, seq, token): each key's tokens, numbered from 0 by ``order``, over and over, ``times`` in all."""
    sizes = tokens.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    x = tokens.join(sizes, key).withColumn("_round", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
    return x.select(key, (F.col("_round") * F.col("_n") + F.col(order)).alias("seq"), F.col(token).alias("token"))


def replay_stream(spark: SparkSession, tokens: list[str], rows_per_second: int) -> DataFrame:
    """The same as an unbounded stream with the time of each row."""
    listed = F.array(*[F.lit(t) for t in tokens])
    rate = spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load()
    return rate.select(F.col("value").alias("seq"), F.element_at(listed, (F.col("value") % len(tokens) + 1).cast("int")).alias("token"), F.col("timestamp").alias("ts"))
