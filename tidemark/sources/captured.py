"""Files of captured responses, a response each, in batch and as streams; and the feeds that give positions."""

from __future__ import annotations

from abc import ABC, abstractmethod

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def files(spark: SparkSession, path: str, stream: bool = False, max_files: int = 100) -> DataFrame:
    """(feed, ts, body): each file's name, time and whole content. A file is read as one row, so it holds one response or one feed's interval."""
    reader = spark.readStream.option("maxFilesPerTrigger", max_files) if stream else spark.read
    raw = reader.text(path, wholetext=True)
    return raw.select(F.col("_metadata.file_name").alias("feed"), F.col("_metadata.file_modification_time").alias("ts"), F.col("value").alias("body"))


def pieces(spark: SparkSession, path: str, stream: bool = False, max_files: int = 100) -> DataFrame:
    """(feed, part, body, t_us) of files ``<feed>/<part>`` under ``path``: bytes of a feed cut anywhere. A part's name begins with its number,
    from 0; its time is the file's."""
    reader = spark.readStream.option("maxFilesPerTrigger", max_files) if stream else spark.read
    schema = "path string, modificationTime timestamp, length long, content binary"
    raw = reader.format("binaryFile").schema(schema).option("recursiveFileLookup", True).load(path)
    names = F.split(F.col("path"), "/")
    part = F.regexp_extract(F.element_at(names, -1), "^([0-9]+)", 1).try_cast("long")
    x = raw.select(F.url_decode(F.element_at(names, -2)).alias("feed"), part.alias("part"), F.col("content").alias("body"), F.unix_micros("modificationTime").alias("t_us"))
    return x.where("part is not null")


class PositionFeed(ABC):
    """What gives positions over time: (key, order, position fields), for the as-of join or the stream."""

    @abstractmethod
    def positions(self, spark: SparkSession) -> DataFrame: ...


class CapturedBodies(PositionFeed):
    """Position bodies captured from a poll, a file each; files whose body lacks a number give no row."""

    def __init__(self, path: str, stream: bool = False):
        self.path, self.stream = path, stream

    def positions(self, spark: SparkSession) -> DataFrame:
        from .positions import FIELDS, parse_position

        x = files(spark, self.path, self.stream).select("feed", "ts", parse_position(F.col("body")).alias("p")).where("p.ok")
        return x.select("feed", "ts", *[F.col(f"p.{c}").alias(c) for c in FIELDS])


class CapturedMessages(PositionFeed):
    """Running positions of captured message feeds, with the limits given here and no profit or loss.

    Whole feeds, a file each; or with ``stream`` feeds that grow, files ``<feed>/<part>`` that may cut a message anywhere.
    """

    def __init__(self, path: str, position_limit: float = 1.0, pnl_limit: float = -10.0, stream: bool = False):
        self.path, self.position_limit, self.pnl_limit, self.stream = path, position_limit, pnl_limit, stream

    def positions(self, spark: SparkSession) -> DataFrame:
        from .fix import net_positions, read_messages

        limit, loss = F.lit(self.position_limit), F.lit(self.pnl_limit)
        if self.stream:
            from ..streaming.feeds import live_positions

            return live_positions(spark, self.path, limit, loss)
        x = net_positions(read_messages(spark, self.path), "feed", "seq")
        return x.select("feed", "seq", "net_position", limit.alias("position_limit"), F.lit(0.0).alias("pnl"), loss.alias("pnl_limit"))
