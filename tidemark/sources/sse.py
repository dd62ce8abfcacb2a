"""Captured event-stream responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .captured import files


def decode_sse(lines: DataFrame, key: str, order: str, line: str = "line") -> DataFrame:
    """(key, order, token) of captured response lines.

    Blank lines and chunk sizes go, ``data: `` lines stay, and a key's stream ends at its first ``[DONE]``; content is read as
    JSON, empty content is dropped.
    """
    text = F.col(line)
    data = lines.where(text.startswith("data: "))
    payload = F.trim(F.substring(text, F.lit(7), F.length(text)))
    done = F.max((payload == "[DONE]").cast("int")).over(W.partitionBy(key).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow))
    return (
        data.select(key, order, payload.alias("payload"), done.alias("done")).where("done = 0")
        .select(key, order, content(F.col("payload")).alias("token")).where("token <> ''")
    )


def content(payload: Column) -> Column:
    """The text that a line of an event stream adds."""
    return F.get_json_object(payload, "$.choices[0].delta.content")


class LineDecoder:
    """Payloads of a response whose bytes come in pieces: the same lines as ``decode_sse`` reads, with their numbers from 0."""

    def __init__(self, rest: bytes = b"", lines: int = 0, ended: bool = False):
        self.rest, self.lines, self.ended = rest, lines, ended

    def feed(self, body: bytes) -> list[tuple[int, str]]:
        if self.ended:
            return []
        *whole, self.rest = (self.rest + body).split(b"\n")
        out = []
        for line in whole:
            n, self.lines = self.lines, self.lines + 1
            if line.startswith(b"data: "):
                payload = line.removesuffix(b"\r")[6:].decode("utf8", "replace").strip(" ")
                if payload == "[DONE]":
                    self.ended, self.rest = True, b""
                    break
                out.append((n, payload))
        return out


def response_tokens(body: Column) -> Column:
    """Array of (n, token) of one whole response: the same rows as ``decode_sse``, without a window, so streams can use it."""
    lines = F.filter(F.transform(F.split(body, "\r?\n"), lambda x, i: F.struct(i.alias("n"), x.alias("line"))), lambda x: x["line"].startswith("data: "))
    parts = F.transform(lines, lambda x: F.struct(x["n"].alias("n"), F.trim(F.substring(x["line"], 7, 1 << 30)).alias("payload")))
    end = F.array_position(F.transform(parts, lambda x: x["payload"]), "[DONE]")
    before = F.slice(parts, F.lit(1), F.when(end > 0, end - 1).otherwise(F.size(parts)).cast("int"))
    tokens = F.transform(before, lambda x: F.struct(x["n"].alias("n"), F.get_json_object(x["payload"], "$.choices[0].delta.content").alias("token")))
    return F.filter(tokens, lambda x: x["token"] != "")


def read_responses(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """(feed, n, token) of captured responses, a file each; as a stream, files that appear go straight into the dataflow."""
    x = files(spark, path, stream).select("feed", F.explode(response_tokens(F.col("body"))).alias("t"))
    return x.select("feed", "t.n", "t.token")
