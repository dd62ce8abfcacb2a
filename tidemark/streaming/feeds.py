"""Responses and messages that come in pieces: decoders that keep what is unfinished in the state store."""

from __future__ import annotations

import pickle

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import fix, sse
from ..sources.captured import pieces
from .ordered import Machine, run_ordered


#: Numbers of pieces that share a state entry while they wait.
BLOCK = 256


class _Pieces(Machine):
    """Pieces of a feed in the order of their numbers from 0, whatever order they arrive in; a piece that comes again is ignored."""

    def open(self, handle):
        self.early = handle.getMapState("early", "block long", "pieces binary")

    def begin(self, next: int, waiting: int):
        """``waiting``: how many pieces have come before their turn; without any the store is not asked."""
        self.next, self.waiting, self.blocks, self.changed = next, waiting, {}, set()

    def block(self, part: int) -> dict[int, tuple]:
        """Waiting pieces by number, those near ``part``: read once, written once a micro-batch."""
        at = part // BLOCK
        if at not in self.blocks:
            self.blocks[at] = pickle.loads(self.early.getValue((at,))[0]) if self.waiting and self.early.containsKey((at,)) else {}
        return self.blocks[at]

    def keep(self):
        for at in sorted(self.changed):
            if self.blocks[at]:
                self.early.updateValue((at,), (pickle.dumps(self.blocks[at], 5),))
            else:
                self.early.removeKey((at,))
        self.blocks, self.changed = {}, set()

    def take(self, row, take):
        """``take(body, t_us)`` of each piece whose turn it is."""
        part = row["part"]
        if part < self.next:
            return
        if part > self.next:
            pieces = self.block(part)
            self.waiting += part not in pieces
            pieces[part] = bytes(row["body"]), row["t_us"]
            self.changed.add(part // BLOCK)
            return
        yield from take(bytes(row["body"]), row["t_us"])
        self.next += 1
        while self.waiting and self.next in (pieces := self.block(self.next)):
            body, t = pieces.pop(self.next)
            self.changed.add(self.next // BLOCK)
            self.waiting -= 1
            yield from take(body, t)
            self.next += 1

    def late(self, row):
        # by number, not by order of arrival
        return self.step(row)


class _Response(_Pieces):
    state = "next long, waiting long, rest binary, lines long, ended boolean"
    output = "feed string, n long, payload string, t_us long"

    def start(self):
        self.begin(0, 0)
        self.decoder = sse.LineDecoder()

    def load(self, values):
        next, waiting, rest, lines, ended = values
        self.begin(next, waiting)
        self.decoder = sse.LineDecoder(bytes(rest), lines, ended)

    def dump(self):
        self.keep()
        d = self.decoder
        return self.next, self.waiting, d.rest, d.lines, d.ended

    def step(self, row):
        def taken(body, t):
            for n, payload in self.decoder.feed(body):
                yield row["feed"], n, payload, t

        return self.take(row, taken)


def response_stream(chunks: DataFrame) -> DataFrame:
    """(feed, n, token, t_us) of responses while they come, from (feed, part, body, t_us): the bytes of a response cut anywhere.

    Kept per response: the half line at the end, the number of lines so far and whether it has ended. Rows are those of ``decode_sse``
    over the whole response's lines, for any cut and order of arrival; a last line that no line feed ends is never read. A token has the
    time of the piece that ended its line. Goes straight into ``prepare`` and ``pipeline_stream``.
    """
    lines = run_ordered(chunks.select("feed", "part", "body", "t_us"), _Response(), ["feed"], ["part"])
    return lines.select("feed", "n", sse.content(F.col("payload")).alias("token"), "t_us").where("token <> ''")


class _Messages(_Pieces):
    state = "next long, waiting long, rest binary, messages long, net double"
    output = "feed string, seq long, message string, net_position double, t_us long"

    def start(self):
        self.begin(0, 0)
        self.rest, self.messages, self.net = b"", 0, 0.0

    def load(self, values):
        next, waiting, rest, self.messages, self.net = values
        self.begin(next, waiting)
        self.rest = bytes(rest)

    def dump(self):
        self.keep()
        return self.next, self.waiting, self.rest, self.messages, self.net

    def step(self, row):
        def taken(body, t):
            whole, self.rest = fix.cut_frames(self.rest + body)
            for m in whole:
                message = m.decode("utf8", "replace")
                moved = fix.position_step(self.net, message)
                self.net = self.net if moved is None else moved
                yield row["feed"], self.messages, message, moved, t
                self.messages += 1

        return self.take(row, taken)


def message_stream(chunks: DataFrame) -> DataFrame:
    """(feed, seq, message, net_position, t_us) of message feeds while they come, from (feed, part, body, t_us).

    Kept per feed: the unfinished message at the end, how many there were, and the net position. ``net_position`` is null where a
    message doesn't move it; else as ``net_positions`` gives it over the whole feed, however its bytes are cut and whenever they come.
    """
    return run_ordered(chunks.select("feed", "part", "body", "t_us"), _Messages(), ["feed"], ["part"])


def live_responses(spark: SparkSession, path: str, max_files: int = 100) -> DataFrame:
    """``response_stream`` over files ``<feed>/<part>`` that appear under ``path``."""
    return response_stream(pieces(spark, path, True, max_files))


def live_positions(spark: SparkSession, path: str, position_limit: Column, pnl_limit: Column, max_files: int = 100) -> DataFrame:
    """(feed, seq, t_us, position fields) after each message that moves a feed's position."""
    x = message_stream(pieces(spark, path, True, max_files)).where("net_position is not null")
    return x.select("feed", "seq", "t_us", "net_position", position_limit.alias("position_limit"), F.lit(0.0).alias("pnl"), pnl_limit.alias("pnl_limit"))
