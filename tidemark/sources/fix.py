"""Tag=value messages: framing, fields, outbound envelopes."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import fix_checksum, utc_stamp

SOH = "\x01"


def frame(buffer: Column) -> Column:
    """The whole messages of a buffer; one ends at the separator after its checksum field. A trailing fragment is left out."""
    return F.regexp_extract_all(buffer, F.lit("(?s)(.*?\\x0110=[^\\x01]*\\x01)"), F.lit(1))


#: One field: up to the next =, and its value up to the separator.
_FIELD = r"(?s)[^=]*=[^\x01]*\x01?"


def fields_of(message: Column) -> Column:
    """Tag to value; the last of equal tags wins, a tag is the whole number that stands first, fields without one are left out.

    One pass over the message: its fields, then one fold over them.
    """
    parts = F.transform(F.regexp_extract_all(message, F.lit(_FIELD), F.lit(0)), lambda p: F.struct(
        F.regexp_extract(p, r"^\s*([+-]?[0-9]+)", 1).try_cast("int").cast("string").alias("k"), F.regexp_extract(p, r"(?s)^[^=]*=([^\x01]*)", 1).alias("v")
    ))
    none = F.create_map().cast("map<string,string>")
    return F.aggregate(parts, none, lambda seen, p: F.when(p["k"].isNull(), seen).otherwise(F.map_concat(F.map_filter(seen, lambda k, _: k != p["k"]), F.create_map(p["k"], p["v"]))))


def tag(message: Column, number: int) -> Column:
    """The value of one tag as ``fields_of`` gives it, by one pattern; null where the message has none."""
    pattern = rf"^(?:[^=]*+=[^\x01]*+\x01)*\s*\+?0*{number}(?![0-9])[^=]*+(=[^\x01]*)"
    return F.substring(F.nullif(F.regexp_extract(message, pattern, 1), F.lit("")), 2, 1 << 30)


def number(value: Column) -> Column:
    """The finite decimal number that a string begins with; null without one."""
    x = F.nullif(F.regexp_extract(value, r"^\s*([+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?)", 1), F.lit("")).try_cast("double")
    return F.when(F.abs(x) < float("inf"), x)


def envelope(body: Column) -> Column:
    """The message around a body: version and length before, checksum after."""
    head = F.concat(F.lit(f"8=FIX.4.2{SOH}9="), F.octet_length(body).cast("string"), F.lit(SOH), body)
    return F.concat(head, F.lit("10="), fix_checksum(head), F.lit(SOH))


def read_messages(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """(feed, seq, message) of captured feeds, a file each; also as a stream over files that appear. Trailing fragments are left out."""
    from .captured import files

    return files(spark, path, stream).select("feed", F.posexplode(frame(F.col("body"))).alias("seq", "message"))


def logon(sender: Column, target: Column, ts: Column, seq: Column, heartbeat: int = 30) -> Column:
    return envelope(F.concat(F.lit("35=A"), *_header(sender, target, ts, seq), F.lit(f"98=0{SOH}108={heartbeat}{SOH}")))


def heartbeat(sender: Column, target: Column, ts: Column, seq: Column) -> Column:
    return envelope(F.concat(F.lit("35=0"), *_header(sender, target, ts, seq)))


def _header(sender: Column, target: Column, ts: Column, seq: Column) -> list[Column]:
    out = [F.lit(SOH)]
    for tag, value in ((49, sender), (56, target), (34, seq.cast("string")), (52, utc_stamp(ts))):
        out += [F.lit(f"{tag}="), value, F.lit(SOH)]
    return out


def net_positions(messages: DataFrame, key: str, order: str, message: str = "message") -> DataFrame:
    """(key, order, net_position) after each message that moves it: fills add, position reports set.

    Equal to a running state: each report starts a segment whose first change is the reported amount.
    """
    from pyspark.sql import Window as W

    # each tag by one pattern: no expression of the message is written twice
    tags = {n: f"_t{n}" for n in (35, 54, 32, 702, 703)}
    x = messages.select(F.col(key), F.col(order), *[tag(F.col(message), n).alias(c) for n, c in tags.items()])
    fill = number(F.col("_t32")) * F.when(F.col("_t54") == "1", 1).otherwise(-1)
    # a report with a field that is no number is ignored; one field alone will do
    part = lambda c: F.when(F.col(c).isNull(), F.lit(0.0)).otherwise(number(F.col(c)))
    report = F.when(F.coalesce("_t702", "_t703").isNotNull(), part("_t702") - part("_t703"))
    kind = F.col("_t35")
    delta = F.when(kind == "AP", report).when((kind == "8") & F.col("_t54").isNotNull(), fill)
    x = x.select(key, order, delta.alias("delta"), (kind == "AP").cast("int").alias("report"))
    # messages that move nothing leave after the windows: a filter before them would be pushed down and write the message's expressions anew
    x = x.withColumn("report", F.when(F.col("delta").isNotNull(), F.col("report")))
    upto = W.partitionBy(key).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    x = x.withColumn("segment", F.coalesce(F.sum("report").over(upto), F.lit(0)))
    within = W.partitionBy(key, "segment").orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return x.withColumn("net_position", F.sum("delta").over(within)).where("delta is not null").select(key, order, "net_position")


_TAG, _NUMBER = re.compile(r"[ \t\n\x0b\f\r]*([+-]?[0-9]+)"), re.compile(r"[ \t\n\x0b\f\r]*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)")
_SUM = b"\x0110="


def cut_frames(buffer: bytes) -> tuple[list[bytes], bytes]:
    """The whole messages of a buffer, as ``frame`` finds them, and the fragment behind them."""
    out, at = [], 0
    while (total := buffer.find(_SUM, at)) >= 0 and (end := buffer.find(b"\x01", total + len(_SUM))) >= 0:
        out.append(buffer[at : end + 1])
        at = end + 1
    return out, buffer[at:]


def position_step(net: float, message: str) -> float | None:
    """The net position after a message; null if it doesn't move it. One message's part in ``net_positions``."""
    tags = {}
    for field in re.findall(r"(?s)([^=]*)=([^\x01]*)\x01?", message):
        if name := _TAG.match(field[0]):
            tags[int(name[1])] = field[1]

    def amount(n):
        found = _NUMBER.match(tags[n]) if n in tags else None
        x = float(found[1]) if found else None
        return x if x is not None and abs(x) < float("inf") else None

    if tags.get(35) == "AP" and (702 in tags or 703 in tags):
        parts = [amount(n) if n in tags else 0.0 for n in (702, 703)]
        return None if None in parts else parts[0] - parts[1]
    if tags.get(35) == "8" and 54 in tags and (quantity := amount(32)) is not None:
        return net + (quantity if tags[54] == "1" else -quantity)
    return None
