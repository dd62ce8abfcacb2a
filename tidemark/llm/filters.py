"""Bit filters of bounded size: which rows can have a partner in a large table."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import power_of_two

#: Bits of a filter at most: 2^19 rows of a place and a word of 64 bits, which is what a broadcast of it holds.
FILTER_BITS = 1 << 25


def mark_partners(df: DataFrame, key: str, ids: DataFrame, count: int) -> DataFrame:
    """``df`` with the boolean _maybe: false only where ``key`` (a 64-bit hash) is not among ``ids``, a one-column table of ``count`` rows.

    The filter's size is bounded, so its broadcast is too; with more ids than it has room for, more rows are marked
    without need, which costs time only. Rows with a null key are not marked.
    """
    bits = power_of_two(16 * count, 1 << 16, FILTER_BITS)
    name = ids.columns[0]
    slot = lambda c: F.shiftrightunsigned(F.pmod(F.col(c), F.lit(bits)), 6)
    words = (
        ids.select(slot(name).alias("_slot"), F.expr(f"shiftleft(1L, cast(pmod(`{name}`, 64) as int))").alias("_bit"))
        .groupBy("_slot").agg(F.bit_or("_bit").alias("_word"))
    )
    x = df.join(F.broadcast(words), slot(key) == F.col("_slot"), "left")
    found = F.expr(f"shiftrightunsigned(_word, cast(pmod(`{key}`, 64) as int)) & 1") == 1
    return x.withColumn("_maybe", F.coalesce(found, F.lit(False))).drop("_slot", "_word")


def _filter_bits(bits: int):
    """Bits of the ids, in parts of 8 KB."""

    def run(batches):
        mine = np.zeros(bits // 8, np.uint8)
        for batch in batches:
            x = batch.column(0).to_numpy().view(np.uint64) & np.uint64(bits - 1)
            np.bitwise_or.at(mine, (x >> np.uint64(3)).astype(np.int64), (1 << (x & np.uint64(7))).astype(np.uint8))
        parts = mine.reshape(-1, min(8192, len(mine)))
        full = np.flatnonzero(parts.any(axis=1))
        if len(full):
            yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array([parts[i].tobytes() for i in full], pa.binary())], names=["part", "bits"])

    return run


def _either(t: pa.Table) -> pa.Table:
    bits = np.bitwise_or.reduce([np.frombuffer(x, np.uint8) for x in t["bits"].to_pylist()])
    return pa.table({"part": t["part"].slice(0, 1), "bits": pa.array([bits.tobytes()], pa.binary())})


def bit_filter(ids: DataFrame, count: int) -> np.ndarray:
    """A bit filter of the ids: at most FILTER_BITS, so what reaches the driver is bounded; ids that it lets by in error cost time only."""
    bits = power_of_two(16 * count, 1 << 16, FILTER_BITS)
    parts = ids.mapInArrow(_filter_bits(bits), "part int, bits binary").groupBy("part").applyInArrow(_either, "part int, bits binary").collect()
    out = np.zeros(bits // 8, np.uint8)
    for part, data in parts:
        size = len(data)
        out[part * size : (part + 1) * size] = np.frombuffer(data, np.uint8)
    return out


def passes(bits: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Which of the 64-bit ids ``bit_filter`` lets by."""
    x = ids.view(np.uint64) & np.uint64(len(bits) * 8 - 1)
    return (bits[(x >> np.uint64(3)).astype(np.int64)] >> (x & np.uint64(7)).astype(np.uint8)) & 1 == 1
