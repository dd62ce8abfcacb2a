"""Helpers that the training-data operators share."""

from __future__ import annotations

import math
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


_own_dirs: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster; a temporary one only where none is configured (local runs)."""
    app = spark.sparkContext.applicationId
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = _own_dirs.setdefault(app, "") or "file://" + tempfile.mkdtemp(prefix="tidemark-")
        _own_dirs[app] = base
    return f"{base.rstrip('/')}/tidemark-{app}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: its lineage ends there.

    The files go when the session ends.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def lean(run):
    """``run`` for mapInArrow, after which the worker gives freed memory back: workers outlive their tasks."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def release() -> None:
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus_size(docs: DataFrame, text: str = "text") -> tuple[int, int]:
    """Rows and bytes of text, from one scan."""
    row = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()
    return int(row[0]), int(row[1])


def power_of_two(x: float, least: int = 1, most: int = 1 << 20) -> int:
    return max(least, min(most, 1 << max(0, math.ceil(math.log2(max(x, 1))))))


def ranked(df: DataFrame, keys: list[str], order: list[str], rows: int, group: int = 4000, weight: str | None = None) -> DataFrame:
    """Add ``rank``: 0-based place of each row within ``keys``, in the order of hash chunks and ``order`` in them.

    A key may hold most of the rows: each is split into hash chunks of about ``group`` rows, ranks
    are taken inside the chunks, and the chunks' sizes are prefix-summed. Equal rows rank in any order.
    """
    from pyspark.sql import Window as W

    chunks = max(1, -(-rows // group))
    parts = [*keys, "_chunk"]
    df = df.withColumn("_chunk", F.pmod(F.xxhash64(*[F.col(c) for c in order]), F.lit(chunks)))
    sizes = df.groupBy(*parts).agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(*keys).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = df.withColumn("_in", F.row_number().over(W.partitionBy(*parts).orderBy(*order)) - 1)
    on = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in parts]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    return (
        inside.alias("a").join(sizes.alias("b"), cond)
        .select(*[F.col(f"a.{c}") for c in df.columns if c != "_chunk"], (F.col("a._in") + F.col("b._before")).alias("rank"))
    )
