"""Dense vectors as rows of bytes and matrices: what the vector searches share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Numbers in one side of a block, so that blocks of long vectors have fewer rows.
BLOCK_NUMBERS = 1 << 22


def finite(vector: Column) -> Column:
    """Whether a vector (array of doubles) is there and all its components are finite numbers."""
    return vector.isNotNull() & F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False))


def one_per_id(rows: DataFrame) -> DataFrame:
    """``rows`` (id, vector, more columns that can be ordered) without null ids, one row for each id: the least by the other columns.

    Vectors are shuffled only where an id does repeat.
    """
    rows = rows.where("id is not null")
    if rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        return rows
    others = [c for c in rows.columns if c != "id"]
    return rows.withColumn("_r", F.row_number().over(W.partitionBy("id").orderBy(*others))).where("_r = 1").drop("_r")


def block_rows(dim: int, most: int) -> int:
    return max(64, min(most, BLOCK_NUMBERS // max(1, dim)))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Arrays of doubles as rows, shorter ones padded with zeros."""
    x = np.zeros((len(column), dim))
    x[np.arange(dim) < pc.list_value_length(column).to_numpy(zero_copy_only=False)[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return x


def to_bytes(x: np.ndarray) -> pa.Array:
    """A binary column with the bytes of each row."""
    x = np.ascontiguousarray(x)
    ends = np.arange(len(x) + 1, dtype=np.int32) * (x.itemsize * x.shape[1])
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(x.tobytes())])


def from_bytes(column, kind, dim: int) -> np.ndarray:
    """Rows of ``kind`` from their bytes."""
    return np.frombuffer(b"".join(column), kind).reshape(len(column), dim)


def few_copies(vectors, ids: np.ndarray, more, keep: int) -> np.ndarray:
    """Indices by ascending id of rows of which at most ``keep - 1`` smaller ids have the same bytes and the same ``more``."""
    seen: dict = {}
    out = []
    for i in np.argsort(ids, kind="stable").tolist():
        k = vectors[i] if more is None else (vectors[i], more[i])
        n = seen[k] = seen.get(k, 0) + 1
        if n <= keep:
            out.append(i)
    return np.array(out, np.int64)


def inner_products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Row by row, summed component after component, so that equal pairs of vectors have equal products wherever they are computed."""
    out = np.zeros(len(q))
    for j in range(q.shape[1]):
        out += q[:, j] * x[:, j]
    return out


def deal(rows: DataFrame, keys: list[str], blocks: DataFrame, own: str, other: str) -> DataFrame:
    """``rows`` with its own block, by id, once for each block of the other side; blocks: (keys, q_blocks, m_blocks)."""
    mine = F.pmod(F.xxhash64("id"), F.col(f"{own}_blocks")).alias(f"{own}_block")
    theirs = F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"{other}_blocks") - 1)).alias(f"{other}_block")
    return rows.join(blocks, keys).select(*rows.columns, mine, theirs)
