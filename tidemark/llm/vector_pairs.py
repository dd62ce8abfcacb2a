"""Near-duplicate embeddings by product quantisation: inverted lists, residual codes, table-lookup distances, exact rerank."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, lean, power_of_two
from .components import connected_components

COSINE = 0.98
#: Rows that the index is fitted on at most; all rows are indexed and searched.
SAMPLE = 20_000
SUBSPACE, CODEWORDS = 8, 64
#: Vectors of one side of a block.
BLOCK = 512
_SLACK = 1e-6


def _kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 11) -> np.ndarray:
    rng = np.random.default_rng(seed)
    k = min(k, len(x))
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = (x @ c.T * -2 + (c * c).sum(1)).argmin(1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=k)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


class ProductIndex:
    """Coarse centroids and residual codebooks over unit vectors padded to one dimension."""

    def __init__(self, sample: np.ndarray, cells: int):
        self.coarse = _kmeans(sample, cells)
        near = (sample @ self.coarse.T * -2 + (self.coarse**2).sum(1)).argmin(1)
        rest = sample - self.coarse[near]
        parts = range(0, sample.shape[1], SUBSPACE)
        self.books = [_kmeans(np.ascontiguousarray(rest[:, p : p + SUBSPACE]), CODEWORDS) for p in parts]
        gaps = ((self.coarse[:, None] - self.coarse[None]) ** 2).sum(2)
        self.gaps = np.sqrt(np.maximum(gaps, 1e-12))

    def distances(self, x: np.ndarray) -> np.ndarray:
        return np.maximum((x * x).sum(1)[:, None] - 2 * x @ self.coarse.T + (self.coarse**2).sum(1), 0)

    def encode(self, x: np.ndarray, cell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes, and the distance from each residual to its code."""
        rest = x - self.coarse[cell]
        codes, error = np.zeros((len(x), len(self.books)), np.uint8), np.zeros(len(x))
        for m, book in enumerate(self.books):
            r = rest[:, m * SUBSPACE : (m + 1) * SUBSPACE]
            d = (r * r).sum(1)[:, None] - 2 * r @ book.T + (book**2).sum(1)
            codes[:, m] = d.argmin(1)
            error += ((r - book[codes[:, m]]) ** 2).sum(1)
        return codes, np.sqrt(error)

    def probes(self, x: np.ndarray, own: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) for each vector's own cell and for other cells in which a vector within ``radius`` can be, of two cells one way.

        A vector of another cell lies beyond the plane between the two centroids, so that plane is within the radius. That holds
        from both sides, so either may probe the other's cell: which does goes by the cells' numbers, to even the work.
        """
        d = self.distances(x)
        far = (d - d[np.arange(len(x)), own][:, None]) / (2 * self.gaps[own])
        cells = np.arange(d.shape[1])
        ours = (cells > own[:, None]) == ((cells + own[:, None]) % 2 == 0)
        return np.nonzero(((far <= radius + _SLACK) & ours) | (cells == own[:, None]))

    def table_distances(self, q: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        """Asymmetric distances from each query to each code of the cell."""
        rest = q - self.coarse[cell]
        out = np.zeros((len(q), len(codes)))
        for m, book in enumerate(self.books):
            r = rest[:, m * SUBSPACE : (m + 1) * SUBSPACE]
            table = (r * r).sum(1)[:, None] - 2 * r @ book.T + (book**2).sum(1)
            out += table[:, codes[:, m]]
        return np.sqrt(np.maximum(out, 0))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Vectors as doubles, padded with zeros."""
    x = np.zeros((len(column), dim))
    x[np.arange(dim) < pc.list_value_length(column).to_numpy(zero_copy_only=False)[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return x


def _unpacked(column, kind, dim: int) -> np.ndarray:
    """Vectors of one length from their bytes."""
    found = np.frombuffer(b"".join(column), kind).reshape(len(column), -1)
    x = np.zeros((len(column), dim))
    x[:, : found.shape[1]] = found
    return x


def _units(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1))[:, None]


def _members(index, dim: int, kind):
    """Each vector's cell, residual code and the code's error; its components as bytes."""
    index = index.value

    def run(batches):
        for batch in batches:
            if not len(batch):
                continue
            x = _matrix(batch.column(2), dim)
            unit = _units(x)
            own = index.distances(unit).argmin(1)
            codes, error = index.encode(unit, own)
            packed = [v[:n].tobytes() for v, n in zip(x.astype(kind), pc.list_value_length(batch.column(2)).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(packed, pa.binary()), batch.column(3), pa.array(own.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error)],
                names=["id", "part", "vector", "many", "cell", "code", "error"],
            )

    return run


def _queries(index, dim: int, kind, radius: float):
    """A row for each cell that a member probes; home: its own cell."""
    index = index.value

    def run(batches):
        for batch in batches:
            for at in range(0, len(batch), 1024):
                some = batch.slice(at, 1024)
                own, packed = some.column(4).to_numpy(), some.column(2).to_pylist()
                x = np.zeros((len(some), dim))
                for i, v in enumerate(packed):
                    v = np.frombuffer(v, kind)
                    x[i, : len(v)] = v
                rows, cells = index.probes(_units(x), own, radius)
                taken = some.select(["id", "part", "vector", "many"]).take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(cells.astype(np.int32)), pa.array(cells == own[rows])], names=["id", "part", "vector", "many", "cell", "home"])

    return run


def _compare(index, dim: int, kind, cosine: float, radius: float):
    def run(key, queries: pd.DataFrame, members: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"id": np.zeros(0, np.int64), "links": np.zeros(0, np.int64), "other": np.zeros(0, np.int64)})
        if not len(queries) or not len(members):
            return empty
        q, m = _unpacked(queries["vector"], kind, dim), _unpacked(members["vector"], kind, dim)
        q_norm, m_norm = np.sqrt((q * q).sum(1)), np.sqrt((m * m).sum(1))
        codes = np.stack([np.frombuffer(c, np.uint8) for c in members["code"]])
        far = index.value.table_distances(q / q_norm[:, None], int(key[1]), codes) - members["error"].to_numpy()
        qi, mi = queries["id"].to_numpy(), members["id"].to_numpy()
        home = queries["home"].to_numpy(bool)[:, None]
        # a code is within its error of its vector: what is farther can't be a link; each pair once, inside a cell from its smaller id
        rows, cols = np.nonzero((far <= radius + _SLACK) & ((qi[:, None] < mi) | (~home & (qi[:, None] > mi))))
        good = np.zeros((len(q), len(m)), bool)
        for at in range(0, len(rows), 200_000):
            r, c = rows[at : at + 200_000], cols[at : at + 200_000]
            good[r, c] = np.einsum("ij,ij->i", q[r], m[c]) / (q_norm[r] * m_norm[c]) >= cosine
        if not good.any():
            return empty
        n_q, n_m = good @ members["many"].to_numpy(), queries["many"].to_numpy() @ good
        # least label of what is reached inside the block
        label_q, label_m = qi.copy(), mi.copy()
        top = np.iinfo(np.int64).max
        while True:
            new_m = np.minimum(label_m, np.where(good, label_q[:, None], top).min(0))
            new_q = np.minimum(label_q, np.where(good, new_m[None], top).min(1))
            if (new_m == label_m).all() and (new_q == label_q).all():
                break
            label_q, label_m = new_q, new_m
        out = pd.DataFrame({"id": np.concatenate([qi, mi]), "links": np.concatenate([n_q, n_m]).astype(np.int64), "other": np.concatenate([label_q, label_m])})
        return out[out["links"] > 0]

    return run


def near_vectors(vectors: DataFrame, cosine: float = COSINE, sample: int = SAMPLE) -> DataFrame:
    """Links between vectors of one label with cosine >= ``cosine``, and the components that they make.

    Takes vec_id, embedding and label; ignores other columns. Returns (vec_id, n_links, component_id, kept), a row
    for each row. Null labels, null, empty or zero vectors and vectors with null or non-finite components link with nothing; only
    vectors of one length are compared. Equal vectors are one class, compared once and counted as many times
    as they occur. An empty table gives no rows.

    The index is fitted on ``sample`` rows at most, taken by hash of the vector; every row is indexed. Of two cells of which each
    can hold vectors within the threshold's distance of the other's, one's vectors probe the other; a query drops a member only if its code is farther than that by more
    than the code's error, so no link is lost but by rounding. Cells of a label are split in blocks of about BLOCK by BLOCK rows.
    """
    spark = vectors.sparkSession
    radius = float(np.sqrt(max(0.0, 2 - 2 * cosine)))
    of = vectors.schema["embedding"].dataType
    kind = np.float32 if isinstance(of, T.ArrayType) and isinstance(of.elementType, T.FloatType) else np.float64
    v = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("vector"), F.col("label").cast("string").alias("label"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    good = F.col("label").isNotNull() & F.col("vector").isNotNull() & finite & F.exists("vector", lambda x: x != 0)
    ids = v.select("vec_id")
    usable = v.where(F.coalesce(good, F.lit(False))).withColumn("vector", F.transform("vector", lambda x: x + 0.0))
    usable = usable.withColumn("part", F.concat_ws(":", F.size("vector").cast("string"), "label"))
    # equal vectors: the smallest id stands for them
    keyed = usable.withColumn("key", F.xxhash64("part", "vector"))
    classes = cut(keyed.groupBy("part", "key", "vector").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("many")), "vectors")
    count, dim = classes.agg(F.count(F.lit(1)), F.max(F.size("vector"))).first()
    if not count:
        return ids.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    dim = -(-dim // SUBSPACE) * SUBSPACE
    drawn = [r[0] for r in classes.orderBy(F.hash("vector"), "id").limit(sample).select("vector").collect()]
    fitted = ProductIndex(_units(_matrix(pa.array(drawn, pa.list_(pa.float64())), dim)), power_of_two(count**0.5 / 4, 8, 1024))
    index = spark.sparkContext.broadcast(fitted)

    base = classes.select("id", "part", "vector", "many")
    fields = "id long, part string, vector binary, many long, cell int"
    members = cut(base.mapInArrow(lean(_members(index, dim, kind)), fields + ", code binary, error double"), "members")
    queries = cut(members.mapInArrow(lean(_queries(index, dim, kind, radius)), fields + ", home boolean"), "queries")
    blocks = members.groupBy("part", "cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("m_blocks"))
    blocks = cut(blocks.join(queries.groupBy("part", "cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("q_blocks")), ["part", "cell"]), "blocks")

    def dealt(df: DataFrame, own: str, other: str) -> DataFrame:
        mine = F.pmod(F.xxhash64("id"), F.col(f"{own}_blocks")).alias(f"{own}_block")
        theirs = F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"{other}_blocks") - 1)).alias(f"{other}_block")
        return df.join(blocks, ["part", "cell"]).select(*df.columns, mine, theirs)

    keys = ["part", "cell", "q_block", "m_block"]
    found = cut(
        dealt(queries, "q", "m").groupBy(*keys).cogroup(dealt(members, "m", "q").groupBy(*keys))
        .applyInPandas(_compare(index, dim, kind, cosine, radius), "id long, links long, other long"), "found",
    )
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    reached = connected_components(found.where("id <> other"), "id", "other")
    classes = cut(
        classes.select("part", "key", "id", "many").join(links, "id", "left").join(reached, "id", "left")
        .select("part", "key", (F.coalesce("links", F.lit(0)) + F.col("many") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id")), "classes",
    )
    named = keyed.select("vec_id", "part", "key").join(classes, ["part", "key"]).select("vec_id", "n_links", "component_id")
    named = named.groupBy("vec_id").agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    out = ids.join(named, "vec_id", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))
