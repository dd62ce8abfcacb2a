"""Nearest vectors by inner product over learned partitions: a balanced cut of a neighbour graph, a classifier that routes queries, exact rerank."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, lean, power_of_two, release
from .dense import block_rows, deal, few_copies, finite, from_bytes, inner_products, matrix, one_per_id, to_bytes

#: Rows that the partitions and the classifier are learned from at most, and numbers in them; all rows are indexed.
SAMPLE, SAMPLE_NUMBERS = 8_192, 1 << 24
#: Share of true neighbours that the probes of the tuning queries must hold, and how many such queries there are at most.
RECALL, TUNING = 0.95, 256
#: Neighbours of a node of the graph; how much over its share a partition may be when the graph is cut.
DEGREE, OVER = 16, 1.1
QUERIES, MEMBERS = 1_024, 8_192


def _directions(x: np.ndarray) -> np.ndarray:
    """Rows of length one; a query's order of candidates doesn't depend on its length."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1))[:, None]


def neighbour_graph(x: np.ndarray, degree: int) -> np.ndarray:
    """Indices of the rows with the largest inner products with each row, but itself."""
    out = []
    for at in range(0, len(x), 128):
        s = x[at : at + 128] @ x.T
        s[np.arange(len(s)), np.arange(at, at + len(s))] = -np.inf
        out.append(np.argpartition(-s, degree - 1, axis=1)[:, :degree])
    return np.concatenate(out)


def _halved(x: np.ndarray, parts: int, rng) -> np.ndarray:
    """Equal parts by halving along directions of large spread."""
    label = np.zeros(len(x), np.int64)
    todo = [(np.arange(len(x)), parts)]
    while todo:
        rows, n = todo.pop()
        if n == 1 or len(rows) < 2:
            continue
        c = x[rows] - x[rows].mean(0)
        along = rng.standard_normal(x.shape[1])
        for _ in range(5):
            along = c.T @ (c @ along) + 1e-12 * along
            along /= np.linalg.norm(along) or 1.0
        order = np.argsort(c @ along, kind="stable")
        low, high = rows[order[: len(rows) // 2]], rows[order[len(rows) // 2 :]]
        label[high] += n // 2
        todo += [(low, n // 2), (high, n // 2)]
    return label


def balanced_cut(near: np.ndarray, x: np.ndarray, parts: int, rounds: int = 30, seed: int = 5) -> np.ndarray:
    """A partition of each node: from equal halves, nodes move to where most of their neighbours are while there is room."""
    rng = np.random.default_rng(seed)
    part = _halved(x, parts, rng)
    n = len(near)
    ends = np.repeat(np.arange(n), near.shape[1]), near.ravel()
    u, v = np.concatenate(ends), np.concatenate(ends[::-1])
    room = int(np.ceil(n / parts * OVER))
    for _ in range(rounds):
        around = np.bincount(u * parts + part[v], minlength=n * parts).reshape(n, parts)
        best = around.argmax(1)
        gain = around[np.arange(n), best] - around[np.arange(n), part]
        # half of them at a time, or neighbours would swap places for ever
        movers = np.nonzero((gain > 0) & (rng.random(n) < 0.5))[0]
        size, moved = np.bincount(part, minlength=parts), False
        for i in movers[np.argsort(-gain[movers], kind="stable")].tolist():
            if size[best[i]] < room:
                size[part[i]] -= 1
                size[best[i]] += 1
                part[i], moved = best[i], True
        if not moved and not len(movers):
            break
    return part


class Router:
    """Multinomial logistic regression: in which partitions the neighbours of a vector are."""

    def __init__(self, x: np.ndarray, targets: np.ndarray, epochs: int = 40, seed: int = 3):
        rng = np.random.default_rng(seed)
        n, parts = targets.shape
        self.weights, self.bias = np.zeros((x.shape[1], parts)), np.zeros(parts)
        if parts == 1:
            return
        params = [self.weights, self.bias]
        first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        steps = epochs * -(-n // 256)
        for step in range(1, steps + 1):
            rows = rng.integers(0, n, min(n, 256))
            gap = (self.route(x[rows]) - targets[rows]) / len(rows)
            rate = 0.01 * (1 + np.cos(np.pi * step / steps))
            for p, g, a, b in zip(params, (x[rows].T @ gap + 1e-5 * self.weights, gap.sum(0)), first, second):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                p -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)

    def route(self, directions: np.ndarray) -> np.ndarray:
        """Probability of each partition."""
        z = directions @ self.weights + self.bias
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def before(self, directions: np.ndarray) -> np.ndarray:
        """Probability of the partitions that are likelier than each one: it is probed if that is under the mass to be probed."""
        p = self.route(directions)
        order = np.argsort(-p, axis=1, kind="stable")
        ranked = np.take_along_axis(p, order, 1)
        out = np.empty_like(p)
        np.put_along_axis(out, order, np.cumsum(ranked, 1) - ranked, 1)
        return out


def learn_partitions(x: np.ndarray, parts: int) -> Router:
    """Cut the neighbour graph of the rows of ``x``, and fit the router to where each row's neighbours are."""
    x = x / max(np.abs(x).max(), 1e-300)
    unit = _directions(x)
    near = neighbour_graph(x, min(DEGREE, len(x) - 1)) if parts > 1 else np.zeros((len(x), 0), np.int64)
    part = balanced_cut(near, unit, parts) if parts > 1 else np.zeros(len(x), np.int64)
    rows = np.repeat(np.arange(len(x)), near.shape[1] + 1)
    held = part[np.hstack([np.arange(len(x))[:, None], near])].ravel()
    targets = np.bincount(rows * parts + held, minlength=len(x) * parts).reshape(len(x), parts).astype(float)
    return Router(unit, targets / targets.sum(1, keepdims=True))


def _indexed(router, dim: int, kind):
    """Each vector's bytes and partition."""
    router = router.value

    def run(batches):
        for batch in batches:
            if len(batch):
                x = matrix(batch.column(1), dim)
                part = router.route(_directions(x)).argmax(1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0), to_bytes(x.astype(kind)), batch.column(2), pa.array(part)], names=["id", "vector", "asked", "part"])

    return run


def _best(q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, x_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, member row, score) of each query's ``k`` best, by score and id; ids of members ascend. Products that are no number are left out."""
    rows, cols, scores = [], [], []
    size = np.sqrt((q * q).sum(1)) * np.sqrt((x * x).sum(1).max(initial=0.0))
    step = max(16, (1 << 21) // max(1, len(x)))
    for at in range(0, len(q), step):
        s = q[at : at + step] @ x.T
        s[q_ids[at : at + step, None] == x_ids] = -np.inf
        s[np.isnan(s)] = -np.inf
        least = np.partition(s, -k, axis=1)[:, -k] if s.shape[1] > k else np.full(len(s), -np.inf)
        # fast products may differ in their last bits: what is near the k-th is compared exactly
        r, c = np.nonzero((s >= (least - 1e-9 * size[at : at + step])[:, None]) & (s > -np.inf))
        exact = np.concatenate([inner_products(q[at + r[i : i + 65536]], x[c[i : i + 65536]]) for i in range(0, len(r), 65536)] or [np.zeros(0)])
        order = np.lexsort((c, -exact, r))
        r, c, exact = r[order], c[order], exact[order]
        place = np.arange(len(r)) - np.searchsorted(r, r)
        rows.append(at + r[place < k])
        cols.append(c[place < k])
        scores.append(exact[place < k])
    return np.concatenate(rows), np.concatenate(cols), np.concatenate(scores)


def _tuned(queries, dim: int, kind, k: int):
    """The best members of the tuning queries in this task's rows: (query, part, score, id)."""
    q_ids, q = queries.value

    def run(batches):
        best = None
        for batch in batches:
            if not len(batch):
                continue
            ids, part = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            order = np.argsort(ids, kind="stable")
            x = from_bytes(batch.column(1).to_pylist(), kind, dim).astype(float)[order]
            r, c, s = _best(q, q_ids, x, ids[order], k)
            now = pd.DataFrame({"query": q_ids[r], "part": part[order][c], "score": s, "id": ids[order][c]})
            best = now if best is None else pd.concat([best, now])
            best = best.sort_values(["query", "score", "id"], ascending=[True, False, True]).groupby("query").head(k)
        if best is not None:
            yield pa.RecordBatch.from_pandas(best, preserve_index=False)

    return run


def _routed(router, dim: int, kind, mass: float):
    """A row for each partition that a query probes."""
    router = router.value

    def run(batches):
        for batch in batches:
            for at in range(0, len(batch), 1024):
                some = batch.slice(at, 1024)
                x = from_bytes(some.column(1).to_pylist(), kind, dim).astype(float)
                rows, parts = np.nonzero(router.before(_directions(x)) < mass)
                taken = some.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([taken.column(0), taken.column(1), pa.array(parts.astype(np.int32))], names=["id", "vector", "part"])

    return run


def _searched(dim: int, kind, k: int):
    def run(key, queries: pd.DataFrame, members: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(members):
            return pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})
        packed, ids = members["vector"].to_numpy(), members["id"].to_numpy()
        # of equal vectors only the least ids can be among the k nearest, one of them may be the query's own
        kept = few_copies(packed, ids, None, k + 1)
        x, ids = from_bytes(packed[kept], kind, dim).astype(float), ids[kept]
        q_ids = queries["id"].to_numpy()
        r, c, s = _best(from_bytes(queries["vector"].to_numpy(), kind, dim).astype(float), q_ids, x, ids, k)
        return pd.DataFrame({"query_id": q_ids[r], "vec_id": ids[c], "score": s})

    return run


def nearest(vectors: DataFrame, queries: Column, k: int = 20, recall: float = RECALL, sample: int = SAMPLE) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of ``vectors`` where ``queries`` holds, its ``k`` nearest among all other rows found.

    Takes vec_id and embedding, and what ``queries`` reads; ignores other columns. Nearness is the inner product in double precision on
    the vectors as given, summed in the order of their components; ties go to the smaller vec_id. Null, empty or zero vectors, vectors
    with null or non-finite components and rows without vec_id take no part; vectors of different lengths are compared as if the
    shorter ended in zeros; of rows with one vec_id the one with the least vector counts; pairs whose product is no number are left
    out. A table without usable queries or without candidates gives no rows.

    Partitions are learned from ``sample`` rows at most (fewer where they hold over SAMPLE_NUMBERS numbers), drawn by hash of vec_id: their
    neighbour graph is cut in balanced parts, and a classifier learns in which parts a vector's neighbours are. Every row is indexed, in
    the part that is likeliest for it. A query probes its likeliest parts until they hold a mass of probability; that mass is set so that
    the probes of at most TUNING queries, compared with every row, hold ``recall`` of their true neighbours. With a recall of 1
    all parts of some probability are probed. Parts are searched in blocks of bounded size, so none needs to fit in a task.
    """
    spark = vectors.sparkSession
    of = vectors.schema["embedding"].dataType
    kind = np.float32 if isinstance(of, T.ArrayType) and isinstance(of.elementType, T.FloatType) else np.float64
    v = vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("vector"), F.coalesce(queries, F.lit(False)).alias("asked"))
    v = one_per_id(v.where(finite(F.col("vector")) & F.exists("vector", lambda x: x != 0)).withColumn("vector", F.transform("vector", lambda x: x + 0.0)))
    count, dim = v.agg(F.count(F.lit(1)), F.max(F.size("vector"))).first()
    nothing = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not count:
        return nothing
    most = max(1, min(sample, SAMPLE_NUMBERS // dim))

    def drawn(rows: DataFrame, n: int, of: int, seed: int) -> pa.Table:
        """About ``n`` of the rows, by hash, and not more."""
        share = F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1 << 30)) < int(min(1.0, n / max(1, of)) * (1 << 30))
        return rows.where(share).select("id", "vector").limit(n).toArrow()

    x = np.unique(matrix(drawn(v, most, count, 1).column(1).combine_chunks(), dim), axis=0)
    if not len(x):
        x = matrix(v.select("id", "vector").limit(1).toArrow().column(1).combine_chunks(), dim)
    parts = min(power_of_two(count**0.5 / 8, 1, 256), max(1, 1 << (len(x) // 32).bit_length() >> 1))
    router = spark.sparkContext.broadcast(learn_partitions(x, parts))
    release()  # what the driver held to learn them
    members = cut(v.mapInArrow(lean(_indexed(router, dim, kind)), "id long, vector binary, asked boolean, part int"), "indexed")
    asked = members.where("asked")
    n_asked = asked.count()
    if not n_asked or count < 2:
        return nothing

    tried = drawn(asked, TUNING, n_asked, 2)
    if not len(tried):
        tried = asked.select("id", "vector").limit(1).toArrow()
    tried_ids, tried = tried.column(0).to_numpy(), from_bytes(tried.column(1).to_pylist(), kind, dim).astype(float)
    tuning = spark.sparkContext.broadcast((tried_ids, tried))
    true = members.select("id", "vector", "part").mapInArrow(lean(_tuned(tuning, dim, kind, k)), "query long, part int, score double, id long")
    true = true.withColumn("r", F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "id"))).where(F.col("r") <= k).select("query", "part").toPandas()
    before = router.value.before(_directions(tried))[pd.Index(tried_ids).get_indexer(true["query"]), true["part"].to_numpy()]
    needed = np.sort(before)[max(0, int(np.ceil(len(before) * recall)) - 1)] if len(before) else 1.0
    mass = float(np.nextafter(needed, 2.0))

    probes = cut(asked.select("id", "vector").mapInArrow(lean(_routed(router, dim, kind, mass)), "id long, vector binary, part int"), "probes")
    q_rows, m_rows = block_rows(dim, QUERIES), block_rows(dim, MEMBERS)
    n_q = probes.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / q_rows).alias("q_blocks"))
    n_m = members.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / m_rows).alias("m_blocks"))
    blocks = F.broadcast(cut(n_q.join(n_m, "part"), "blocks"))  # a row for each part, 256 at most

    keys = ["part", "q_block", "m_block"]
    found = (
        deal(probes, ["part"], blocks, "q", "m").groupBy(*keys).cogroup(deal(members.select("id", "vector", "part"), ["part"], blocks, "m", "q").groupBy(*keys))
        .applyInPandas(_searched(dim, kind, k), "query_id long, vec_id long, score double")
    )
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
