"""Hard negatives by a pivot table: inner products as distances in one more dimension, bracketed by the triangle inequality, exact for what is left."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, lean
from .dense import block_rows, deal, few_copies, finite, from_bytes, matrix, one_per_id, to_bytes

SCALE = 256
PIVOTS = 8
#: Rows that pivots are picked from at most; any pivots give the same results.
SAMPLE = 1_024
ANCHORS, MEMBERS = 1_024, 8_192
#: Squared length from which a vector's products may not fit a long.
LONGEST = float(1 << 62)
_LOW = np.iinfo(np.int64).min


class PivotTable:
    """Distances to pivots after one more component makes every row as long as the longest.

    A row x becomes (x, sqrt(M - |x|^2)) with M the largest squared length, a query q becomes (q, 0). Then the squared
    distance is |q|^2 + M - 2 q.x: the nearest row has the largest product, and bounds of distances are bounds of products.
    """

    def __init__(self, sample: np.ndarray, most: float, pivots: int):
        self.most = most
        x = sample.astype(float)
        taken = [int((x * x).sum(1).argmax())]
        gap = np.full(len(x), np.inf)
        while len(taken) < min(pivots, len(x)):
            gap = np.minimum(gap, self._between(x, x[taken[-1:]])[:, 0])
            if gap.max() <= 0:
                break
            taken.append(int(gap.argmax()))
        self.pivots = x[taken]

    def _last(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(self.most - (x * x).sum(1), 0))

    def _between(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        product = x @ y.T + self._last(x)[:, None] * self._last(y)
        return np.sqrt(np.maximum(2 * self.most - 2 * product, 0))

    def of_rows(self, x: np.ndarray) -> np.ndarray:
        return self._between(x, self.pivots)

    def of_queries(self, q: np.ndarray) -> np.ndarray:
        """Without the component that makes it long."""
        return np.sqrt(np.maximum((q * q).sum(1)[:, None] + self.most - 2 * q @ self.pivots.T, 0))

    def products(self, q: np.ndarray, distances: np.ndarray) -> np.ndarray:
        """Products that belong to distances from the queries."""
        return ((q * q).sum(1)[:, None] + self.most - distances**2) / 2

    def brackets(self, q: np.ndarray, to: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest product of each query and row; ``to`` and ``table`` are their distances to the pivots."""
        near, far = np.zeros((len(q), len(table))), np.full((len(q), len(table)), np.inf)
        for j in range(table.shape[1]):
            near = np.maximum(near, np.abs(to[:, j, None] - table[:, j]))
            far = np.minimum(far, to[:, j, None] + table[:, j])
        slack = 1e-6 * self.most + 1e-6
        return self.products(q, far) - slack, self.products(q, near) + slack

    def block_bounds(self, q: np.ndarray, to: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for whole blocks: no row of the table has a product outside of it."""
        low, high = table.min(0), table.max(0)
        near = np.maximum(np.maximum(to - high, low - to), 0).max(1)
        far = (to + high).min(1)
        slack = 1e-6 * self.most + 1e-6
        return self.products(q, far[:, None])[:, 0] - slack, self.products(q, near[:, None])[:, 0] + slack


def _whole(q: np.ndarray, x: np.ndarray, most: float) -> np.ndarray:
    """Exact integer products: sums below 2^53 are exact as doubles."""
    if most < float(1 << 53):
        return (q.astype(float) @ x.astype(float).T).astype(np.int64)
    return q.astype(np.int64) @ x.astype(np.int64).T


def _stored(table, dim: int, kind, scale: int):
    """Whole components as bytes, distances to the pivots, and the nearest one."""
    table = table.value

    def run(batches):
        for batch in batches:
            if len(batch):
                x = np.floor(scale * matrix(batch.column(1), dim))
                d = table.of_rows(x)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), to_bytes(x.astype(kind)), batch.column(2), batch.column(3), to_bytes(d.astype(np.float32)), pa.array(d.argmin(1).astype(np.int32))],
                    names=["id", "vector", "label", "anchor", "distances", "cell"],
                )

    return run


class _Block:
    """One block's anchors and rows, ids of rows ascending, copies beyond ``keep`` left out: smaller ids go before them."""

    def __init__(self, table: PivotTable, anchors: pd.DataFrame, members: pd.DataFrame, dim: int, kind, keep: int):
        packed, ids, labels = (members[c].to_numpy() for c in ("vector", "id", "label"))
        kept = few_copies(packed, ids, labels, keep)
        self.ids, self.labels, self.x = ids[kept], labels[kept], from_bytes(packed[kept], kind, dim)
        width = len(table.pivots)
        self.stored = from_bytes(members["distances"].to_numpy()[kept], np.float32, width).astype(float)
        self.q_ids, self.q = anchors["id"].to_numpy(), from_bytes(anchors["vector"].to_numpy(), kind, dim)
        self.table, self.wide = table, self.q.astype(float)
        self.to = table.of_queries(self.wide)

    def survivors(self, least: np.ndarray, most: np.ndarray):
        """(anchors, rows, products, which of them may lie between ``least`` and ``most``), a part of the anchors at a time."""
        low, high = self.table.block_bounds(self.wide, self.to, self.stored)
        open_ = np.nonzero((high >= least) & (low <= most))[0]
        step = max(16, (1 << 20) // max(1, len(self.x)))
        for at in range(0, len(open_), step):
            a = open_[at : at + step]
            low, high = self.table.brackets(self.wide[a], self.to[a], self.stored)
            may = (high >= least[a, None]) & (low <= most[a, None])
            a, may = a[may.any(1)], may[may.any(1)]
            rows = np.nonzero(may.any(0))[0] if len(a) else a
            if len(rows):
                yield a, rows, _whole(self.q[a], self.x[rows], self.table.most), may[:, rows]


def _top(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, place) of the ``k`` greatest of each row that aren't _LOW, smaller columns first among equals."""
    least = np.partition(scores, -k, axis=1)[:, -k] if scores.shape[1] > k else np.full(len(scores), _LOW)
    r, c = np.nonzero((scores >= least[:, None]) & (scores > _LOW))
    order = np.lexsort((c, -scores[r, c], r))
    r, c = r[order], c[order]
    place = np.arange(len(r)) - np.searchsorted(r, r)
    return r[place < k], c[place < k], place[place < k]


def _positives(table, dim: int, kind, k: int, home: bool):
    """The best rows of the anchors' label in a block. At home, where an anchor itself is, they give a floor that others must reach."""

    def run(key, anchors: pd.DataFrame, members: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"id": np.zeros(0, np.int64), "other": np.zeros(0, np.int64), "score": np.zeros(0, np.int64)})]
        if len(anchors) and len(members):
            b = _Block(table.value, anchors, members, dim, kind, k + 1)
            floor = np.full(len(b.q), -np.inf) if home else anchors["floor"].fillna(-np.inf).to_numpy(float)
            for a, rows, s, may in b.survivors(floor, np.full(len(b.q), np.inf)):
                s = np.where(may & (b.q_ids[a][:, None] != b.ids[rows]), s, _LOW)
                r, c, _ = _top(s, k)
                out.append(pd.DataFrame({"id": b.q_ids[a][r], "other": b.ids[rows][c], "score": s[r, c]}))
        return pd.concat(out)

    return run


def _window(scores: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Whole numbers n with low * score <= 100 * n <= high * score, without products that overflow: (least, greatest)."""
    whole, rest = np.divmod(scores, 100)
    return whole * low + -((-rest * low) // 100), whole * high + rest * high // 100


def _negatives(table, dim: int, kind, k: int, low: int, high: int):
    """For each positive of the anchors the best rows of other labels between its bounds."""

    def run(key, anchors: pd.DataFrame, members: pd.DataFrame) -> pd.DataFrame:
        names = ("anchor_id", "positive_id", "negative_id", "positive_score", "negative_score")
        out = [pd.DataFrame({n: np.zeros(0, np.int64) for n in names})]
        if len(anchors) and len(members):
            b = _Block(table.value, anchors, members, dim, kind, k)
            labels = anchors["label"].to_numpy()
            many = anchors["positives"].str.len().to_numpy()
            width = int(many.max())
            # bounds of each positive; where there is none, an empty range
            first, last = np.ones((len(b.q), width), np.int64), np.zeros((len(b.q), width), np.int64)
            for i, found in enumerate(anchors["positive_scores"]):
                first[i, : many[i]], last[i, : many[i]] = _window(np.asarray(found, np.int64), low, high)
            empty = first > last
            least = np.where(empty, np.inf, first).min(1)
            most = np.where(empty, -np.inf, last).max(1)
            for a, rows, s, may in b.survivors(least, most):
                s = np.where(may & (labels[a][:, None] != b.labels[rows]), s, _LOW)
                for j in range(width):
                    inside = np.where((s >= first[a, j, None]) & (s <= last[a, j, None]), s, _LOW)
                    some = np.nonzero((inside > _LOW).any(1) & (many[a] > j))[0]
                    r, c, _ = _top(inside[some], k)
                    at = a[some[r]]
                    out.append(pd.DataFrame({
                        "anchor_id": b.q_ids[at], "positive_id": np.array([anchors["positives"].iat[i][j] for i in at], np.int64), "negative_id": b.ids[rows][c],
                        "positive_score": np.array([anchors["positive_scores"].iat[i][j] for i in at], np.int64), "negative_score": inside[some[r], c],
                    }))
        return pd.concat(out)

    return run


def mine_negatives(vectors: DataFrame, anchors: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = SCALE, pivots: int = PIVOTS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score), exact.

    Takes vec_id, embedding and label, and what ``anchors`` reads; ignores other columns. A component x counts as floor(scale * x), a
    row's score is its integer inner product with the anchor; higher scores come first, among equal ones the smaller vec_id.
    Each anchor's positives are its first ``positives`` other rows of its label; for each of them come the first ``negatives`` rows of
    other labels with low * positive_score <= 100 * negative_score <= high * positive_score. A positive with a negative score has none.

    Rows with a null label, a null vector or a null or non-finite component take no part, nor do rows without vec_id and rows whose
    squared length in whole components may reach 2^62, since their scores need not fit a long. Empty vectors have scores of 0; vectors of
    different lengths are compared as if the shorter ended in zeros; of rows with one vec_id the one with the least vector, label
    counts. No anchors or no rows give no rows.

    A row's distances to the pivots are stored with it; brackets from the triangle inequality leave out blocks, then rows, that can't
    reach an anchor's floor or lie in its range, and all others are compared exactly. Where data have no structure the brackets leave out
    little and the work is that of all anchors with all rows, in blocks of bounded size.
    """
    spark = vectors.sparkSession
    v = vectors.select(
        F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("vector"), F.col("label").cast("string").alias("label"), F.coalesce(anchors, F.lit(False)).alias("anchor")
    )
    limit = F.lit(2.0**40)
    whole = F.transform("vector", lambda x: F.floor(F.greatest(-limit, F.least(limit, x * scale))).cast("double"))
    length = F.aggregate(whole, F.lit(0.0), lambda a, x: a + x * x)
    v = one_per_id(v.where(F.col("label").isNotNull() & finite(F.col("vector"))).where(length < LONGEST))
    biggest = F.max(F.coalesce(F.array_max(F.transform(whole, lambda x: F.abs(x))), F.lit(0.0)))
    count, dim, most, biggest = v.agg(F.count(F.lit(1)), F.max(F.size("vector")), F.max(length), biggest).first()
    nothing = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    if not count:
        return nothing
    dim = max(1, dim)
    kind = np.int16 if biggest < 1 << 15 else np.int32

    share = F.pmod(F.xxhash64(F.lit(3), "id"), F.lit(1 << 30)) < int(min(1.0, SAMPLE / count) * (1 << 30))
    picked = v.where(share).select("vector").limit(SAMPLE).toArrow()
    if not len(picked):
        picked = v.select("vector").limit(1).toArrow()
    table = spark.sparkContext.broadcast(PivotTable(np.floor(scale * matrix(picked.column(0).combine_chunks(), dim)), float(most), pivots))
    rows = cut(v.mapInArrow(lean(_stored(table, dim, kind, scale)), "id long, vector binary, label string, anchor boolean, distances binary, cell int"), "pivot-table")
    asked = rows.where("anchor").drop("anchor", "distances")
    n_asked = asked.count()
    if not n_asked:
        return nothing
    rows = rows.drop("anchor")
    q_rows, m_rows = block_rows(dim, ANCHORS), block_rows(dim, MEMBERS)

    # floors from the block in which an anchor is itself, then the blocks that can beat them
    sizes = rows.groupBy("label", "cell").agg(F.ceil(F.count(F.lit(1)) / m_rows).alias("m_blocks"))
    own = F.pmod(F.xxhash64("id"), F.col("m_blocks")).alias("m_block")
    chunk = lambda blocks, c: F.pmod(F.xxhash64(F.lit(7), "id"), blocks).alias(c)
    n_own = asked.groupBy("label").agg(F.ceil(F.count(F.lit(1)) / q_rows).alias("q_blocks"))
    blocks = cut(sizes.join(n_own, "label"), "label-blocks")
    placed = cut(asked.join(blocks, ["label", "cell"]).select(*asked.columns, own, chunk(F.col("q_blocks"), "q_block")), "placed")
    by_label = deal(rows, ["label", "cell"], blocks, "m", "q")
    keys = ["label", "cell", "m_block", "q_block"]
    schema = "id long, other long, score long"
    at_home = cut(placed.groupBy(*keys).cogroup(by_label.groupBy(*keys)).applyInPandas(_positives(table, dim, kind, positives, True), schema), "home")
    floors = at_home.groupBy("id").agg(F.when(F.count(F.lit(1)) >= positives, F.min("score")).alias("floor"))
    places = blocks.select("label", F.col("cell").alias("_cell"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("m_blocks") - 1)).alias("_block"))
    away = placed.join(floors, "id", "left").join(places, "label").where("cell <> _cell or m_block <> _block")
    away = away.select("id", "vector", "label", F.col("_cell").alias("cell"), F.col("_block").alias("m_block"), "q_block", "floor")
    elsewhere = away.groupBy(*keys).cogroup(by_label.groupBy(*keys)).applyInPandas(_positives(table, dim, kind, positives, False), schema)
    place = F.row_number().over(W.partitionBy("id").orderBy(F.desc("score"), "other"))
    best = at_home.unionByName(elsewhere).withColumn("place", place).where(F.col("place") <= positives)
    found = F.array_sort(F.collect_list(F.struct("place", "other", "score")))  # positives at most
    best = best.groupBy("id").agg(found.alias("p")).select("id", F.col("p.other").alias("positives"), F.col("p.score").alias("positive_scores"))
    ready = cut(asked.select("id", "vector", "label").join(best, "id"), "positives")
    # a row for each pivot
    n_blocks = rows.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / m_rows).alias("m_blocks")).collect()
    q_blocks = -(-n_asked // q_rows)
    each = F.explode(F.array(*[F.struct(F.lit(cell).alias("cell"), F.lit(n).cast("long").alias("n")) for cell, n in n_blocks]))
    sent = ready.withColumn("q_block", chunk(F.lit(q_blocks), "q_block")).select("*", each.alias("_to"))
    sent = sent.select(*ready.columns, "q_block", "_to.cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_to.n") - 1)).alias("m_block"))
    n_blocks = spark.createDataFrame([(cell, n, q_blocks) for cell, n in n_blocks], "cell int, m_blocks long, q_blocks long")
    keys = ["cell", "m_block", "q_block"]
    held = deal(rows, ["cell"], F.broadcast(n_blocks), "m", "q")
    out = "anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long"
    pairs = sent.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInPandas(_negatives(table, dim, kind, negatives, low, high), out)
    rank = F.row_number().over(W.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id"))
    pairs = pairs.withColumn("rank", rank).where(F.col("rank") <= negatives)
    return pairs.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
