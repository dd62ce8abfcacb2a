"""Merkle manifest of a table: a tree of hashes for each language, a tree over their roots, and a proof for each row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import LOWER, UPPER, cut

FANOUT = 8
#: Columns that a leaf holds, in this order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def row_hash(*values: Column) -> Column:
    """H of a row: each value as its UTF-8 byte count, a colon and the value, ``-`` for null; so no two rows spell the same bytes."""
    spelt = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in spelt]), 256)


def _numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """``df`` with i, the place of each row within its ``key`` in the order of ``order``, and n, the key's rows; as a written table.

    Rows are range-partitioned over (key, order), so a key may hold all rows: places are row numbers inside a key's part and the
    sizes of its parts before. Rows that are equal in ``order`` are told apart by where they were read, so they don't meet in one part.
    """
    placed = df.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange("key", *order, "_tie")
    placed = cut(placed.withColumn("_part", F.spark_partition_id()), name)
    sizes = placed.groupBy("key", "_part").agg(F.count(F.lit(1)).alias("_n"))
    whole = W.partitionBy("key")
    before = F.coalesce(F.sum("_n").over(whole.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("key", "_part", before.alias("_before"), F.sum("_n").over(whole).alias("n"))
    inside = F.row_number().over(W.partitionBy("key", "_part").orderBy(*order, "_tie")) - 1
    rows = placed.withColumn("_in", inside).join(sizes, ["key", "_part"])
    return cut(rows.select(*df.columns, (F.col("_in") + F.col("_before")).alias("i"), "n"), f"{name}-numbered")


def _levels(leaves: DataFrame, fanout: int, name: str) -> list[DataFrame]:
    """Written tables (key, i, n, hash, children) of the levels above ``leaves`` (key, i, n, hash); n: nodes of the key on the level.

    A key whose level has one node is at its root and goes no further up.
    """
    out, nodes = [], leaves
    most = leaves.agg(F.max("n")).first()[0] or 0
    while most > 1:
        runs = nodes.where("n > 1").groupBy("key", F.floor(F.col("i") / fanout).alias("i"), F.ceil(F.col("n") / fanout).alias("n"))
        children = F.transform(F.array_sort(F.collect_list(F.struct("i", "hash"))), lambda c: c["hash"])
        parents = runs.agg(children.alias("children"))
        nodes = cut(parents.select("key", "i", "n", F.sha2(F.array_join("children", ""), 256).alias("hash"), "children"), f"{name}-{len(out) + 1}")
        out.append(nodes)
        most = -(-most // fanout)
    return out


def _roots(leaves: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """(key, hash) of each key's root."""
    out = leaves.where("n = 1").select("key", "hash")
    for level in levels:
        out = out.unionByName(level.where("n = 1").select("key", "hash"))
    return out


def _siblings(children: Column, at: Column) -> Column:
    """The other nodes of a run, joined, left and right of the place ``at``."""
    left, right = F.slice(children, F.lit(1), at), F.slice(children, at + 2, F.size(children))
    return F.struct(F.array_join(left, "").alias("left"), F.array_join(right, "").alias("right"))


def _paths(levels: list[DataFrame], above: DataFrame, fanout: int) -> list[DataFrame]:
    """(key, i, kept columns of ``above``, path) of each level's nodes, lowest first: siblings on the way to the root, lowest first.

    ``above``: (key, path, more columns), what stands over each key's root. From the top level down, each level's runs are joined
    to the paths of their parents; so a path is made once for a run, not once for a row.
    """
    more = [c for c in above.columns if c not in ("key", "path")]
    out: list[DataFrame] = []
    for k in range(len(levels) - 1, -1, -1):
        here = levels[k].where("n = 1").select("key", "i").join(above, "key").select("key", "i", *more, "path")
        if out:
            runs = levels[k + 1].select("key", "i", "children").join(out[0], ["key", "i"])
            runs = runs.select("key", F.col("i").alias("_up"), *more, "path", "children", F.posexplode("children").alias("_at", "_child"))
            step = F.concat(F.array(_siblings(F.col("children"), F.col("_at"))), F.col("path"))
            here = here.unionByName(runs.select("key", (F.col("_up") * fanout + F.col("_at")).alias("i"), *more, step.alias("path")))
        out.insert(0, here)
    return out


def _to_leaves(leaves: DataFrame, levels: list[DataFrame], above: DataFrame, fanout: int) -> DataFrame:
    """``leaves`` with the columns of ``above``, path from the leaf itself on."""
    more = [c for c in above.columns if c not in ("key", "path")]
    own = [c for c in leaves.columns if c != "n"]
    alone = leaves.where("n = 1").join(above, "key").select(*own, *more, "path")
    if not levels:
        return alone
    runs = levels[0].select("key", "i", "children").join(_paths(levels, above, fanout)[0], ["key", "i"]).withColumnRenamed("i", "_up")
    x = leaves.where("n > 1").withColumn("_up", F.floor(F.col("i") / fanout)).join(runs, ["key", "_up"])
    step = _siblings(F.col("children"), (F.col("i") - F.col("_up") * fanout).cast("int"))
    return x.select(*own, *more, F.concat(F.array(step), F.col("path")).alias("path")).unionByName(alone)


class Manifest:
    """The trees of a table: leaves by language, levels up to each language's subroot, and the tree over the subroots.

    ``edited`` is an expression of the text, put in place of it where ``changed`` holds: what the proofs are tried on.
    """

    def __init__(self, docs: DataFrame, edited: Column | None = None, changed: Column | None = None, fanout: int = FANOUT):
        if fanout < 2:
            raise ValueError("a node has two children at least")
        self.fanout = fanout
        fields = [F.col(c) for c in FIELDS]
        other = F.lit(None).cast("string")
        if edited is not None:
            other = F.when(F.lit(True) if changed is None else changed, row_hash(*fields[:-1], edited))
        # null before all strings, which compare by their bytes
        key = F.when(F.col("lang").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col("lang")))
        rows = docs.select(key.alias("key"), "doc_id", row_hash(*fields).alias("hash"), other.alias("changed"))
        self.leaves = _numbered(rows, ["doc_id", "hash"], "leaves")
        self.levels = _levels(self.leaves, fanout, "level")
        roots = _roots(self.leaves, self.levels).select(F.lit("").alias("key"), F.col("key").alias("lang_key"), "hash")
        self.subroots = _numbered(roots, ["lang_key"], "subroots")
        self.top = _levels(self.subroots, fanout, "top")

    def nodes(self) -> DataFrame:
        """The manifest itself: (tree, lang, level, i, hash) of every node; tree: ``lang`` or ``top``, level 0: leaves or subroots."""
        lang = lambda c: F.when(F.col(c) != "", F.substring(F.col(c), 2, 1 << 30)).alias("lang")
        out = self.subroots.select(F.lit("top").alias("tree"), F.lit(None).cast("string").alias("lang"), F.lit(0).alias("level"), "i", "hash")
        for k, level in enumerate([self.leaves, *self.levels]):
            out = out.unionByName(level.select(F.lit("lang").alias("tree"), lang("key"), F.lit(k).alias("level"), "i", "hash"))
        for k, level in enumerate(self.top):
            out = out.unionByName(level.select(F.lit("top").alias("tree"), F.lit(None).cast("string").alias("lang"), F.lit(k + 1).alias("level"), "i", "hash"))
        return out

    def proofs(self) -> DataFrame:
        """(doc_id, leaf, changed, subroot, root, path) of each row; path: left and right siblings, from the leaf to the root."""
        root = _roots(self.subroots, self.top).select("key", F.col("hash").alias("root"), F.array().cast("array<struct<left:string,right:string>>").alias("path"))
        above = _to_leaves(self.subroots, self.top, root, self.fanout)
        above = above.select(F.col("lang_key").alias("key"), F.col("hash").alias("subroot"), "root", "path")
        x = _to_leaves(self.leaves, self.levels, above, self.fanout)
        return x.select("doc_id", F.col("hash").alias("leaf"), "changed", "subroot", "root", "path")


def fold_path(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings of its path give."""
    return F.aggregate(path, leaf, lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]), 256))


def verify_rows(docs: DataFrame, edited: Column | None = None, changed: Column | None = None, fanout: int = FANOUT) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified): every row's proof, tried on the row as it now is.

    Takes doc_id, source, lang, n_chars and text, any of them null, and ignores other columns. A leaf is the hash of those five
    values. Leaves of a language (null is one) ascend by doc_id, nulls first; repeated doc_ids by their leaves, so rows that are
    equal in all of them are equal leaves next to each other. ``fanout`` consecutive nodes make a node until one is left, the
    subroot; subroots by language, null first, make the root the same way. ``proof_sha256`` is the hash of the siblings from leaf
    to root. Where ``changed`` holds, ``folded_root`` is made from the row with ``edited`` as its text; ``verified`` says whether it
    is the root. One row alone is its own leaf, subroot and root with an empty proof. An empty table gives no rows.

    Memory: a run has ``fanout`` nodes; places are taken in range parts, so a language may hold all rows. Levels are written tables.
    """
    p = Manifest(docs, edited, changed, fanout).proofs()
    proof = F.sha2(F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), ""), 256)
    folded = fold_path(F.coalesce("changed", "leaf"), F.col("path"))
    x = p.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), folded.alias("folded_root"))
    return x.withColumn("verified", F.col("folded_root") == F.col("root"))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)
