"""Exact Jaccard join of word-shingle sets: grouped prefix join."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import corpus_size, cut, lean, power_of_two
from .components import connected_components
from .filters import bit_filter, passes
from .hashing import mix, pieces, shingle_sets

WIDTH, PERCENT = 5, 75
#: The broadcast table of frequent shingles has at most so many rows of 8 bytes, see ``_frequent``.
MOST_FREQUENT = 1 << 20
#: A shingle of fewer documents is never taken as frequent.
LEAST_FREQUENT = 8
#: Posting lists of at most so many groups give all their pairs with counts.
SHORT = 12
#: Groups of a long list, least by as many hashes, that all others of it are first compared with.
PIVOTS = 4
#: Sets of a long list that are compared with each other before those still apart are.
CHUNK = 64


def _sizes_fit(n: str, m: str, percent: int) -> str:
    return f"100 * least({n}, {m}) >= {percent} * greatest({n}, {m})"


def _overlap_needed(n: str, m: str, percent: int) -> str:
    """Elements that two sets of these sizes have in common at least, if they reach the threshold."""
    return f"ceil({percent} * ({n} + {m}) / {100 + percent})"


def prefix_length(n: int, percent: int = PERCENT) -> int:
    """Of two sets that reach the threshold, the first so many elements of each, in one order, have one in common."""
    return n - (-(-percent * n // 100)) + 1


def _signature(a: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(a.tobytes()) - (1 << 63)


def _by_bucket(buckets: np.ndarray, *columns: np.ndarray):
    order = np.argsort(buckets, kind="stable")
    b = buckets[order]
    cuts = np.flatnonzero(np.diff(b)) + 1
    sorted_columns = [c[order] for c in columns]
    for lo, hi in zip([0, *cuts], [*cuts, len(b)]):
        if hi > lo:
            yield int(b[lo]), [c[lo:hi].tobytes() for c in sorted_columns]


def _sets(batches, width: int):
    """(batch of the other columns, sets) in pieces of bounded text; the text is the first column."""
    for batch in batches:
        for at, texts in pieces(batch.column(0)):
            yield batch.slice(at, len(texts)), shingle_sets(texts, width)


def _planes(sorted_low: np.ndarray) -> bytes:
    """The highest bytes first: of sorted numbers they repeat, and shuffle files shrink."""
    return sorted_low.astype(">u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view(">u4").ravel().astype(np.uint32)


def _census(bits: int, width: int):
    """Each bucket of hashes, packed: 32 bits of each that follow the bucket's ``bits``."""

    def run(batches):
        held, size = [], 0

        def flush():
            a = np.concatenate(held)
            b = (a >> np.uint64(64 - bits)).astype(np.uint16)
            low = ((a >> np.uint64(32 - bits)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            rows = [(bucket, [_planes(np.sort(np.frombuffer(data, np.uint32)))]) for bucket, (data,) in _by_bucket(b, low)]
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1][0] for r in rows], pa.binary())], names=["bucket", "packed"])

        for _, sets in _sets(batches, width):
            held += sets
            size += sum(map(len, sets))
            if size > 500_000:
                yield flush()
                held, size = [], 0
        if size:
            yield flush()

    return run


def _counted(t: pa.Table) -> pa.Table:
    low = np.concatenate([_from_planes(x) for x in t["packed"].to_pylist()])
    low, n = np.unique(low, return_counts=True)
    keep = n >= LEAST_FREQUENT
    key = (np.int64(t["bucket"][0].as_py()) << 32) + low[keep].astype(np.int64)
    return pa.table({"key": key, "df": n[keep].astype(np.int64)})


def _frequent(docs: DataFrame, bits: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The keys of frequent shingles and their numbers of documents, sorted by key; bounded.

    All shingles of all documents are counted. Frequent are those of at least so many documents, a power of two,
    that no more than MOST_FREQUENT are: the order of the prefixes only has to be the same for all documents,
    and what is rarer than that bound is ordered by hash.
    """
    counted = cut(
        docs.select("text").mapInArrow(lean(_census(bits, width)), "bucket int, packed binary").groupBy("bucket").applyInArrow(_counted, "key long, df long"), "frequent",
    )
    steps = counted.groupBy(F.floor(F.log2("df")).cast("int").alias("k")).agg(F.count(F.lit(1)).alias("n")).collect()
    by_step = {int(r[0]): int(r[1]) for r in steps}
    total, least = 0, max(by_step, default=0) + 1
    while least > LEAST_FREQUENT.bit_length() - 1 and total + by_step.get(least - 1, 0) <= MOST_FREQUENT:
        least -= 1
        total += by_step.get(least, 0)
    rows = counted.where(F.col("df") >= F.lit(1 << least)).toPandas()  # at most MOST_FREQUENT rows, counted above
    rows = rows.sort_values("key")
    return rows["key"].to_numpy(np.int64), rows["df"].to_numpy(np.int64)


def _prefixes(bits: int, width: int, percent: int, keys, dfs):
    """A row for each document: number of shingles, signatures of set and prefix, packed prefix keys, frequent ones last."""
    frequent, dfs = keys.value, dfs.value
    shift = np.uint64(32 - bits)

    def run(batches):
        for rest, sets in _sets(batches, width):
            out = [], [], [], []
            for s in sets:
                n = len(s)
                key = (s >> shift).astype(np.int64)
                if len(frequent) and n:
                    at = np.minimum(np.searchsorted(frequent, key), len(frequent) - 1)
                    df = np.where(frequent[at] == key, dfs[at], 0)
                    if df.any():
                        key = key[np.lexsort((s, df))]
                key = key[: prefix_length(n, percent) if n else 0]
                packed = (key & 0xFFFFFFFF).astype(np.uint32).tobytes() + (key >> 32).astype(np.uint16).tobytes()
                for col, v in zip(out, (n, _signature(s), xxhash.xxh3_64_intdigest(packed) - (1 << 63), packed)):
                    col.append(v)
            yield pa.RecordBatch.from_arrays(
                [rest.column(1), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.binary())],
                names=["doc_id", "n", "set_id", "prefix_id", "prefix"],
            )

    return run


def _unpacked(packed: bytes) -> np.ndarray:
    n = len(packed) // 6
    return (np.frombuffer(packed, np.uint16, n, 4 * n).astype(np.int64) << 32) + np.frombuffer(packed, np.uint32, n)


def _is_frequent(key: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    if not len(frequent):
        return np.zeros(len(key), bool)
    return frequent[np.minimum(np.searchsorted(frequent, key), len(frequent) - 1)] == key


def _placed(batch, wanted) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, group, size, place in the prefix) of the wanted keys of a batch of (group, size, prefix)."""
    out = [[np.zeros(0, np.int64)] for _ in range(4)]
    for g, n, packed in zip(*(batch.column(i).to_pylist() for i in range(3))):
        key = _unpacked(packed)
        at = np.flatnonzero(wanted(key))
        for col, v in zip(out, (key[at], np.full(len(at), g, np.int64), np.full(len(at), n, np.int64), at)):
            col.append(v)
    return tuple(map(np.concatenate, out))


def _postings(keys):
    """The rare keys of the groups' prefixes by bucket: packed low bits, groups, sizes and places in the prefix."""
    frequent = keys.value

    def run(batches):
        for batch in batches:
            key, ids, ns, at = _placed(batch, lambda k: ~_is_frequent(k, frequent))
            rows = list(_by_bucket((key >> 32).astype(np.uint16), (key & 0xFFFFFFFF).astype(np.uint32), ids, ns.astype(np.int32), at.astype(np.int32)))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int32()), *[pa.array([r[1][k] for r in rows], pa.binary()) for k in range(4)]], names=["bucket", "low", "ids", "ns", "ats"],
            )

    return run


def _lists(percent: int):
    """Of each bucket, rows (kind, a, b, c).

    Kind 0: pairs of the short lists with the number of keys they share there. Of long lists, kind 1: (list, group, place), kind 2: (group,
    0, its number of keys in long lists), kind 3: pairs with the list's pivots and of neighbours by size. Lists of the same groups are
    one, with the place of its first key.
    """

    def run(t: pa.Table) -> pa.Table:
        low, ids, ns, ats = (np.frombuffer(b"".join(t[c].to_pylist()), k) for c, k in (("low", np.uint32), ("ids", np.int64), ("ns", np.int32), ("ats", np.int32)))
        order = np.lexsort((ids, ns, low))
        low, ids, ns, ats = low[order], ids[order], ns[order].astype(np.int64), ats[order].astype(np.int64)
        cuts = np.flatnonzero(np.diff(low)) + 1
        starts, sizes = np.concatenate([[0], cuts]).astype(np.int64), np.diff(np.concatenate([[0], cuts, [len(low)]]))
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for k in range(2, SHORT + 1):
            at = starts[sizes == k][:, None] + np.arange(k)
            i, j = np.triu_indices(k, 1)
            near = 100 * ns[at[:, i]] >= percent * ns[at[:, j]]  # sizes ascend
            left.append(ids[at[:, i]][near])
            right.append(ids[at[:, j]][near])
        left, right = np.concatenate(left), np.concatenate(right)
        both, c = np.unique(np.stack([np.minimum(left, right), np.maximum(left, right)]), axis=1, return_counts=True)
        out = [(np.zeros(len(c), np.int32), both[0], both[1], c)]
        named: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        held = []
        for lo, k in zip(starts[sizes > SHORT], sizes[sizes > SHORT]):
            g, n, at = ids[lo : lo + k], ns[lo : lo + k], ats[lo : lo + k]
            held.append(g)
            name = _signature(g)
            if name in named:
                named[name] = g, np.minimum(named[name][1], at)
                continue
            named[name] = g, at
            x, y = _star(g, n, percent)
            out.append((np.full(len(x), 3, np.int32), np.minimum(x, y), np.maximum(x, y), np.ones(len(x), np.int64)))
        for name, (g, at) in named.items():
            out.append((np.ones(len(g), np.int32), np.full(len(g), name), g, at))
        if held:
            g, c = np.unique(np.concatenate(held), return_counts=True)
            out.append((np.full(len(g), 2, np.int32), g, np.zeros(len(g), np.int64), c))
        return pa.table({name: np.concatenate([np.asarray(x[k], np.int32 if k == 0 else np.int64) for x in out]) for k, name in enumerate(("kind", "a", "b", "c"))})

    return run


def _star(g: np.ndarray, n: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a list sorted by size: each with the list's pivots, and neighbours, where sizes allow a link."""
    near = 100 * n[:-1] >= percent * n[1:]
    left, right = [g[:-1][near]], [g[1:][near]]
    for salt in range(PIVOTS):
        p = int(np.argmin(mix(g.view(np.uint64) + np.uint64(salt))))
        star = (100 * np.minimum(n, n[p]) >= percent * np.maximum(n, n[p])) & (g != g[p])
        left.append(np.full(star.sum(), g[p]))
        right.append(g[star])
    return np.concatenate(left), np.concatenate(right)


def _frequent_postings(keys):
    frequent = keys.value

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in _placed(batch, lambda k: _is_frequent(k, frequent))], names=["list", "id", "n", "at"])

    return run


def _wanted_sets(width: int, wanted):
    bits = wanted.value

    def run(batches):
        for _, sets in _sets(batches, width):
            rows = []
            for s in sets:
                name = _signature(s)
                if len(s) and passes(bits, np.array([name], np.int64))[0]:
                    rows.append((name, s.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["set_id", "shingles"])

    return run


def _verified(percent: int):
    def run(batches):
        for batch in batches:
            ids = batch.select(["a", "b"])
            good = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(100 * both >= percent * (len(x) + len(y) - both))
            yield ids.filter(pa.array(good, pa.bool_()))

    return run


def _elements(batches):
    """A row for each element of the sets, which are the last column."""
    for batch in batches:
        sets = [np.frombuffer(x, np.int64) for x in batch.column(batch.num_columns - 1).to_pylist()]
        at = np.repeat(np.arange(len(sets)), list(map(len, sets)))
        rest = batch.select(range(batch.num_columns - 1)).take(pa.array(at))
        yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(np.concatenate([np.zeros(0, np.int64), *sets]))], names=[*rest.schema.names, "element"])


def pairs_of_families(members: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Pairs (a, b) of sets of a family that are in different components and may reach the threshold; no link is lost.

    ``members``: rows (family, side, leads, set_id, n, m, component). Pairs are of two sides, or within a family of one side; n is the size of
    the set, m that of the sets it is paired with. Sets that lead are compared before: with each other on two sides, with all others on one. Of sets with n and m elements that link, in any one order, one of the first n less the overlap needed plus
    one is shared. The order is by the number of the family's sets that hold an element, those of one component before all others: what a family
    has in common, as its prefix, comes last, so what is compared are sets that share what is rare in it, not all pairs.
    """
    ends = members.groupBy("family").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), (F.min("side") != F.max("side")).alias("two"))
    mixed = ends.where("lo <> hi").select("family", "two")
    some = members.join(mixed, "family").join(sets, "set_id").select("family", "two", "side", "leads", "set_id", "n", "m", "component", "shingles")
    elements = cut(some.mapInArrow(lean(_elements), "family long, two boolean, side int, leads boolean, set_id long, n long, m long, component long, element long"), "elements")
    held = elements.groupBy("family", "element").agg(F.count(F.lit(1)).alias("df"), F.min("component").alias("lo"), F.max("component").alias("hi"))
    held = held.where("lo <> hi").select("family", "element", "df")
    own = elements.join(held, ["family", "element"]).groupBy("family", "two", "side", "leads", "set_id", "n", "m", "component")
    own = own.agg(F.sort_array(F.collect_list(F.struct("df", "element"))).alias("e"))
    # the elements that one component holds stand before those listed
    first = F.expr(f"slice(e, 1, cast(greatest(n - {_overlap_needed('n', 'm', percent)} + 1 - (n - size(e)), 0) as int))")
    posted = cut(own.select("family", "two", "side", "leads", "set_id", "component", F.explode(first["element"]).alias("element")), "posted")
    x, y = (posted.select("family", "element", "two", *[F.col(c).alias(f"{c}{i}") for c in ("side", "leads", "set_id", "component")]) for i in (1, 2))
    new = "if(two, side1 <> side2 and not (leads1 and leads2), not (leads1 or leads2))"
    found = x.join(y, ["family", "element", "two"]).where(f"component1 <> component2 and set_id1 < set_id2 and {new}")
    return found.select(F.col("set_id1").alias("a"), F.col("set_id2").alias("b")).distinct()


def jaccard_components(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """Link documents whose shingle sets have at least ``percent`` in common, and find what links reach.

    Takes doc_id and text, ignores other columns. Returns (doc_id, n_shingles, set_id, component_id), a row for each
    row: size of its set, a name that equal sets share, and the smallest doc_id that links reach. Documents without words have
    no shingles and link with nothing: set_id is null, component_id their doc_id. Equal sets are one class, so copies are never paired, and
    repeated rows belong to their class. Ties do not matter: components depend on the links alone.

    Sets of one size whose prefixes are equal form a group, and only groups are posted. Short posting lists give all pairs with
    the number of keys shared; long ones first give pairs with a few pivots and between neighbours by size. Group pairs that
    can still reach the threshold are verified. What these links join needs no more pairs: then all
    other pairs of long lists that are in different components are expanded and verified, and of group pairs and groups those that a prefix join of their own
    lets through, so no link between components is lost.
    """
    spark = docs.sparkSession
    docs = docs.select("text", F.col("doc_id").cast("long"))
    _, size = corpus_size(docs)
    bits = power_of_two(size / 6 / 1_000_000, 64, 1 << 16).bit_length() - 1
    keys, dfs = map(spark.sparkContext.broadcast, _frequent(docs, bits, width))
    rows = cut(docs.mapInArrow(lean(_prefixes(bits, width, percent, keys, dfs)), "doc_id long, n long, set_id long, prefix_id long, prefix binary"), "prefixes")
    some = rows.where("n > 0")
    groups = cut(some.groupBy("n", "prefix_id").agg(F.min("set_id").alias("lead"), F.first("prefix").alias("prefix")), "groups")
    classes = some.groupBy("set_id").agg(F.first("n").alias("n"), F.first("prefix_id").alias("prefix_id"))
    classes = cut(classes.join(groups.select("n", "prefix_id", "lead"), ["n", "prefix_id"]).select("set_id", "n", "lead"), "classes")

    g = groups.select("lead", "n", "prefix")
    rare = (
        g.mapInArrow(lean(_postings(keys)), "bucket int, low binary, ids binary, ns binary, ats binary")
        .groupBy("bucket").applyInArrow(_lists(percent), "kind int, a long, b long, c long")
        .groupBy("kind", "a", "b").agg(F.when(F.col("kind") == 1, F.min("c")).otherwise(F.sum("c")).alias("c"))
    )
    rare = cut(rare, "rare")
    often = cut(g.mapInArrow(lean(_frequent_postings(keys)), "list long, id long, n long, at long"), "often")
    pivots = F.array(*[F.min_by(F.struct("id", "n"), F.struct(F.xxhash64("id", F.lit(k)), "id")) for k in range(PIVOTS)])
    first = often.groupBy("list").agg(F.array_distinct(pivots).alias("p"))
    first = cut(first.select("list", F.explode("p").alias("p")).select("list", F.col("p.id").alias("p"), F.col("p.n").alias("pn")), "first")
    stars = often.join(first, "list").where(f"id <> p and {_sizes_fit('n', 'pn', percent)}")
    shared = rare.where("kind = 0").select("a", "b", "c")
    # frequent keys of the same groups are one list, with the place of the first of them
    alike = often.groupBy("list").agg(F.xxhash64(F.count(F.lit(1)), F.sum(F.col("id").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("id"))).alias("alike"))
    merged = often.join(alike, "list").groupBy(F.col("alike").alias("list"), F.col("id").alias("lead")).agg(F.min("at").alias("at"))
    lists = rare.where("kind = 1").select(F.col("a").alias("list"), F.col("b").alias("lead"), F.col("c").alias("at")).union(merged)
    stars = rare.where("kind = 3").select("a", "b").union(stars.select(F.least("id", "p"), F.greatest("id", "p"))).distinct()
    # keys of each group's prefix in long lists: what the counts of short lists may miss
    long = rare.where("kind = 2").select(F.col("a").alias("lead"), "c").union(often.groupBy("id").agg(F.count(F.lit(1)).alias("c")))
    long = cut(groups.select("lead", "n").join(long.groupBy("lead").agg(F.sum("c").alias("long")), "lead", "left").select("lead", "n", F.coalesce("long", F.lit(0)).alias("long")), "long")

    def hopeful(pairs: DataFrame) -> DataFrame:
        """Pairs (a, b, c: keys shared in short lists) of groups that can still reach the threshold.

        Of two sets, what the one whose prefix ends first has in common with the other is in both prefixes or beyond its own.
        """
        x, y = (long.select(F.col("lead").alias(k), F.col("n").alias(f"n{k}"), F.col("long").alias(f"long{k}")) for k in "ab")
        beyond = f"greatest(ceil({percent} * na / 100), ceil({percent} * nb / 100)) - 1"
        need = _overlap_needed("na", "nb", percent)
        return pairs.join(x, "a").join(y, "b").where(f"{_sizes_fit('na', 'nb', percent)} and c + least(longa, longb) + {beyond} >= {need}").select("a", "b")

    counted = stars.join(shared, ["a", "b"], "left_anti").select("a", "b", F.lit(0).cast("long").alias("c"))
    pairs = cut(hopeful(shared.union(counted)), "pairs")
    within = classes.where("set_id <> lead").select(F.least("set_id", "lead").alias("a"), F.greatest("set_id", "lead").alias("b"))

    def sets_of(needed: DataFrame, have: DataFrame | None = None) -> DataFrame:
        """(set_id, shingles) of the classes, from their texts."""
        needed = needed.distinct() if have is None else needed.distinct().join(have, "set_id", "left_anti")
        needed = cut(needed, "needed")
        wanted = spark.sparkContext.broadcast(bit_filter(needed, needed.count()))
        found = docs.select("text").mapInArrow(lean(_wanted_sets(width, wanted)), "set_id long, shingles binary")
        return cut(found.groupBy("set_id").agg(F.first("shingles").alias("shingles")), "sets")

    def verify(p: DataFrame, sets: DataFrame) -> DataFrame:
        x, y = (sets.select(F.col("set_id").alias(k), F.col("shingles").alias(v)) for k, v in (("a", "x"), ("b", "y")))
        return p.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(lean(_verified(percent)), "a long, b long")

    one = lambda df: df.select(F.explode(F.array("a", "b")).alias("set_id"))
    sets = sets_of(one(pairs.union(within)))
    links = cut(verify(pairs.union(within), sets), "links")
    def classed(links: DataFrame) -> DataFrame:
        """(set_id, n, lead, component) of all classes."""
        reached = connected_components(links, "a", "b").withColumnRenamed("id", "set_id")
        return cut(classes.join(reached, "set_id", "left").select("set_id", "n", "lead", F.coalesce("component", "set_id").alias("component")), "classes")

    sizes = _sizes_fit("n1", "n2", percent)
    apart = f"component1 <> component2 and {sizes}"
    ends = [F.least("set_id1", "set_id2").alias("a"), F.greatest("set_id1", "set_id2").alias("b")]
    sides = lambda df, *more: [df.select(*more, *[F.col(k).alias(f"{k}{i}") for k in df.columns if k not in more]) for i in (1, 2)]

    def in_lists(c: DataFrame, some: DataFrame | None = None) -> DataFrame:
        """Pairs (a, b) of long lists in different components; of those of ``some``, only pairs that fall in one of the list's chunks."""
        # no set whose part from the key on is less than what a set of the least size that fits must share
        members = lists.join(c, "lead").where(f"n - at >= {_overlap_needed('n', f'ceil({percent} * n / 100)', percent)}")
        mixed = members.groupBy("list").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.ceil(F.count(F.lit(1)) / CHUNK).alias("chunks")).where("lo <> hi")
        members = members.join(cut(mixed.select("list", "chunks"), "mixed"), "list")
        keys = ["list"]
        if some is not None:
            members = members.join(some, "set_id", "left_semi").withColumn("chunk", F.pmod(F.xxhash64("set_id", "list"), F.col("chunks")))
            keys.append("chunk")
        left, right = sides(cut(members.drop("chunks"), "members"), *keys)
        # the first key that two linked sets share is in a list of both, and what they share follows it in both
        placed = f"least(n1 - at1, n2 - at2) >= {_overlap_needed('n1', 'n2', percent)}"
        found = left.join(right, keys).where(f"{apart} and set_id1 < set_id2 and {placed}").select("set_id1", "set_id2", "lead1", "lead2").distinct()
        found = cut(found, "of_lists")
        led = found.select(F.least("lead1", "lead2").alias("a"), F.greatest("lead1", "lead2").alias("b")).distinct().join(shared, ["a", "b"], "left").select("a", "b", F.coalesce("c", F.lit(0)).alias("c"))
        led = hopeful(led.where("a <> b"))
        return found.join(led, (F.least("lead1", "lead2") == F.col("a")) & (F.greatest("lead1", "lead2") == F.col("b"))).select(*ends)

    # families whose links are few: random pairs of their lists join most of them before all that are still apart are compared
    more = cut(in_lists(classed(links), sets.select("set_id")), "chunked")
    if more.limit(1).count():
        links = links.union(cut(verify(more, sets), "links"))
    c = classed(links)
    # families: groups of several sets, and group pairs with such a group
    crowded = cut(classes.where("set_id <> lead").select("lead").distinct(), "crowded")
    some_pairs = pairs.join(crowded.withColumnRenamed("lead", "a"), "a", "left_semi").union(pairs.join(crowded.withColumnRenamed("lead", "b"), "b", "left_semi").select("a", "b")).distinct()
    two = some_pairs.select(F.xxhash64("a", "b").alias("family"), F.explode(F.array(*[F.struct(F.lit(i).alias("side"), F.col(x).alias("lead"), F.col(y).alias("other")) for i, x, y in ((0, "a", "b"), (1, "b", "a"))])).alias("x")).select("family", "x.*")
    leads = (F.col("set_id") == F.col("lead")).alias("leads")
    other = groups.select(F.col("lead").alias("other"), F.col("n").alias("m"))
    of_pairs = two.join(other, "other").join(c, "lead").select("family", "side", leads, "set_id", "n", "m", "component")
    of_groups = c.join(crowded, "lead").select(F.col("lead").alias("family"), F.lit(0).alias("side"), leads, "set_id", "n", F.col("n").alias("m"), "component")
    more = cut(pairs_of_families(of_pairs.union(of_groups), sets, percent).union(in_lists(c)).distinct(), "more")
    if more.limit(1).count():
        have = sets
        other = sets_of(one(more), have.select("set_id"))
        links = links.union(cut(verify(more, have.union(other)), "links"))

    reached = cut(connected_components(links, "a", "b"), "reached")
    named = some.groupBy("set_id").agg(F.min("doc_id").alias("doc")).join(reached.withColumnRenamed("id", "set_id"), "set_id", "left")
    named = cut(named.select("set_id", "doc", F.coalesce("component", "set_id").alias("component")), "named")
    least = cut(named.groupBy("component").agg(F.min("doc").alias("component_id")), "least")
    named = cut(named.join(least, "component").select("set_id", "component_id"), "named")
    ids = rows.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("set_id")).alias("set_id"))
    return ids.join(named, "set_id", "left").select("doc_id", "n_shingles", "set_id", F.coalesce("component_id", "doc_id").alias("component_id"))
