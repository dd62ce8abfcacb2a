"""Routed search, hard negatives and the Merkle manifest against brute force and definitions."""

import hashlib
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import queries as Q
from tidemark.llm.common import table
from tidemark.llm.hard_negatives import PivotTable, mine_negatives
from tidemark.llm.merkle import FANOUT, FIELDS, Manifest, lower_ascii, verify_rows
from tidemark.llm.routed_search import balanced_cut, nearest, neighbour_graph

VECTORS = "vec_id long, embedding array<double>, label int"


def usable(v, zero_too=False):
    return v is not None and all(x is not None and math.isfinite(x) for x in v) and (zero_too or any(v))


def product(a, b):
    out = 0.0
    for x, y in zip(a, b):
        out += x * y
    return out


def brute_nearest(rows, queries, k):
    good = {i: v for i, v, *_ in rows if i is not None and usable(v)}
    return {q: sorted(((-product(good[q], v), i) for i, v in good.items() if i != q))[:k] for q in good if queries(q)}


def found_of(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return out


def clustered(n, dim, seed=1, copies=0):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((12, dim)) * 2
    x = centres[rng.integers(0, 12, n)] + rng.standard_normal((n, dim)) * 0.6
    x[n - copies :] = x[0]
    return [(i, [float(v) for v in x[i]], int(i % 4)) for i in range(n)]


@pytest.fixture(scope="module")
def vectors(spark, sf):
    return [tuple(r) for r in table(spark, sf, "embeddings").select("vec_id", "embedding", "label").collect()]


def recall(found, true):
    """Share of each query's true neighbours, by score so that ties count, that were found."""
    hits = sum(sum(s >= -true[q][-1][0] - 1e-12 for _, _, s in found.get(q, [])) for q in true if true[q])
    return hits / max(1, sum(len(t) for t in true.values()))


def test_search_query(spark, sf, vectors):
    found, true = found_of(Q.op11_routed_search(spark, sf)), brute_nearest(vectors, lambda q: q % 20 == 0, 20)
    assert set(found) == set(true) and recall(found, true) >= 0.9
    of = {i: v for i, v, _ in vectors}
    for q, got in found.items():
        assert [r for r, _, _ in got] == list(range(1, 21)) and q not in {i for _, i, _ in got} and len({i for _, i, _ in got}) == 20
        assert all(s == product(of[q], of[i]) for _, i, s in got)
        assert got == [(n + 1, i, s) for n, (_, i, s) in enumerate(sorted(got, key=lambda x: (-x[2], x[1])))]


def test_search_of_clusters_probes_few_and_finds_nearly_all(spark):
    rows = clustered(3_000, 16)
    df = spark.createDataFrame(rows, VECTORS)
    true = brute_nearest(rows, lambda q: q % 20 == 0, 10)
    assert recall(found_of(nearest(df, F.col("vec_id") % 20 == 0, 10)), true) >= 0.9
    assert recall(found_of(nearest(df, F.col("vec_id") % 20 == 0, 10, recall=1.0)), true) >= 0.98


def test_search_without_partitions_is_exact_and_ties_go_to_smaller_ids(spark):
    rows = clustered(60, 5, copies=30)  # half of the rows are copies of one
    found = found_of(nearest(spark.createDataFrame(rows, VECTORS).repartition(7), F.col("vec_id") % 10 == 0, 20))
    for q, t in brute_nearest(rows, lambda q: q % 10 == 0, 20).items():
        assert [(i, s) for _, i, s in found[q]] == [(i, -s) for s, i in t]


ODD = [
    (0, [1.0, 0.0], 1), (1, None, 1), (2, [0.0, 0.0], 1), (3, [1.0, None], 1), (4, [float("nan"), 1.0], 1), (5, [float("inf"), 1.0], 1),
    (6, [], 1), (7, [0.5, 0.5], None), (8, [2.0], 2), (9, [1e200, 1e200], 2), (None, [3.0, 3.0], 2), (10, [-1.0, 0.0, 4.0], 3), (20, [1.0, 0.0], 1), (20, [5.0, 0.0], 1),
]


def test_search_of_odd_rows(spark):
    df = spark.createDataFrame(ODD, VECTORS).withColumn("score", F.lit("clash")).withColumn("rank", F.lit("clash"))
    found = found_of(nearest(df, F.col("vec_id") % 10 == 0, 20))
    # of two rows with id 20 the least vector counts; shorter vectors end in zeros
    rows = [(i, v + [0.0] * (3 - len(v)) if v else v) for i, v, _ in ODD[:-1] if i is not None and (v is None or v)]
    assert {q: [i for _, i, _ in t] for q, t in found.items()} == {q: [i for _, i in t] for q, t in brute_nearest(rows, lambda q: q % 10 == 0, 20).items()}
    assert nearest(df.limit(0), F.lit(True)).count() == 0 and nearest(df.where("vec_id = 0"), F.lit(True)).count() == 0
    assert nearest(df, F.lit(None).cast("boolean")).count() == 0 and nearest(df.where("vec_id in (1, 2, 3)"), F.lit(True)).count() == 0


def test_cut_is_balanced_and_follows_the_graph():
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.standard_normal((100, 8)) + 6 * c for c in rng.standard_normal((8, 8))])
    part = balanced_cut(neighbour_graph(x / np.linalg.norm(x, axis=1)[:, None], 8), x, 8)
    assert np.bincount(part, minlength=8).max() <= math.ceil(100 * 1.1)


def brute_negatives(rows, positives=5, negatives=3, low=50, high=95):
    v = {i: ([math.floor(256 * x) for x in e], label) for i, e, label in rows if i is not None and label is not None and usable(e, True)}
    out = []
    for a, (x, label) in v.items():
        if a % 50:
            continue
        scores = sorted((-sum(p * q for p, q in zip(x, y)), b, other) for b, (y, other) in v.items() if b != a)
        for p, b, _ in [s for s in scores if s[2] == label][:positives]:
            fits = [(n, c) for n, c, other in scores if other != label and low * -p <= 100 * -n <= high * -p][:negatives]
            out += [(a, b, k + 1, c, -p, -n) for k, (n, c) in enumerate(fits)]
    return sorted(out)


def mined(df, **more):
    x = mine_negatives(df, F.col("vec_id") % 50 == 0, **more)
    return sorted(tuple(r) for r in x.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def test_negatives_query(spark, sf, vectors):
    rows = [(i, v, (label + 1) % 10 if i % 7 == 0 and label is not None else label) for i, v, label in vectors]
    got = Q.op13_hard_negatives(spark, sf)
    assert sorted(tuple(r) for r in got.collect()) == brute_negatives(rows) != []


@pytest.mark.parametrize("rows", [clustered(1_200, 8), clustered(900, 6, 5, copies=300)], ids=["clusters", "copies"])
def test_negatives_of_clusters(spark, rows, monkeypatch):
    from tidemark.llm import hard_negatives

    monkeypatch.setattr(hard_negatives, "MEMBERS", 64)  # many blocks, so that floors and brackets leave some out
    monkeypatch.setattr(hard_negatives, "ANCHORS", 4)
    assert mined(spark.createDataFrame(rows, VECTORS)) == brute_negatives(rows) != []


def test_negatives_of_large_and_odd_vectors(spark):
    big = [(50 * i, [1e6 * (i + 1), -3e5 * i], i % 2) for i in range(4)] + [(7 + i, [2e6 - i, 1e5 * i], i % 3) for i in range(20)]
    assert mined(spark.createDataFrame(big, VECTORS)) == brute_negatives(big) != []  # products beyond 2^53
    odd = [(i * 50 if i is not None else None, v, label) for i, v, label in ODD[:-1] if i != 9] + [(450, [1e200, 1.0], 2)]
    df = spark.createDataFrame(odd, VECTORS).withColumn("positives", F.lit("clash")).withColumn("cell", F.lit("clash"))
    rows = [(i, None if v is None else v + [0.0] * (3 - len(v)), label) for i, v, label in odd if i != 450]
    assert mined(df) == brute_negatives(rows)
    assert mined(df.limit(0)) == [] == mined(df.where("vec_id = 50")) == mined(df.where("vec_id = 0"))


def test_brackets_hold():
    rng = np.random.default_rng(4)
    x = np.floor(rng.standard_normal((300, 6)) * 100)
    q = np.floor(rng.standard_normal((40, 6)) * 100)
    t = PivotTable(x, float((x * x).sum(1).max()), 8)
    stored = t.of_rows(x).astype(np.float32).astype(float)
    low, high = t.brackets(q, t.of_queries(q), stored)
    true = q @ x.T
    assert (low <= true).all() and (true <= high).all()
    at = [int(np.flatnonzero((x == p).all(1))[0]) for p in t.pivots]  # of a pivot the distance is known
    assert (high - low)[:, at].max() < 1e-3 * np.abs(true).max()
    low, high = t.block_bounds(q, t.of_queries(q), stored)
    assert (low <= true.min(1)).all() and (true.max(1) <= high).all()


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def tree(nodes, fanout=FANOUT):
    """Root, and each node's levels of (siblings left, siblings right)."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, i in enumerate(at):
            lo = i // fanout * fanout
            paths[k].append(("".join(nodes[lo:i]), "".join(nodes[i + 1 : lo + fanout])))
        nodes = [H(*nodes[i : i + fanout]) for i in range(0, len(nodes), fanout)]
        at = [i // fanout for i in at]
    return nodes[0], paths


LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_manifest(rows, fanout=FANOUT):
    """rows: FIELDS each."""
    out, by_lang = [], {}
    for r in rows:
        by_lang.setdefault(r[2], []).append(r)
    trees = {}
    for lang, some in by_lang.items():
        some.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[lang] = some, *tree([leaf(r) for r in some], fanout)
    langs = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    root, tops = tree([trees[x][1] for x in langs], fanout)
    for lang, top in zip(langs, tops):
        some, sub, paths = trees[lang]
        for r, path in zip(some, paths):
            path = path + top
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            h = leaf((*r[:4], None if r[4] is None else r[4].translate(LOWER)) if tampered else r)
            for lo, hi in path:
                h = H(lo, h, hi)
            out.append((r[0], leaf(r), sub, root, H(*[x for s in path for x in s]), h, h == root))
    return sorted(out, key=repr)


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def verified(df, fanout=FANOUT):
    x = verify_rows(df, lower_ascii(F.col("text")), F.crc32(F.col("doc_id").cast("string")) % 3 == 0, fanout)
    return sorted((tuple(r) for r in x.select(*COLUMNS).collect()), key=repr)


def test_manifest_query(spark, sf):
    rows = [tuple(r) for r in table(spark, sf, "documents").select(*FIELDS).collect()]
    got = sorted((tuple(r) for r in Q.op12_merkle_manifest(spark, sf).select(*COLUMNS).collect()), key=repr)
    assert got == brute_manifest(rows) and {r[-1] for r in got} == {True, False}


DOCS = "doc_id long, source string, lang string, n_chars long, text string"


@pytest.mark.parametrize("rows,fanout", [
    ([(1, None, None, None, None)], 8),
    ([(i, "s", f"l{i}", i, "T") for i in range(70)], 8),
    ([(i, "é", None if i % 3 else "en", i, "A" * (i * 1000)) for i in range(20)], 2),
    ([(None, "a", "en", 1, "X"), (None, "a", "en", 1, "X"), (None, "b", "en", 1, "X"), (3, "a", "en", 2, ""), (3, "a", "en", 2, ""), (3, "a", "en", 2, "B"), (6, "-", "", 0, "-"), (6, "1:-", "é", -5, None)], 3),
    ([(7, "s", "en", 1, "Same")] * 600 + [(8, "s", "de", 1, "Other")], 8),
], ids=["one", "many languages", "long texts", "ties and nulls", "repeated rows"])
def test_manifest_of_odd_rows(spark, rows, fanout):
    df = spark.createDataFrame(rows, DOCS).withColumn("key", F.lit("clash")).withColumn("i", F.lit("clash")).withColumn("hash", F.lit(1)).repartition(5)
    assert verified(df, fanout) == brute_manifest(rows, fanout)


def test_manifest_of_nothing_and_its_nodes(spark, sf):
    docs = table(spark, sf, "documents")
    assert verified(docs.limit(0)) == []
    m = Manifest(docs)
    nodes = m.nodes().collect()
    n = docs.count()
    assert sum(r.tree == "lang" and r.level == 0 for r in nodes) == n and len({(r.tree, r.lang, r.level, r.i) for r in nodes}) == len(nodes)
    root = next(r.hash for r in nodes if r.tree == "top" and r.level == max(x.level for x in nodes if x.tree == "top"))
    assert {r.root for r in verify_rows(docs).select("root").collect()} == {root} and verify_rows(docs).where("not verified").count() == 0
    with pytest.raises(ValueError, match="two children"):
        Manifest(docs, fanout=1)
