"""The training-data operators against brute force on small tables."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import queries as Q
from tidemark.llm.common import table

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ODD = [
    (1, "one two three four five six seven", "en", "a"),
    (1, "one two three four five six seven", "en", "a"),
    (2, None, "en", None),
    (3, "", None, "a"),
    (4, "One  TWO three\tfour five six seven", "en", "b"),
    (5, "short", "en", "b"),
    (6, "word " * 30_000, "en", "a"),
    (7, " \n \n", "en", "a"),
    (8, "you stupid idiot\n\nyou worthless clown é日本🙂", "en", "c"),
    (None, "no id here", "en", "c"),
]


def words(t):
    return WORD.findall((t or "").translate(LOWER))


@pytest.fixture(scope="module")
def docs(spark, sf):
    return table(spark, sf, "documents")


@pytest.fixture(scope="module")
def texts(docs):
    return {r[0]: r[1] for r in docs.select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def odd(spark):
    from pyspark.sql import functions as F

    d = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string")
    return d.withColumn("n_chars", F.length("text").cast("long")).withColumn("score", F.lit("clash")).withColumn("rank", F.lit(1)).withColumn("n_lines", F.lit("clash"))


def rows(df):
    return [r.asDict() for r in df.collect()]


def components(ids, links):
    parent = {i: i for i in ids}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def shingles(t):
    w = words(t)
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute_jaccard(texts):
    sets = {i: shingles(t) for i, t in texts.items()}
    of = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            of[x].append(i)
    common = Counter((a, b) for ids in of.values() for a in ids for b in ids if a < b)
    links = [(a, b) for (a, b), n in common.items() if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n)]
    return sets, components(texts, links)


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_sql(spark, sf, name):
    """Rows against DuckDB where SQL expresses the query."""
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    expect = con.execute(Q.ORACLES[name])
    names = [d[0] for d in expect.description]
    assert Counter(tuple(r[c] for c in names) for r in rows(Q.QUERIES[name](spark, sf))) == Counter(expect.fetchall())


def test_scores(spark, sf, texts):
    got = {r["doc_id"]: r for r in rows(Q.op1_brown_scores(spark, sf))}
    counts, total = Counter(), 0
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    for i, t in texts.items():
        if not held[i]:
            counts.update([*words(t), None])
    n, v = sum(counts.values()), len(counts)
    for i, t in texts.items():
        tokens = [*words(t), None]
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(tokens), sum(counts[w] > 0 for w in tokens), n)
        assert math.isclose(r["base_score"], sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens), rel_tol=1e-9)
    out = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)


def test_exchange_finds_alternation():
    from tidemark.llm.brown import exchange

    c = np.zeros((8, 8))
    c[np.ix_([0, 1, 2], [3, 4, 5])] = 10
    c[np.ix_([3, 4, 5], [0, 1, 2])] = 10
    own = exchange(c, 4)
    assert len({own[0], own[1], own[2]}) == 1 and len({own[3], own[4], own[5]}) == 1 and own[0] != own[3]


def plain_likelihood(bigrams, cls):
    """sum f(N(c, d)) - sum f(N(c)) - sum f(N(d)) from the bigrams themselves."""
    both, first, second = Counter(), Counter(), Counter()
    for (a, b), n in bigrams.items():
        both[cls[a], cls[b]] += n
        first[cls[a]] += n
        second[cls[b]] += n
    f = lambda counts: sum(n * math.log(n) for n in counts.values())
    return f(both) - f(first) - f(second)


def test_exchange_of_core(spark):
    """Each round's table and every gain by definition; at the end no word has a move that gains."""
    from tidemark.llm.brown import END, REST, best_move, exchange_core

    draw = np.random.default_rng(5)
    core, classes = 30, 6
    kinds = draw.integers(0, 4, core)
    chain = []
    for _ in range(4000):
        pool = np.flatnonzero(kinds == (kinds[chain[-1]] + 1) % 4) if chain and chain[-1] < core and draw.random() < 0.9 else np.arange(core + 2)
        chain.append(int(draw.choice(pool)) if len(pool) else core)
    bigrams = Counter(zip(chain, chain[1:]))
    m = core + 2
    pairs = spark.createDataFrame([(a * m + b, n) for (a, b), n in bigrams.items()], "pair long, n long")
    order = np.argsort(-np.bincount(chain, minlength=m)[:core], kind="stable")
    own, found = exchange_core(pairs, order, classes, seeds=8, rounds=60, least_gain=0.0)
    assert own[core] == REST and own[core + 1] == END and END not in own[:core]
    expect = np.zeros((classes, classes))
    for (a, b), n in bigrams.items():
        expect[own[a], own[b]] += n
    assert (found == expect).all()
    here = plain_likelihood(bigrams, own)
    for w in range(core):
        right, left = np.zeros(classes), np.zeros(classes)
        for (a, b), n in bigrams.items():
            if a == w != b:
                right[own[b]] += n
            if b == w != a:
                left[own[a]] += n
        best, gain = best_move(found.copy(), own[w], right, left, bigrams[w, w])
        moved = {c: plain_likelihood(bigrams, [*own[:w], c, *own[w + 1 :]]) - here for c in range(2, classes)}
        assert math.isclose(gain, max(moved.values()), abs_tol=1e-6) and math.isclose(moved[best], gain, abs_tol=1e-6)
        assert gain < 1e-6


def test_exchange_as_it_runs(spark, sf):
    """With the settings of the query: what the early end leaves is under two thousandths of the likelihood that rounds to the end reach."""
    from pyspark.sql import functions as F

    from tidemark.llm import brown

    docs = table(spark, sf, "documents")
    reached = []
    for least_gain, rounds in ((brown.LEAST_GAIN, brown.ROUNDS), (0.0, 60)):
        train = docs.where(F.crc32(F.col("doc_id").cast("string")) % 7 != 2).select("text")
        counts = train.mapInArrow(brown._word_counts, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("word") != -1)
        top = counts.orderBy(F.desc("n"), "word").limit(800).collect()
        core = np.array(sorted(r[0] for r in top), np.int64)
        n_of = {r[0]: r[1] for r in top}
        pairs = train.mapInArrow(brown._core_pairs(spark.sparkContext.broadcast(core)), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).persist()
        order = np.argsort([-n_of[w] for w in core.tolist()], kind="stable").astype(np.int64)
        own, found = brown.exchange_core(pairs, order, 64, seeds=200, rounds=rounds, least_gain=least_gain)
        assert set(own[: len(core)]) <= {brown.REST, *range(2, 64)} and brown.END not in own[: len(core)]
        reached.append(brown.likelihood(found) / found.sum())
    assert reached[0] <= reached[1] + 1e-9 and reached[1] - reached[0] < 0.002 * abs(reached[1])


def test_scores_of_rarer_words(spark):
    """About half of the words are under the core's share and are placed by their contexts; the score of a text does not depend on the others' order."""
    from pyspark.sql import functions as F

    from tidemark.llm.brown import class_scores

    draw = np.random.default_rng(8)
    texts = [" ".join(f"{'ab'[k % 2]}{draw.integers(0, 40)}" for k in range(30)) for _ in range(120)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in rows(class_scores(frame, F.col("doc_id") % 5 == 0, share=0.012, classes=6))}
    again = {r["doc_id"]: r["score"] for r in rows(class_scores(frame.orderBy(F.desc("doc_id")), F.col("doc_id") % 5 == 0, share=0.012, classes=6))}
    assert all(math.isclose(r["score"], again[i]) for i, r in got.items())
    out = [r for r in got.values() if r["held_out"]]
    # half of the words can follow at each place: a bit a token less than the base
    assert sum(r["score"] - r["base_score"] for r in out) > 0.2 * sum(r["n_tokens"] for r in out)


def test_scores_odd(spark, odd):
    from pyspark.sql import functions as F

    from tidemark.llm.brown import class_scores

    got = rows(class_scores(odd, F.lit(False)))
    assert len(got) == len(ODD)
    assert [r["n_tokens"] for r in got if r["doc_id"] in (2, 3, 7)] == [1, 1, 1]
    alone = rows(class_scores(odd, F.lit(True)))
    assert all(r["train_tokens"] == 0 and r["n_known"] == 0 for r in alone)
    assert rows(class_scores(odd.limit(0), F.lit(False))) == []


def test_jaccard(spark, sf, texts):
    sets, expect = brute_jaccard(texts)
    got = rows(Q.op2_jaccard_join(spark, sf))
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == {i: (len(sets[i]), expect[i]) for i in texts}


def test_jaccard_families(spark):
    """Copies, near copies with edits, a passage that many share, and lists that need the second round."""
    from tidemark.llm.ngram_join import jaccard_components

    rng = np.random.default_rng(5)
    vocabulary = [f"w{k}" for k in range(4000)]
    passage = list(rng.choice(vocabulary, 60))
    data = []
    for family in range(6):
        base = list(rng.choice(vocabulary, 120))
        for _ in range(25):
            t = list(base)
            for k in rng.choice(120, rng.integers(0, 7), replace=False):
                t[k] = str(rng.choice(vocabulary))
            data.append(t)
    for _ in range(60):
        data.append([*rng.choice(vocabulary, rng.integers(10, 90)), *passage])
    data += [passage, passage[:40], passage, data[0]]
    order = rng.permutation(len(data))
    texts = {int(i): " ".join(data[k]) for k, i in enumerate(order)}
    sets, expect = brute_jaccard(texts)
    got = rows(jaccard_components(spark.createDataFrame(list(texts.items()), "doc_id long, text string")))
    assert {r["doc_id"]: r["component_id"] for r in got} == expect


@pytest.mark.parametrize("sizes", [(40, 40), (36, 44)])
def test_pairs_of_families(spark, sizes):
    """In families of one side and of two every link between components comes out, and few pairs of sets that have only the family's prefix in common."""
    from tidemark.llm.ngram_join import pairs_of_families

    rng = np.random.default_rng(sum(sizes))
    common = rng.integers(-(1 << 62), 1 << 62, 12)
    two = sizes[0] != sizes[1]
    made, members = [], []
    for k in range(240):
        side = k % 2 if two else 0
        n = sizes[side]
        if k >= 6 and k % 3 == 0:  # a set near another
            _, near = made[int(rng.integers(0, k))]
            keep = [*common, *[x for x in near if x not in set(common)][: n - 12 - int(rng.integers(0, 6))]]
        else:
            keep = list(common)
        keep = list(dict.fromkeys(keep))[:n]
        made.append((side, [*keep, *rng.integers(-(1 << 62), 1 << 62, n - len(keep))]))
        members.append((7, side, False, k, n, sizes[1 - side] if two else n, k % 40))
    m = spark.createDataFrame(members, "family long, side int, leads boolean, set_id long, n long, m long, component long")
    sets = spark.createDataFrame([(k, bytes(np.array(s, np.int64).tobytes())) for k, (_, s) in enumerate(made)], "set_id long, shingles binary")
    got = {(r["a"], r["b"]) for r in rows(pairs_of_families(m, sets))}
    apart = [(a, b) for a in range(240) for b in range(a + 1, 240) if a % 40 != b % 40 and (not two or made[a][0] != made[b][0])]
    links = {(a, b) for a, b in apart if 100 * len(set(made[a][1]) & set(made[b][1])) >= 75 * len(set(made[a][1]) | set(made[b][1]))}
    assert len(links) > 20 and links <= got <= set(apart) and len(got) < 0.1 * len(apart)
    led = m.withColumn("leads", m["set_id"] == 0)
    assert {(r["a"], r["b"]) for r in rows(pairs_of_families(led, sets))} == {(a, b) for a, b in got if a != 0 or two}


def test_jaccard_crowded_group(spark):
    """Documents of a rare passage and two of many common ones: one prefix, many components, and near copies away from the group's lead."""
    from tidemark.llm.ngram_join import jaccard_components

    rng = np.random.default_rng(9)
    vocabulary = [f"w{k}" for k in range(6000)]
    rare, *pool = (list(rng.choice(vocabulary, 20)) for _ in range(25))
    data = [[*rare, *pool[i], *pool[j]] for i in range(24) for j in range(i + 1, 24)]
    data += [[*data[k][:-1], f"end{k}"] for k in range(0, len(data), 5)]
    data += [[*pool[i], *pool[(i + k) % 24]] for i in range(24) for k in range(1, 20)]
    texts = {int(i): " ".join(data[k]) for k, i in enumerate(rng.permutation(len(data)))}
    _, expect = brute_jaccard(texts)
    got = rows(jaccard_components(spark.createDataFrame(list(texts.items()), "doc_id long, text string")))
    assert {r["doc_id"]: r["component_id"] for r in got} == expect


def test_jaccard_odd(spark, odd):
    from tidemark.llm.ngram_join import jaccard_components

    got = rows(jaccard_components(odd))
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == Counter(
        [(1, 3, 1), (1, 3, 1), (2, 0, 2), (3, 0, 3), (4, 3, 1), (5, 1, 5), (6, 1, 6), (7, 0, 7), (8, 3, 8), (None, 1, None)]
    )
    assert rows(jaccard_components(odd.limit(0))) == []


def test_toxicity(spark):
    """Held-out rows of the larger table."""
    sf = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in rows(Q.op3_toxicity(spark, sf))}
    toxic = {r["doc_id"]: r["toxic"] for r in rows(table(spark, sf, "labels"))}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    held = [(got[i]["predicted"], y) for i, y in toxic.items() if got[i]["held_out"]]
    assert sum(p and y for p, y in held) >= 0.7 * sum(y for _, y in held)
    assert sum(p and not y for p, y in held) <= 0.03 * len(held)


def test_toxicity_odd(spark, odd):
    from tidemark.llm.toxicity import score_toxicity

    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = rows(score_toxicity(odd, none))
    by = {r["doc_id"]: r["score"] for r in got}
    assert len(got) == len(ODD) and by[2] == by[3] and all(0 <= r["score"] <= 1 for r in got)
    assert rows(score_toxicity(odd.limit(0), none)) == []


def test_toxicity_voters_from_all_labels(spark):
    """A word of too few toxic rows among those the classifier is fitted to still votes."""
    from tidemark.llm.toxicity import score_toxicity, train_toxicity

    data = [(i, f"plain words of row{i} here and there" + (" zorgblat" if i % 10 == 0 else "")) for i in range(600)]
    docs = spark.createDataFrame([*data, (1000, "one zorgblat more"), (1001, "nothing at all")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 10 == 0)) for i in range(600)], "doc_id long, toxic int")
    voters, _ = train_toxicity(docs, labels, sample=12)
    assert "0zorgblat" in voters.numbers
    by = {r["doc_id"]: r["score"] for r in rows(score_toxicity(docs, labels, sample=12))}
    assert by[1000] > by[1001]


@pytest.mark.parametrize("anchored", [0.0, 0.3])
def test_label_model(anchored):
    """Planted accuracies are found with few labels and without any, and a voter that repeats another counts half."""
    from tidemark.llm.toxicity import VOTERS, LabelModel

    rng = np.random.default_rng(3)
    n = 40_000
    y = rng.random(n) < 0.15
    rates = [(0.02, 0.7), (0.05, 0.5), (0.01, 0.6), (0.02, 0.8), (0.03, 0.6)]
    votes = np.stack([rng.random(n) < np.where(y, b, a) for a, b in rates])
    votes = np.concatenate([votes, votes[4:5]])  # the sixth repeats the fifth
    bits = (votes * (1 << np.arange(6))[:, None]).sum(0)
    patterns, at = np.unique(bits, return_inverse=True)
    known = np.zeros((len(patterns), 2))
    labelled = rng.random(n) < anchored
    np.add.at(known, (at[labelled], y[labelled].astype(int)), 1)
    m = LabelModel(patterns, np.bincount(at), known)
    assert abs(m.base - 0.15) < 0.03
    for k, (a, b) in enumerate(rates):
        assert abs(m.fires[0, k] - a) < 0.03 and abs(m.fires[1, k] - b) < 0.06, VOTERS[k]
    assert m.correlations[4, 5] > 0.9 and abs(m.weights[4] - 0.5) < 0.1 and m.weights[0] > 0.8
    p = m.posterior(patterns)[at]
    assert ((p > 0.5) == y).mean() > 0.95


def brute_lines(texts, least=50):
    """Every line in a run of ``least`` words that stands in any earlier place."""
    lines = {i: [x.strip() for x in t.split("\n")] for i, t in texts.items()}
    at, gone = defaultdict(list), defaultdict(set)
    order = sorted(lines)
    for i in order:
        for k, x in enumerate(lines[i]):
            if x:  # a run has a line with words; matches that begin with others are found from there
                for j, p in at[x]:
                    if k and p and lines[i][k - 1] and lines[i][k - 1] == lines[j][p - 1]:
                        continue  # part of a match looked at already
                    a, b = k, k
                    while a > 0 and p - (k - a) > 0 and lines[i][a - 1] == lines[j][p - (k - a) - 1]:
                        a -= 1
                    while b < len(lines[i]) and p + b - k < len(lines[j]) and lines[i][b] == lines[j][p + b - k]:
                        b += 1
                    if sum(len(y.split()) for y in lines[i][a:b]) >= least:
                        gone[i].update(range(a, b))
                at[x].append((i, k))
    return {i: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i]) if gone[i] else t for i, t in texts.items()}


def test_line_dedup(spark, sf, texts):
    got = {r["doc_id"]: r["text"] for r in rows(Q.op4_line_dedup(spark, sf))}
    expect = brute_lines(texts)
    assert sum(expect[i] != texts[i] for i in texts) > 0
    assert got == expect


def test_line_dedup_any_earlier_place(spark):
    """A run goes whichever earlier text holds it, not only the first that holds its beginning."""
    from tidemark.llm.line_dedup import dedup_lines

    a, b, c = " ".join(f"a{k}" for k in range(40)), " ".join(f"b{k}" for k in range(40)), "five words at the end"
    texts = {1: f"{a}\n{b}\nx", 2: f"{a}\n{b}\n{c}", 3: f"\n{a}\n{b}\n{c}", 4: f"{c}\n\n{b}\n{c}\n{a}"}
    rng = np.random.default_rng(7)
    some = [" ".join(f"w{x}" for x in rng.integers(0, 99, rng.integers(0, 30))) for _ in range(12)]
    for i in range(5, 60):
        texts[i] = "\n".join(some[x] for x in rng.integers(0, 12, rng.integers(1, 9)))
    df = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in texts.items()], "doc_id long, text string, _cuts int, _uid int, _maybe int")
    got = rows(dedup_lines(df))
    assert {r["doc_id"]: r["text"] for r in got} == brute_lines(texts)
    assert all((r["_cuts"], r["_uid"], r["_maybe"]) == (1, 2, 3) for r in got)
    assert {r["doc_id"]: r["text"] for r in got}[3] == ""


def test_line_dedup_cases(spark, odd):
    from tidemark.llm.line_dedup import dedup_lines

    got = rows(dedup_lines(odd))
    assert len(got) == len(ODD) and all(r["text"] == t for r, t in zip(sorted(got, key=lambda r: str(r["doc_id"])), [x[1] for x in sorted(ODD, key=lambda x: str(x[0]))]))
    run = "\n".join(f"line {k} " + "x y z " * 6 for k in range(6))
    data = [(1, f"a\n{run}\nb"), (2, f"c\nd\n{run}"), (3, f"{run}\n{run}"), (4, None)]
    got = {r["doc_id"]: r["text"] for r in rows(dedup_lines(spark.createDataFrame(data, "doc_id long, text string")))}
    assert got == {1: f"a\n{run}\nb", 2: "c\nd", 3: "", 4: None}


def brute_vectors(data):
    ok = {}
    for i, v, label in data:
        if v is None or label is None or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            continue
        ok[i] = (label, np.array(v, float))
    ids = sorted(ok)
    links = [
        (a, b) for x, a in enumerate(ids) for b in ids[x + 1 :]
        if ok[a][0] == ok[b][0] and len(ok[a][1]) == len(ok[b][1]) and ok[a][1] @ ok[b][1] / np.linalg.norm(ok[a][1]) / np.linalg.norm(ok[b][1]) >= 0.98
    ]
    n = Counter(i for link in links for i in link)
    c = components([i for i, _, _ in data], links)
    return {i: (n[i], c[i], c[i] == i) for i, _, _ in data}


def test_vectors(spark, sf):
    data = [tuple(r) for r in table(spark, sf, "embeddings").select("vec_id", "embedding", "label").collect()]
    rng = np.random.default_rng(1)
    base = rng.normal(size=64)
    data += [(100_000 + k, [float(x) for x in np.float32(base + rng.normal(size=64) * rng.choice([0.02, 0.12, 0.2]))], 3) for k in range(700)]
    data += [(200_000 + k, data[5][1], data[5][2]) for k in range(3)]
    data += [(300_000, None, 1), (300_001, [0.0] * 64, 1), (300_002, [float("nan")] + [1.0] * 63, 1), (300_003, [1.0] * 64, None), (300_004, [], 1), (300_005, [1.0, None], 1), (300_006, [1.0, 2.0], 1), (300_007, [2.0, 4.0], 1)]
    from tidemark.llm.vector_pairs import near_vectors

    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, label int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in rows(near_vectors(df))}
    expect = brute_vectors(data)
    wrong = {i: (got[i], expect[i]) for i in expect if got[i] != expect[i]}
    assert not wrong
    as_doubles = near_vectors(df.withColumn("embedding", df["embedding"].cast("array<double>")))
    assert {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in rows(as_doubles)} == got
    assert rows(near_vectors(df.limit(0))) == []


def test_fingerprints(spark, sf, texts):
    got = rows(Q.op6_fingerprints(spark, sf))
    ids = sorted(texts, reverse=True)
    after = dict(zip(ids, ids[1:] + ids[:1]))
    assert len(got) == len(texts)
    for r in got:
        t, u = texts[r["doc_id"]], texts[after[r["doc_id"]]]
        k = len(t) // 2
        assert r["n_chars"] == len(t)
        assert r["edited_sha256"] == hashlib.sha256((t[: len(t) - k] + u[:k]).encode()).hexdigest()
    long = [r for r in got if r["n_chars"] > 500]
    assert np.mean([r["near_edited"] for r in long]) > 0.2 > np.mean([r["near_next"] for r in long])


def test_fingerprints_shared_interior():
    from tidemark.llm.parsing import phrase_level

    rng = np.random.default_rng(3)
    shared = rng.integers(97, 120, 2000)
    a, b = np.concatenate([rng.integers(97, 120, 37), shared]), np.concatenate([rng.integers(97, 120, 411), shared])
    for level in range(3):
        x, bx = phrase_level(a.astype(np.uint64), np.array([0, len(a)]))
        y, by = phrase_level(b.astype(np.uint64), np.array([0, len(b)]))
        assert len(set(x) & set(y)) > 0.5 * len(shared) / 6 ** (level + 1)
        a, b = x, y
    assert phrase_level(np.zeros(0, np.uint64), np.array([0, 0]))[1].tolist() == [0, 0]


def test_phrases_by_definition():
    """Boundaries and names of phrases, symbol by symbol."""
    from itertools import groupby

    from tidemark.llm.hashing import mix
    from tidemark.llm.parsing import phrase_level

    def coin(before, own):
        d = before ^ own
        k = (d & -d).bit_length() - 1
        return 2 * k + (own >> k & 1)

    def phrases(x):
        runs = [(v, len(list(g))) for v, g in groupby(x)]
        with np.errstate(over="ignore"):
            y = [v if n == 1 else int(mix(np.array([v], np.uint64) + np.uint64(n) * np.uint64(0xA0761D6478BD642F))[0]) for v, n in runs]
        label = [coin(~y[0] & (2**64 - 1), y[0]), *(coin(a, b) for a, b in zip(y, y[1:]))]
        for _ in range(2):
            label = [coin(label[0] ^ 1, label[0]), *(coin(a, b) for a, b in zip(label, label[1:]))]
        starts = [k for k in range(len(y)) if k == 0 or (k < len(y) - 1 and label[k] > label[k - 1] and label[k] > label[k + 1])]
        return [tuple(y[a:b]) for a, b in zip(starts, [*starts[1:], len(y)])]

    rng = np.random.default_rng(5)
    texts = [rng.integers(97, 97 + k, n).astype(np.uint64) for k, n in ((2, 400), (26, 700), (4, 1), (3, 2), (1, 50), (1000, 300))]
    x, bounds = np.concatenate(texts), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    for _ in range(3):
        expect = [phrases([int(v) for v in x[a:b]]) for a, b in zip(bounds, bounds[1:])]
        x, bounds = phrase_level(x, bounds)
        assert list(np.diff(bounds)) == [len(p) for p in expect]
        name_of = {}
        for p, v in zip([q for e in expect for q in e], x):
            assert name_of.setdefault(p, v) == v
        assert len(set(name_of.values())) == len(name_of)


def test_fingerprints_large_ids(spark, monkeypatch):
    """Ids that doubles can't tell apart, in many parts; rows without doc_id last."""
    from tidemark.llm import parsing

    monkeypatch.setattr(parsing, "PART_BYTES", 200)
    texts = {(1 << 60) + 97 * k: f"text {k} " * (1 + k % 7) for k in range(150)} | {-(1 << 63): "least", (1 << 63) - 1: "most"}
    data = [*texts.items(), *[(None, f"none {k} " * 3) for k in range(40)]]
    got = rows(parsing.parse_documents(spark.createDataFrame(data, "doc_id long, text string")))
    assert len(got) == len(data)
    ids = sorted(texts, reverse=True)
    by = {r["doc_id"]: r["edited_sha256"] for r in got}
    for i, j in zip(ids, ids[1:]):
        k = len(texts[i]) // 2
        assert by[i] == hashlib.sha256((texts[i][: len(texts[i]) - k] + texts[j][:k]).encode()).hexdigest()


def test_fingerprints_odd(spark, odd):
    from tidemark.llm.parsing import parse_documents

    got = rows(parse_documents(odd))
    assert Counter(r["doc_id"] for r in got) == Counter(x[0] for x in ODD)
    same = [r["fingerprint"] for r in got if r["doc_id"] == 1]
    assert same[0] == same[1] and all(r["fingerprint"] == "" for r in got if r["doc_id"] in (2, 3))
    assert rows(parse_documents(odd.limit(0))) == []
    one = rows(parse_documents(odd.where("doc_id = 5")))
    assert one[0]["edited_sha256"] == hashlib.sha256(b"shosh").hexdigest() and one[0]["near_next"] == 1.0


def test_licenses(spark, sf, texts):
    got = {r["doc_id"]: r for r in rows(Q.op7_licenses(spark, sf))}
    splits = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    phrases = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
    for i, t in texts.items():
        w = splits.findall(t.translate(LOWER))
        found = [(k, x) for p, x in phrases.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        r = got[i]
        starts = [k for k, _ in found]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(w), len(found), min(starts, default=None), max(starts, default=None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in found}))
        assert set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(",")))
    assert any(r["n_base"] for r in got.values())


def test_license_templates(spark, odd):
    from tidemark.llm.licenses import TEMPLATES, scan_licenses

    data = [(k, f"some words here\n{t.upper()} and more\nend") for k, t in enumerate(TEMPLATES)]
    got = {r["doc_id"]: r for r in rows(scan_licenses(spark.createDataFrame(data, "doc_id long, text string")))}
    assert all(label in got[k]["labels"].split(",") and got[k]["score"] == 1.0 for k, label in enumerate(TEMPLATES.values()))
    assert len(rows(scan_licenses(odd))) == len(ODD) and rows(scan_licenses(odd.limit(0))) == []


def license_labels(spark, data):
    from tidemark.llm.licenses import scan_licenses

    return {r["doc_id"]: set(filter(None, r["labels"].split(","))) for r in rows(scan_licenses(spark.createDataFrame(list(enumerate(data)), "doc_id long, text string")))}


def test_licenses_apart(spark):
    """Notices of one license don't get another's label, nor does long prose with a template's words."""
    prose = " ".join(f"{w} {'filler ' * 30}" for w in "permission is hereby granted free of charge to any person obtaining a copy this software and associated documentation files".split())
    got = license_labels(spark, [
        "This work is licensed under the GNU General Public License, version 3.", "Licensed under CC BY-NC 4.0.", "released under the license", prose,
        "This work is licensed under the GNU Lesser General Public License, version 3.", "Licensed under the Apache License, Version 1.0",
        "Licensed under CC BY-NC-SA 4.0.",
    ])
    assert got == {0: {"gpl", "gpl-3.0"}, 1: {"cc-by", "cc-by-nc-4.0"}, 2: set(), 3: set(), 4: {"lgpl"}, 5: {"apache"}, 6: {"cc-by", "cc-by-nc-sa-4.0"}}


def test_licenses_changed(spark):
    """Notices that lack a word or have another one, and each license's own notice among its relatives'."""
    got = license_labels(spark, [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and its documentation files",
        "Redistribution and use in source or binary forms, with or without modification, are permitted",
        "Licensed under the Apache Licence, Version 2.0",
        "Licensed under the Eclipse Public License, Version 2.0", "Licensed under the Example License, Version 2.0",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "Licensed under the GNU Lesser General Public License. " + "then " * 5 + "Licensed under the GNU General Public License.",
        "Licensed under the GNU Affero General Public License.",
    ])
    assert got == {0: {"mit"}, 1: {"bsd"}, 2: {"apache-2.0"}, 3: {"epl-2.0"}, 4: set(), 5: {"lgpl"}, 6: {"gpl"}, 7: {"lgpl", "gpl"}, 8: {"agpl"}}


def test_licenses_against_all_runs(spark, docs, texts):
    """Every run of every text with enough of a template's weight overlaps a place that the join found, and no place has less."""
    from pyspark.sql import functions as F

    from tidemark.llm.licenses import TEMPLATES, THRESHOLD, span_of, template_places, weight_of, words_of

    data = list(texts.items())
    rng = np.random.default_rng(5)
    for k, t in enumerate(list(TEMPLATES) * 3):  # notices with words lost and added, in long texts
        w = [x for x in t.split() if rng.random() > 0.12 for x in ([x, "extra"] if rng.random() < 0.1 else [x])]
        data.append((10_000 + k, " ".join(["filler"] * int(rng.integers(0, 90)) + w + ["the"] * int(rng.integers(0, 9)) + w[::-1])))
    df = spark.createDataFrame(data, "doc_id long, text string").withColumn("uid", F.xxhash64("doc_id", "text"))
    found = defaultdict(list)
    for r in template_places(df).collect():
        found[r["doc_id"], r["name"]].append((r["first"], r["end"], r["share"]))
    met = 0
    for i, t in data:
        words = [w.decode() for w in words_of(t)]
        for name, template in enumerate(TEMPLATES):
            wanted, span = set(template.split()), span_of(template)
            full = weight_of(sorted(wanted))
            share = lambda run: weight_of(sorted(wanted.intersection(run))) / full
            places = found.get((i, name), [])
            for lo in [k for k, w in enumerate(words) if w in wanted]:
                if len(wanted.intersection(words[lo : lo + span])) > 1 and share(words[lo : lo + span]) >= THRESHOLD - 1e-9:
                    assert any(a < lo + span and lo < b for a, b, _ in places), (i, template, lo)
                    met += 1
            assert all(b - a <= span and abs(share(words[a:b]) - s) < 1e-9 and s >= THRESHOLD - 1e-9 for a, b, s in places)
    assert met > 100


def test_licenses_wrapped(spark):
    """Every template wrapped after each third word, at every offset to the blocks' bounds."""
    from tidemark.llm.licenses import TEMPLATES

    data, expect = [], []
    for template, label in TEMPLATES.items():
        w = template.split()
        wrapped = "\n * ".join(" ".join(w[k : k + 3]) for k in range(0, len(w), 3))
        for before in range(0, 60, 7):
            data.append(f"{'filler ' * before}\n{wrapped}\nend")
            expect.append(label)
    got = license_labels(spark, data)
    assert all(label in got[k] for k, label in enumerate(expect))
    assert all(got[k] <= {label, "gpl", "mit", "apache", "cc-by"} for k, label in enumerate(expect))


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_spans(t):
    from tidemark.llm.pii import luhn

    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [("email", *m.span()) for m in EMAIL.finditer(t)]
    out += [("ip", *m.span()) for m in IP.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(t) if 12 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    out += [("phone", *m.span()) for m in PHONE.finditer(t) if 9 <= len(digits(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[1], ("email", "ip", "card", "phone").index(s[0])))


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="a1 2.@+-(5)0\n%é", max_size=60))
def test_base_spans(t):
    from tidemark.llm.pii import base_spans

    assert base_spans(t) == plain_spans(t)


def test_pii(spark, sf, texts):
    for r in rows(Q.op8_pii(spark, sf)):
        spans = plain_spans(texts[r["doc_id"]])
        base = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [sum(s[0] == k for s in spans) for k in ("email", "ip", "card", "phone")]
        assert set(filter(None, base.split(","))) <= set(r["spans"].split(","))


def test_pii_contexts(spark, odd):
    from tidemark.llm.pii import extract_pii

    data = [(k, f"filler words then contact phone: +1 202 555 01{k:02d} and more") for k in range(20)]
    data += [(100 + k, f'other words token = "{k:02d}ab34cd56ef{k:02d}9912" end') for k in range(8)]
    data += [(200, "write to contact phone: 0202-555-0199 please")]
    got = {r["doc_id"]: r["spans"] for r in rows(extract_pii(spark.createDataFrame(data, "doc_id long, text string")))}
    assert got[100].startswith("secret:") and got[200].startswith("phone:")
    assert len(rows(extract_pii(odd))) == len(ODD) and rows(extract_pii(odd.limit(0))) == []


def test_pii_discovery(spark):
    """Runs of numbers, contexts after a candidate and at a line's start, and no secret without what looks like one."""
    from tidemark.llm.pii import _contexts, extract_pii

    found = lambda t: {t[a:b] for a, b, *_ in _contexts(t, [])}
    assert found("call 202 555 0199 now") == {"202 555 0199"} and found("call (202) 555-0199 now") == {"(202) 555-0199"}
    data = [(k, f"filler words then contact phone: +1 202 555 01{k:02d} is my mobile") for k in range(20)]
    data += [(100 + k, f"date: 2024-01-{k:02d} then") for k in range(10, 20)]
    data += [(200, "reach contact phone: 202 555 0199 please"), (201, "0202-555-0199 is my mobile"), (202, "contact phone: (202) 555-0199")]
    got = {r["doc_id"]: r["spans"] for r in rows(extract_pii(spark.createDataFrame(data, "doc_id long, text string")))}
    assert got[200] == "phone:21:33" and got[201] == "phone:0:13" and got[202] == "phone:15:29"
    assert all(got[100 + k] == "" for k in range(10, 20))


def test_pii_words_around():
    """Two words on each side, however long the gaps are; parts of a word that a candidate cuts; of long words what is next to it."""
    from tidemark.llm.pii import _shape, _Words

    w = _Words("one two " + "x" * 500 + " 12 -- key=AB12 tail: " + "9 " * 400 + "end")
    at = w.line.index("AB12")
    assert w.before(at) == ["x" * 60, "key="] and w.after(at + 4) == ["tail:", "end"] and w.after(at) == ["ab", "tail:"]
    assert w.before(0) == [] and w.after(len(w.line)) == [] and _Words("").after(0) == []
    line = ",".join(f"n{k}" for k in range(20_000))  # one word: what is kept of it doesn't grow with it
    w = _Words(line)
    assert all(len(x) <= 60 for at in range(0, len(line), 997) for x in (*w.before(at), *w.after(at)))
    long = "".join(f"{k % 10}-" for k in range(40))
    assert _shape(long) != _shape(long + "a") and _shape("12ab-3") == "99a-9"


def test_pii_recall_of_planted(spark):
    """Each kind in contexts that seeds make known, in forms that no fixed pattern has; dates and counts beside them stay."""
    from tidemark.llm.pii import extract_pii

    data, expect = [], {}
    for k in range(30):
        data += [
            (k, f"some text then mobile number: +44 20 7946 {k:04d} today"), (100 + k, f"please reach mailbox: user{k}@example.org soon"),
            (200 + k, f"server address: 10.0.{k}.7 is up"), (300 + k, f'config api_key = "a{k:02d}b34c{k:02d}d56e7{k % 10}f9" set'),
            (400 + k, f"released on 2024-03-{k % 28 + 1:02d} with {1000 + k} items"),
        ]
    for n, (t, kind, value) in enumerate([
        ("again mobile number: 020 7946 0999 thanks", "phone", "020 7946 0999"), ("then mobile number: (020) 7946-0123 ok", "phone", "(020) 7946-0123"),
        ("here mailbox: someone@intranet now", "email", "someone@intranet"), ('the api_key = "z99y88x77w66v55u44t3" there', "secret", "z99y88x77w66v55u44t3"),
    ]):
        data.append((1000 + n, t))
        expect[1000 + n] = f"{kind}:{t.index(value)}:{t.index(value) + len(value)}"
    got = {r["doc_id"]: r["spans"] for r in rows(extract_pii(spark.createDataFrame(data, "doc_id long, text string")))}
    assert {k: got[k] for k in expect} == expect
    assert all(got[300 + k].startswith("secret:") for k in range(30)) and all(got[400 + k] == "" for k in range(30))


def test_pii_graph_by_definition(spark):
    """Confidences of a small graph against the same rounds in plain numbers, to their end."""
    from tidemark.llm.pii import STILL, confident_patterns

    draw = np.random.default_rng(17)
    marks = []
    for uid in range(400):
        kind = draw.choice(["phone", "email", None], p=[0.3, 0.2, 0.5])
        shape = {"phone": "+9", "email": "a@a"}.get(kind) or str(draw.choice(["9-9", "9.9", "a9a", "+9"]))
        pattern = str(draw.choice(["call", "mail", "at", "nr"], p=[0.7, 0.1, 0.1, 0.1] if kind == "phone" else [0.1, 0.7, 0.1, 0.1] if kind == "email" else [0.25] * 4))
        marks.append((uid, pattern, shape, kind, None))
    edges = Counter((p, s, k) for _, p, s, k, _ in marks)
    total = Counter(p for _, p, *_ in marks)
    seeds, unknown = Counter(), Counter()
    for (p, s, k), n in edges.items():
        if k:
            seeds[s, k] += n
        else:
            unknown[s] += n
    belief = {(s, k): n / (n + unknown[s]) for (s, k), n in seeds.items() if unknown[s]}
    while True:
        b = Counter()
        for (p, s, k), n in edges.items():
            for kind in ("phone", "email"):
                b[p, kind] += n * (k == kind) if k else n * belief.get((s, kind), 0.0)
        confidence = {x: v / (total[x[0]] + 1) for x, v in b.items() if v}
        doubt = defaultdict(float)
        for (p, s, k), n in edges.items():
            for kind in ("phone", "email"):
                if not k and confidence.get((p, kind), 0) >= 0.3:
                    doubt[s, kind] += math.log1p(-min(0.95, confidence[p, kind] * 0.9)) * min(1.0, n / 3)
        new = {x: 1 - math.exp(v) for x, v in doubt.items()}
        moved = max(abs(new.get(x, 0) - belief.get(x, 0)) for x in {*new, *belief})
        belief = new
        if moved <= STILL:
            break
    got = {r["pattern"]: (r["as"], r["confidence"]) for r in rows(confident_patterns(spark.createDataFrame(marks, "uid long, pattern string, shape string, kind string, form string"), confident=0.5))}
    best = {p: max((c, k) for (q, k), c in confidence.items() if q == p) for p in total}
    assert {p for p, (c, _) in best.items() if c >= 0.5} == set(got) != set()
    assert all(best[p][1] == k and math.isclose(best[p][0], c, rel_tol=1e-9) for p, (k, c) in got.items())


def brute_targets(sizes):
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    cap = {s: 2.0 * sizes[s] for s in order}
    target, rest = {}, 1.5 * sum(sizes.values())
    free = list(order)
    while free:
        level = rest / sum(w[s] for s in free)
        over = [s for s in free if level * w[s] > cap[s]]
        if not over:
            target |= {s: level * w[s] for s in free}
            break
        for s in over:
            target[s] = cap[s]
            rest -= cap[s]
            free.remove(s)
    return target


def test_mixing(spark, sf, docs):
    got = rows(Q.op9_mix_sources(spark, sf))
    source = {r[0]: r[1] for r in docs.select("doc_id", "source").collect()}
    sizes = Counter()
    for r in got:
        sizes[source[r["doc_id"]]] += r["size"]
    target, taken, largest = brute_targets(sizes), Counter(), Counter()
    for r in got:
        s = source[r["doc_id"]]
        assert r["source_size"] == sizes[s] and math.isclose(r["target"], target[s], rel_tol=1e-9) and r["taken"] <= 2 * r["size"]
        taken[s] += r["taken"]
        largest[s] = max(largest[s], r["size"])
    assert all(abs(taken[s] - target[s]) <= 1.5 * largest[s] for s in sizes)
    again = {(r["doc_id"], r["taken"]) for r in rows(Q.op9_mix_sources(spark, sf))}
    assert again == {(r["doc_id"], r["taken"]) for r in got}


def test_mixing_odd(spark, odd):
    from tidemark.llm.mixing import mix_sources, take_mix

    got = rows(mix_sources(odd))
    assert len(got) == len(ODD) and all(r["taken"] == 0 for r in got if r["doc_id"] in (2, 3, 7))
    took = rows(take_mix(odd))
    assert sum(len(words(r["text"])) for r in took) == sum(r["taken"] for r in got)
    assert rows(mix_sources(odd.limit(0))) == [] == rows(take_mix(odd.limit(0)))


def test_mixing_rows(spark):
    """Columns of any name stay; rows that share an id, or have none, share their copies."""
    from tidemark.llm.mixing import mix_sources, take_mix

    data = [(i if i % 3 else None, "w " * (i % 17), "abc"[i % 3], i, "x") for i in range(300)] + [(1, "w w", "b", 7, "y")] * 5
    df = spark.createDataFrame(data, "doc_id long, text string, source string, _copies int, row string")
    took = rows(take_mix(df))
    mix = rows(mix_sources(df))
    assert sum(len(words(r["text"])) for r in took) == sum(r["taken"] for r in mix)
    for s in "abc":
        assert sum(len(words(r["text"])) for r in took if r["source"] == s) == sum(r["taken"] for r in mix if r["source"] == s)
    assert max(Counter((r["doc_id"], r["_copies"], r["row"]) for r in took if r["row"] == "x").values()) <= 2
    assert {(r["_copies"], r["row"]) for r in took} <= {(d[3], d[4]) for d in data}


def test_mixing_without_ids(spark):
    """Rows without a doc_id and of one size are told apart by their texts: no window has most of them, and reruns agree."""
    from pyspark.sql import functions as F

    from tidemark.llm.mixing import CHUNK, mix_sources

    n = 5 * CHUNK
    df = spark.range(n).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("word x"), "id").alias("text"), F.lit("a").alias("source"))
    df = df.union(spark.range(n).select("id", F.lit("two words"), F.lit("b")))
    got = mix_sources(df)
    d = df.select("doc_id", F.lit(2).alias("size"), F.xxhash64("text").alias("tie"), "source").where("source = 'a'")
    largest = d.groupBy(F.pmod(F.xxhash64("doc_id", "size", "tie"), F.lit(5))).count().agg(F.max("count")).first()[0]
    assert largest < 1.3 * CHUNK
    first, again = (Counter(map(tuple, rows(mix_sources(df.repartition(k))))) for k in (3, 5))
    assert first == again
    for s in "ab":
        assert abs(sum(r["taken"] for r in rows(got.where(F.col("source") == s))) - rows(got.where(F.col("source") == s).limit(1))[0]["target"]) <= 4


def brute_systematic(data, seed_offset):
    """Copies of (doc_id, source, size) in the order of size class, chunk and size, one chunk here: a walk along the line of expectations."""
    out = {}
    for source, (rate, offset) in seed_offset.items():
        mine = sorted((x for x in data if x[1] == source), key=lambda x: (math.floor(math.log2(x[2] + 1) * 4), x[2], x[0]))
        for k, x in enumerate(mine):
            out[x[0]] = math.floor((k + 1) * rate + offset) - math.floor(k * rate + offset)
    return out


def test_mixing_by_definition(spark):
    """Which documents are taken, and how often, against a walk in plain Python."""
    from tidemark.llm.mixing import mix_sources

    rng = np.random.default_rng(11)
    data = [(i, "abcd"[int(rng.integers(0, 4))], int(rng.integers(0, 60))) for i in range(400)]
    df = spark.createDataFrame([(i, s, "w " * n) for i, s, n in data], "doc_id long, source string, text string")
    got = rows(mix_sources(df))
    offsets = {r["s"]: r["o"] for r in rows(df.select("source").distinct().selectExpr("source as s", "pmod(xxhash64(source, 7), 1048576) / double(1048576) as o"))}
    rates = {r["source"]: r["target"] / r["source_size"] for r in got}
    expect = brute_systematic(data, {s: (rates[s], offsets[s]) for s in rates})
    assert {r["doc_id"]: r["copies"] for r in got} == expect
    total = sum(n for *_, n in data)
    assert abs(sum(r["target"] for r in {r["source"]: r for r in got}.values()) - 1.5 * total) < 1e-6 * total


def brute_best_fit(sizes, capacity):
    bins = []
    for s in sorted(sizes, reverse=True):
        fits = [k for k, r in enumerate(bins) if r >= s]
        if fits:
            bins[min(fits, key=lambda k: bins[k])] -= s
        else:
            bins.append(capacity - s)
    return sorted(bins)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=80))
def test_best_fit(sizes):
    from tidemark.llm.packing import best_fit_runs

    left, seen = defaultdict(lambda: 40), Counter()
    for size, first, items, each, start, offset in best_fit_runs(Counter(sizes), 40):
        assert first == seen[size]
        seen[size] += items
        for k in range(items):
            assert 40 - left[start + k // each] == offset + (k % each) * size
            left[start + k // each] -= size
    assert seen == Counter(sizes) and sorted(left.values()) == brute_best_fit(sizes, 40)


def check_packing(got, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    of = defaultdict(list)
    for r in got:
        of[r["doc_id"]].append(r)
    for i, t in texts.items():
        ids = [*model.encode(t or "", add_special_tokens=False).ids, 0]
        mine = sorted(of[i], key=lambda r: r["piece"])
        assert [r["piece"] for r in mine] == list(range(-(-len(ids) // 2048)))
        at = 0
        for k, r in enumerate(mine):
            assert r["start"] == at and (r["length"] == 2048 or k == 0)
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    by = defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by.values():
        end = 0
        for o, n in sorted(parts):
            assert o == end
            end += n
        assert end <= 2048
    return len(by)


def test_packing(spark, sf, texts):
    got = rows(Q.op10_pack(spark, sf))
    n = check_packing(got, texts)
    assert n == len(brute_best_fit([r["length"] for r in got], 2048))


def test_packing_odd(spark, odd):
    from tidemark.llm.packing import pack_documents

    got = rows(pack_documents(odd))
    assert sum(r["doc_id"] == 1 for r in got) == 2
    once = [r for r in got if r["doc_id"] != 1]
    for r in got:
        if r["doc_id"] == 1:
            once.append(r)
    by = defaultdict(int)
    for r in got:
        by[r["sequence_id"]] += r["length"]
    assert max(by.values()) <= 2048
    assert rows(pack_documents(odd.limit(0))) == []


def test_packing_added_tokens(spark):
    """Text that spells an added token is that token, as in a plain call of the library."""
    from tidemark.llm.packing import token_pieces

    texts = {1: "a<|endoftext|>b", 2: "<|endoftext|>", 3: "x <|endoftext|> y<|endoftext|><|endoftext|> z", 4: "<|endoftext"}
    got = rows(token_pieces(spark.createDataFrame(list(texts.items()), "doc_id long, text string")))
    assert {r["doc_id"]: r["length"] for r in got}[1] == 4
    check_ids = {i: np.asarray([*tokenizer().encode(t, add_special_tokens=False).ids, 0], "<u4").tobytes() for i, t in texts.items()}
    assert {r["doc_id"]: r["ids_crc32"] for r in got} == {i: zlib.crc32(b) for i, b in check_ids.items()}


def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_encoder_cuts_anywhere():
    import random

    import public_tokenizers
    from tokenizers import Tokenizer

    from tidemark.llm.packing import _Encoder

    path = public_tokenizers.path("byte_bpe_50k.json")
    model = Tokenizer.from_file(path)
    r = random.Random(1)
    parts = ["a", "B ", " ", "\n", "\t", "'s", "don't ", " é", "<|endoftext|>", "日本", "  ", "\xa0", "12 ", " ", "!?", "\x1c", "\x85", "🙂"]
    for _ in range(500):
        t = "".join(r.choice(parts) for _ in range(30))
        assert np.asarray(model.encode(t, add_special_tokens=False).ids, "<u4").tobytes() == _Encoder.of(path).encode(t)


def test_pipeline(spark, sf, docs):
    import corpus_pipeline as P

    docs = docs.cache()
    d, seen = docs, []
    for name, stage in P.STAGES[:-1]:
        before = d
        d = stage(spark, d, sf).cache()
        assert d.columns == docs.columns
        seen.append((name, before.count(), d.count()))
        if name == "n-gram Jaccard join":
            texts = {r["doc_id"]: r["text"] for r in rows(before)}
            _, c = brute_jaccard(texts)
            assert {r["doc_id"] for r in rows(d)} == {i for i in texts if c[i] == i}
        if name == "line dedup":
            texts = {r["doc_id"]: r["text"] for r in rows(before)}
            expect = brute_lines(texts)
            assert {r["doc_id"]: r["text"] for r in rows(d)} == {i: t for i, t in expect.items() if t == texts[i] or t.strip()}
    got = rows(P.STAGES[-1][1](spark, d, sf))
    assert len({(r["sequence_id"], r["offset"]) for r in got}) == len(got) >= d.count()
    assert P.run(spark, sf).count() == len(got)


def test_pipeline_jaccard_rows(spark):
    """One row of each group: shared, repeated and null doc_ids."""
    import corpus_pipeline as P

    a, b, c, d = (" ".join(f"{x}{k}" for k in range(40)) for x in "abcd")
    data = [(3, a), (5, a), (5, b), (7, c), (7, c), (8, c), (None, d), (None, d), (None, a), (9, ""), (10, None), (9, "")]
    docs = spark.createDataFrame([(i, t, "en", f"s{k % 2}", 1) for k, (i, t) in enumerate(data)], "doc_id long, text string, lang string, source string, n_chars long")
    got = P.jaccard_join(spark, docs, None)
    assert got.columns == docs.columns
    assert Counter((r["doc_id"], r["text"]) for r in rows(got)) == Counter([(3, a), (5, b), (7, c), (None, d), (9, ""), (9, ""), (10, None)])
    assert {r["source"] for r in rows(got) if r["doc_id"] == 7} == {"s0"}
    assert rows(P.jaccard_join(spark, docs.limit(0), None)) == []


def test_pipeline_odd(spark, sf):
    """Nulls, repeats, empty and long texts, extra columns with clashing names, and an empty table, through all stages."""
    import corpus_pipeline as P

    more = {c: k for k, c in enumerate(("score", "n_lines", "n_removed", "row", "key", "copies", "uid", "cuts", "toxic", "n"))}
    data = [(i, t, lang, source, len(t or ""), *more.values()) for i, t, lang, source in ODD]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} int" for c in more))
    d = docs
    for _, stage in P.STAGES[:-1]:
        d = stage(spark, d, sf)
        assert d.columns == docs.columns
        found = rows(d)
        assert all(r[c] == k for r in found for c, k in more.items())
        d = spark.createDataFrame(found or [], docs.schema)
    got = rows(P.STAGES[-1][1](spark, d, sf))
    assert {r["doc_id"] for r in got} == {r["doc_id"] for r in found} and 6 in {r["doc_id"] for r in found}
    e = docs.limit(0)
    for _, stage in P.STAGES:
        e = stage(spark, e, sf)
        assert rows(e) == []


def test_jaccard_stage_with_columns_of_any_type(spark, sf):
    """Maps, arrays and structs beside the text; of rows that repeat in doc_id and text, the one whose JSON is least stays."""
    import corpus_pipeline
    from pyspark.sql import functions as F

    text = "one two three four five six seven eight nine ten"
    data = [(1, text, {"a": 2}, [2]), (1, text, {"a": 1}, [2]), (1, text, {"a": 1}, [2]), (2, text, {}, None), (3, "apart from all the others here", None, [1]), (4, None, {"b": 1}, []), (None, text + " more", {"a": 9}, [9])]
    df = spark.createDataFrame(data, "doc_id long, text string, more map<string,int>, list array<int>")
    df = df.select("*", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.length("text").cast("long").alias("n_chars"), F.struct("more").alias("nested"))
    got = corpus_pipeline.jaccard_join(spark, df, sf)
    assert got.columns == df.columns
    assert sorted(((r["doc_id"], r["more"], r["list"]) for r in got.collect()), key=repr) == sorted([(1, {"a": 1}, [2]), (3, None, [1]), (4, {"b": 1}, [])], key=repr)


def test_base_scores_need_no_classes(spark, sf, monkeypatch):
    """What is asked of the base alone clusters nothing."""
    from tidemark.llm import brown, queries

    def none(*_, **__):
        raise AssertionError("clusters words")

    monkeypatch.setattr(brown, "exchange_core", none)
    got = queries.unigram_scores(spark, sf).collect()
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count() and all(r["base_score"] < 0 for r in got)
