"""Class-based n-gram scores: exchange clustering of words, class transitions, word emissions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import corpus_size, cut, lean, power_of_two
from .hashing import pieces, word_hashes

#: Words of at least this share of all training tokens, the core, are the contexts that classes are found from: at most 1 / SHARE
#: words, whatever the corpus; of fewer training tokens than that, all words.
SHARE = 1e-5
#: Words of the core that are exchanged first, on a matrix of bounded size, to begin with.
SEEDS = 510
CLASSES = 64
ROUNDS = 16
#: A round that gains less log likelihood a token ends the exchange.
LEAST_GAIN = 1e-3
#: Parts of a round's moves, each half of the one before, that one pass over the pair counts tries.
TRIALS = 3
#: Bytes of text that share one table of their words.
BLOCK_BYTES = 16 << 20
#: Words whose distinct ones, or pairs, a worker counts before it ships them.
HELD = 4_000_000
#: Classes of the text's end and, while the core is clustered, of all other words.
END, REST = 0, 1
_END_KEY = -1


def _doc_words(batches):
    """(batch part, word keys, bounds) in pieces; the text is the first column."""
    for batch in batches:
        for at, texts in pieces(batch.column(0)):
            h, bounds = word_hashes(texts)
            yield batch.slice(at, len(texts)), h.view(np.int64), bounds


def _word_counts(batches):
    held, size, ends = [], 0, 0

    def flush():
        words, n = np.unique(np.concatenate([*held, np.full(ends, _END_KEY, np.int64)]), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(words), pa.array(n.astype(np.int64))], names=["word", "n"])

    for part, h, _ in _doc_words(batches):
        held.append(h)
        size += len(h)
        ends += len(part)
        if size > 2 * HELD:
            yield flush()
            held, size, ends = [], 0, 0
    if ends:
        yield flush()


def _units(h: np.ndarray, bounds: np.ndarray, core: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each word's place in the sorted core, len(core) for others, with an end unit after each text; and the new bounds."""
    at = np.minimum(np.searchsorted(core, h), max(len(core) - 1, 0))
    unit = np.where(core[at] == h, at, len(core)) if len(core) else np.zeros(len(h), np.int64)
    return np.insert(unit, bounds[1:], len(core) + 1), bounds + np.arange(len(bounds))


def _before(units: np.ndarray, bounds: np.ndarray, end: int) -> np.ndarray:
    """The unit before each; a text's first follows an end."""
    prev = np.empty_like(units)
    prev[1:] = units[:-1]
    prev[bounds[:-1][bounds[:-1] < len(units)]] = end
    return prev


def _core_pairs(core):
    """Counts of pairs of units that follow each other, as unit * units + unit."""
    core = core.value

    def run(batches):
        m = len(core) + 2
        held, size = [], 0

        def flush():
            found, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(found), pa.array(n.astype(np.int64))], names=["pair", "n"])

        for _, h, bounds in _doc_words(batches):
            units, b = _units(h, bounds, core)
            held.append(_before(units, b, m - 1) * m + units)
            size += len(units)
            if size > HELD:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    return run


def _folded(owns, size: int):
    """Pair counts of units as pair counts of their classes, for each of some ways to class the units."""
    owns = owns.value

    def run(batches):
        tables = np.zeros((len(owns), size * size))
        for batch in batches:
            a, b = np.divmod(batch.column(0).to_numpy(), len(owns[0]))
            n = batch.column(1).to_numpy()
            for own, table in zip(owns, tables):
                table += np.bincount(own[a] * size + own[b], n, size * size)
        tables = tables.ravel()
        found = np.flatnonzero(tables)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(tables[found].astype(np.int64))], names=["pair", "n"])

    return run


def _tables_of(pairs: DataFrame, owns: list[np.ndarray], size: int) -> np.ndarray:
    """How often each class follows each, by each of ``owns``, in one pass; as many times ``size`` squared rows at most come to the driver."""
    run = _folded(pairs.sparkSession.sparkContext.broadcast(owns), size)
    tables = np.zeros(len(owns) * size * size)
    for p, n in pairs.mapInArrow(lean(run), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect():
        tables[p] = n
    return tables.reshape(len(owns), size, size)


def _table_of(pairs: DataFrame, own: np.ndarray, size: int) -> np.ndarray:
    return _tables_of(pairs, [own], size)[0]


def _f(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def likelihood(table: np.ndarray) -> float:
    """The part of a class bigram model's log likelihood that depends on the classes: sum f(N(c, d)) - sum f(N(c)) - sum f(N(d)), f(x) = x log x."""
    return float(_f(table).sum() - _f(table.sum(1)).sum() - _f(table.sum(0)).sum())


def _shift(table: np.ndarray, c: int, right: np.ndarray, left: np.ndarray, loops: float, sign: int) -> None:
    """Put a word into class c of the table (sign 1) or take it out (-1)."""
    table[c] += sign * right
    table[:, c] += sign * left
    table[c, c] += sign * loops


def best_move(table: np.ndarray, c: int, right: np.ndarray, left: np.ndarray, loops: float) -> tuple[int, float]:
    """The class, END and REST apart, to which a word of class ``c`` moves best, and what likelihood that gains over staying.

    ``right``, ``left``: counts of the classes after and before the word, itself aside; ``loops``: how often it follows itself.
    """
    _shift(table, c, right, left, loops, -1)
    rows, cols = table.sum(1) + left, table.sum(0) + right  # what leads to the word and follows it counts in any class
    r, v = np.flatnonzero(right), np.flatnonzero(left)  # other classes' counts stay
    gain = (_f(table[:, r] + right[None, r]) - _f(table[:, r])).sum(1) + (_f(table[v] + left[v, None]) - _f(table[v])).sum(0)
    d = np.diag(table)
    gain += _f(d + right + left + loops) - _f(d + right) - _f(d + left) + _f(d)
    n_right, n_left = right.sum() + loops, left.sum() + loops
    gain -= _f(rows + n_right) - _f(rows) + _f(cols + n_left) - _f(cols)
    _shift(table, c, right, left, loops, 1)
    best = 2 + int(np.argmax(gain[2:]))
    return best, float(gain[best] - gain[c])


def exchange(counts: np.ndarray, classes: int, rounds: int = 12) -> np.ndarray:
    """Classes of units by the exchange method: each unit in turn moves to the class that gains most likelihood.

    ``counts[a, b]``: how often b follows a. The last two units, all other words and the end, keep classes of their own.
    """
    m = len(counts)
    order = np.argsort(-counts.sum(0)[: m - 2], kind="stable")
    own = np.empty(m, np.int64)
    own[order] = 2 + np.arange(m - 2) % max(1, classes - 2)
    own[m - 2], own[m - 1] = REST, END
    table = np.zeros((classes, classes))
    np.add.at(table, (own[:, None].repeat(m, 1), own[None].repeat(m, 0)), counts)
    for _ in range(rounds if classes > 3 else 0):
        moved = 0
        for w in order:
            right = np.bincount(own, counts[w], classes)
            left = np.bincount(own, counts[:, w], classes)
            loops, c = counts[w, w], own[w]
            right[c] -= loops
            left[c] -= loops
            best, gain = best_move(table, c, right, left, loops)
            if best != c and gain > 1e-9:
                _shift(table, c, right, left, loops, -1)
                _shift(table, best, right, left, loops, 1)
                own[w] = best
                moved += 1
        if not moved:
            break
    return own


_CONTEXTS = "bucket int, word binary, other binary, after binary, n binary"


def _packed(t: pa.Table) -> pa.Table:
    """All contexts of a bucket's words as one row of arrays, by word."""
    word = t["word"].to_numpy()
    order = np.argsort(word, kind="stable")
    columns = {c: t[c].to_numpy(zero_copy_only=False)[order] for c in ("word", "other", "after", "n")}
    return pa.table({
        "bucket": pa.array([t["bucket"][0].as_py()], pa.int32()),
        **{c: pa.array([columns[c].astype(k).tobytes()], pa.binary()) for c, k in (("word", np.uint32), ("other", np.uint32), ("after", bool), ("n", np.int64))},
    })


def _proposals(own, table):
    """The best move of each word of a bucket, all others staying where they are."""
    own, table = own.value, table.value

    def run(batches):
        size, table_here = len(table), table.copy()
        for batch in batches:
            for word, other, after, n in zip(*(batch.column(c).to_pylist() for c in ("word", "other", "after", "n"))):
                word, other, after, n = (np.frombuffer(x, k) for x, k in ((word, np.uint32), (other, np.uint32), (after, bool), (n, np.int64)))
                words, starts = np.unique(word, return_index=True)
                cls, out = own[other], []
                for w, lo, hi in zip(words.tolist(), starts, [*starts[1:], len(word)]):
                    loop, right_side = other[lo:hi] == w, after[lo:hi]
                    right = np.bincount(cls[lo:hi], n[lo:hi] * (right_side & ~loop), size)
                    left = np.bincount(cls[lo:hi], n[lo:hi] * (~right_side & ~loop), size)
                    out.append(best_move(table_here, own[w], right, left, float(n[lo:hi][loop & right_side].sum())))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(words.astype(np.int64)), pa.array([c for c, _ in out], pa.int32()), pa.array([g for _, g in out], pa.float64())], names=["word", "cls", "gain"],
                )

    return run


def _contexts(pairs: DataFrame, n_core: int) -> DataFrame:
    """The units before and after each word of the core, packed by buckets of words: a bucket's pairs are distinct, so their number is bounded."""
    m = n_core + 2
    buckets = max(1, min(n_core, 1 << 12))
    first, second = F.expr(f"pair div {m}"), F.col("pair") % m
    sides = pairs.select(first.alias("word"), second.alias("other"), F.lit(True).alias("after"), "n")
    sides = sides.unionAll(pairs.select(second, first, F.lit(False), "n")).where(F.col("word") < n_core)
    sides = sides.withColumn("bucket", (F.col("word") % buckets).cast("int"))
    tasks = min(buckets, 4 * pairs.sparkSession.sparkContext.defaultParallelism)
    return cut(sides.repartition(tasks, "bucket").groupBy("bucket").applyInArrow(_packed, _CONTEXTS), "contexts")


def exchange_core(pairs: DataFrame, order: np.ndarray, classes: int, seeds: int = SEEDS, rounds: int = ROUNDS, least_gain: float = LEAST_GAIN) -> tuple[np.ndarray, np.ndarray]:
    """Classes of the core's units, and the table of class pairs, by exchange rounds of Spark.

    ``pairs``: (pair, n) of units; ``order``: the core's units, most frequent first. The ``seeds`` first are exchanged one by one
    to begin with, the others begin in REST. In a round every word finds its best move, all others staying; all moves that gain are
    tried together, as are the half and the quarter with the higher gains, and the one that gains most likelihood is made. Where all of them
    lose it, the next halves are tried, down to the one best move, whose gain is exact; the next round begins with twice the part that gained.
    Rounds end when none moves, when they gain less than ``least_gain`` a token, or after ``rounds``.
    """
    spark = pairs.sparkSession
    n_core = len(order)
    seeds = min(seeds, n_core)
    to_seed = np.full(n_core + 2, seeds)
    to_seed[order[:seeds]] = np.arange(seeds)
    to_seed[n_core + 1] = seeds + 1
    seeded = exchange(_table_of(pairs, to_seed, seeds + 2), classes)
    own = np.full(n_core + 2, REST)
    own[order[:seeds]] = seeded[:seeds]
    own[n_core + 1] = END
    table = _table_of(pairs, own, classes)
    tokens, reached = table.sum(), likelihood(table)
    contexts = _contexts(pairs, n_core) if n_core and classes > 3 else None
    part = 1.0
    for _ in range(rounds if contexts is not None else 0):
        run = _proposals(spark.sparkContext.broadcast(own), spark.sparkContext.broadcast(table))
        moves = contexts.mapInArrow(lean(run), "word long, cls int, gain double").where("gain > 1e-9").collect()  # 1 / SHARE rows at most
        moves.sort(key=lambda r: (-r[2], r[0]))
        before, count = reached, max(1, int(len(moves) * part))
        while count and reached == before:
            trials = []
            for k in range(TRIALS):
                if count >> k:
                    trials.append(own.copy())
                    trials[-1][[r[0] for r in moves[: count >> k]]] = [r[1] for r in moves[: count >> k]]
            found = _tables_of(pairs, trials, classes) if moves else []
            best = max(range(len(found)), key=lambda k: likelihood(found[k]), default=None)
            if best is not None and likelihood(found[best]) > reached:
                own, table, reached = trials[best], found[best], likelihood(found[best])
                count >>= best
            else:
                count = count >> TRIALS if moves else 0
        part = min(1.0, 2 * max(1, count) / max(1, len(moves)))
        if reached - before <= least_gain * tokens:
            break
    return own, table


def _rest_events(core, own, bits: int):
    """Classes before and after each word outside the core, packed by buckets of words."""
    core, own = core.value, own.value

    def run(batches):
        m = len(core) + 2
        for _, h, bounds in _doc_words(batches):
            units, b = _units(h, bounds, core)
            cls = own[units].astype(np.uint8)
            after = np.append(cls[1:], np.uint8(END))
            before = _before(cls, b, END)
            rest = np.flatnonzero(units == m - 2)
            if not len(rest):
                continue
            words = h[units[units != m - 1] == m - 2].view(np.uint64)
            bucket = (words >> np.uint64(64 - bits)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            bucket = bucket[order]
            low = ((words >> np.uint64(32 - bits)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)[order]
            lefts, rights = before[rest][order], after[rest][order]
            cuts = np.flatnonzero(np.diff(bucket)) + 1
            spans = list(zip([0, *cuts], [*cuts, len(bucket)]))
            yield pa.RecordBatch.from_arrays(
                [pa.array([int(bucket[lo]) for lo, _ in spans], pa.int32()), *[pa.array([x[lo:hi].tobytes() for lo, hi in spans], pa.binary()) for x in (low, lefts, rights)]],
                names=["bucket", "low", "before", "after"],
            )

    return run


def _exchanged(affinity):
    """The class of each word of a bucket: the one whose transitions best explain the classes around it."""
    right_of, left_of = affinity.value  # [class before, candidate], [class after, candidate]

    def run(t: pa.Table) -> pa.Table:
        low, before, after = (np.frombuffer(b"".join(t[c].to_pylist()), k) for c, k in (("low", np.uint32), ("before", np.uint8), ("after", np.uint8)))
        order = np.argsort(low, kind="stable")
        low, before, after = low[order], before[order], after[order]
        words, starts = np.unique(low, return_index=True)
        out = np.zeros(len(words), np.int32)
        step = 4096
        for at in range(0, len(words), step):
            lo, hi = starts[at], starts[at + step] if at + step < len(words) else len(low)
            k = np.searchsorted(starts[at : at + step], np.arange(lo, hi), side="right") - 1
            n = min(step, len(words) - at)
            size = len(right_of)
            b = np.bincount(k * size + before[lo:hi], minlength=n * size).reshape(n, size)
            a = np.bincount(k * size + after[lo:hi], minlength=n * size).reshape(n, size)
            out[at : at + n] = (b @ right_of + a @ left_of).argmax(1)
        return pa.table({"key": (np.int64(t["bucket"][0].as_py()) << 32) + words.astype(np.int64), "cls": out})

    return run


def _block_words(batches):
    """The distinct words of each block among the texts that a worker holds."""
    held, size = {}, 0

    def flush():
        for b, hs in held.items():
            words = np.unique(np.concatenate(hs))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(words), b, np.int64)), pa.array(words)], names=["block", "word"])

    for batch in batches:
        block = batch.column(1).to_numpy()
        for b in np.unique(block):
            for _, h, _ in _doc_words([batch.filter(pa.array(block == b))]):
                held.setdefault(int(b), []).append(h)
                size += len(h)
        if size > HELD:
            yield from flush()
            held, size = {}, 0
    yield from flush()


def _read_block(constants):
    """Of each document of a block: sizes, base score, emission score and its class transitions."""
    v = constants.value

    def run(key, docs: pa.Table, words: pa.Table) -> pa.Table:
        w = words["word"].to_numpy()
        order = np.argsort(w)
        w, n_of, class_of = w[order], words["n"].to_numpy()[order], words["cls"].to_numpy()[order]
        unknown = v["classes"]
        mass, total = v["mass"], v["total"]
        out = {c: [] for c in ("doc_id", "held_out", "n_tokens", "n_known", "base_score", "emission")}
        moves, counts = [], []
        for batch in docs.select(["text", "doc_id", "held_out"]).combine_chunks().to_batches():
            for part, h, bounds in _doc_words([batch]):
                at = np.minimum(np.searchsorted(w, h), max(len(w) - 1, 0))
                known = (w[at] == h) if len(w) else np.zeros(len(h), bool)
                n = np.where(known, n_of[at] if len(w) else 0, 0)
                cls = np.where(known, class_of[at] if len(w) else 0, unknown)
                n = np.insert(n, bounds[1:], v["ends"])
                cls = np.insert(cls, bounds[1:], END if v["ends"] else unknown)
                b = bounds + np.arange(len(bounds))
                sums = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[b])
                out["doc_id"] += part.column(1).to_pylist()
                out["held_out"] += part.column(2).to_pylist()
                out["n_tokens"] += np.diff(b).tolist()
                out["n_known"] += sums((n > 0).astype(np.int64)).tolist()
                out["base_score"] += [float(np.log10((n[lo:hi] + 1) / total).sum()) for lo, hi in zip(b[:-1], b[1:])]
                if v["mass"] is None:  # the base alone
                    out["emission"] += [0.0] * len(part)
                    moves += [b""] * len(part)
                    counts += [b""] * len(part)
                    continue
                emission = np.where(cls == unknown, -np.log10(total), np.log10((n + 1) / mass[cls]) + v["known"])
                out["emission"] += [float(emission[lo:hi].sum()) for lo, hi in zip(b[:-1], b[1:])]
                pair = _before(cls, b, END) * (unknown + 1) + cls
                for lo, hi in zip(b[:-1], b[1:]):
                    p, k = np.unique(pair[lo:hi], return_counts=True)
                    moves.append(p.astype(np.uint16).tobytes())
                    counts.append(k.astype(np.uint32).tobytes())
        return pa.table({
            "doc_id": pa.array(out["doc_id"], pa.int64()), "held_out": pa.array(out["held_out"], pa.bool_()), "n_tokens": pa.array(out["n_tokens"], pa.int64()), "n_known": pa.array(out["n_known"], pa.int64()),
            "base_score": pa.array(out["base_score"], pa.float64()), "emission": pa.array(out["emission"], pa.float64()), "moves": pa.array(moves, pa.binary()), "counts": pa.array(counts, pa.binary()),
        })

    return run


def _transitions(size: int):
    def run(batches):
        table = np.zeros(size * size, np.int64)
        for batch in batches:
            for p, k in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                table[np.frombuffer(p, np.uint16)] += np.frombuffer(k, np.uint32)
        found = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(table[found])], names=["pair", "n"])

    return run


def _scored(log_moves, names):
    table = log_moves.value

    def run(batches):
        for batch in batches:
            add = [float(table[np.frombuffer(p, np.uint16)] @ np.frombuffer(k, np.uint32)) for p, k in zip(batch.column("moves").to_pylist(), batch.column("counts").to_pylist())]
            score = np.asarray(add, float) + batch.column("emission").to_numpy()
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(score)], names=[*names, "score"])

    return run


def _counted(docs: DataFrame, held_out):
    """The rows, the training texts, bytes of all texts; the training words with their counts, and how many tokens, words and ends they are."""
    _, size = corpus_size(docs)
    docs = docs.select("text", F.col("doc_id").cast("long"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    train = docs.where(~F.col("held_out")).select("text")
    counts = cut(train.mapInArrow(lean(_word_counts), "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "counts")
    n_tokens, types = (int(x or 0) for x in counts.agg(F.sum("n"), F.count(F.lit(1))).first())
    ends = counts.where(F.col("word") == _END_KEY).first()
    ends = int(ends[1]) if ends else 0
    return docs, train, size, counts, n_tokens, types, ends


def _read(docs: DataFrame, size: int, vocabulary: DataFrame, constants) -> DataFrame:
    """What ``_read_block`` finds, block by block, each with the words of the vocabulary that it holds."""
    blocks = max(1, -(-size // BLOCK_BYTES))
    dealt = docs.withColumn("block", F.pmod(F.xxhash64("doc_id", F.crc32("text")), F.lit(blocks)))
    words = dealt.select("text", "block").mapInArrow(lean(_block_words), "block long, word long").repartition("word").distinct().join(vocabulary, "word")
    return dealt.groupBy("block").cogroup(words.select("block", "word", "n", "cls").groupBy("block")).applyInArrow(
        _read_block(constants), "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, emission double, moves binary, counts binary",
    )


def base_scores(docs: DataFrame, held_out) -> DataFrame:
    """The columns of ``class_scores`` but for the class model's: the same counts and the same reading of the texts, no classes."""
    docs, _, size, counts, n_tokens, types, ends = _counted(docs, held_out)
    vocabulary = counts.where(F.col("word") != _END_KEY).select("word", "n", F.lit(REST).cast("int").alias("cls"))
    constants = docs.sparkSession.sparkContext.broadcast({"classes": CLASSES, "mass": None, "total": float(n_tokens + types + 1), "ends": ends})
    return _read(docs, size, vocabulary, constants).select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n_tokens).cast("long").alias("train_tokens"), "base_score")


def class_scores(docs: DataFrame, held_out, share: float = SHARE, classes: int = CLASSES, strength: float = 50.0) -> DataFrame:
    """Score each text by a class bigram model of the texts that are not held out.

    ``held_out``: boolean column of ``docs``. Returns (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), a row for
    each row; takes doc_id and text, ignores other columns. A null or empty text is an end alone. Without training
    texts every token is unknown. Equal texts get equal scores; ties between words of one count are broken by hash.

    All words of the training texts get a class. Those of at least ``share`` of all tokens, so 1 / share at most, are exchanged
    against each other on the counts of their pairs (``exchange_core``), in rounds that end when one gains less than LEAST_GAIN of log
    likelihood a token, or after ROUNDS: not always when no move gains. All others, whose classes no word's
    context depends on, are exchanged once: Spark gathers the classes around each of their places, and each goes to
    the class that explains them best. README says what the early end costs. Words are told apart by 64-bit hashes. Then
    log10 p(word | word before) = log10 p(class | class before) + log10 p(word | class), with transitions
    smoothed by ``strength`` counts of the classes' shares and emissions by adding one. An unknown word has the probability 1 / (N + V + 1) in every place.
    """
    spark = docs.sparkSession
    docs, train, size, counts, n_tokens, types, ends = _counted(docs, held_out)
    top = counts.where((F.col("word") != _END_KEY) & (F.col("n") >= share * n_tokens)).orderBy("word").collect()  # 1 / share rows at most
    core = np.array([r[0] for r in top], np.int64)
    shared = spark.sparkContext.broadcast(core)
    pairs = cut(train.mapInArrow(lean(_core_pairs(shared)), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")), "pairs")
    own, table = exchange_core(pairs, np.argsort([-r[1] for r in top], kind="stable").astype(np.int64), classes)
    expected = (table.sum(1)[:, None] + 1) * (table.sum(0)[None] + 1) / (table.sum() + 1)
    affinity = np.log((table + 1) / (expected + 1))
    forward, backward = affinity.copy(), affinity.T.copy()
    forward[:, END] = backward[:, END] = -1e9  # the end keeps a class of its own
    own_b, affinity_b = spark.sparkContext.broadcast(own), spark.sparkContext.broadcast((forward, backward))
    bits = power_of_two(size / 6 / 1_000_000, 64, 1 << 24).bit_length() - 1
    rest = cut(
        train.mapInArrow(lean(_rest_events(shared, own_b, bits)), "bucket int, low binary, before binary, after binary")
        .groupBy("bucket").applyInArrow(_exchanged(affinity_b), "key long, cls int"), "rest",
    )
    core_rows = spark.createDataFrame([(int(w), int(c)) for w, c in zip(core, own)] or [(0, 0)], "core_word long, core_cls int")  # 1 / share rows at most
    key = F.expr(f"shiftrightunsigned(word, {32 - bits})")
    vocabulary = counts.where(F.col("word") != _END_KEY).join(F.broadcast(core_rows), F.col("word") == F.col("core_word"), "left").withColumn("key", F.when(F.col("core_cls").isNull(), key))
    vocabulary = cut(vocabulary.join(rest, "key", "left").select("word", "n", F.coalesce("core_cls", "cls", F.lit(REST)).cast("int").alias("cls")), "vocabulary")

    mass = np.zeros(classes + 1)
    for c, n, k in vocabulary.groupBy("cls").agg(F.sum("n"), F.count(F.lit(1))).collect():
        mass[c] += n + k
    mass[END] += (ends + 1) * (ends > 0)
    total = float(n_tokens + types + 1)
    known = float(np.log10(1 - 1 / total)) if types else 0.0
    constants = spark.sparkContext.broadcast({"classes": classes, "mass": np.maximum(mass, 1), "total": total, "ends": ends, "known": known})
    read = cut(_read(docs, size, vocabulary, constants), "read")
    k = classes + 1
    found = read.where("not held_out").select("moves", "counts").mapInArrow(lean(_transitions(k)), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect()
    moves = np.zeros(k * k)
    for p, n in found:
        moves[p] = n
    moves = moves.reshape(k, k)
    share = mass / max(mass.sum(), 1)
    smooth = (moves + strength * share[None]) / (moves.sum(1)[:, None] + strength)
    log_moves = np.log10(np.maximum(smooth, 1e-300))
    log_moves[:, classes] = 0.0  # unknown words have their whole probability in the emission
    names = ["doc_id", "held_out", "n_tokens", "n_known", "base_score"]
    out = read.mapInArrow(lean(_scored(spark.sparkContext.broadcast(log_moves.ravel()), names)), "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n_tokens).cast("long").alias("train_tokens"), "base_score", "score")
