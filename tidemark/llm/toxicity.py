"""Toxicity by weak supervision: voters, a generative label model, a linear classifier on its posterior labels."""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, lean
from .filters import mark_partners

#: Labelled rows that the classifier is fitted to at most; voters, class sizes and anchors take all of them.
SAMPLE = 24_000
#: Common English words of abuse, the seed lexicon.
SEEDS = ("idiot", "moron", "stupid", "loser", "trash", "scum", "clown", "pathetic", "worthless", "disgusting")
STEM_LENGTHS = (4, 5, 6)
_KEPT_WORDS = 150_000
_KEPT_STEMS = 200_000
_NO_LETTERS = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))
#: Lexicons that the induced words and stems are dealt to; each is a voter of its own.
WORD_LISTS, STEM_LISTS = 3, 2
_LISTS = [("word", 0, k) for k in range(WORD_LISTS)] + [(f"stem {n}", n, k) for n in STEM_LENGTHS for k in range(STEM_LISTS)]
VOTERS = ("seed word", *[f"{kind}, list {k + 1}" for kind, _, k in _LISTS], "two words", "share", "spelled out", "shouted", "marks")
_BIT = {f"{n}/{k}": 1 << (1 + i) for i, (_, n, k) in enumerate(_LISTS)}
_TWO, _SHARE, _SPELLED, _SHOUTED, _MARKS = (1 << (1 + len(_LISTS) + k) for k in range(5))
_LEXICON_BITS = (1 << (1 + len(_LISTS))) - 1
_CAPITALS = re.compile(r"\b[A-Z]{4,}\b[^A-Za-z]+[A-Z]{3,}\b")


def voter_of(stem: str) -> int:
    """The bit of the lexicon that an induced word (0...) or stem (its length first) is in."""
    return _BIT[f"{stem[0]}/{zlib.crc32(stem.encode()) % (STEM_LISTS if stem[0] != '0' else WORD_LISTS)}"]


def distinct_words(text: str) -> set[bytes]:
    """Lower-cased runs of letters; bytes beyond ASCII count as letters."""
    return set(text.lower().encode().translate(_NO_LETTERS).split())


def stems(word: bytes) -> list[str]:
    w = word.decode("utf8", "replace")
    return [f"0{w}", *[f"{n}{w[:n]}" for n in STEM_LENGTHS if len(w) >= n]]


def _stem_counts(batches):
    """Documents of each label that hold each stem, and of each label at all under the empty stem; in parts of a bounded size."""
    counts: dict[str, list[int]] = {}
    kept: dict[bytes, list[str]] = {}

    def part():
        keys = list(counts)
        return pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.string()), pa.array([counts[k][1] for k in keys], pa.int64()), pa.array([counts[k][0] for k in keys], pa.int64())], names=["stem", "toxic", "clean"],
        )

    for batch in batches:
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            found = {""}
            for w in distinct_words(text or ""):
                if (of := kept.get(w)) is None:
                    of = kept[w] = stems(w)
                found.update(of)
            for s in found:
                counts.setdefault(s, [0, 0])[toxic] += 1
            if len(kept) > _KEPT_STEMS // 4:
                kept.clear()
            if len(counts) > _KEPT_STEMS:
                yield part()
                counts = {}
    yield part()


@dataclass
class Voters:
    """Induced stems with their numbers; turns a text into votes and stem numbers."""

    numbers: dict[str, int]
    kept: dict[bytes, tuple[tuple[int, ...], int]] = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return {"numbers": self.numbers, "kept": {}}

    def read(self, text: str | None) -> tuple[int, list[int]]:
        """Votes as bits, in the order of VOTERS, and the numbers of the stems found."""
        if len(self.kept) > _KEPT_WORDS:
            self.kept.clear()
        found: set[int] = set()
        votes = marked = 0
        words = distinct_words(text or "")
        for w in words:
            hit = self.kept.get(w)
            if hit is None:
                numbers, bits = [], 0
                for s in stems(w):
                    if (k := self.numbers.get(s)) is not None:
                        numbers.append(k)
                        bits |= voter_of(s)
                if w.decode("utf8", "replace") in SEEDS:
                    bits |= 1
                hit = self.kept[w] = (tuple(numbers), bits)
            if hit[1]:
                votes |= hit[1]
                found.update(hit[0])
                marked += 1
        if marked >= 2:
            votes |= _TWO
        if marked and marked >= 0.005 * len(words):
            votes |= _SHARE
        text = text or ""
        if not votes & _LEXICON_BITS and any(len(w) == 1 for w in words):  # letters set apart
            joined = text.lower()
            if any(sign.join(s) in joined for sign in " .-*_" for s in SEEDS):
                votes |= _SPELLED
        if _CAPITALS.search(text):
            votes |= _SHOUTED
        if "!!" in text or "?!" in text:
            votes |= _MARKS
        return votes, sorted(found)


def _chosen(toxic_rows: int, clean_rows: int, tried: int):
    """Stems whose share of toxic documents can't be chance, with the chance's logarithm.

    The chance that as many of a stem's documents are toxic at the base rate, with smoothing for the clean ones, is
    held against the number of stems that were tried.
    """
    rate = (toxic_rows + 1) / (toxic_rows + clean_rows + 2)
    most = math.log(0.1 / max(1, tried))

    def run(batches):
        for batch in batches:
            found = []
            for stem, a, b in zip(*(batch.column(i).to_pylist() for i in range(3))):
                chance = math.lgamma(a + b + 1) - math.lgamma(a + 1) - math.lgamma(b + 1) + a * math.log(rate) + b * math.log(1 - rate)
                if chance < most:
                    found.append((stem, chance))
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=["stem", "chance"])

    return run


#: Correlations below this count as none.
NOISE = 0.1


class LabelModel:
    """Accuracies and correlations of voters by expectation maximisation over counts of vote patterns.

    A voter fires or abstains. Given the hidden label, voters count as independent but for their
    correlation: a voter's evidence is divided by what it shares with the others, estimated from the votes' covariances
    within the labels in each round.
    """

    def __init__(self, patterns: np.ndarray, counts: np.ndarray, known: np.ndarray, rounds: int = 25):
        """``known``: for each pattern, labelled clean and toxic rows; they anchor the labels."""
        v = (patterns[:, None] >> np.arange(len(VOTERS))) & 1
        self.weights = np.ones(len(VOTERS))
        p = np.where(v.any(1), 0.9, 0.02)
        n = counts.astype(float)
        for _ in range(rounds):
            fixed = known.sum(1)
            toxic, clean = np.maximum(n - fixed, 0) * p + known[:, 1], np.maximum(n - fixed, 0) * (1 - p) + known[:, 0]
            self.base = (toxic.sum() + 1) / (toxic.sum() + clean.sum() + 2)
            self.fires = np.stack([(w @ v + 0.1) / (w.sum() + 0.2 + 1e-9) for w in (clean, toxic)])
            shared = np.zeros((len(VOTERS), len(VOTERS)))
            for w, q in zip((clean, toxic), self.fires):
                x = v - q
                cov = (x * w[:, None]).T @ x / max(w.sum(), 1)
                sd = np.sqrt(np.maximum(np.diag(cov), 1e-6))
                shared += 0.5 * np.clip(cov / sd[:, None] / sd[None], 0, 1)
            shared[shared < NOISE] = 0
            np.fill_diagonal(shared, 0)
            self.correlations = shared
            self.weights = 1 / (1 + shared.sum(1))
            p = self.posterior(patterns)

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        v = (patterns[:, None] >> np.arange(len(VOTERS))) & 1
        on, off = np.log(self.fires[1] / self.fires[0]), np.log((1 - self.fires[1]) / (1 - self.fires[0]))
        logit = math.log(self.base / (1 - self.base)) + (np.where(v, on, off) * self.weights).sum(1)
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def fit_linear(rows: list[tuple[list[int], int]], target: np.ndarray, stems_count: int, rounds: int = 300, ridge: float = 0.02) -> np.ndarray:
    """Logistic regression on stems and votes against soft labels; the last weight is the intercept."""
    width = stems_count + len(VOTERS) + 1
    r = np.concatenate([np.full(len(f) + bin(v).count("1") + 1, i) for i, (f, v) in enumerate(rows)]).astype(np.int64)
    c = np.concatenate([[*f, *[stems_count + k for k in range(len(VOTERS)) if v >> k & 1], width - 1] for f, v in rows]).astype(np.int64)
    w, m, s = np.zeros(width), np.zeros(width), np.zeros(width)
    for t in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(r, w[c], len(rows)), -30, 30)))
        g = np.bincount(c, (p - target)[r], width) / len(rows)
        g[:-1] += ridge * w[:-1] / len(rows)
        m, s = 0.9 * m + 0.1 * g, 0.99 * s + 0.01 * g * g
        w -= 0.2 * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.99**t)) + 1e-9)
    return w


def _votes(voters):
    voters = voters.value

    def run(batches):
        for batch in batches:
            found = [voters.read(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int32()), batch.column(1), pa.array([f[1] for f in found], pa.list_(pa.int32()))], names=["votes", "toxic", "stems"])

    return run


def _patterns(voters):
    voters = voters.value

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([voters.read(t)[0] for t in batch.column(0).to_pylist()], pa.int32())], names=["doc_id", "votes"])

    return run


def _scorer(model):
    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        voters, weights = model.value
        n = len(weights) - len(VOTERS) - 1
        for batch in texts:
            out = []
            for t in batch.to_pylist():
                votes, found = voters.read(t)
                z = weights[-1] + weights[found].sum() + sum(weights[n + k] for k in range(len(VOTERS)) if votes >> k & 1)
                out.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
            yield pa.array(out, pa.float64())

    return run


def train_toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE):
    """(voters, weights) of the classifier. ``labels``: doc_id, toxic; rows with a null in either are left out, the highest of several labels counts.

    Voters and the anchors of the label model are counted over all labelled rows, vote patterns over all documents; only the
    classifier is fitted to a sample, the posterior labels of at most ``sample`` labelled rows, drawn by a hash of doc_id.
    """
    spark = docs.sparkSession
    known = labels.select(F.col("doc_id"), F.col("toxic").cast("int")).dropna().where("toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = cut(known, "known")
    n_known = known.count()
    share = min(1.0, sample / max(1, n_known))
    drawn = known.where(F.pmod(F.xxhash64(F.col("doc_id"), F.lit(3)), F.lit(1_000_000)) < F.lit(int(share * 1_000_000)))
    # labels grow with the documents, so they are never broadcast whole: a filter of bounded size leaves out the texts that have
    # none, and the others meet their labels in a shuffle, at every size the same
    some = mark_partners(docs.select("doc_id", "text").withColumn("_name", F.xxhash64("doc_id")), "_name", known.select(F.xxhash64("doc_id").alias("name")), n_known)
    learn = some.where("_maybe").select("doc_id", "text").join(known.hint("shuffle_hash"), "doc_id").select("text", "toxic")
    counts = learn.mapInArrow(lean(_stem_counts), "stem string, toxic long, clean long").groupBy("stem").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    counts = cut(counts.where("toxic + clean >= 3 or stem = ''"), "stems")
    sizes = counts.where("stem = ''").first() or ("", 0, 0)
    tried = counts.where("toxic + clean >= 3 and stem <> ''").count()
    # only what passes comes to the driver
    passed = counts.where("stem <> '' and toxic >= 3 and toxic > 4 * clean").mapInArrow(_chosen(int(sizes[1]), int(sizes[2]), tried), "stem string, chance double")
    chosen = [s for _, s in sorted((float(r[1]), r[0]) for r in passed.collect())]
    voters = Voters({s: k for k, s in enumerate(chosen)})
    shared = spark.sparkContext.broadcast(voters)
    # at most about ``sample`` rows of two numbers
    fitted = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").select("text", "toxic")
    rows = [(list(r[2]), int(r[0]), int(r[1])) for r in fitted.mapInArrow(lean(_votes(shared)), "votes int, toxic int, stems array<int>").collect()]
    votes = docs.select("text", "doc_id").mapInArrow(lean(_patterns(shared)), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, votes int")
    patterns = votes.join(known, "doc_id", "left").groupBy("votes", "toxic").agg(F.count(F.lit(1)).alias("n")).collect()  # three rows of a pattern, of 2^15 patterns at most
    found = sorted({int(r[0]) for r in patterns} | {0})
    at = {p: k for k, p in enumerate(found)}
    n, anchors = np.zeros(len(found)), np.zeros((len(found), 2))
    for votes, toxic, many in patterns:
        n[at[int(votes)]] += many
        if toxic is not None:
            anchors[at[int(votes)], toxic] += many
    model = LabelModel(np.array(found), n, anchors)
    if not rows:
        rows = [([], 0, 0)]
    target = model.posterior(np.array([r[1] for r in rows]))
    weights = fit_linear([(f, v) for f, v, _ in rows], target, len(chosen))
    return voters, weights


def score_toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``docs`` with score, 0 to 1: likelihood that labels mark the text toxic. A score depends on the text alone.

    Null and empty texts get the score of a text without any vote. Repeated rows get equal scores; without labels the seed
    lexicon decides; an empty table gives no rows; a column named score is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(train_toxicity(docs, labels, sample))
    score = F.arrow_udf(_scorer(shared), "double")
    return docs.select(*[F.col(f"`{c}`") for c in docs.columns if c != "score"], score(F.col("text")).alias("score"))
