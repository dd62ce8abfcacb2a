"""Personal data: fixed patterns as seeds, and spans found by bootstrapped contextual extraction."""

from __future__ import annotations

import itertools
import re
from bisect import bisect_left

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

KINDS = ("email", "ip", "card", "phone")
#: Confidence that a pattern must reach; distinct documents it must be seen in; rounds of scoring end when no belief moves by more than STILL.
CONFIDENT, SUPPORT, STILL = 0.8, 3, 0.01
#: A round from which on beliefs move by ever smaller shares of what is found, so that rounds do end.
DAMPED = 8
#: Words of context on each side of a candidate, and characters of each.
CONTEXT, NEAREST = 2, 60

#: The seed patterns. Look-behinds only skip starts that give no other match.
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_CONTACT = re.compile(r"[0-9@]")
_TOKEN = re.compile(r"[^\s\"'<>()\[\]{},;]+")
_NUMBER = re.compile(r"[0-9+][0-9.-]*")
_GAPS = (" ", "(", ")", " (", ") ")
_DIGITS = re.compile(r"[^0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str):
    """Leftmost matches; each @ takes the run of local characters before it, so no start is tried twice."""
    at, done = text.find("@"), 0
    while at >= 0:
        lo = at
        while lo > done and text[lo - 1] in _LOCAL:
            lo -= 1
        if lo < at and (m := _EMAIL.match(text, lo)):
            yield m.start(), m.end()
            done = m.end()
        at = text.find("@", at + 1)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then kind as listed: leftmost non-overlapping matches of each kind; failing ones are dropped."""
    found = []
    if "@" in text:
        found += [("email", lo, hi) for lo, hi in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
            found.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = _DIGITS.sub("", m[0])
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_DIGITS.sub("", m[0])) <= 15:
                found.append(("phone", *m.span()))
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def _shape(token: str) -> str:
    """The token's make-up: classes of characters, runs as one but for digits, so that a date is not of a phone number's shape."""
    out = []
    for c in token:
        k = "9" if c.isdigit() else "a" if c.isalpha() else c
        if k == "9" or not out or out[-1] != k:
            out.append(k)
    shape = "".join(out)
    return shape if len(shape) <= 24 else f"{shape[:24]}~{xxhash.xxh3_64_hexdigest(shape)}"


def _looks_identifying(token: str) -> bool:
    """At least six characters with several digits, or an @ inside."""
    digits = sum(c.isdigit() for c in token)
    return len(token) >= 6 and (digits >= 4 or "@" in token[1:-1])


def _secret_form(token: str) -> str | None:
    """Kinds of characters and length of a token that looks like a key: long, without blanks, letters and digits by turns; else None."""
    if len(token) < 16 or "@" in token or " " in token:
        return None
    kinds = ["9" if c.isdigit() else "a" if c.isalpha() else c for c in token]
    turns = sum({x, y} == {"a", "9"} for x, y in zip(kinds, kinds[1:]))
    return f"{''.join(sorted(set(kinds)))}:{len(token)}" if turns >= 3 else None


def _number_runs(line: str, tokens: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The tokens, with adjacent ones of digits as one, and the brackets inside."""
    out: list[tuple[int, int]] = []
    numbers = False
    for a, b in tokens:
        number = bool(_NUMBER.fullmatch(line, a, b))
        if number and numbers and line[out[-1][1] : a] in _GAPS:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
        numbers = number
    return [(a - (line[a - 1 : a] == "(" and ")" in line[a:b] and "(" not in line[a : line.index(")", a)]), b) for a, b in out]


def _contexts(text: str, spans: list[tuple[str, int, int]]) -> list[tuple[int, int, str, str, str | None, str | None]]:
    """(start, end, lexical pattern, shape, kind, form of a secret) of seeds and of other tokens or runs of numbers that look identifying.

    A lexical pattern is the words before or the words after on the same line, digits left out; those after are marked with > and end
    with the nearest, as those before do.
    """
    found = []
    for at in _seeded_lines(text, spans):
        lo, hi, own = at
        line = text[lo:hi]
        taken = [(a - lo, b - lo, k) for k, a, b in own]
        places = [(a, b, k) for a, b, k in taken]
        tokens = [(m.start(), m.start() + len(m[0].rstrip(".!?:"))) for m in _TOKEN.finditer(line)]
        tokens = [(x, y) for x, y in tokens if x < y and not any(x < b and a < y for a, b, _ in taken)]
        places += [(x, y, None) for x, y in _number_runs(line, tokens) if _looks_identifying(line[x:y])]
        around = _Words(line) if places else None
        for a, b, kind in places:
            shape, form = _shape(line[a:b]), None if kind else _secret_form(line[a:b])
            sides = around.before(a), [f"{w}>" for w in around.after(b)[::-1]]
            found += [(lo + a, lo + b, " ".join(side), shape, kind, form) for side in sides if side]
    return found


_WORD = re.compile(r"\S+")
_SIGNS = frozenset("=:")


class _Words:
    """A line's words without anything but letters and signs of assignment; those that have none are left out.

    Of a word of more than NEAREST characters the ones next to the candidate count: a line may be one word with candidates all over it.
    """

    def __init__(self, line: str):
        self.line = line
        self.spans = [m.span() for m in _WORD.finditer(line) if any(c.isalpha() or c in _SIGNS for c in m[0])]
        self.starts, self.ends = [a for a, _ in self.spans], [b for _, b in self.spans]

    def _near(self, spans) -> list[str]:
        out: list[str] = []
        for a, b in spans:
            if word := "".join(c for c in self.line[a:b].lower() if c.isalpha() or c in _SIGNS):
                out.append(word)
                if len(out) == CONTEXT:
                    break
        return out

    def before(self, at: int) -> list[str]:
        """The last words that begin before ``at``, the nearest last; of one that goes on beyond it the part before."""
        k = bisect_left(self.starts, at)
        return self._near((max(a, min(b, at) - NEAREST), min(b, at)) for a, b in (self.spans[i] for i in range(k - 1, -1, -1)))[::-1]

    def after(self, at: int) -> list[str]:
        """The first words that end after ``at``; of one that begins before it the part after."""
        k = bisect_left(self.ends, at + 1)
        return self._near((max(a, at), min(b, max(a, at) + NEAREST)) for a, b in (self.spans[i] for i in range(k, len(self.spans))))


def _seeded_lines(text: str, spans):
    """Lines with a digit or an @: bounds and the seeds inside."""
    lo = k = 0
    while lo <= len(text):
        hi = text.find("\n", lo)
        hi = len(text) if hi < 0 else hi
        own = []
        while k < len(spans) and spans[k][1] < hi:
            if spans[k][2] <= hi:
                own.append(spans[k])
            k += 1
        if own or _CONTACT.search(text, lo, hi):
            yield lo, hi, own
        lo = hi + 1


def joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _scan(batches):
    for batch in batches:
        out = [[] for _ in range(8)]
        for uid, doc, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
            text = text or ""
            spans = base_spans(text)
            kinds = [k for k, _, _ in spans]
            marked = [{"lo": a, "hi": b, "pattern": p, "shape": s, "kind": k, "form": f} for a, b, p, s, k, f in _contexts(text, spans)]
            base = joined(spans)
            for col, v in zip(out, (uid, doc, *[kinds.count(k) for k in KINDS], base, marked)):
                col.append(v)
        yield pa.RecordBatch.from_arrays(
            [*[pa.array(c, pa.int64()) for c in out[:6]], pa.array(out[6], pa.string()), pa.array(out[7], _MARKS)],
            names=["uid", "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base", "marks"],
        )


_MARKS = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64()), ("pattern", pa.string()), ("shape", pa.string()), ("kind", pa.string()), ("form", pa.string())]))
_SCANNED = "uid long, doc_id long, n_email long, n_ip long, n_card long, n_phone long, base string, marks array<struct<lo: long, hi: long, pattern: string, shape: string, kind: string, form: string>>"


def confident_patterns(marks: DataFrame, confident: float = CONFIDENT, support: int = SUPPORT, still: float = STILL) -> DataFrame:
    """(pattern, kind, confidence): contexts whose candidates are identifying with enough confidence.

    ``marks``: uid, pattern, shape, kind (of seeds; null: unknown), form (of what looks like a key, else null). The graph joins each lexical pattern with the
    instances it stands next to, an instance being a shape, or a form for what looks like a key, of one kind or none. A pattern's confidence in a kind is the mean belief of its
    instances; an unknown instance's belief in a kind is one minus the product of the doubts of its patterns, damped.
    Seeds keep belief 1 in their kind. Rounds go on until no belief moves by more than ``still``. Patterns of fewer than ``support`` documents are never confident.

    Secrets have no pattern of their own as seeds. Their seeds are keys (``_secret_form``) in contexts that end in a sign of assignment and whose
    candidates are, by the share ``confident`` at least, of that one form in enough documents; such a context is confident itself, others become so on the graph.
    """
    of_form = marks.where(F.col("pattern").rlike("[=:]$")).groupBy("pattern", "form").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("uid").alias("docs"))
    top = F.max(F.when(F.col("form").isNotNull(), F.struct("n", "docs", "form"))).alias("top")
    assigned = of_form.groupBy("pattern").agg(F.sum("n").alias("all"), top).select("pattern", F.col("top.form").alias("form"), (F.col("top.n") / F.col("all")).alias("confidence"), F.col("top.docs").alias("docs"))
    assigned = cut(assigned.where(F.col("docs") >= support).where(F.col("confidence") >= confident).select("pattern", "form", "confidence"), "assigned")

    edges = marks.groupBy("pattern", F.coalesce("form", "shape").alias("shape"), "kind").agg(F.count(F.lit(1)).alias("n"))
    keys = assigned.select("pattern", F.col("form").alias("shape"), F.lit("secret").alias("as"))
    edges = cut(edges.join(keys, ["pattern", "shape"], "left").select("pattern", "shape", F.coalesce("kind", "as").alias("kind"), "n"), "edges")
    # each document counts once for a pattern, whatever the shapes
    support_of = marks.select("pattern", "uid").distinct().groupBy("pattern").agg(F.count(F.lit(1)).alias("docs")).where(F.col("docs") >= support)
    support_of = cut(support_of, "support")
    total = edges.groupBy("pattern").agg(F.sum("n").alias("all"))
    known = edges.where("kind is not null").groupBy("pattern", "kind").agg(F.sum("n").cast("double").alias("b")).join(total, "pattern")
    known = cut(known.select("pattern", "kind", "b", "all"), "known")
    unknown = cut(edges.where("kind is null").join(total, "pattern").select("pattern", "shape", "n", "all"), "unknown")
    seeds = edges.where("kind is not null").groupBy("shape", "kind").agg(F.sum("n").alias("n"))
    left = unknown.groupBy("shape").agg(F.sum("n").alias("u"))
    # an unknown shape begins with the share of its places that are seeds
    belief = cut(seeds.join(left, "shape").select("shape", "kind", (F.col("n") / (F.col("n") + F.col("u"))).alias("belief")), "belief")

    def patterns(belief: DataFrame) -> DataFrame:
        guessed = unknown.join(belief, "shape").select("pattern", "kind", (F.col("n") * F.col("belief")).alias("b"), "all")
        return known.union(guessed).groupBy("pattern", "kind").agg((F.sum("b") / (F.max("all") + 1)).alias("confidence"))

    for k in itertools.count():
        before, scored = belief, patterns(belief)
        through = unknown.join(scored.where("confidence >= 0.3"), "pattern")
        doubts = F.log1p(-F.least(F.lit(0.95), F.col("confidence") * 0.9)) * F.least(F.lit(1.0), F.col("n") / 3)
        both = through.select("shape", "kind", doubts.alias("doubt"), F.lit(0.0).alias("belief")).union(before.select("shape", "kind", F.lit(0.0), "belief"))
        both = both.groupBy("shape", "kind").agg(F.max("belief").alias("was"), (1 - F.exp(F.sum("doubt"))).alias("found"))
        step = (F.col("found") - F.col("was")) / max(1, k - DAMPED)
        moved = cut(both.select("shape", "kind", (F.col("was") + step).alias("belief"), F.abs(step).alias("moved")), "belief")
        belief = moved.drop("moved")
        if (moved.agg(F.max("moved")).first()[0] or 0.0) <= still:
            break
    scored = cut(patterns(before), "patterns")
    strong = scored.where(F.col("confidence") >= confident).join(support_of, "pattern", "left_semi").select("pattern", "kind", "confidence")
    both = strong.union(assigned.select("pattern", F.lit("secret"), "confidence"))
    return both.groupBy("pattern").agg(F.max_by("kind", F.struct("confidence", "kind")).alias("as"), F.max("confidence").alias("confidence"))


def last_word(pattern):
    return F.element_at(F.split(pattern, " "), -1)


def extract_pii(docs: DataFrame) -> DataFrame:
    """Personal data of each text.

    Returns (doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans), a row for each row; takes doc_id and text and
    ignores other columns. Counts and base_sha256 are those of the seeds; spans are the seeds' and those that confident contexts
    add, as kind:start:end by start, in code points, end exclusive. An added span never overlaps a seed. A null text is
    empty and has no spans. Equal rows get equal results; an empty table gives no rows. Rows are told apart by a 64-bit hash of doc_id and text.

    The seeds' contexts are gathered over all texts, scored with all other candidates on a graph of patterns and instances, and
    candidates in contexts of enough confidence and support are added.
    """
    d = docs.select(F.xxhash64("doc_id", "text").alias("uid"), F.col("doc_id").cast("long"), "text")
    scanned = cut(d.mapInArrow(_scan, _SCANNED), "scanned")
    marks = scanned.select("uid", F.explode("marks").alias("m")).select("uid", "m.*")
    # two-word contexts and their last words alone
    tail = marks.where(F.col("pattern").contains(" ")).withColumn("pattern", last_word("pattern"))
    patterns = cut(confident_patterns(marks.union(tail).select("uid", "pattern", "shape", "kind", "form")), "confident")
    open_marks = marks.where("kind is null").select("uid", "lo", "hi", "form", "pattern", last_word("pattern").alias("tail"))
    p = patterns.select("pattern", F.col("as").alias("kind"))
    hits = open_marks.join(p, "pattern").select("uid", "lo", "hi", "form", "kind").union(
        open_marks.where("tail <> pattern").join(p.withColumnRenamed("pattern", "tail"), "tail").select("uid", "lo", "hi", "form", "kind")
    ).where("kind <> 'secret' or form is not null")
    added = hits.groupBy("uid", "lo", "hi").agg(F.min("kind").alias("kind")).groupBy("uid").agg(F.collect_list(F.struct("lo", "hi", "kind")).alias("added"))
    base = F.transform(F.filter(F.split("base", ","), lambda s: s != ""), lambda s: F.struct(
        F.element_at(F.split(s, ":"), 2).cast("long").alias("lo"), F.element_at(F.split(s, ":"), 3).cast("long").alias("hi"), F.element_at(F.split(s, ":"), 1).alias("kind"),
    ))
    rank = F.create_map(*[F.lit(x) for k, name in enumerate((*KINDS, "secret")) for x in (name, k)])
    every = F.array_sort(F.transform(F.concat(base, F.coalesce("added", F.array().cast("array<struct<lo: long, hi: long, kind: string>>"))), lambda s: F.struct(
        s["lo"].alias("lo"), F.element_at(rank, s["kind"]).alias("k"), s["hi"].alias("hi"), s["kind"].alias("kind"),
    )))
    spans = F.array_join(F.transform(every, lambda s: F.concat_ws(":", s["kind"], s["lo"].cast("string"), s["hi"].cast("string"))), ",")
    return scanned.join(added, "uid", "left").select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), spans.alias("spans"))
