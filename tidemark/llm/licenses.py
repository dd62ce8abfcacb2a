"""License scans: exact containment join of text blocks with license templates."""

from __future__ import annotations

import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Phrases that mark a license wherever their words stand consecutively.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Sentences of public licenses and notices; a block holds one if it has enough of its words.
TEMPLATES = {
    "licensed under the apache license version 2 0": "apache-2.0",
    "licensed under the apache license version 1 0": "apache",
    "licensed under the apache license version 1 1": "apache",
    "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0": "apache-2.0",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "apache-2.0",
    "licensed under the gnu general public license": "gpl",
    "this work is licensed under the gnu general public license version 2": "gpl-2.0",
    "this work is licensed under the gnu general public license version 3": "gpl-3.0",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation": "gpl",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license": "gpl",
    "you should have received a copy of the gnu general public license along with this program": "gpl",
    "licensed under the gnu lesser general public license": "lgpl",
    "this work is licensed under the gnu lesser general public license version 3": "lgpl",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation": "lgpl",
    "you should have received a copy of the gnu lesser general public license along with this library": "lgpl",
    "licensed under the gnu affero general public license": "agpl",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation": "agpl",
    "licensed under cc by 4 0": "cc-by-4.0",
    "licensed under cc by nc 4 0": "cc-by-nc-4.0",
    "licensed under cc by nd 4 0": "cc-by-nd-4.0",
    "licensed under cc by sa 4 0": "cc-by-sa-4.0",
    "licensed under cc by nc nd 4 0": "cc-by-nc-nd-4.0",
    "licensed under cc by nc sa 4 0": "cc-by-nc-sa-4.0",
    "this work is licensed under a creative commons attribution 4 0 international license": "cc-by-4.0",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files": "mit",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "mit",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "isc",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation": "bsd",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd",
    "subject to the terms of the mozilla public license v 2 0": "mpl-2.0",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl-2.0",
    "licensed under the mozilla public license version 2 0": "mpl-2.0",
    "licensed under the eclipse public license version 2 0": "epl-2.0",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "all rights reserved no part of this publication may be reproduced": "all-rights-reserved",
}
#: Share of a template's weight that a block must hold.
THRESHOLD = 0.8
_SLACK = 1e-9


def _weights() -> dict[str, float]:
    """A word's weight: the fewer templates hold it, the more it tells them apart. From the templates alone, so no corpus changes a result."""
    n = Counter(w for t in TEMPLATES for w in set(t.split()))
    return {w: math.log((len(TEMPLATES) + 1) / k) for w, k in sorted(n.items())}


WEIGHTS = _weights()


def span_of(template: str) -> int:
    """Consecutive words that a match may take: the template's own, a quarter more and two."""
    n = len(template.split())
    return n + n // 4 + 2


def weight_of(words) -> float:
    return math.fsum(WEIGHTS[w] for w in words)


_TABLE = bytes(b if b >= 128 or chr(b).isdigit() or chr(b).islower() else 32 for b in (x + 32 if 65 <= x <= 90 else x for x in range(256)))


def words_of(text: str) -> list[bytes]:
    """Runs of 0-9, a-z and characters beyond ASCII, after lower-casing A-Z."""
    return text.encode("utf8", "surrogatepass").translate(_TABLE).split()


def _vocabulary() -> set[bytes]:
    return {w.encode() for w in WEIGHTS}


def _token_counts(batches):
    """How often each template word occurs."""
    wanted = _vocabulary()
    counts = dict.fromkeys(wanted, 0)
    for batch in batches:
        for text in batch.column(0).to_pylist():
            words = words_of(text or "")
            if not wanted.isdisjoint(words):
                for w in words:
                    if w in counts:
                        counts[w] += 1
    yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in counts]), pa.array(list(counts.values()), pa.int64())], names=["token", "n"])


def phrase_places(words: list[bytes], phrases: list[tuple[list[bytes], str]]) -> list[tuple[int, str]]:
    """(first word, label) of every place of every phrase."""
    found = []
    for phrase, label in phrases:
        at = -1
        while True:
            try:
                at = words.index(phrase[0], at + 1)
            except ValueError:
                break
            if words[at : at + len(phrase)] == phrase:
                found.append((at, label))
    return found


def _base(batches):
    phrases = [([w.encode() for w in p.split()], label) for p, label in PHRASES.items()]
    signs = re.compile("|".join(p.split()[0] for p in PHRASES), re.I)
    for batch in batches:
        out = [], [], [], [], []
        for text in batch.column(0).to_pylist():
            text = text or ""
            words = words_of(text)
            places = phrase_places(words, phrases) if signs.search(text) else []
            starts = [p for p, _ in places]
            for col, v in zip(out, (len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places})))):
                col.append(v)
        yield pa.RecordBatch.from_arrays(
            [batch.column(1), batch.column(2), *[pa.array(c, pa.int64()) for c in out[:4]], pa.array(out[4], pa.string())],
            names=["doc_id", "uid", "n_words", "n_base", "first_word", "last_word", "base_labels"],
        )


def _blocks(rank: dict[str, int], prefix: set[str], least: float):
    """Blocks that hold a word of some template's prefix: their distinct template words in global order, the rarest first, the weight from each on; and all words in place, others empty.

    A block is a window of consecutive words, across line ends. Windows are twice as long as the longest match and start one such length
    apart, so each match lies whole in one.
    """
    ranks = {k.encode(): v for k, v in rank.items()}
    wanted = {k.encode() for k in prefix}
    step = max(map(span_of, TEMPLATES))

    def run(batches):
        for batch in batches:
            at, blocks, tokens, rests, whole = [], [], [], [], []
            for row, text in enumerate(batch.column(0).to_pylist()):
                words = words_of(text or "")
                if wanted.isdisjoint(words):
                    continue
                near = {k // step for k, w in enumerate(words) if w in wanted}
                for k in sorted(near | {k - 1 for k in near if k}):
                    part = words[k * step : (k + 2) * step]
                    found = [w.decode() for w in sorted({w for w in part if w in ranks}, key=ranks.__getitem__)]
                    rest = [weight_of(found[i:]) for i in range(len(found))]
                    if found and rest[0] >= least - _SLACK:
                        at.append(row)
                        blocks.append(k * step)
                        tokens.append(found)
                        rests.append(rest)
                        whole.append([w.decode() if w in ranks else "" for w in part])
            ids = batch.select([1, 2]).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*ids.columns, pa.array(blocks, pa.int64()), pa.array(tokens, pa.list_(pa.string())), pa.array(rests, pa.list_(pa.float64())), pa.array(whole, pa.list_(pa.string()))],
                names=["uid", "doc_id", "block", "tokens", "rests", "whole"],
            )

    return run


def places_of(words: list[str], template: str, threshold: float) -> list[tuple[int, int, float]]:
    """(first word, end, share) of the template's places: runs of at most ``span_of`` words that hold ``threshold`` of its weight.

    Of runs that overlap, the one of the greatest share, then the first, is the place; and so on beside it. It begins and ends with words of the template.
    """
    wanted = set(template.split())
    span, full = span_of(template), weight_of(wanted)
    at = [k for k, w in enumerate(words) if w in wanted]
    runs = []
    for k in at:
        held = {w for w in words[k : k + span] if w in wanted}
        share = weight_of(sorted(held)) / full
        if share >= threshold - _SLACK:
            # up to where the last of its words first stands
            end = max(words.index(w, k) for w in held) + 1
            runs.append((-share, k, end))
    out: list[tuple[int, int, float]] = []
    for share, lo, hi in sorted(runs):
        if all(hi <= a or lo >= b for a, b, _ in out):
            out.append((lo, hi, -share))
    return sorted(out)


def _verified(threshold: float):
    names = list(TEMPLATES)

    def run(batches):
        for batch in batches:
            at, cols = [], ([], [], [], [])
            for row, (name, block, words) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("name", "block", "whole")))):
                for lo, hi, share in places_of(words, names[name], threshold):
                    at.append(row)
                    for col, v in zip(cols, (name, block + lo, block + hi, share)):
                        col.append(v)
            ids = batch.select(["uid", "doc_id"]).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*ids.columns, pa.array(cols[0], pa.int32()), *[pa.array(c, pa.int64()) for c in cols[1:3]], pa.array(cols[3], pa.float64())], names=["uid", "doc_id", "name", "first", "end", "share"])

    return run


def template_places(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(uid, doc_id, name, first, end, share): every place of every template in the texts of ``docs`` (text, uid, doc_id), by a block join.

    A word's weight is ``WEIGHTS``; a block holds a template where a run of at most ``span_of`` words has at least ``threshold`` of the weight
    of its distinct words. Words are ordered by their number in all documents, the rarest first. The words of a template from
    which on less than the weight needed is left are not in its prefix; so a block that holds it has a word of the prefix. Blocks and
    templates are joined on the first prefix word they share. A pair goes on only if the block's words weigh enough in all (length)
    and those from that word on, in both, can still make up enough (position); then it is verified on the block's words in place.
    Nothing but the threshold decides, so no place is missed.
    """
    spark = docs.sparkSession
    counts = docs.select("text").mapInArrow(_token_counts, "token string, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()  # the templates' words
    counts = {w: 0 for w in WEIGHTS} | {r[0]: int(r[1]) for r in counts}
    rank = {w: k for k, w in enumerate(sorted(counts, key=lambda w: (counts[w], w)))}
    rows, prefixes, least = [], set(), math.inf
    for name, template in enumerate(TEMPLATES):
        tokens = sorted(set(template.split()), key=rank.__getitem__)
        need = threshold * weight_of(tokens)
        least = min(least, need)
        rest = [weight_of(tokens[k:]) for k in range(len(tokens))]
        prefix = [w for w, r in zip(tokens, rest) if r >= need - _SLACK]
        prefixes.update(prefix)
        rows += [(name, prefix, need - _SLACK, r, w) for w, r in zip(prefix, rest)]
    templates = spark.createDataFrame(rows, "name int, prefix array<string>, need double, rest double, token string")
    blocks = docs.select("text", "uid", "doc_id").mapInArrow(_blocks(rank, prefixes, least), "uid long, doc_id long, block long, tokens array<string>, rests array<double>, whole array<string>")
    spread = blocks.select("*", F.posexplode("tokens").alias("at", "token"))
    # the templates' prefixes: a fixed number of rows
    pairs = spread.join(F.broadcast(templates), "token").where(F.element_at(F.array_intersect("tokens", "prefix"), 1) == F.col("token"))
    pairs = pairs.where((F.col("rests")[0] >= F.col("need")) & (F.least(F.col("rests")[F.col("at")], F.col("rest")) >= F.col("need")))
    held = pairs.select("uid", "doc_id", "block", "whole", "name").mapInArrow(_verified(threshold), "uid long, doc_id long, name int, first long, end long, share double")
    return held.distinct()  # a place may lie in two blocks


def _best(places: list[tuple[int, int, float, float, str]]) -> list[tuple[str, float]]:
    """(label, share) of places (first, end, share, weight, label) that no other place overlaps with a greater share, or an equal one and more weight."""
    places = sorted(places)
    out, ahead = [], []
    longest = max(end - first for first, end, *_ in places)
    for k, (first, end, share, weight, label) in enumerate(places):
        ahead = [p for p in ahead if first - p[0] < longest]
        beaten = False
        for other in (*ahead, *_following(places, k, end)):
            if other[1] > first and (other[2] - share > _SLACK or abs(other[2] - share) <= _SLACK and other[3] - weight > _SLACK):
                beaten = True
                break
        ahead.append(places[k])
        if not beaten:
            out.append((label, share))
    return out


def _following(places, k: int, end: int):
    for other in places[k + 1 :]:
        if other[0] >= end:
            return
        yield other


def _resolved(batches):
    """Labels of each text's places, and the greatest share."""
    names = [(label, weight_of(sorted(set(t.split())))) for t, label in TEMPLATES.items()]
    for batch in batches:
        more, best = [], []
        for places in batch.column(2).to_pylist():
            kept = _best([(p["first"], p["end"], p["share"], p["share"] * names[p["name"]][1], names[p["name"]][0]) for p in places])
            more.append(sorted({label for label, _ in kept}))
            best.append(max(share for _, share in kept))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(more, pa.list_(pa.string())), pa.array(best, pa.float64())], names=["uid", "id", "more", "best"])


def scan_licenses(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Licenses of each text: phrases word by word, and templates by containment of their words in runs of the text's words, across line ends.

    Returns (doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score), a row for each row; takes
    doc_id and text, ignores other columns. first_word and last_word are the least and greatest start of a phrase, else null; labels
    are distinct, sorted and joined by commas, or empty; score is the greatest containment of a template, 1 where a
    phrase stands, else 0. Of templates at places that overlap, the label is that of the one with the greatest share, then the greatest weight:
    a notice of one license holds most words of its relatives. A null text is empty. Equal rows get equal results; an empty table gives no rows.
    Rows are told apart by doc_id and a 64-bit hash of doc_id and text.
    """
    d = docs.select("text", F.col("doc_id").cast("long")).withColumn("uid", F.xxhash64("doc_id", "text"))
    base = d.select("text", "doc_id", "uid").mapInArrow(_base, "doc_id long, uid long, n_words long, n_base long, first_word long, last_word long, base_labels string")
    places = template_places(d, threshold).groupBy("uid", "doc_id").agg(F.collect_list(F.struct("name", "first", "end", "share")).alias("places"))  # of one text
    found = places.mapInArrow(_resolved, "uid long, id long, more array<string>, best double")
    own = F.when(F.col("base_labels") == "", F.array().cast("array<string>")).otherwise(F.split("base_labels", ","))
    labels = F.array_join(F.array_sort(F.array_union(own, F.coalesce("more", F.array().cast("array<string>")))), ",")
    score = F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0)))
    return base.join(found, (base["uid"] == found["uid"]) & base["doc_id"].eqNullSafe(found["id"]), "left").select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", labels.alias("labels"), score.alias("score"))
