"""DuckDB SQL of the training-data queries that SQL expresses: the rows by definition, every pair compared."""

from __future__ import annotations

#: A-Z alone are lower-cased.
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

#: Smallest vertex that the links of ``pairs(a, b)`` reach, of each row of ``nodes(id)``.
_REACHED = """both_ways AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
    walk(id, seen) AS (SELECT id, id FROM nodes UNION SELECT w.id, e.b FROM walk w JOIN both_ways e ON e.a = w.seen),
    reached AS (SELECT id, min(seen) AS component_id FROM walk GROUP BY id)"""

JACCARD = f"""WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(_LOWER.format("coalesce(text, '')"))} AS w FROM documents),
    s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS shingle FROM w),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id < y.doc_id GROUP BY x.doc_id, y.doc_id),
    pairs AS (SELECT a, b FROM shared JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 75 * (na.n + nb.n - c)),
    nodes AS (SELECT doc_id AS id FROM documents), {_REACHED}
    SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, r.component_id FROM documents d LEFT JOIN n USING (doc_id) JOIN reached r ON r.id = d.doc_id"""

_COMPONENTS = "list_transform({}, lambda x: x::DOUBLE)"
VECTORS = f"""WITH RECURSIVE v AS (SELECT vec_id, label, {_COMPONENTS.format("embedding")} AS v FROM embeddings),
    good AS (SELECT * FROM v WHERE v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
    pairs AS (SELECT x.vec_id AS a, y.vec_id AS b FROM good x JOIN good y ON x.label = y.label AND x.vec_id < y.vec_id WHERE list_cosine_similarity(x.v, y.v) >= 0.98),
    nodes AS (SELECT vec_id AS id FROM embeddings), {_REACHED},
    n AS (SELECT a, count(*) AS n FROM both_ways GROUP BY a)
    SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN reached ON id = vec_id LEFT JOIN n ON a = vec_id"""

#: Targets of the mix: the share of all words by weight, what is over a cap dealt again, as often as there are sources.
TARGETS = f"""WITH RECURSIVE z AS (SELECT doc_id, source, len({_WORDS.format("coalesce(text, '')")})::BIGINT AS size FROM documents),
    s AS (SELECT source, sum(size)::BIGINT AS source_size, [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w FROM z GROUP BY source),
    t AS (SELECT sum(source_size) * 1.5::DOUBLE AS want, count(*) AS n FROM s),
    r(k, capped) AS (SELECT 0, []::VARCHAR[] UNION ALL
      SELECT k + 1, (SELECT coalesce(list(coalesce(source, chr(0))), []) FROM s, (SELECT (want - coalesce(sum(source_size) FILTER (list_contains(capped, coalesce(source, chr(0)))), 0) * 2)
          / nullif(sum(w) FILTER (NOT list_contains(capped, coalesce(source, chr(0)))), 0) AS level FROM s, t GROUP BY want)
        WHERE list_contains(capped, coalesce(source, chr(0))) OR level * w >= source_size * 2) FROM r, t WHERE k <= n),
    c AS (SELECT arg_max(capped, k) AS capped FROM r),
    l AS (SELECT (want - coalesce(sum(source_size) FILTER (list_contains(capped, coalesce(source, chr(0)))), 0) * 2) / nullif(sum(w) FILTER (NOT list_contains(capped, coalesce(source, chr(0)))), 0) AS level FROM s, t, c GROUP BY want)
    SELECT z.doc_id, z.size, s.source_size, round(CASE WHEN list_contains(capped, coalesce(s.source, chr(0))) THEN s.source_size * 2 ELSE level * w END, 3) AS target
    FROM z JOIN s ON z.source IS NOT DISTINCT FROM s.source, c, l"""

_PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
_PLACES = " UNION ALL ".join(
    f"SELECT doc_id, i - 1 AS place, '{label}' AS label FROM w, unnest(range(1, len(w) + 1)) u(i) WHERE w[i:i + {len(p.split()) - 1}] = {p.split()}" for p, label in _PHRASES.items()
)
LICENSES = rf"""WITH w AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
    p AS ({_PLACES}),
    g AS (SELECT doc_id, count(*) AS n, min(place) AS first_word, max(place) AS last_word, array_to_string(list_sort(list(DISTINCT label)), ',') AS labels FROM p GROUP BY doc_id)
    SELECT w.doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word, coalesce(labels, '') AS base_labels FROM w LEFT JOIN g USING (doc_id)"""

NEGATIVES = f"""WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform({_COMPONENTS.format("embedding")}, lambda x: floor(256 * x)) AS v
      FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT x.vec_id AS a, y.vec_id AS b, x.label = y.label AS same, list_inner_product(x.v, y.v)::BIGINT AS score FROM v x JOIN v y ON x.vec_id % 50 = 0 AND x.vec_id <> y.vec_id),
    p AS (SELECT a, b, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5)
    SELECT p.a AS anchor_id, p.b AS positive_id, (row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b))::INT AS rank, s.b AS negative_id, p.score AS positive_score, s.score AS negative_score
    FROM p JOIN s ON s.a = p.a AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score QUALIFY rank <= 3"""

#: CRC-32 of the decimal digits of doc_id, bit by bit.
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda d: ord(d)::BIGINT)), lambda c, d:
    list_reduce(list_prepend(xor(c, d), range(8)), lambda e, k: CASE WHEN e & 1 = 1 THEN xor(e >> 1, 3988292384) ELSE e >> 1 END)))"""
_SPELT = "coalesce(strlen({0}::VARCHAR) || ':' || {0}::VARCHAR, '-')"
_LEAF = "sha256(" + " || ".join(_SPELT.format(c) for c in ("doc_id", "source", "lang", "n_chars", "{text}")) + ")"


def _tree(name: str, leaves: str) -> str:
    """Nodes (key, level, i, h, n) over ``leaves`` (key, i, h), and each key's root; n: nodes of the key on the level."""
    return f"""{name}(key, level, i, h, n) AS (SELECT key, 0, i, h, count(*) OVER (PARTITION BY key) FROM {leaves}
      UNION ALL SELECT key, any_value(level) + 1, i // 8, sha256(string_agg(h, '' ORDER BY i)), any_value((n + 7) // 8) FROM {name} WHERE n > 1 GROUP BY key, i // 8)"""


MERKLE = f"""WITH RECURSIVE r AS (SELECT doc_id, coalesce('=' || lang, '') AS key, {_LEAF.format(text="text")} AS h,
      CASE WHEN {_CRC} % 3 = 0 THEN {_LEAF.format(text=_LOWER.format("text"))} END AS changed FROM documents),
    l AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id, h) - 1 AS i FROM r),
    {_tree("t", "l")},
    sub AS (SELECT key AS lang_key, h AS subroot, '' AS key, row_number() OVER (ORDER BY key) - 1 AS i, h FROM t WHERE n = 1),
    {_tree("u", "sub")},
    -- every row's nodes, level by level through both trees, and their siblings
    walk AS (SELECT l.key, l.i AS row, t.level, t.i // 8 AS run, t.i AS at, t.key AS tree_key, 0 AS top FROM l JOIN t ON t.key = l.key AND t.n > 1 AND t.i = l.i >> (3 * t.level)
      UNION ALL SELECT l.key, l.i, u.level, u.i // 8, u.i, u.key, 1 FROM l JOIN sub ON sub.lang_key = l.key JOIN u ON u.n > 1 AND u.i = sub.i >> (3 * u.level)),
    nodes AS (SELECT *, 0 AS top FROM t UNION ALL SELECT *, 1 FROM u),
    step AS (SELECT w.key, w.row, row_number() OVER (PARTITION BY w.key, w.row ORDER BY w.top, w.level) AS k, coalesce(string_agg(x.h, '' ORDER BY x.i) FILTER (x.i < w.at), '') AS lo, coalesce(string_agg(x.h, '' ORDER BY x.i) FILTER (x.i > w.at), '') AS hi
      FROM walk w JOIN nodes x ON x.top = w.top AND x.key = w.tree_key AND x.level = w.level AND x.i // 8 = w.run GROUP BY w.key, w.row, w.top, w.level, w.at),
    f(key, row, k, h) AS (SELECT key, i, 0, coalesce(changed, h) FROM l UNION ALL SELECT f.key, f.row, f.k + 1, sha256(s.lo || f.h || s.hi) FROM f JOIN step s ON s.key = f.key AND s.row = f.row AND s.k = f.k + 1),
    folded AS (SELECT key, row, arg_max(h, k) AS h FROM f GROUP BY key, row),
    proof AS (SELECT key, row, string_agg(lo || hi, '' ORDER BY k) AS p FROM step GROUP BY key, row)
    SELECT l.doc_id, l.h AS leaf, sub.subroot, root.h AS root, sha256(coalesce(p, '')) AS proof_sha256, folded.h AS folded_root, folded.h = root.h AS verified
    FROM l JOIN sub ON sub.lang_key = l.key JOIN folded ON folded.key = l.key AND folded.row = l.i LEFT JOIN proof ON proof.key = l.key AND proof.row = l.i, (SELECT h FROM u WHERE n = 1) root"""

UNIGRAMS = f"""WITH w AS (SELECT doc_id, row_number() OVER () AS k, {_CRC} % 7 = 2 AS held_out, list_append({_WORDS.format(_LOWER.format("coalesce(text, '')"))}, NULL) AS w FROM documents),
    t AS (SELECT k, held_out, unnest(w) AS word FROM w),
    c AS (SELECT word, count(*) AS c FROM t WHERE NOT held_out GROUP BY word),
    s AS (SELECT sum(c)::BIGINT AS n, count(*) AS v FROM c),
    x AS (SELECT t.k, count(*) AS n_tokens, count(c.c) AS n_known, sum(log10((coalesce(c.c, 0) + 1) / (s.n + 1.0::DOUBLE * (s.v + 1)))) AS base FROM t CROSS JOIN s LEFT JOIN c ON c.word IS NOT DISTINCT FROM t.word GROUP BY t.k)
    SELECT doc_id, held_out, n_tokens, n_known, s.n AS train_tokens, round(base, 6) AS base_score FROM w JOIN x USING (k), s"""

_FOUND = "len(list_filter(regexp_extract_all(coalesce(text, ''), '{}'), lambda m: {}))::BIGINT"
_ONLY = "regexp_replace(m, '[^0-9]', '', 'g')"
#: Doubled digits at every second place from the last but one.
_LUHN = f"list_sum(list_transform(range(1, len({_ONLY}) + 1), lambda i: (({_ONLY})[-i]::INT * (2 - i % 2)) - CASE WHEN ({_ONLY})[-i]::INT * (2 - i % 2) > 9 THEN 9 ELSE 0 END)) % 10 = 0"
PII = f"""SELECT doc_id, {_FOUND.format(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:[.][A-Za-z0-9-]+)+", "true")} AS n_email,
    {_FOUND.format(r"[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+", "len(list_filter(string_split(m, '.'), lambda p: coalesce(try_cast(p AS BIGINT), 256) > 255)) = 0")} AS n_ip,
    {_FOUND.format(r"[0-9](?:[ -]?[0-9])+", f"len({_ONLY}) BETWEEN 12 AND 19 AND {_LUHN}")} AS n_card,
    {_FOUND.format(r"[+][0-9][ ().0-9-]+[0-9]", f"len({_ONLY}) BETWEEN 9 AND 15")} AS n_phone FROM documents"""

ORACLES = {
    "op2_jaccard_join": JACCARD, "op5_vector_pairs": VECTORS, "op12_merkle_manifest": MERKLE, "op13_hard_negatives": NEGATIVES,
    "mix_targets": TARGETS, "license_phrases": LICENSES, "unigram_scores": UNIGRAMS, "pii_counts": PII,
}
