"""Queries of the reference operators with their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import latency as L
from ..operators import lexicon as X
from ..operators import signals as S
from ..operators import steps
from ..operators.dedup import dedup, live_entries, whole_seconds
from ..params import EVENTS_BACKTEST, EVENTS_DEDUP, EVENTS_RISK, EVENTS_SIGNAL, T0_US, LatencyParams, PressureParams
from ..sources import fix, sse
from ..sources.positions import FIELDS, parse_position, position_asof, replay_positions
from ..sources.tokens import replay_table
from . import sql as Q
from . import streams as V
from .pipeline import event_summary, outcome_counts, run_pipeline
from .pipeline import session_summary as summary_of

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}
#: The demonstration's token list.
DEMO = ["crash", "panic", "inevitable", "guarantee", "bullish", "collapse", "volatile", "surge", "confident", "uncertain", "rally", "plunge", "breakout", "support", "resistance", "momentum"]
#: The demonstration's positions.
DEMO_POSITIONS = [(0.1, 1.0, 0.5, -10.0), (0.25, 1.0, 0.3, -10.0), (-0.1, 1.0, -0.2, -10.0)]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def csv(c: str):
    return F.array_join(c, ",").alias(c)


# sources

@query(f"SELECT doc_id, (i - 1)::BIGINT AS seq, w[i] AS token FROM (SELECT doc_id, {Q.WORDS.format('text')} AS w FROM documents), unnest(range(1, len(w) + 1)) u(i)")
def src_tokenize_documents(spark, sf):
    return V.document_tokens(spark, sf)


CONVERSATION = f"""t AS (SELECT conv_id, turn, {Q.WORDS.format('text')} AS w FROM conversations),
    c AS (SELECT conv_id, turn, i, w[i] AS token FROM t, unnest(range(1, len(w) + 1)) u(i)),
    ct AS (SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn, i) - 1)::BIGINT AS seq, token FROM c)"""


@query(f"WITH {CONVERSATION} SELECT * FROM ct")
def src_tokenize_conversations(spark, sf):
    return V.conversation_tokens(spark, sf)


@query(f"WITH {CONVERSATION}, n AS (SELECT conv_id, count(*) AS n FROM ct GROUP BY conv_id) SELECT conv_id, r * n + seq AS seq, token FROM ct JOIN n USING (conv_id), range(3) q(r)")
def src_replay_cycle(spark, sf):
    """Each conversation's tokens, replayed three times."""
    return replay_table(V.conversation_tokens(spark, sf), "conv_id", "seq", 3)


def _sse_lines(spark, sf):
    """Conversation tokens as response lines: a size line before each and a blank one after, an empty token beside each
    fiftieth; the end comes after the last token, and after it lines that don't count."""
    t = V.conversation_tokens(spark, sf)
    json = F.to_json(F.array("token"))
    content = F.concat(F.lit('data: {"choices":[{"delta":{"content":'), json.substr(F.lit(2), F.length(json) - 2), F.lit("}}]}"))
    empty = F.lit('data: {"choices":[{"delta":{"content":""}}]}')
    lines = F.array(F.lower(F.hex(F.length(content))), content, F.lit(""), F.when(F.col("seq") % 50 == 49, empty).otherwise(F.lit("")))
    body = t.select("conv_id", "seq", F.posexplode(lines).alias("k", "line")).select("conv_id", (F.col("seq") * 4 + F.col("k")).alias("n"), "line")
    after = F.array(F.lit("data: [DONE]"), F.lit('data: {"choices":[{"delta":{"content":"late"}}]}'), F.lit(""))
    ends = t.groupBy("conv_id").agg(F.max("seq").alias("seq")).select("conv_id", F.col("seq"), F.posexplode(after).alias("k", "line"))
    return body.union(ends.select("conv_id", ((F.col("seq") + 1) * 4 + F.col("k")).alias("n"), "line"))


@query(f"WITH {CONVERSATION} SELECT conv_id, seq * 4 + 1 AS n, token FROM ct")
def sse_decode(spark, sf):
    return sse.decode_sse(_sse_lines(spark, sf), "conv_id", "n")


@query("""SELECT event_id, (value - 50) / 100 AS net_position, 1.0::DOUBLE AS position_limit, value / 10 AS pnl, CASE WHEN event_type = 'error' THEN NULL ELSE -10.0::DOUBLE END AS pnl_limit, event_type <> 'error' AS ok FROM events""")
def json_position_parse(spark, sf):
    e = V.events(spark, sf)
    n = lambda c: c.cast("string")
    limit = F.when(F.col("token") == "error", F.lit('"none"')).otherwise(F.lit("-10.0"))
    body = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nServer: x\r\n\r\n"), F.lit('{"net_position": '), n((F.col("value") - 50) / 100), F.lit(', "position_limit": 1.0, "pnl": '), n(F.col("value") / 10), F.lit(', "pnl_limit": '), limit, F.lit("}"),
    )
    return e.select("event_id", parse_position(body).alias("p")).select("event_id", "p.*")


@query("SELECT event_id, try_cast(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events")
def json_number_extract(spark, sf):
    return V.table(spark, sf, "events").select("event_id", T.json_number(F.col("props"), "k").alias("k"))


@query(f"WITH {Q.EV}, {Q.POS} SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS seq, {T0_US} + (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) * 10000 AS t_us, net_position, position_limit, pnl, pnl_limit FROM pos")
def src_positions(spark, sf):
    """Each user's positions as a feed, one in ten milliseconds."""
    return replay_positions(V.event_positions(spark, sf), "user_id", "event_id", T0_US, 10_000)


MESSAGE = """m0 AS (SELECT o_custkey, o_orderkey, o_orderdate, CASE o_orderstatus
      WHEN 'P' THEN '35=AP' || chr(1) || '702=' || amount || chr(1) || '703=0' || chr(1)
      ELSE '35=8' || chr(1) || '54=' || CASE o_orderstatus WHEN 'F' THEN '1' ELSE '2' END || chr(1) || '32=' || amount || chr(1) END AS body
    FROM (SELECT *, format('{:.2f}', o_totalprice) AS amount FROM orders)),
    m AS (SELECT *, '8=FIX.4.2' || chr(1) || '9=' || strlen(body) || chr(1) || body AS head FROM m0),
    f AS (SELECT *, lpad((list_sum(list_transform(split(head, ''), lambda x: ord(x))) % 256)::BIGINT::VARCHAR, 3, '0') AS checksum FROM m)"""


def _messages(spark, sf):
    return V.order_messages(spark, sf).select("o_custkey", "o_orderkey", "seq", fix.envelope(F.col("body")).alias("message"))


@query(f"WITH {MESSAGE} SELECT o_orderkey, head || '10=' || checksum || chr(1) AS message FROM f")
def fix_envelope(spark, sf):
    return _messages(spark, sf).select("o_orderkey", "message")


@query(f"WITH {MESSAGE} SELECT o_orderkey, checksum FROM f")
def fix_checksum(spark, sf):
    body = F.col("body")
    soh = F.lit("\x01")
    head = F.concat(F.lit("8=FIX.4.2"), soh, F.lit("9="), F.octet_length(body).cast("string"), soh, body)
    return V.order_messages(spark, sf).select("o_orderkey", T.fix_checksum(head).alias("checksum"))


@query(f"WITH {MESSAGE} SELECT o_orderkey, 'AB' || strlen(body) AS first_tag110, 2::BIGINT AS frames FROM f")
def fix_frame(spark, sf):
    """Two messages, the first with a tag 110, and a fragment: two frames."""
    soh = F.lit("\x01")
    x = _messages(spark, sf)
    own = F.concat(F.lit("35=0"), soh, F.lit("110=AB"), F.octet_length(F.regexp_extract("message", "(?s)(35=.*)10=", 1)).cast("string"), soh)
    frames = fix.frame(F.concat(fix.envelope(own), F.col("message"), F.lit("8=FIX.4.2\x019=5\x0135=0\x01")))
    return x.select("o_orderkey", frames.alias("f")).select("o_orderkey", fix.fields_of(F.col("f")[0])["110"].alias("first_tag110"), F.size("f").cast("long").alias("frames"))


@query("""SELECT o_orderkey, CASE o_orderstatus WHEN 'P' THEN 'AP' ELSE '8' END AS kind, CASE o_orderstatus WHEN 'F' THEN '1' WHEN 'P' THEN NULL ELSE '2' END AS side,
    CASE WHEN o_orderstatus <> 'P' THEN round(o_totalprice, 2) END AS qty, CASE WHEN o_orderstatus = 'P' THEN round(o_totalprice, 2) END AS long_qty FROM orders""")
def fix_parse(spark, sf):
    f = _messages(spark, sf).select("o_orderkey", fix.fields_of(F.col("message")).alias("f"))
    n = lambda tag: F.round(fix.number(F.col("f")[tag]), 2)
    return f.select("o_orderkey", F.col("f")["35"].alias("kind"), F.col("f")["54"].alias("side"), n("32").alias("qty"), n("702").alias("long_qty"))


@query("""WITH d AS (SELECT o_custkey, o_orderkey, o_orderdate, CASE o_orderstatus WHEN 'O' THEN -1 ELSE 1 END * round(o_totalprice, 2) AS delta, (o_orderstatus = 'P')::INT AS report FROM orders),
    s AS (SELECT *, sum(report) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS seg FROM d)
    SELECT o_custkey, o_orderkey, round(sum(delta) OVER (PARTITION BY o_custkey, seg ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING), 2) AS net_position FROM s""")
def fix_position(spark, sf):
    p = fix.net_positions(_messages(spark, sf), "o_custkey", "seq")
    return p.select("o_custkey", F.col("seq.o_orderkey").alias("o_orderkey"), F.round("net_position", 2).alias("net_position"))


# lexicon

@query(f"""WITH {CONVERSATION}, l AS (SELECT * FROM (VALUES {Q.LEXICON}) AS t{Q.NAMES})
    SELECT l.*, (SELECT count(*) FROM ct WHERE translate(ct.token, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') = l.token) AS used FROM l""")
def lex_default(spark, sf):
    """The built-in lexicon, and how often conversations use each of its tokens."""
    used = X.lookup(V.conversation_tokens(spark, sf), X.default_lexicon(spark), bounded=True).where("hit")
    used = used.groupBy(T.normalise(F.col("token")).alias("token")).agg(F.count(F.lit(1)).alias("used"))
    return X.default_lexicon(spark).join(used, "token", "left").select("token", *X.WEIGHT, F.coalesce("used", F.lit(0)).cast("long").alias("used"))


@query("""WITH x AS (SELECT event_id, CASE WHEN event_type = 'error' THEN 'bad' ELSE 'u' || user_id || event_type END AS token, floor(value)::DOUBLE AS v, event_type FROM events)
    SELECT token, arg_max(-v, event_id) AS sentiment, arg_max(v / 100, event_id) AS confidence, arg_max(v * 1000, event_id) AS volatility, arg_max(0.5::DOUBLE, event_id) AS bias FROM x WHERE event_type NOT IN ('error', 'signup') GROUP BY token""")
def lex_load(spark, sf):
    """Lines of a lexicon made of events: errors have a word for a number, sign-ups a column too few, clicks more columns; of a token's lines the last wins."""
    v = F.floor("value").cast("long")
    e = V.events(spark, sf)
    numbers = [F.concat(F.lit("-"), v.cast("string")), (v / 100).cast("string"), F.concat(v.cast("string"), F.lit("e3")), F.lit(".5")]
    line = F.when(F.col("token") == "error", F.concat_ws(" ", F.lit("bad"), *numbers[:3], F.lit("x")))
    line = line.when(F.col("token") == "signup", F.concat_ws("  ", F.lit("short"), *numbers[:3]))
    name = F.concat(F.lit("u"), F.col("user_id").cast("string"), F.col("token"))
    line = line.when(F.col("token") == "click", F.concat_ws("\t", F.lit(" "), name, *numbers, F.lit("more 1"))).otherwise(F.concat_ws(" ", name, *numbers))
    return X.parse_lexicon(e.select(F.col("event_id").alias("n"), line.alias("value")))


@query("""SELECT event_id, lower(trim(props, ' {}') || event_type) AS norm FROM events""")
def token_normalize(spark, sf):
    e = V.table(spark, sf, "events")
    padded = F.concat(F.lit(" \t\x0b"), F.upper(F.concat(F.regexp_replace("props", r"^[ {}]+|[ {}]+$", ""), F.col("event_type"))), F.lit("\r\n\x0c "))
    return e.select("event_id", T.normalise(padded).alias("norm"))


@query(f"WITH {Q.EV}, {Q.EW} SELECT event_id, token, sentiment, confidence, volatility, bias, hit FROM ew")
def lexicon_lookup(spark, sf):
    return V.weighted_events(spark, sf).select("event_id", "token", *X.WEIGHT, "hit")


@query("SELECT event_id, event_type AS token FROM events WHERE event_type IN ('error', 'purchase', 'signup', 'click')")
def lexicon_hits(spark, sf):
    lex = V.event_lexicon(spark).select(F.col("token").alias("key"))
    return V.events(spark, sf).join(F.broadcast(lex), T.normalise(F.col("token")) == F.col("key"), "left_semi").select("event_id", "token")


@query("SELECT event_id, event_type AS token FROM events WHERE event_type NOT IN ('error', 'purchase', 'signup', 'click')")
def lexicon_misses(spark, sf):
    lex = V.event_lexicon(spark).select(F.col("token").alias("key"))
    return V.events(spark, sf).join(F.broadcast(lex), T.normalise(F.col("token")) == F.col("key"), "left_anti").select("event_id", "token")


@query(f"WITH {Q.EV}, {Q.EW} SELECT event_id, bias * confidence * 1.0::DOUBLE AS bias_in, volatility * confidence * 1.0::DOUBLE AS volatility_in FROM ew")
def weight_contribution(spark, sf):
    return V.weighted_events(spark, sf).select("event_id", "bias_in", "volatility_in")


def _sequence_sql(where: str = "true") -> str:
    return f"""WITH t AS (SELECT doc_id, i - 1 AS seq, lower(w[i]) AS token FROM (SELECT doc_id, {Q.WORDS.format('text')} AS w FROM documents), unnest(range(1, len(w) + 1)) u(i)),
    lex AS (SELECT * FROM (VALUES {Q.LEXICON}) AS x{Q.NAMES}),
    w AS (SELECT t.doc_id, {Q.MISSES} FROM t LEFT JOIN lex l ON t.token = l.token WHERE {where}),
    s AS (SELECT doc_id, count(*) AS n, {", ".join(f"sum(CAST({c} AS DECIMAL(24,12)))::DOUBLE AS {a}" for a, c in (("st", "sentiment * confidence"), ("vt", "volatility * confidence"), ("bt", "bias * confidence"), ("ct", "confidence")))} FROM w GROUP BY doc_id)
    SELECT doc_id, round(st / ct, 6) AS sentiment, round(vt / ct, 6) AS volatility, round(bt / ct, 6) AS bias, round(ct / n, 6) AS confidence, n FROM s"""


@query(_sequence_sql())
def sequence_weight(spark, sf):
    return X.sequence_weight(X.lookup(V.document_tokens(spark, sf), X.default_lexicon(spark), bounded=True), "doc_id")


@query(_sequence_sql("t.seq >= 10 AND t.seq < 50"))
def sequence_weight_range(spark, sf):
    t = V.document_tokens(spark, sf).where("seq >= 10 and seq < 50")
    return X.sequence_weight(X.lookup(t, X.default_lexicon(spark), bounded=True), "doc_id")


@query(_sequence_sql())
def sequence_weight_vectorized(spark, sf):
    """Tokens of a document that weigh the same are counted before anything is moved, and weighed by their counts; the same answer."""
    t = X.lookup(V.document_tokens(spark, sf), X.default_lexicon(spark), bounded=True).groupBy("doc_id", *X.WEIGHT).agg(F.count(F.lit(1)).alias("n"))
    return X.sequence_weight(t, "doc_id", count="n")


# deduplication

TTL_US = EVENTS_DEDUP.ttl_ms * 1000
TTL_SQL = f"{TTL_US}::BIGINT"


@query("""SELECT event_id, printf('%x', list_reduce(list_prepend(14695981039346656037::UHUGEINT, list_transform(split(event_type || '|' || user_id, ''), lambda x: ord(x)::UHUGEINT)),
    lambda h, b: (xor(h, b) * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT) AS dedup_key FROM events""")
def dedup_key(spark, sf):
    return V.events(spark, sf).select("event_id", T.dedup_key(F.col("token"), F.col("user_id").cast("string")).alias("dedup_key"))


@query(f"WITH RECURSIVE {Q.EV}, {Q.dedup_cte('e0', chr(34) + 'user_id' + chr(34) + ' || ' + chr(39) + '|' + chr(39) + ' || token', TTL_SQL)} SELECT event_id, is_novel, expires_us FROM seen")
def dedup_ttl(spark, sf):
    return dedup(V.events(spark, sf), ["user_id", "token"], ["event_id"], F.col("t_us"), F.lit(TTL_US).cast("long")).select("event_id", "is_novel", "expires_us")


@query(f"WITH RECURSIVE {Q.EV}, {Q.dedup_cte('e0', 'token', '3600000000::BIGINT')} SELECT event_id, is_novel FROM seen")
def dedup_context(spark, sf):
    """Without a context: one key per token for all users, and another time to live."""
    return dedup(V.events(spark, sf), ["token"], ["event_id"], F.col("t_us"), F.lit(3_600_000_000).cast("long")).select("event_id", "is_novel")


@query(f"WITH RECURSIVE {Q.EV}, {Q.dedup_cte('e0', 'user_id', '172800000000::BIGINT', chr(34) + 'token' + chr(34) + ' = ' + chr(39) + 'error' + chr(39))} SELECT event_id, is_novel FROM seen")
def dedup_evict(spark, sf):
    """Errors delete their user's key."""
    return dedup(V.events(spark, sf), ["user_id"], ["event_id"], F.col("t_us"), F.lit(172_800_000_000).cast("long"), F.col("token") == "error").select("event_id", "is_novel")


@query(f"WITH RECURSIVE {Q.EV}, {Q.dedup_cte('e0', 'user_id', 'greatest(1, floor(value * 1000)::BIGINT // 1000) * 1000000')} SELECT event_id, is_novel, expires_us FROM seen")
def dedup_ttl_seconds(spark, sf):
    """A time to live per row, kept in whole seconds."""
    ttl = whole_seconds(F.floor(F.col("value") * 1000).cast("long"))
    return dedup(V.events(spark, sf), ["user_id"], ["event_id"], F.col("t_us"), ttl).select("event_id", "is_novel", "expires_us")


@query(f"""WITH RECURSIVE {Q.EV}, {Q.dedup_cte('e0', "user_id || '|' || token", '864000000000::BIGINT')}
    SELECT count(*) AS live FROM (SELECT dk, max(expires_us) AS e FROM seen GROUP BY dk) WHERE e > {T0_US + 30 * 86_400_000_000}""")
def dedup_live_size(spark, sf):
    seen = dedup(V.events(spark, sf), ["user_id", "token"], ["event_id"], F.col("t_us"), F.lit(864_000_000_000).cast("long"))
    now = F.lit(T0_US + 30 * 86_400_000_000)
    return live_entries(seen, ["user_id", "token"], ["event_id"], now).agg(F.count(F.lit(1)).alias("live"))


@query(f"""WITH RECURSIVE {Q.EV}, {Q.dedup_cte('e0', "user_id || '|' || token", TTL_SQL)}
    SELECT user_id, count(*) FILTER (is_novel) AS novel, count(*) FILTER (NOT is_novel) AS duplicates FROM seen GROUP BY user_id""")
def dedup_counts(spark, sf):
    seen = dedup(V.events(spark, sf), ["user_id", "token"], ["event_id"], F.col("t_us"), F.lit(TTL_US).cast("long"))
    return seen.groupBy("user_id").agg(F.count_if("is_novel").alias("novel"), F.count_if(~F.col("is_novel")).alias("duplicates"))


# signals and gates

SIGNAL_SQL = "SELECT event_id, user_id, nb AS signal_bias, nv AS signal_volatility FROM sig WHERE emitted"


@query(f"WITH RECURSIVE {Q.EV}, {Q.EW}, {Q.signal_cte('ew', True)} {SIGNAL_SQL}")
def signals_backtest(spark, sf):
    x = S.signals(V.weighted_events(spark, sf), ["user_id"], ["event_id"], EVENTS_BACKTEST)
    return x.where("emitted").select("event_id", "user_id", "signal_bias", "signal_volatility")


@query(f"WITH RECURSIVE {Q.EV}, {Q.EW}, {Q.signal_cte('ew', False)} {SIGNAL_SQL}")
def signals_realtime(spark, sf):
    x = S.signals(V.weighted_events(spark, sf), ["user_id"], ["event_id"], EVENTS_SIGNAL)
    return x.where("emitted").select("event_id", "user_id", "signal_bias", "signal_volatility")


@query(f"WITH RECURSIVE {Q.EV}, {Q.EW}, {Q.signal_cte('ew', True)} SELECT event_id, t_us * 1000 AS timestamp_ns, toggle AS strategy_toggle, weight AS strategy_weight, spread AS spread_modifier, confidence FROM sig")
def signal_attributes(spark, sf):
    x = S.signals(V.weighted_events(spark, sf), ["user_id"], ["event_id"], EVENTS_BACKTEST)
    return x.select("event_id", (F.col("t_us") * 1000).alias("timestamp_ns"), "strategy_toggle", "strategy_weight", "spread_modifier", "confidence")


@query(f"WITH RECURSIVE {Q.EV}, {Q.EW}, {Q.signal_cte('ew', True)} SELECT event_id, strength FROM sig")
def signal_strength(spark, sf):
    return S.signals(V.weighted_events(spark, sf), ["user_id"], ["event_id"], EVENTS_BACKTEST).select("event_id", "strength")


@query(f"WITH RECURSIVE {Q.EV}, {Q.EW}, {Q.signal_cte('ew', True)} SELECT event_id, abs(nb) <= {EVENTS_RISK.max_bias}::DOUBLE AND abs(nv) <= {EVENTS_RISK.max_volatility}::DOUBLE AND abs(spread) <= {EVENTS_RISK.max_spread}::DOUBLE AS ok FROM sig")
def gate_magnitude(spark, sf):
    return S.signals(V.weighted_events(spark, sf), ["user_id"], ["event_id"], EVENTS_BACKTEST).select("event_id", S.magnitude_ok(EVENTS_RISK).alias("ok"))


@query(f"WITH {Q.EV}, {Q.EW} SELECT event_id, confidence >= {EVENTS_RISK.min_confidence}::DOUBLE AS ok FROM ew")
def gate_confidence(spark, sf):
    return V.weighted_events(spark, sf).select("event_id", S.confidence_ok(EVENTS_RISK).alias("ok"))


@query(f"WITH {Q.EV}, {Q.EW}, {Q.POS}, {Q.placed('ew')} SELECT event_id, net_position, position_limit, pnl, pnl_limit FROM placed")
def position_asof_join(spark, sf):
    return V.positioned_events(spark, sf).select("event_id", *FIELDS)


@query(f"""WITH {Q.EV}, {Q.EW}, {Q.POS}, {Q.placed('ew')} SELECT event_id, NOT (abs(net_position + bias) > position_limit) AND NOT (pnl < pnl_limit) AS position_ok,
    CASE WHEN abs(net_position + bias) > position_limit THEN 'position_limit_breached' ELSE concat_ws(',', CASE WHEN abs(net_position + bias) > position_limit * {EVENTS_RISK.warn_fraction}::DOUBLE THEN 'position_limit_approaching' END,
      CASE WHEN pnl < pnl_limit THEN 'pnl_limit_breached' END) END AS position_events FROM placed""")
def gate_position(spark, sf):
    return V.positioned_events(spark, sf).select("event_id", *S.position_gate(F.col("bias"), EVENTS_RISK)).select("event_id", "position_ok", csv("position_events"))


@query(f"""WITH RECURSIVE {Q.EV}, g AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM e0),
    r AS (SELECT DISTINCT user_id, 0::BIGINT AS k, {T0_US}::BIGINT AS rs, 0::BIGINT AS n, NULL::BIGINT AS event_id, false AS ok FROM g
      UNION ALL SELECT user_id, k, rs, n + (n < {EVENTS_RISK.rate_limit})::BIGINT, event_id, n < {EVENTS_RISK.rate_limit}
      FROM (SELECT g.user_id, g.k, g.event_id, CASE WHEN (g.t_us - r.rs) // 1000000 >= {EVENTS_RISK.rate_window_s} THEN g.t_us ELSE r.rs END AS rs,
        CASE WHEN (g.t_us - r.rs) // 1000000 >= {EVENTS_RISK.rate_window_s} THEN 0 ELSE r.n END AS n FROM r JOIN g ON g.user_id = r.user_id AND g.k = r.k + 1))
    SELECT event_id, ok AS rate_ok FROM r WHERE k > 0""")
def rate_gate(spark, sf):
    return S.rate_gate(V.events(spark, sf), ["user_id"], ["event_id"], EVENTS_RISK).select("event_id", "rate_ok")


@query(f"""WITH RECURSIVE {Q.EV}, {Q.EW}, g AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM ew),
    r AS (SELECT DISTINCT user_id, 0::BIGINT AS k, {T0_US}::BIGINT AS ds, 0.0::DOUBLE AS cum, NULL::BIGINT AS event_id, false AS ok FROM g
      UNION ALL SELECT user_id, k, ds, CASE WHEN abs(cum + bias) <= {EVENTS_RISK.max_drawdown}::DOUBLE THEN cum + bias ELSE cum END, event_id, abs(cum + bias) <= {EVENTS_RISK.max_drawdown}::DOUBLE
      FROM (SELECT g.user_id, g.k, g.event_id, g.bias, CASE WHEN (g.t_us - r.ds) // 1000000 >= {EVENTS_RISK.drawdown_window_s} THEN g.t_us ELSE r.ds END AS ds,
        CASE WHEN (g.t_us - r.ds) // 1000000 >= {EVENTS_RISK.drawdown_window_s} THEN 0.0::DOUBLE ELSE r.cum END AS cum FROM r JOIN g ON g.user_id = r.user_id AND g.k = r.k + 1))
    SELECT event_id, ok AS drawdown_ok, cum AS cum_bias FROM r WHERE k > 0""")
def drawdown_gate(spark, sf):
    return S.drawdown_gate(V.weighted_events(spark, sf), ["user_id"], ["event_id"], "bias", EVENTS_RISK).select("event_id", "drawdown_ok", "cum_bias")


RESET_SQL = f"""WITH RECURSIVE {Q.EV}, {Q.EW}, g AS (SELECT *, token = 'signup' AS control, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM ew),
    r AS (SELECT DISTINCT user_id, 0::BIGINT AS k, {T0_US}::BIGINT AS ws, 0::BIGINT AS n, 0.0::DOUBLE AS cum, NULL::BIGINT AS event_id, NULL::BOOLEAN AS rate_ok, NULL::BOOLEAN AS drawdown_ok FROM g
      UNION ALL SELECT user_id, k, ws, CASE WHEN control THEN 0 WHEN n < {EVENTS_RISK.rate_limit} THEN n + 1 ELSE n END,
        CASE WHEN control THEN 0.0::DOUBLE WHEN abs(cum + bias) <= {EVENTS_RISK.max_drawdown}::DOUBLE THEN cum + bias ELSE cum END, event_id,
        CASE WHEN NOT control THEN n < {EVENTS_RISK.rate_limit} END, CASE WHEN NOT control THEN abs(cum + bias) <= {EVENTS_RISK.max_drawdown}::DOUBLE END
      FROM (SELECT g.user_id, g.k, g.event_id, g.bias, g.control,
          CASE WHEN g.control OR (g.t_us - r.ws) // 1000000 >= 864000 THEN g.t_us ELSE r.ws END AS ws,
          CASE WHEN (g.t_us - r.ws) // 1000000 >= 864000 THEN 0 ELSE r.n END AS n,
          CASE WHEN (g.t_us - r.ws) // 1000000 >= 864000 THEN 0.0::DOUBLE ELSE r.cum END AS cum FROM r JOIN g ON g.user_id = r.user_id AND g.k = r.k + 1))
    SELECT event_id, rate_ok, drawdown_ok, cum AS cum_bias FROM r WHERE k > 0"""


@query(RESET_SQL)
def gate_reset(spark, sf):
    """Sign-ups are control rows that start both windows, ten days here, anew."""
    p = replace(EVENTS_RISK, rate_window_s=864_000, drawdown_window_s=864_000)
    x = V.weighted_events(spark, sf).withColumn("control", F.col("token") == "signup")
    x = S.rate_gate(x, ["user_id"], ["event_id"], p, "control")
    return S.drawdown_gate(x, ["user_id"], ["event_id"], "bias", p, "control").select("event_id", "rate_ok", "drawdown_ok", "cum_bias")


@query(f"WITH RECURSIVE {Q.EV}, {Q.EW}, {Q.POS}, {Q.placed('ew')}, {Q.signal_cte('placed', True)}, {Q.risk_cte('sig')} SELECT event_id, outcome, cum_bias, oms_events FROM gated")
def risk_gated_signals(spark, sf):
    x = S.gated_signals(V.positioned_events(spark, sf), ["user_id"], ["event_id"], EVENTS_BACKTEST, EVENTS_RISK)
    return x.select("event_id", "outcome", "cum_bias", csv("oms_events"))


# the whole dataflow

def _pipeline(spark, sf, signal=EVENTS_SIGNAL, keep=()) -> DataFrame:
    return run_pipeline(V.events(spark, sf), V.event_lexicon(spark), V.event_positions(spark, sf), "user_id", "event_id", signal, EVENTS_RISK, EVENTS_DEDUP, keep)


OUTCOME_COLUMNS = "event_id, user_id, token, outcome, signal_bias, signal_volatility, confidence, strategy_toggle, strategy_weight, spread_modifier"


def _outcomes(x: DataFrame) -> DataFrame:
    return x.select(*OUTCOME_COLUMNS.split(", "), F.array_join(F.coalesce("oms_events", F.array().cast("array<string>")), ",").alias("oms_events"))


@query(f"WITH RECURSIVE {Q.pipeline_cte(False)} SELECT {OUTCOME_COLUMNS}, oms_events FROM outcomes")
def pipeline_end_to_end(spark, sf):
    return _outcomes(_pipeline(spark, sf))


@query(f"WITH RECURSIVE {Q.pipeline_cte(True)} SELECT {OUTCOME_COLUMNS}, oms_events FROM outcomes")
def pipeline_backtest(spark, sf):
    return _outcomes(_pipeline(spark, sf, EVENTS_BACKTEST))


@query(f"WITH RECURSIVE {Q.pipeline_cte(False)} SELECT outcome, count(*) AS n FROM outcomes GROUP BY outcome")
def gate_counts(spark, sf):
    return outcome_counts(_pipeline(spark, sf))


@query(f"""WITH RECURSIVE {Q.pipeline_cte(True)},
    b AS (SELECT *, outcome NOT IN ('pass', 'cooldown', 'duplicate') AS blocked, nullif(split_part(oms_events, ',', -1), '') AS event FROM outcomes),
    g AS (SELECT *, coalesce(sum(blocked::INT) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g FROM b),
    e AS (SELECT user_id, g, arg_max(event, event_id) FILTER (event IS NOT NULL) AS event FROM g GROUP BY user_id, g)
    SELECT event_id, substr(coalesce(e.event, 'risk'), 1, 16) AS label FROM g JOIN e USING (user_id, g) WHERE blocked""")
def gate_labels(spark, sf):
    return S.gate_labels(_pipeline(spark, sf, EVENTS_BACKTEST), ["user_id"], ["event_id"]).select("event_id", "label")


LAT = "lat AS (SELECT event_id, user_id, epoch_us(ts) AS t_us, floor(value * 100)::BIGINT AS latency_us FROM events)"
STATS = LatencyParams(sample_window=1_000, target_us=5_000)
PERCENTILES = f"{LAT}, s AS (SELECT list_sort(list(latency_us)) AS x FROM (SELECT latency_us FROM lat ORDER BY event_id DESC LIMIT 1000)), q AS (SELECT x[least(floor(len(x) * 0.95::DOUBLE)::INT + 1, len(x))] AS p95_us, x[least(floor(len(x) * 0.99::DOUBLE)::INT + 1, len(x))] AS p99_us FROM s)"


@query(f"""WITH RECURSIVE {Q.pipeline_cte(False)}, {PERCENTILES}, t AS (SELECT count(*) AS tokens, count(*) FILTER (outcome = 'duplicate') AS duplicates, count(*) FILTER (outcome = 'cooldown') AS suppressed,
    count(*) FILTER (outcome NOT IN ('duplicate', 'cooldown')) AS generated, count(*) FILTER (outcome = 'pass') AS passed, count(*) FILTER (outcome NOT IN ('duplicate', 'cooldown', 'pass')) AS blocked FROM outcomes)
    SELECT t.*, (SELECT (sum(latency_us) // count(*))::BIGINT FROM lat) AS avg_us, (SELECT max(latency_us) FROM lat) AS max_us, p99_us FROM t, q""")
def session_summary(spark, sf):
    return summary_of(_pipeline(spark, sf), V.latencies(spark, sf), "latency_us", "event_id", STATS)


EVENT_LOG = """SELECT 'TOKEN_RECEIVED' AS event_type, event_id AS sequence_id, token, NULL::DOUBLE AS bias, NULL::DOUBLE AS volatility, NULL::BIGINT AS latency_us FROM outcomes WHERE outcome <> 'duplicate'
    UNION ALL SELECT 'SIGNAL_GENERATED', event_id, NULL, signal_bias, signal_volatility, NULL FROM outcomes WHERE outcome = 'pass'
    UNION ALL SELECT 'LATENCY_MEASUREMENT', event_id, NULL, NULL, NULL, floor(value * 100)::BIGINT FROM e0
    UNION ALL SELECT 'SYSTEM_STATS', max(event_id), NULL, NULL, NULL, max(floor(value * 100)::BIGINT) FROM e0"""


@query(f"WITH RECURSIVE {Q.pipeline_cte(False)} {EVENT_LOG}")
def event_log(spark, sf):
    """One typed log: tokens, passed signals, latencies, statistics. Each row of the dataflow is made once and gives all its entries."""
    x = _pipeline(spark, sf, keep=("value",)).withColumn("latency", F.floor(F.col("value") * 100).cast("long"))
    none = {"token": F.lit(None).cast("string"), "bias": F.lit(None).cast("double"), "volatility": F.lit(None).cast("double"), "latency_us": F.lit(None).cast("long")}
    entry = lambda when, kind, **own: F.when(when, F.struct(F.lit(kind).alias("event_type"), *[own.get(c, v).alias(c) for c, v in none.items()]))
    o = F.col("outcome")
    entries = F.array_compact(F.array(
        entry(o != steps.DUPLICATE, "TOKEN_RECEIVED", token=F.col("token")),
        entry(o == steps.PASS, "SIGNAL_GENERATED", bias=F.col("signal_bias"), volatility=F.col("signal_volatility")),
        entry(F.lit(True), "LATENCY_MEASUREMENT", latency_us=F.col("latency")),
    ))
    log = x.select(F.col("event_id").alias("sequence_id"), F.explode(entries).alias("e")).select("e.event_type", "sequence_id", *[f"e.{c}" for c in none])
    stats = V.latencies(spark, sf).agg(F.max("event_id").alias("sequence_id"), F.max("latency_us").alias("latency_us"))
    return log.unionByName(stats.withColumn("event_type", F.lit("SYSTEM_STATS")), allowMissingColumns=True)


@query(f"WITH RECURSIVE {Q.pipeline_cte(False)}, entries AS ({EVENT_LOG}) SELECT coalesce(event_type, 'ALL') AS event_type, count(*) AS entries FROM entries GROUP BY ROLLUP (event_type)")
def event_log_summary(spark, sf):
    return event_summary(event_log(spark, sf))


# latency, pressure, back-off

@query(f"WITH {LAT} SELECT count(*) AS measurements, (sum(latency_us) // count(*))::BIGINT AS avg_us, min(latency_us) AS min_us, max(latency_us) AS max_us FROM lat")
def latency_stats(spark, sf):
    return L.latency_stats(V.latencies(spark, sf), "latency_us")


@query(f"WITH {PERCENTILES} SELECT * FROM q")
def latency_percentiles(spark, sf):
    return L.latency_percentiles(V.latencies(spark, sf), "latency_us", "event_id", STATS)


@query(f"WITH {PERCENTILES} SELECT p99_us, CASE WHEN p99_us < 5000 THEN 'green' WHEN p99_us < 25000 THEN 'yellow' ELSE 'red' END AS light, p99_us > 5000 AS over_target FROM q")
def latency_alert(spark, sf):
    p = L.latency_percentiles(V.latencies(spark, sf), "latency_us", "event_id", STATS)
    return p.select("p99_us", *L.alert_level(F.col("p99_us"), STATS.target_us))


@query(f"WITH {LAT}, m AS (SELECT (sum(latency_us) // count(*))::BIGINT AS a FROM lat) SELECT round(sqrt(avg(pow(latency_us - a, 2))) / 1000, 6) AS jitter_ms FROM (SELECT * FROM lat ORDER BY event_id DESC LIMIT 1000), m")
def latency_jitter(spark, sf):
    return L.latency_jitter(V.latencies(spark, sf), "latency_us", "event_id", STATS)


@query(f"WITH {LAT} SELECT user_id, arg_max(latency_us, event_id) AS avg_us, max(latency_us) AS max_us FROM lat GROUP BY user_id")
def replay_latency(spark, sf):
    """The replay's average is its last sample."""
    return V.latencies(spark, sf).groupBy("user_id").agg(F.max_by("latency_us", "event_id").alias("avg_us"), F.max("latency_us").alias("max_us"))


@query(f"""WITH {LAT}, r AS (SELECT user_id, max(event_id) AS last FROM events WHERE event_type = 'signup' GROUP BY user_id)
    SELECT lat.user_id, count(*) AS measurements, (sum(latency_us) // count(*))::BIGINT AS avg_us, min(latency_us) AS min_us, max(latency_us) AS max_us FROM lat LEFT JOIN r ON lat.user_id = r.user_id WHERE r.last IS NULL OR event_id > r.last GROUP BY lat.user_id""")
def latency_reset(spark, sf):
    """Statistics since each user's last sign-up, the control row."""
    e = V.events(spark, sf).select("event_id", "user_id", F.floor(F.col("value") * 100).cast("long").alias("latency_us"), (F.col("token") == "signup").alias("control"))
    return L.latency_stats(L.since_reset(e, ["user_id"], "event_id", "control"), "latency_us", ["user_id"])


@query(f"WITH {Q.EV}, {Q.EW} SELECT event_id, round(coalesce(var_samp(sentiment) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING), 0), 9) AS variance FROM ew")
def sentiment_variance(spark, sf):
    return V.weighted_events(spark, sf).select("event_id", F.round(L.running_variance(F.col("sentiment"), ["user_id"], "event_id"), 9).alias("variance"))


@query("SELECT epoch_us(ts) // 1000000 AS second, count(*) AS tokens FROM events GROUP BY 1")
def token_rate(spark, sf):
    x = V.table(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("ts"))
    return x.groupBy(F.window("ts", "1 second").alias("w")).agg(F.count(F.lit(1)).alias("tokens")).select(F.unix_seconds("w.start").alias("second"), "tokens")


PRESSURE = PressureParams(max_tps=80.0, queue_capacity=90)
COMPONENTS = "SELECT event_id, user_id, greatest(0.0, least(1.0, value / 80)) AS ingestion, greatest(0.0, least(1.0, value * value / 20000 / 0.25::DOUBLE)) AS semantic, CASE WHEN event_type = 'view' THEN 0.0::DOUBLE ELSE greatest(0.0, least(1.0, (user_id % 97)::DOUBLE / 90)) END AS queue FROM events"


def _pressures(spark, sf, keep=()):
    e = V.events(spark, sf)
    depth = F.when(F.col("token") == "view", 0).otherwise(F.col("user_id") % 97).cast("double")
    return e.select("event_id", "user_id", *keep, *L.pressure(F.col("value"), F.col("value") * F.col("value") / 20000, depth, PRESSURE))


@query(f"WITH c AS ({COMPONENTS}) SELECT event_id, ingestion, semantic, queue, greatest(ingestion, semantic, queue) AS composite FROM c")
def pressure_components(spark, sf):
    return _pressures(spark, sf).drop("user_id")


@query(f"""WITH RECURSIVE c AS (SELECT event_id, user_id, greatest(ingestion, semantic) AS c, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM ({COMPONENTS})),
    r AS (SELECT DISTINCT user_id, 0::BIGINT AS k, NULL::BIGINT AS event_id, 1.0::DOUBLE AS m FROM c
      UNION ALL SELECT c.user_id, c.k, c.event_id, CASE WHEN c.c >= 0.8::DOUBLE THEN least(r.m * 1.5::DOUBLE, 5.0::DOUBLE) WHEN c.c < 0.5::DOUBLE THEN 1.0::DOUBLE ELSE r.m END FROM r JOIN c ON c.user_id = r.user_id AND c.k = r.k + 1)
    SELECT event_id, m AS multiplier FROM r WHERE k > 0""")
def backoff_level(spark, sf):
    x = _pressures(spark, sf).select("event_id", "user_id", F.greatest("ingestion", "semantic").alias("composite"))
    return L.backoff(x, "composite", ["user_id"], "event_id").select("event_id", "multiplier")


MONITOR = PressureParams(max_tps=4.0, queue_capacity=24)


@query(f"""WITH RECURSIVE {Q.pipeline_cte(False)}, x AS (SELECT o.user_id, o.event_id, (e.t_us - {T0_US}) // 86400000000 AS tick, o.outcome = 'cooldown' AS held,
      coalesce(var_samp(e.sentiment) OVER (PARTITION BY o.user_id ORDER BY o.event_id ROWS UNBOUNDED PRECEDING), 0) AS variance FROM outcomes o JOIN ew e USING (event_id) WHERE o.outcome <> 'duplicate'),
    k AS (SELECT user_id, tick, count(*) AS tokens, sum(held::INT) AS held, arg_max(variance, event_id) AS variance FROM x GROUP BY user_id, tick),
    p AS (SELECT *, sum(held) OVER (PARTITION BY user_id ORDER BY tick ROWS UNBOUNDED PRECEDING)::BIGINT AS suppressed FROM k),
    q AS (SELECT *, least(1.0, tokens / 4.0::DOUBLE) AS i, least(1.0, variance / 0.25::DOUBLE) AS s, least(1.0, suppressed / 24.0::DOUBLE) AS d FROM p),
    z AS (SELECT *, coalesce(tick - lag(tick) OVER w - 1, 0) AS idle, coalesce(lag(i) OVER w, 0) AS i0, coalesce(lag(s) OVER w, 0) AS s0, coalesce(lag(d) OVER w, 0) AS d0 FROM q WINDOW w AS (PARTITION BY user_id ORDER BY tick)),
    u AS (SELECT user_id, tick, 0 AS step, 0 AS event_id, greatest(s0, d0) AS c, 2 * idle AS n FROM z WHERE idle > 0
      UNION ALL SELECT x.user_id, x.tick, 1, x.event_id, greatest(least(1.0, x.variance / 0.25::DOUBLE), CASE WHEN z.idle = 0 THEN z.i0 ELSE 0 END, z.d0), 1 FROM x JOIN z USING (user_id, tick)
      UNION ALL SELECT user_id, tick, 2, 0, greatest(i, s, d0), 1 FROM z UNION ALL SELECT user_id, tick, 3, 0, greatest(i, s, d), 1 FROM z),
    o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY tick, step, event_id) AS j FROM u),
    r AS (SELECT DISTINCT user_id, 0::BIGINT AS j, 0::BIGINT AS tick, 0 AS step, 1.0::DOUBLE AS m FROM o
      UNION ALL SELECT o.user_id, o.j, o.tick, o.step, CASE WHEN o.c >= 0.8::DOUBLE THEN least(r.m * pow(1.5::DOUBLE, least(o.n, 10)), 5.0::DOUBLE) WHEN o.c < 0.5::DOUBLE THEN 1.0::DOUBLE ELSE r.m END FROM r JOIN o ON o.user_id = r.user_id AND o.j = r.j + 1)
    SELECT z.user_id, z.tick, z.tokens, z.suppressed, round(i, 6) AS ingestion, round(s, 6) AS semantic, round(d, 6) AS queue, round(greatest(i, s, d), 6) AS composite, round(m, 6) AS multiplier FROM z JOIN r ON r.user_id = z.user_id AND r.tick = z.tick AND r.step = 3""")
def pressure_timeline(spark, sf):
    """The monitor of each user's stream; a tick is a day, the table's scale."""
    x = L.pressure_monitor(_pipeline(spark, sf), "user_id", "event_id", 86_400_000_000, T0_US, MONITOR)
    return x.select("user_id", "tick", "tokens", "suppressed", *[F.round(c, 6).alias(c) for c in ("ingestion", "semantic", "queue", "composite", "multiplier")])


QUERIES["position_asof"] = QUERIES.pop("position_asof_join")
ORACLES["position_asof"] = ORACLES.pop("position_asof_join")

from .replays import register  # noqa: E402  # its queries are the same as these, as streams

register(QUERIES, ORACLES)
