"""DuckDB SQL of the reference operators' queries: the same rows by recursion, one row of each key a step."""

from __future__ import annotations

from ..operators.lexicon import DEFAULT
from ..params import EVENTS_DEDUP, EVENTS_RISK, EVENTS_SIGNAL, T0_US
from .streams import EVENT_WEIGHTS

D = "::DOUBLE"
WEIGHTS = ", ".join(f"('{t}', {s}{D}, {c}{D}, {v}{D}, {b}{D})" for t, s, c, v, b in EVENT_WEIGHTS)
LEXICON = ", ".join("('{}', {}::DOUBLE, {}::DOUBLE, {}::DOUBLE, {}::DOUBLE)".format(*x.split()) for x in DEFAULT.strip().splitlines())
NAMES = "(token, sentiment, confidence, volatility, bias)"
MISSES = f"coalesce(l.sentiment, 0.0{D}) AS sentiment, coalesce(l.confidence, 0.5{D}) AS confidence, coalesce(l.volatility, 0.1{D}) AS volatility, coalesce(l.bias, 0.0{D}) AS bias"
WORDS = r"list_filter(regexp_split_to_array({}, '[ \t\n\x0B\f\r]+'), lambda x: x <> '')"

EV = "e0 AS (SELECT event_id, user_id, event_type AS token, epoch_us(ts) AS t_us, value FROM events)"
EW = f"lex AS (SELECT * FROM (VALUES {WEIGHTS}) AS t{NAMES}), ew AS (SELECT e0.*, {MISSES}, l.token IS NOT NULL AS hit FROM e0 LEFT JOIN lex l ON e0.token = l.token)"
POS = f"pos AS (SELECT event_id, user_id, (value - 50) / 100 AS net_position, 1.0{D} AS position_limit, -value / 10 AS pnl, -10.0{D} AS pnl_limit FROM e0 WHERE token = 'view')"
ASOF = f"coalesce(p.net_position, 0.0{D}) AS net_position, coalesce(p.position_limit, 1.0{D}) AS position_limit, coalesce(p.pnl, 0.0{D}) AS pnl, coalesce(p.pnl_limit, -10.0{D}) AS pnl_limit"


def placed(source: str) -> str:
    return f"placed AS (SELECT x.*, {ASOF} FROM {source} x ASOF LEFT JOIN pos p ON x.user_id = p.user_id AND x.event_id >= p.event_id)"


def dedup_cte(source: str, key: str, ttl: str, evict: str = "false") -> str:
    """seen: rows of source with is_novel, expires_us; key: SQL expression over source."""
    return f"""
    d0 AS (SELECT *, {key} AS dk, {ttl} AS ttl_us, {evict} AS gone FROM {source}),
    d1 AS (SELECT *, row_number() OVER (PARTITION BY dk ORDER BY event_id) AS k FROM d0),
    dr AS (
      SELECT DISTINCT dk, 0::BIGINT AS k, NULL::BIGINT AS event_id, false AS is_novel, NULL::BIGINT AS expires_us FROM d1
      UNION ALL
      SELECT d1.dk, d1.k, d1.event_id, NOT d1.gone AND NOT coalesce(dr.expires_us > d1.t_us, false),
        CASE WHEN d1.gone THEN NULL WHEN coalesce(dr.expires_us > d1.t_us, false) THEN dr.expires_us ELSE d1.t_us + d1.ttl_us END
      FROM dr JOIN d1 ON d1.dk = dr.dk AND d1.k = dr.k + 1),
    seen AS (SELECT d1.* EXCLUDE (dk, k, ttl_us, gone), d1.dk, dr.is_novel, dr.expires_us FROM d1 JOIN dr ON d1.dk = dr.dk AND d1.k = dr.k)"""


def signal_cte(source: str, backtest: bool) -> str:
    """sig: rows of source with emitted, nb, nv (before the reset), strength."""
    emits = "true" if backtest else f"s1.t_us - sr.last >= {EVENTS_SIGNAL.cooldown_us}"
    return f"""
    s1 AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM {source}),
    sr AS (
      SELECT DISTINCT user_id, 0::BIGINT AS k, 0.0{D} AS b, 0.0{D} AS v, {T0_US}::BIGINT AS last, false AS emitted, 0.0{D} AS nb, 0.0{D} AS nv, 0.0{D} AS strength FROM s1
      UNION ALL
      SELECT user_id, k, CASE WHEN emitted AND (abs(nb) > 0.8{D} OR abs(nv) > 0.8{D}) THEN nb * 0.5{D} ELSE nb END,
        CASE WHEN emitted AND (abs(nb) > 0.8{D} OR abs(nv) > 0.8{D}) THEN nv * 0.5{D} ELSE nv END,
        CASE WHEN emitted THEN t_us ELSE last END, emitted, nb, nv, CASE WHEN emitted THEN (strength + abs(nb)) / 2 ELSE strength END
      FROM (SELECT sr.user_id, s1.k, s1.t_us, sr.last, sr.strength, {emits} AS emitted,
          0.95{D} * sr.b + s1.bias * s1.confidence * 1.0{D} AS nb, 0.95{D} * sr.v + s1.volatility * s1.confidence * 1.0{D} AS nv
        FROM sr JOIN s1 ON s1.user_id = sr.user_id AND s1.k = sr.k + 1)),
    sig AS (SELECT s1.* EXCLUDE (k), sr.emitted, sr.nb, sr.nv, sr.strength,
        CASE WHEN abs(nb) > 0.5{D} THEN CASE WHEN nb > 0 THEN 1 ELSE -1 END ELSE 0 END::INTEGER AS toggle,
        least(1.0{D}, 2.0{D} * s1.confidence) AS weight, CASE WHEN abs(nb) > 0.5{D} THEN -0.1{D} * nb ELSE 0.0{D} END AS spread
      FROM s1 JOIN sr ON s1.user_id = sr.user_id AND s1.k = sr.k)"""


EVENTS_OF = f"""CASE WHEN outcome NOT IN ('pass', 'position_limit') THEN ''
  WHEN abs(net_position + nb) > position_limit THEN 'position_limit_breached'
  ELSE concat_ws(',', CASE WHEN abs(net_position + nb) > position_limit * {EVENTS_RISK.warn_fraction}{D} THEN 'position_limit_approaching' END,
    CASE WHEN pnl < pnl_limit THEN 'pnl_limit_breached' END) END"""


def risk_cte(source: str) -> str:
    """gated: rows of source (sig with positions) with outcome, cum_bias."""
    r = EVENTS_RISK
    return f"""
    g1 AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM {source} WHERE emitted),
    gr AS (
      SELECT DISTINCT user_id, 0::BIGINT AS k, {T0_US}::BIGINT AS rs, 0::BIGINT AS n, {T0_US}::BIGINT AS ds, 0.0{D} AS cum, NULL::VARCHAR AS outcome FROM g1
      UNION ALL
      SELECT user_id, k, rs, CASE WHEN outcome = 'pass' THEN n + 1 ELSE n END, ds, CASE WHEN outcome = 'pass' THEN cum + nb ELSE cum END, outcome
      FROM (SELECT *, CASE WHEN why IS NOT NULL THEN why WHEN abs(net_position + nb) > position_limit OR pnl < pnl_limit THEN 'position_limit' ELSE 'pass' END AS outcome
        FROM (SELECT * EXCLUDE (why), CASE WHEN why IS NULL AND NOT abs(cum + nb) <= {r.max_drawdown}{D} THEN 'drawdown_limit_exceeded' ELSE why END AS why
          FROM (SELECT * EXCLUDE (ds, cum), CASE WHEN why IS NULL AND (t_us - ds) // 1000000 >= {r.drawdown_window_s} THEN t_us ELSE ds END AS ds,
              CASE WHEN why IS NULL AND (t_us - ds) // 1000000 >= {r.drawdown_window_s} THEN 0.0{D} ELSE cum END AS cum
            FROM (SELECT * EXCLUDE (why), CASE WHEN why IS NULL AND NOT n < {r.rate_limit} THEN 'rate_limit_exceeded' ELSE why END AS why
              FROM (SELECT * EXCLUDE (rs, n), CASE WHEN why IS NULL AND (t_us - rs) // 1000000 >= {r.rate_window_s} THEN t_us ELSE rs END AS rs,
                  CASE WHEN why IS NULL AND (t_us - rs) // 1000000 >= {r.rate_window_s} THEN 0 ELSE n END AS n
                FROM (SELECT gr.user_id, g1.k, g1.t_us, g1.nb, g1.net_position, g1.position_limit, g1.pnl, g1.pnl_limit, gr.rs, gr.n, gr.ds, gr.cum,
                    CASE WHEN NOT (abs(g1.nb) <= {r.max_bias}{D} AND abs(g1.nv) <= {r.max_volatility}{D} AND abs(g1.spread) <= {r.max_spread}{D}) THEN 'magnitude_exceeded'
                      WHEN NOT g1.confidence >= {r.min_confidence}{D} THEN 'confidence_below_minimum' END AS why
                  FROM gr JOIN g1 ON g1.user_id = gr.user_id AND g1.k = gr.k + 1))))))),
    gated AS (SELECT g1.* EXCLUDE (k), gr.outcome, gr.cum AS cum_bias, {EVENTS_OF} AS oms_events FROM g1 JOIN gr ON g1.user_id = gr.user_id AND g1.k = gr.k)"""


def pipeline_cte(backtest: bool) -> str:
    """outcomes: event_id, user_id, token, outcome and the signal of every event."""
    ttl = f"{EVENTS_DEDUP.ttl_ms * 1000}::BIGINT"
    return f"""{EV}, {EW}, {POS}, {dedup_cte("ew", "user_id || '|' || token", ttl)}, {placed("seen")}, novel AS (SELECT * FROM placed WHERE is_novel), {signal_cte("novel", backtest)}, {risk_cte("sig")},
    outcomes AS (
      SELECT s.event_id, s.user_id, s.token, coalesce(g.outcome, 'cooldown') AS outcome, s.nb AS signal_bias, s.nv AS signal_volatility, s.confidence,
        s.toggle AS strategy_toggle, s.weight AS strategy_weight, s.spread AS spread_modifier, coalesce(g.oms_events, '') AS oms_events
      FROM sig s LEFT JOIN gated g ON s.event_id = g.event_id
      UNION ALL
      SELECT event_id, user_id, token, 'duplicate', NULL, NULL, NULL, NULL, NULL, NULL, '' FROM seen WHERE NOT is_novel)"""
