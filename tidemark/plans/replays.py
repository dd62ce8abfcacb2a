"""Queries that run tables through the streaming operators: each in several micro-batches, with a stop and a restart, and the rows of its batch form."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.backends import InProcess, WholeSeconds
from ..operators.dedup import dedup_with, whole_seconds
from ..operators.lexicon import contribution, lookup
from ..params import EVENTS_DEDUP, EVENTS_RISK, EVENTS_SIGNAL, T0_US, LatencyParams
from ..sources.positions import FIELDS
from ..streaming import feeds, operators
from ..streaming import processor as P
from . import sql as Q
from . import streams as V

#: Micro-batches that a table is cut into.
BATCHES = 3
#: Microseconds by which the end mark is behind all that a delay of the table's span waits for.
LATER = 86_400_000_000


def shared_dir(spark: SparkSession) -> str:
    """A new folder under the cluster's shared one; a temporary one only in a local run without it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tidemark-stream-")
    return f"{base.rstrip('/')}/stream-{uuid.uuid4().hex[:12]}"


def replay_through(spark: SparkSession, table: DataFrame, make: Callable[[DataFrame], DataFrame], t_us: str | None = None, batches: int = BATCHES) -> DataFrame:
    """What the stream ``make(source)`` returns for all rows of ``table``.

    The table is written as files, dealt by hash of its rows, so rows come in no order; the stream takes them in ``batches`` micro-batches and
    stops. A micro-batch has a file for each core, as one file would be written and read by one task, whatever its size.
    With ``t_us`` a row of nulls with a time after all others follows in a second run from the checkpoint, so that the watermark
    passes everything; rows of null keys are not in the result.
    """
    base = shared_dir(spark)
    source, out, check = f"{base}/source", f"{base}/out", f"{base}/check"
    files = spark.sparkContext.defaultParallelism
    table.repartition(batches * files, F.xxhash64(*table.columns)).write.parquet(source)

    def run() -> None:
        rows = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", files).parquet(source)
        q = make(rows).writeStream.format("parquet").option("path", out).option("checkpointLocation", check).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()

    run()
    if t_us:
        last = F.max(t_us) + (F.max(t_us) - F.min(t_us)) + LATER
        end = spark.read.parquet(source).agg(last.alias(t_us)).select(*[(F.col(c) if c == t_us else F.lit(None).cast(table.schema[c].dataType)).alias(c) for c in table.columns])
        end.write.mode("append").parquet(source)
        run()
    return spark.read.parquet(out)


def _span(df: DataFrame, t_us: str = "t_us") -> str:
    """A delay that no row of the table is behind; watermarks are whole milliseconds, so it is a second longer than the table."""
    low, high = df.agg(F.min(t_us), F.max(t_us)).first()
    return f"{(high or 0) - (low or 0) + 1_000_000} microseconds"


def stream_dedup(spark, sf):
    """Keyed state: one row for each (user, token), dropped by a timer."""
    e = V.events(spark, sf).select("event_id", "user_id", "token", "t_us")
    delay, ttl = _span(e), F.lit(EVENTS_DEDUP.ttl_ms * 1000).cast("long")
    x = replay_through(spark, e, lambda s: operators.dedup_stream(s, ["user_id", "token"], "event_id", F.col("t_us"), ttl, delay), "t_us")
    return x.where("user_id is not null").select("event_id", "is_novel", "expires_us")


def _dedup(spark, sf, keys: list[str], ttl_us, evict=None) -> DataFrame:
    e = V.events(spark, sf).select("event_id", "user_id", "token", "t_us", "value")
    delay = _span(e)
    x = replay_through(spark, e, lambda s: operators.dedup_stream(s, keys, "event_id", F.col("t_us"), ttl_us, delay, evict), "t_us")
    return x.where("event_id is not null").select("event_id", "is_novel", "expires_us")


def stream_evict(spark, sf):
    """Errors are control rows that delete their user's key."""
    return _dedup(spark, sf, ["user_id"], F.lit(172_800_000_000).cast("long"), F.coalesce(F.col("token") == "error", F.lit(False))).drop("expires_us")


def stream_context(spark, sf):
    """Without a context: one key per token for all users, and another time to live."""
    return _dedup(spark, sf, ["token"], F.lit(3_600_000_000).cast("long")).drop("expires_us")


def stream_ttl_seconds(spark, sf):
    """A time to live per row, kept in whole seconds."""
    return _dedup(spark, sf, ["user_id"], whole_seconds(F.floor(F.coalesce("value", F.lit(0.0)) * 1000).cast("long")))


def dedup_backend(spark, sf):
    """The same in batch, by a backend that keeps whole seconds behind the common interface."""
    e = V.events(spark, sf).select("event_id", "user_id", "t_us", F.lit("key").alias("name"), (F.floor(F.col("value") * 1000).cast("long") * 1000).alias("ttl_us"))
    return dedup_with(e, ["user_id"], ["event_id"], "name", "t_us", "ttl_us", lambda: WholeSeconds(InProcess())).select("event_id", "is_novel", "expires_us")


def stream_reset(spark, sf):
    """Both gates with sign-ups as control rows that start their windows, ten days here, anew."""
    p = replace(EVENTS_RISK, rate_window_s=864_000, drawdown_window_s=864_000)
    e = V.weighted_events(spark, sf).select("event_id", "user_id", "t_us", "bias", (F.col("token") == "signup").alias("control"))
    delay = _span(e)
    rate = replay_through(spark, e, lambda s: operators.rate_gate_stream(s, "user_id", "event_id", p, "control", delay), "t_us").where("event_id is not null")
    down = replay_through(spark, e, lambda s: operators.drawdown_gate_stream(s, "user_id", "event_id", "bias", p, "control", delay), "t_us").where("event_id is not null")
    return rate.select("event_id", "rate_ok").join(down.select("event_id", "drawdown_ok", "cum_bias"), "event_id")


def stream_asof(spark, sf):
    """Tokens and positions as two streams, joined in one operator."""
    e = V.events(spark, sf).select("event_id", "user_id", "token", "t_us", "value")
    delay = _span(e)

    def make(s):
        views = s.where("token = 'view'").select("user_id", "event_id", "t_us", ((F.col("value") - 50) / 100).alias("net_position"), F.lit(1.0).alias("position_limit"), (-F.col("value") / 10).alias("pnl"), F.lit(-10.0).alias("pnl_limit"))
        return operators.position_asof_stream(s, views, "user_id", "event_id", delay)

    return replay_through(spark, e, make, "t_us").where("user_id is not null").select("event_id", *FIELDS)


def stream_pipeline(spark, sf):
    """The whole dataflow over tokens and positions in one stream, rows held until the watermark has passed them."""
    e = V.events(spark, sf).select("event_id", "user_id", "token", "t_us")
    p = V.event_positions(spark, sf).join(e.select("event_id", "t_us"), "event_id").select("user_id", "event_id", "t_us", *FIELDS)
    both, delay, lexicon = P.merge_positions(e, p, "user_id", "event_id"), _span(e), V.event_lexicon(spark)

    def make(s):
        weights = lookup(s, lexicon, bounded=True).select("*", *contribution(EVENTS_SIGNAL.bias_sensitivity, EVENTS_SIGNAL.volatility_sensitivity))
        return P.pipeline_stream(weights, "user_id", "event_id", EVENTS_SIGNAL, EVENTS_RISK, EVENTS_DEDUP, delay, hold=True)

    return replay_through(spark, both, make, "t_us").where("user_id is not null").select("event_id", "user_id", "token", "outcome", "signal_bias", "signal_volatility")


def stream_backoff(spark, sf):
    from .catalog import _pressures

    e = _pressures(spark, sf, ("t_us",)).select("event_id", "user_id", F.greatest("ingestion", "semantic").alias("composite"), "t_us")
    delay = _span(e)
    x = replay_through(spark, e, lambda s: operators.backoff_stream(s, "composite", "user_id", "event_id", t_us="t_us", delay=delay), "t_us")
    return x.where("user_id is not null").select("event_id", "multiplier")


def stream_pressure(spark, sf):
    """The monitor of each user's stream, ticks by event timers."""
    from .catalog import MONITOR, _pipeline

    x = _pipeline(spark, sf).select("user_id", "event_id", "t_us", "outcome", "sentiment")
    delay = _span(x)
    x = replay_through(spark, x, lambda s: operators.pressure_stream(s, "user_id", "event_id", 86_400_000_000, T0_US, delay, MONITOR), "t_us").where("user_id is not null")
    return x.select("user_id", "tick", "tokens", "suppressed", *[F.round(c, 6).alias(c) for c in ("ingestion", "semantic", "queue", "composite", "multiplier")])


#: Samples of the running statistics.
RUNNING = LatencyParams(sample_window=20)


def _rounded(x: DataFrame) -> DataFrame:
    return x.select("event_id", "user_id", "measurements", "avg_us", "min_us", "max_us", "p95_us", "p99_us", F.round("jitter_ms", 6).alias("jitter_ms"))


def stream_running_latency(spark, sf):
    x = V.latencies(spark, sf)
    delay = _span(x)
    x = replay_through(spark, x, lambda s: operators.running_latency_stream(s, "latency_us", "user_id", "event_id", RUNNING, t_us="t_us", delay=delay), "t_us")
    return _rounded(x.where("user_id is not null"))


def running_latency(spark, sf):
    """Statistics after every measurement of each user: all-time, and of the last twenty samples."""
    from ..operators import latency as L

    return _rounded(L.running_latency(V.latencies(spark, sf), "latency_us", ["user_id"], ["event_id"], RUNNING))


def _pieces(bodies: DataFrame, size: int = 37) -> DataFrame:
    """(feed, part, body, t_us) of (feed, body): the bytes in pieces of one length, which cut lines and messages anywhere."""
    n = F.octet_length("body")
    parts = F.sequence(F.lit(0).cast("long"), F.greatest(F.floor((n - 1) / size), F.lit(0)).cast("long"))
    x = bodies.select("feed", "body", F.explode(parts).alias("part"))
    return x.select("feed", "part", F.substring(F.encode("body", "UTF-8"), (F.col("part") * size + 1).cast("int"), F.lit(size)).alias("body"), F.lit(T0_US).cast("long").alias("t_us"))


def stream_positions(spark, sf):
    """Orders as each customer's message feed, its bytes in pieces: positions while they come."""
    from ..sources.fix import envelope

    m = V.order_messages(spark, sf).select("o_custkey", "o_orderkey", "seq", envelope(F.col("body")).alias("message"))
    of = m.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("seq", "o_orderkey", "message"))).alias("m"))  # of one customer
    bodies = of.select(F.col("o_custkey").cast("string").alias("feed"), F.array_join(F.transform("m", lambda x: x["message"]), "").alias("body"))
    x = replay_through(spark, _pieces(bodies, 173), feeds.message_stream).where("net_position is not null")
    names = of.select(F.col("o_custkey").cast("string").alias("feed"), F.posexplode(F.transform("m", lambda x: x["o_orderkey"])).alias("seq", "o_orderkey"))
    return x.join(names, ["feed", "seq"]).select(F.col("feed").cast(m.schema["o_custkey"].dataType).alias("o_custkey"), "o_orderkey", F.round("net_position", 2).alias("net_position"))


def stream_responses(spark, sf):
    """Conversations as event-stream responses, their bytes in pieces: tokens while they come."""
    from .catalog import _sse_lines

    lines = _sse_lines(spark, sf).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("n", "line"))).alias("l"))  # of one response
    bodies = lines.select(F.col("conv_id").cast("string").alias("feed"), F.concat(F.array_join(F.transform("l", lambda x: x["line"]), "\r\n"), F.lit("\r\n")).alias("body"))
    x = replay_through(spark, _pieces(bodies), feeds.response_stream)
    return x.select(F.col("feed").cast("long").alias("conv_id"), "n", "token")


RUNNING_SQL = f"""WITH l AS (SELECT event_id, user_id, floor(value * 100)::BIGINT AS x FROM events),
    w AS (SELECT *, count(*) OVER a AS measurements, (sum(x) OVER a // count(*) OVER a)::BIGINT AS avg_us, min(x) OVER a AS min_us, max(x) OVER a AS max_us,
      list(x) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN {RUNNING.sample_window - 1} PRECEDING AND CURRENT ROW) AS s FROM l WINDOW a AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)),
    o AS (SELECT *, list_sort(s) AS o, len(s) AS n FROM w)
    SELECT event_id, user_id, measurements, avg_us, min_us, max_us, o[least(floor(n * 0.95::DOUBLE)::INT + 1, n)] AS p95_us, o[least(floor(n * 0.99::DOUBLE)::INT + 1, n)] AS p99_us,
      round(sqrt(list_sum(list_transform(s, lambda y: (y - avg_us)::DOUBLE * (y - avg_us))) / n) / 1000, 6) AS jitter_ms FROM o"""


def register(queries: dict, oracles: dict) -> None:
    """Each stream's SQL is that of its batch form."""
    from .catalog import CONVERSATION

    like = {
        stream_dedup: "dedup_ttl", stream_evict: "dedup_evict", stream_context: "dedup_context", stream_ttl_seconds: "dedup_ttl_seconds", dedup_backend: "dedup_ttl_seconds", stream_reset: "gate_reset",
        stream_backoff: "backoff_level", stream_pressure: "pressure_timeline", stream_positions: "fix_position",
    }
    own = {
        stream_asof: f"WITH {Q.EV}, {Q.POS}, {Q.placed('e0')} SELECT event_id, {', '.join(FIELDS)} FROM placed",
        stream_pipeline: f"WITH RECURSIVE {Q.pipeline_cte(False)} SELECT event_id, user_id, token, outcome, signal_bias, signal_volatility FROM outcomes",
        stream_running_latency: RUNNING_SQL, running_latency: RUNNING_SQL,
        stream_responses: f"WITH {CONVERSATION} SELECT conv_id, seq * 4 + 1 AS n, token FROM ct",
    }
    for f, sql in {**{f: oracles[name] for f, name in like.items()}, **own}.items():
        queries[f.__name__], oracles[f.__name__] = f, sql
