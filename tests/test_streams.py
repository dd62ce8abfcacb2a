"""Ordered operators over streams against their batch forms: any split of the rows, restarts from the checkpoint, rows out of order."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import dedup as D
from tidemark.operators import latency as L
from tidemark.operators import signals as S
from tidemark.operators import steps
from tidemark.operators.backends import DedupBackend, InProcess, StateBacked, WholeSeconds
from tidemark.params import EVENTS_DEDUP, EVENTS_RISK, EVENTS_SIGNAL, T0_US, DedupParams, LatencyParams, PressureParams, RiskParams
from tidemark.plans import streams as V
from tidemark.sources import fix, sse
from tidemark.sources.captured import CapturedMessages
from tidemark.sources.positions import FIELDS, position_asof
from tidemark.streaming import feeds, operators
from tidemark.streaming import processor as P

FAR = 10**15


class Fed:
    """Runs a stream over batches of rows; each run starts from the checkpoint and finds one more file."""

    def __init__(self, spark, tmp_path, schema):
        self.spark, self.schema, self.path = spark, schema, {k: str(tmp_path / k) for k in ("in", "out", "check")}

    def source(self):
        return self.spark.readStream.schema(self.schema).parquet(self.path["in"])

    def run(self, batches, make):
        for rows in batches:
            self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(self.path["in"])
            self.drain(make)
        return self.spark.read.parquet(self.path["out"])

    def drain(self, make):
        q = make(self.source()).writeStream.format("parquet").option("path", self.path["out"]).option("checkpointLocation", self.path["check"]).outputMode("append").trigger(availableNow=True).start()
        assert q.awaitTermination(300)
        if q.exception():
            raise q.exception()
        return q

    def state(self, name, operator=0):
        return self.spark.read.format("statestore").option("path", self.path["check"]).option("operatorId", operator).option("stateVarName", name).load()


def split(rows, parts, seed=0, apart=0):
    """Rows in ``parts`` batches; with ``apart`` each is up to so many places out of order."""
    rng = random.Random(seed)
    rows = [r for _, r in sorted(enumerate(rows), key=lambda x: x[0] + rng.uniform(0, apart))]
    cuts = sorted(rng.sample(range(1, len(rows)), parts - 1))
    return [rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)])]


def same(a, b, columns):
    plain = lambda df: sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
    x, y = plain(a), plain(b)
    assert len(x) == len(y) > 0
    for p, q in zip(x, y):
        assert all(u == v or (isinstance(u, float) and isinstance(v, float) and math.isclose(u, v, rel_tol=1e-12, abs_tol=1e-12)) for u, v in zip(p, q)), (p, q)


def ordered_rows(n=240, keys="ab", seed=3):
    """(key, seq, t_us, token, x): times ascend with seq, some are equal; gaps of several seconds."""
    rng = random.Random(seed)
    t, out = T0_US, []
    for seq in range(n):
        t += rng.choice([0, 1, 1_000, 400_000, 1_500_000, 7_000_000])
        out.append((rng.choice(keys), seq, t, rng.choice("pqrs"), round(rng.random(), 3)))
    return out


ROWS = "key string, seq long, t_us long, token string, x double"
END = [("zz", 10_000, T0_US + FAR, "p", 0.0)]


@pytest.mark.parametrize("parts,apart", [(1, 0), (3, 6)])
def test_dedup(spark, tmp_path, parts, apart):
    rows = ordered_rows()
    ttl, evict = F.lit(5_000_000).cast("long"), (F.col("x") < 0.1)
    fed = Fed(spark, tmp_path, ROWS)
    make = lambda s: operators.dedup_stream(s, ["key", "token"], "seq", F.col("t_us"), ttl, "60 seconds", evict)
    got = fed.run([*split(rows, parts, 1, apart), END], make).where("key <> 'zz'")
    expect = D.dedup(spark.createDataFrame(rows, ROWS), ["key", "token"], ["seq"], F.col("t_us"), ttl, evict)
    same(got, expect, ["key", "seq", "is_novel", "expires_us"])
    # all keys of the rows have expired and left; the last row waits
    assert fed.state("value").count() == 0


def test_asof(spark, tmp_path):
    rng = random.Random(5)
    rows = [(k, 2 * n, t, tok, x, None) for k, n, t, tok, x in ordered_rows()]
    marks = [(rng.choice("ab"), 2 * n + rng.choice([0, 1]), t, None, x, 1) for _, n, t, _, x in ordered_rows()[::5]]
    schema = ROWS + ", mark int"
    side = lambda df: (df.where("mark is null").drop("mark"), df.where("mark = 1").select("key", "seq", "t_us", F.col("x").alias("net_position"), F.lit(2.0).alias("position_limit"), F.lit(0.5).alias("pnl"), F.lit(-1.0).alias("pnl_limit")))
    both = sorted(rows + marks, key=lambda r: (r[2], r[1]))
    fed = Fed(spark, tmp_path, schema)
    end = [(*END[0], None)]
    got = fed.run([*split(both, 4, 2, 8), end], lambda s: operators.position_asof_stream(*side(s), "key", "seq", "120 seconds")).where("key <> 'zz'")
    same(got, position_asof(*side(spark.createDataFrame(rows + marks, schema)), "key", "seq"), ["key", "seq", "token", *FIELDS])


@pytest.mark.parametrize("delay", [None, "60 seconds"])
def test_backoff(spark, tmp_path, delay):
    rows = ordered_rows()
    fed = Fed(spark, tmp_path, ROWS)
    make = lambda s: operators.backoff_stream(s, "x", "key", "seq", t_us="t_us" if delay else None, delay=delay)
    got = fed.run([*split(rows, 4, 3, 5 if delay else 0), END], make).where("key <> 'zz'")
    same(got, L.backoff(spark.createDataFrame(rows, ROWS), "x", ["key"], ["seq"]), ["key", "seq", "multiplier"])


@pytest.mark.parametrize("parts,apart", [(1, 0), (4, 7)])
def test_pressure(spark, tmp_path, parts, apart):
    p = PressureParams(max_tps=2.0, queue_capacity=40)
    outcome = F.when(F.col("token") == "p", "duplicate").when(F.col("token") == "q", "cooldown").otherwise("pass")
    shaped = lambda df: df.select("key", "seq", "t_us", outcome.alias("outcome"), F.col("x").alias("sentiment"))
    rows = ordered_rows()
    fed = Fed(spark, tmp_path, ROWS)
    make = lambda s: operators.pressure_stream(shaped(s), "key", "seq", 1_000_000, T0_US, "60 seconds", p)
    got = fed.run([*split(rows, parts, 4, apart), END], make).where("key <> 'zz'")
    expect = L.pressure_monitor(shaped(spark.createDataFrame(rows, ROWS)), "key", "seq", 1_000_000, T0_US, p)
    same(got, expect, ["key", "tick", "tokens", "suppressed", "ingestion", "semantic", "queue", "composite", "multiplier"])


def test_pressure_of_empty_ticks(spark, tmp_path):
    """A silent key has a row for each tick as other keys move the watermark."""
    rows = [[("a", 0, T0_US, "r", 0.5)], [("b", 1, T0_US + 3_500_000, "r", 0.5)], [("b", 2, T0_US + 6_100_000, "r", 0.5)]]
    shaped = lambda df: df.select("key", "seq", "t_us", F.lit("cooldown").alias("outcome"), F.col("x").alias("sentiment"))
    fed = Fed(spark, tmp_path, ROWS)
    got = fed.run(rows, lambda s: operators.pressure_stream(shaped(s), "key", "seq", 1_000_000, T0_US, "1 second", PressureParams(max_tps=1.0), True))
    assert [tuple(r) for r in got.where("key = 'a'").orderBy("tick").select("tick", "tokens", "ingestion", "multiplier").collect()] == [
        (0, 1, 1.0, 2.25), (1, 0, 0.0, 1.0), (2, 0, 0.0, 1.0), (3, 0, 0.0, 1.0), (4, 0, 0.0, 1.0),
    ]


def brute_stats(rows, n, resets=()):
    out, seen = {}, {}
    for key, seq, x in rows:
        if seq in resets:
            seen[key] = []
            continue
        s = seen.setdefault(key, [])
        s.append(x)
        w = sorted(s[-n:])
        m = sum(s) // len(s)
        at = lambda q: w[min(int(len(w) * q), len(w) - 1)]
        out[seq] = (len(s), m, min(s), max(s), at(0.95), at(0.99), math.sqrt(sum((v - m) ** 2 for v in w) / len(w)) / 1000)
    return out


def test_running_latency(spark, tmp_path):
    rng = random.Random(8)
    rows = [(k, n, t, rng.choice([1, 5, 5, 10, 10_000, rng.randrange(1000)]), n in (90, 91)) for k, n, t, _, _ in ordered_rows(300)]
    schema, p = "key string, seq long, t_us long, latency_us long, reset boolean", LatencyParams(sample_window=25)
    expect = brute_stats([(k, n, x) for k, n, _, x, _ in rows], 25, {90, 91})
    names = ["measurements", "avg_us", "min_us", "max_us", "p95_us", "p99_us", "jitter_ms"]
    batch = L.running_latency(spark.createDataFrame(rows, schema), "latency_us", ["key"], ["seq"], p, "reset")
    fed = Fed(spark, tmp_path, schema)
    stream = fed.run(split(rows, 4, 5), lambda s: operators.running_latency_stream(s, "latency_us", "key", "seq", p, "reset"))
    for df in (batch, stream):
        got = {r["seq"]: tuple(r[c] for c in names) for r in df.collect()}
        assert set(got) == set(expect)
        for seq, v in expect.items():
            assert got[seq][:6] == v[:6] and math.isclose(got[seq][6], v[6], rel_tol=1e-12, abs_tol=1e-12)
    assert fed.state("ring").count() <= 2 * 25
    # the last row of each key is what the final statistics say
    last = {r.key: r for r in batch.groupBy("key").agg(F.max_by("p99_us", "seq").alias("p99_us"), F.max_by("p95_us", "seq").alias("p95_us")).collect()}
    kept = L.since_reset(spark.createDataFrame(rows, schema), ["key"], ["seq"], "reset")
    for r in L.latency_percentiles(kept, "latency_us", "seq", p, ["key"]).collect():
        assert (r.p95_us, r.p99_us) == (last[r.key].p95_us, last[r.key].p99_us)


def test_running_latency_without_profiling(spark):
    rows = [("a", n, n * 10) for n in range(5)]
    got = L.running_latency(spark.createDataFrame(rows, "key string, seq long, x long"), "x", ["key"], ["seq"], LatencyParams(profiling=False)).orderBy("seq").collect()
    assert [(r.measurements, r.avg_us, r.max_us, r.p99_us, r.jitter_ms) for r in got][-1] == (5, 20, 40, 0, 0.0)


def test_gates_with_control_rows(spark, tmp_path):
    r = RiskParams(rate_limit=2, rate_window_s=20, max_drawdown=1.0, drawdown_window_s=40)
    rows = [(k, n, t, tok, x, n % 37 == 36) for k, n, t, tok, x in ordered_rows()]
    schema = ROWS + ", reset boolean"
    table = spark.createDataFrame(rows, schema)
    for name, make, expect, columns in (
        ("rate", lambda s: operators.rate_gate_stream(s, "key", "seq", r, "reset"), S.rate_gate(table, ["key"], ["seq"], r, "reset"), ["rate_ok"]),
        ("down", lambda s: operators.drawdown_gate_stream(s, "key", "seq", "x", r, "reset"), S.drawdown_gate(table, ["key"], ["seq"], "x", r, "reset"), ["drawdown_ok", "cum_bias"]),
    ):
        fed = Fed(spark, tmp_path / name, schema)
        same(fed.run(split(rows, 3, 6), make), expect, ["key", "seq", *columns])


class _Map:
    """Map state of a test."""

    def __init__(self):
        self.entries, self.writes = {}, 0

    def containsKey(self, k):
        return k in self.entries

    def getValue(self, k):
        return self.entries[k]

    def updateValue(self, k, v):
        self.entries[k] = v
        self.writes += 1

    def removeKey(self, k):
        self.entries.pop(k, None)

    def keys(self):
        return iter(list(self.entries))


@pytest.mark.parametrize("make", [InProcess, lambda: StateBacked(_Map(), _Map()), lambda: WholeSeconds(InProcess())])
def test_backend_contract(make):
    b: DedupBackend = make()
    s = 1_000_000
    assert b.size() == 0 and b.check_and_register("k", 0, 2 * s) and not b.check_and_register("k", s, 9 * s)  # a repeat doesn't renew
    assert b.expires("k") == 2 * s and b.check_and_register("other", s, 5 * s) and b.size() == 2
    assert b.check_and_register("k", 2 * s, 2 * s)  # novel at the very time of expiry
    b.evict("k")
    b.evict("never there")
    assert b.expires("k") is None and b.check_and_register("k", 2 * s, s)
    assert b.purge_expired(3 * s) == 1 and b.size() == 1 and b.expires("other") == 6 * s
    assert b.purge_expired(3 * s) == 0 and b.check_and_register("k", 3 * s, s)


def test_backends_agree():
    rng = random.Random(2)
    stores = [InProcess(), StateBacked(_Map(), _Map())]
    t = 0
    for _ in range(2_000):
        t += rng.choice([0, 1, 999, 300_000])
        key, what = rng.choice("abcdef"), rng.random()
        if what < 0.1:
            [b.evict(key) for b in stores]
        elif what < 0.2:
            assert len({b.purge_expired(t) for b in stores}) == 1
        else:
            ttl = rng.choice([1_500_000, 1_499_999, 700])
            assert len({b.check_and_register(key, t, ttl) for b in stores}) == 1
        if what > 0.9:
            stores[1].flush()
            stores[1].start()  # the next micro-batch
    seen = stores[1].seen.writes
    stores[1].flush()
    assert stores[1].seen.writes - seen <= 6  # only what has changed


def test_whole_seconds_and_purges(spark):
    rows = [("s", n, "k", n * 600_000) for n in range(8)]
    x = spark.createDataFrame(rows, "stream string, seq long, name string, t_us long").withColumn("ttl_us", F.lit(1_900_000).cast("long"))
    novel = lambda backend: [r.is_novel for r in D.dedup_with(x, ["stream"], ["seq"], "name", "t_us", "ttl_us", backend).orderBy("seq").collect()]
    assert novel(InProcess) == [True, False, False, False, True, False, False, False]
    assert novel(lambda: WholeSeconds(InProcess())) == [True, False, True, False, True, False, True, False]
    many = spark.range(5_000).select(F.lit("s").alias("stream"), F.col("id").alias("seq"), F.col("id").cast("string").alias("name"), (F.col("id") * 1000).alias("t_us"), F.lit(5_000).cast("long").alias("ttl_us"))
    assert D.dedup_with(many, ["stream"], ["seq"], "name", "t_us", "ttl_us").where("is_novel").count() == 5_000


def wire(messages):
    soh = "\x01"
    return "".join(m.replace("|", soh) for m in messages).encode()


def cut_bytes(data, rng, most=40):
    out, at = [], 0
    while at < len(data):
        n = rng.randrange(1, most)
        out.append(data[at : at + n])
        at += n
    return out


CHUNKS = "feed string, part long, body binary, t_us long"


def chunk_batches(feeds_, rng, batches=3):
    rows = [(f, k, bytearray(b), T0_US + k) for f, data in feeds_.items() for k, b in enumerate(cut_bytes(data, rng))]
    rng.shuffle(rows)  # pieces out of order, over micro-batches
    return [rows[k::batches] for k in range(batches)], rows


def test_messages_in_pieces(spark, tmp_path):
    rng = random.Random(11)
    kinds = ["35=8|54=1|32=10.5|10=001|", "35=8|54=2|32= 3x|10=002|", "35=AP|702=7|703=2.5|10=003|", "35=AP|702=x|10=004|", "35=0|10=005|", "35=8|32=1|10=006|", "35=AP|703=1e2|10=007|", "110=5|35=8|54=1|32=+2|10=008|", "35=8|54=1|32=.5|54=2|10=é|"]
    feeds_ = {f: wire(rng.choices(kinds, k=60)) + b"35=8\x0154=1" for f in ("one", "two", "three")}
    batches, rows = chunk_batches(feeds_, rng)
    # a piece that comes again is ignored
    got = Fed(spark, tmp_path, CHUNKS).run([*batches, rows[:5]], feeds.message_stream)
    whole = spark.createDataFrame([(f, d.decode()) for f, d in feeds_.items()], "feed string, body string").select("feed", F.posexplode(fix.frame(F.col("body"))).alias("seq", "message"))
    same(got, whole, ["feed", "seq", "message"])
    same(got.where("net_position is not null"), fix.net_positions(whole, "feed", "seq"), ["feed", "seq", "net_position"])


def response(rng, n):
    lines = ["HTTP/1.1 200 OK", "Transfer-Encoding: chunked", ""]
    for k in range(n):
        text = json.dumps({"choices": [{"delta": {"content": rng.choice(["crash", " rally", "é\n", "", "日本"])}}]}, ensure_ascii=rng.random() < 0.5)
        lines += [format(len(text), "x"), "data: " + text, ""]
        if k % 7 == 3:
            lines += ["data: broken", ": note", 'data: {"choices":[{"delta":{}}]}']
    return "\r\n".join([*lines, "data: [DONE]", 'data: {"choices":[{"delta":{"content":"late"}}]}', "half"]).encode()


def test_responses_in_pieces(spark, tmp_path):
    rng = random.Random(12)
    bodies = {f: response(rng, 25) for f in ("r1", "r2")}
    batches, _ = chunk_batches(bodies, rng, 4)
    got = Fed(spark, tmp_path, CHUNKS).run(batches, feeds.response_stream)
    lines = [(f, n, x.removesuffix("\r")) for f, b in bodies.items() for n, x in enumerate(b.decode().split("\n"))]
    same(got, sse.decode_sse(spark.createDataFrame(lines, "feed string, n long, line string"), "feed", "n"), ["feed", "n", "token"])


def test_feeds_from_files_into_the_dataflow(spark, tmp_path):
    """Pieces of responses as files that appear, decoded and run through the dataflow in one query of two stateful operators."""
    from tidemark.operators.lexicon import default_lexicon
    from tidemark.params import LIVE_RISK, SignalParams

    rng = random.Random(13)
    body = response(rng, 12)
    signal = SignalParams(backtest=True)
    folder, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    for k, b in enumerate(cut_bytes(body, rng, 120)):
        (tmp_path / "in" / "r 1").mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / "r 1" / f"{k:04d}.txt").write_bytes(b)
        if k % 6 and k < 12:
            continue
        tokens = P.with_no_positions(feeds.live_responses(spark, folder))
        x = P.pipeline_stream(P.prepare(tokens, default_lexicon(spark), signal), "feed", "n", signal, LIVE_RISK, DedupParams(1))
        q = x.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).outputMode("append").trigger(availableNow=True).start()
        assert q.awaitTermination(300) and not q.exception()
        if k >= 12:
            break
    got = [(r.feed, r.n, r.token) for r in spark.read.parquet(out).orderBy("n").collect()]
    done = sse.LineDecoder().feed(b"".join((tmp_path / "in" / "r 1" / f"{i:04d}.txt").read_bytes() for i in range(k + 1)))
    assert got == [("r 1", n, t) for n, p in done if p[0] == "{" and (t := json.loads(p)["choices"][0]["delta"].get("content"))] and got


def test_positions_of_a_growing_feed(spark, tmp_path):
    data = wire(["35=8|54=1|32=10|10=001|", "35=AP|702=7|703=2|10=003|", "35=8|54=2|32=1|10=009|"])
    (tmp_path / "in" / "f").mkdir(parents=True)
    for k, b in enumerate((data[:30], data[30:45], data[45:])):
        (tmp_path / "in" / "f" / f"{k}.fix").write_bytes(b)
    x = CapturedMessages(str(tmp_path / "in"), 3.0, -5.0, stream=True).positions(spark)
    q = x.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    assert q.awaitTermination(300) and not q.exception()
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("seq").collect()
    assert [(r.seq, r.net_position, r.position_limit, r.pnl, r.pnl_limit) for r in got] == [(0, 10.0, 3.0, 0.0, -5.0), (1, 5.0, 3.0, 0.0, -5.0), (2, 4.0, 3.0, 0.0, -5.0)]


def test_dataflow_holds_rows_and_positions(spark, sf, tmp_path):
    """Tokens and positions as two streams in one, out of order, held until the watermark: the batch's rows."""
    from tidemark.plans.catalog import _pipeline

    e = V.events(spark, sf).select("user_id", "event_id", "token", "t_us")
    p = V.event_positions(spark, sf).join(e.select("event_id", "t_us"), "event_id").select("user_id", "event_id", "t_us", *FIELDS)
    rows = [tuple(r) for r in P.merge_positions(e, p, "user_id", "event_id").select("user_id", "event_id", "token", "t_us", *FIELDS).collect()]
    rows.sort(key=lambda r: (r[3], r[1], r[2] is not None))
    schema = "user_id long, event_id long, token string, t_us long, " + ", ".join(f"{f} double" for f in FIELDS)
    fed = Fed(spark, tmp_path, schema)
    span = max(r[3] for r in rows) - min(r[3] for r in rows)
    make = lambda s: P.pipeline_stream(P.prepare(s, V.event_lexicon(spark), EVENTS_SIGNAL), "user_id", "event_id", EVENTS_SIGNAL, EVENTS_RISK, EVENTS_DEDUP, f"{span // 20} microseconds", hold=True)
    end = [(10**6, 10**9, "view", T0_US + FAR, None, None, None, None)]
    got = fed.run([*split(rows, 3, 7, 10), end], make).where("user_id < 1000000")
    same(got, _pipeline(spark, sf), ["user_id", "event_id", "outcome", "signal_bias", "signal_volatility"])


def test_dataflow_control_rows(spark, tmp_path):
    """Eviction, a time to live and a context per row, resets: as the batch folds have them; state rows of expired keys go."""
    from tidemark.operators.lexicon import default_lexicon
    from tidemark.params import SignalParams

    rng = random.Random(21)
    rows = []
    for k, n, t, _, x in ordered_rows(200, "ab", 9):
        control = "evict" if n % 11 == 5 else "reset" if n % 29 == 28 else None
        rows.append((k, n, rng.choice(["crash", "rally", "the"]), t, rng.choice(["", "", "c1"]), rng.choice([3_000_000, 20_000_000]), control))
    schema = "key string, seq long, token string, t_us long, context string, ttl_us long, control string"
    signal, risk = SignalParams(backtest=True), RiskParams(rate_limit=2, rate_window_s=30, max_bias=9.0, max_volatility=9.0, max_drawdown=2.0)
    fed = Fed(spark, tmp_path, schema)
    make = lambda s: P.pipeline_stream(P.prepare(P.with_no_positions(s), default_lexicon(spark), signal), "key", "seq", signal, risk, DedupParams(), "60 seconds")
    got = {r.seq: r for r in fed.run([*split(rows, 3, 8), [("zz", 10_000, "crash", T0_US + FAR, "", 1_000_000, None)]], make).collect()}
    table = spark.createDataFrame(rows, schema)
    d = D.dedup(table.where("control is null or control = 'evict'"), ["key", "token", "context"], ["seq"], F.col("t_us"), F.col("ttl_us"), F.coalesce(F.col("control") == "evict", F.lit(False)))
    novel = {r.seq: r.is_novel for r in d.where("control is null").collect()}
    assert {n: r.outcome != steps.DUPLICATE for n, r in got.items() if n in novel} == novel
    from tidemark.operators.lexicon import contribution, lookup

    kept = table.where("control is null or control = 'reset'").join(d.where("control is null and is_novel").select("seq", F.lit(True).alias("new")), "seq", "left").where("new or control = 'reset'")
    weighted = lookup(kept, default_lexicon(spark)).select("*", *contribution(), *[F.lit(x).alias(f) for f, x in zip(FIELDS, (0.0, 1.0, 0.0, -10.0))], (F.coalesce(F.col("control") == "reset", F.lit(False))).alias("control_row"))
    expect = {r.seq: (r.outcome, r.cum_bias) for r in S.gated_signals(weighted, ["key"], ["seq"], signal, risk, "control_row").collect()}
    assert {n: (r.outcome, r.cum_bias) for n, r in got.items() if r.outcome != steps.DUPLICATE and n < 10_000} == expect
    assert {o for o, _ in expect.values()} >= {"pass", "reset", "rate_limit_exceeded"}
    live = P.live_keys(spark, fed.path["check"]).collect()
    assert [(r.key["key"], r.token) for r in live] == [("zz", "|crash")]


def test_rows_without_order_time_or_key(spark, tmp_path):
    """Rows without an order or a time have no place; null is a key like others; columns of any name stay."""
    schema = "key string, seq long, t_us long, token string, x double, _t string, rows string, last string"
    rows = [(None, 0, T0_US, "a", 0.9, "1", "2", "3"), ("k", None, T0_US, "a", 0.9, "1", "2", "3"), ("k", 1, None, "a", 0.9, "1", "2", "3"), ("k", 2, T0_US + 5, None, None, None, None, None), ("k", 3, T0_US + 6, "a", 0.9, "1", "2", "3")]
    end = [("zz", 9, T0_US + FAR, "a", 0.0, "", "", "")]
    fed = Fed(spark, tmp_path, schema)
    got = fed.run([rows, end], lambda s: operators.backoff_stream(s, "x", "key", "seq", t_us="t_us", delay="1 second"))
    assert sorted(((r.key, r.seq, r.multiplier, r._t, r["rows"], r["last"]) for r in got.where("key is null or key <> 'zz'").collect()), key=repr) == [
        ("k", 2, 1.0, None, None, None), ("k", 3, 1.5, "1", "2", "3"), (None, 0, 1.5, "1", "2", "3"),
    ]


class _Handle:
    """A key's states and timers in memory; counts what is written."""

    def __init__(self):
        self.maps, self.timers, self.writes = {}, [], 0

    def getMapState(self, name, *_):
        handle = self

        class Map(_Map):
            def updateValue(self, key, value):
                handle.writes += 1
                super().updateValue(key, value)

        return self.maps.setdefault(name, Map())

    def getValueState(self, *_):
        return type("Value", (), {"exists": lambda s: False, "get": lambda s: None, "update": lambda s, v: None, "clear": lambda s: None})()

    def registerTimer(self, ms):
        self.timers.append(ms)


def test_rows_wait_in_blocks(monkeypatch):
    """A micro-batch writes an entry for each block and one timer for a key, not one of each for every row; all come in order."""
    from types import SimpleNamespace

    from pyspark.sql import Row
    from pyspark.sql import types as T

    from tidemark.streaming import ordered

    monkeypatch.setattr(ordered, "BLOCK", 16)
    monkeypatch.setattr(ordered, "RUN", 64)

    class Echo(ordered.Machine):
        state = "n long"
        start, dump, step = (lambda self: None), (lambda self: (0,)), (lambda self, row: [(row.t,)])

    rng, handle = random.Random(2), _Handle()
    x = ordered.Ordered(Echo(), T.StructType().add("seq", T.LongType()).add("t", T.LongType()), ["seq"], ["t"], True, "t")
    x.init(handle)
    at = lambda ms: SimpleNamespace(getCurrentWatermarkInMs=lambda: ms)
    times = [1_000 * k + 1 for k in rng.sample(range(5_000), 600)]
    for part in (times[:300], times[300:]):
        list(x.handleInputRows(("k",), iter([Row("seq", "t", "stamp")(t, t, None) for t in part]), at(0)))
    assert handle.writes <= 2 * (300 // 16 + 5) and len(handle.timers) == 2
    got = []
    for now in (1_000, 3_333, 9_999):
        got += [r.t for r in x.handleExpiredTimer(("k",), at(now), None)]
        assert got == sorted(t for t in times if -(-t // 1000) <= now)
    assert not list(handle.maps["held"].keys())


def test_early_pieces_share_entries():
    """Pieces that come in any order are written some hundreds an entry, and read as if they came in order."""
    body = b"".join(b'data: {"choices":[{"delta":{"content":"%d"}}]}\r\n' % n for n in range(200))
    pieces = [(part, body[k : k + 7]) for part, k in enumerate(range(0, len(body), 7))]
    random.Random(4).shuffle(pieces)
    handle, machine, got, kept = _Handle(), feeds._Response(), [], None
    machine.open(handle)
    for batch in (pieces[:500], pieces[500:900], pieces[900:]):
        machine.start() if kept is None else machine.load(kept)
        for part, piece in batch:
            got += machine.step({"feed": "f", "part": part, "body": piece, "t_us": 0})
        kept = machine.dump()
    assert [n for _, n, _, _ in got] == list(range(200))
    assert handle.writes <= 3 * (len(pieces) // feeds.BLOCK + 1) and not list(handle.maps["early"].keys())


def test_pressure_at_a_tie_of_its_rounding(spark):
    """The variance of these is a short decimal, 0.248203125, so its pressure of 0.9928125 rounds up, in batch and step by step."""
    tenths = "60633306030636603633669006033606339330636369606993333906939063090066636039663990903033360306393903036003333699660993069393306633"
    x = [-0.9 if c == "9" else int(c) / 10 for c in tenths]
    p, monitor = PressureParams(max_tps=200.0, queue_capacity=10), steps.Monitor(PressureParams(max_tps=200.0, queue_capacity=10))
    for sentiment in x:
        monitor.load(monitor.dump())
        monitor.token(0, sentiment, False)
    assert monitor.close(1)[0][4] == 0.9928125
    rows = spark.createDataFrame([("a", n, T0_US + n, "pass", s) for n, s in enumerate(x)], "key string, seq long, t_us long, outcome string, sentiment double")
    assert [r.s for r in L.pressure_monitor(rows, "key", "seq", 1_000_000, T0_US, p).select(F.round("semantic", 6).alias("s")).collect()] == [0.992813]


@pytest.mark.parametrize("extra", ["decimal(20,4)", "timestamp"])
def test_keys_share_entries(spark, tmp_path, extra):
    """Rows of many keys wait in few entries, and what goes along is the same after it; columns that can't go as text have entries by key."""
    odd = [math.nan, math.inf, -math.inf, -0.0, 0.1, 5e-324, None]
    words = ['"', "\\", "\n\t\x01", "é 😀", "", "{}", "null", None]
    rows = [(f"k{n % 3_000}" if n % 7 else None, n, T0_US + n * 1_000, odd[n % 7], words[n % 8], n % 5 == 0, 2**63 - 1 - n) for n in range(6_000 if extra != "timestamp" else 60)]
    schema = "key string, seq long, t_us long, x double, `a b` string, evict boolean, big long"
    table = lambda x: spark.createDataFrame(x, schema).withColumn("more", (F.col("seq") / 8).cast(extra))
    fed, ttl = Fed(spark, tmp_path, table(rows[:1]).schema), F.lit(4_000_000).cast("long")
    make = lambda s: operators.dedup_stream(s, ["key"], "seq", F.col("t_us"), ttl, "60 seconds", F.col("evict"))
    table(rows).write.parquet(fed.path["in"])
    fed.drain(make)
    assert fed.state("held").count() <= (1_100 if extra != "timestamp" else 60)
    table([("zz", 10_000, T0_US + FAR, 0.0, "", False, 0)]).write.mode("append").parquet(fed.path["in"])
    fed.drain(make)
    assert fed.state("value").count() == 0
    plain = lambda df: sorted(repr(tuple(r[c] for c in ("seq", "key", "x", "a b", "big", "more", "is_novel", "expires_us"))) for r in df.collect())
    got = plain(spark.read.parquet(fed.path["out"]).where("key is null or key <> 'zz'"))
    assert got == plain(D.dedup(table(rows), ["key"], ["seq"], F.col("t_us"), ttl, F.col("evict"))) and len(got) == len(rows)


def test_replays_deal_each_micro_batch_to_all_cores(spark, sf, tmp_path, monkeypatch):
    """Three micro-batches before the stop, each of a file for each core, not of one that one task writes and reads."""
    from tidemark.plans import replays

    monkeypatch.setattr(replays, "shared_dir", lambda spark: str(tmp_path / "shared"))
    assert replays.stream_ttl_seconds(spark, sf).count() == 1_000
    logs = [(tmp_path / "shared" / "check" / "sources" / "0" / str(n)).read_text().splitlines()[1:] for n in range(4)]
    cores = spark.sparkContext.defaultParallelism
    assert cores > 1 and [len(files) for files in logs] == [cores, cores, cores, 1]


def test_backoff_replay_keeps_its_rows_apart(spark, tmp_path):
    """Each user counts events from 0: the times are those of the rows themselves, not of all that share a number."""
    import duckdb

    from tidemark.plans import catalog

    path = str(tmp_path / "events.parquet")
    sql = f"SELECT k AS event_id, TIMESTAMP '2024-01-01' + INTERVAL (k * 60 + u) SECOND AS ts, u AS user_id, 'click' AS event_type, (k * 37 + u * 11) % 100 * 1.5 AS value FROM range(40) a(k), range(3) b(u)"
    con = duckdb.connect()
    con.execute(f"COPY ({sql}) TO '{path}' (FORMAT parquet)")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{path}'")
    expect = con.execute(catalog.ORACLES["backoff_level"]).fetchall()
    got = catalog.QUERIES["stream_backoff"](spark, str(tmp_path)).collect()
    assert sorted(tuple(r) for r in got) == sorted(expect) and len(got) == 120 and len({m for _, m in expect}) > 2
