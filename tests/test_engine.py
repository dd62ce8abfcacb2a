"""Golden vectors, invariants and small cases of the engine."""

import json
import re
from dataclasses import replace

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import latency as L
from tidemark.operators import lexicon as X
from tidemark.operators import signals as S
from tidemark.operators import steps
from tidemark.operators.dedup import dedup
from tidemark.params import LIVE_RISK, T0_US, Config, ConfigWatcher, DedupParams, LatencyParams, RiskParams, SignalParams, load_config, save_config
from tidemark.plans import streams as V
from tidemark.plans.catalog import DEMO, DEMO_POSITIONS
from tidemark.plans.pipeline import run_pipeline
from tidemark.sources import fix, sse
from tidemark.sources.positions import mock_positions, parse_position
from tidemark.sources.tokens import read_token_file, replay

GOLDEN = [
    (-0.630000, 0.720000, -1, 0.063000, "pass"), (-1.238500, 1.404000, -1, 0.123850, "pass"), (-0.588288, 0.936900, -1, 0.058829, "pass"), (-0.189437, 0.625028, 0, 0.0, "pass"),
    (0.540035, 0.953776, 1, -0.054004, "pass"), (-0.553483, 1.083044, -1, 0.055348, "pass"), (-0.262905, 1.144446, 0, 0.0, "pass"), (0.275120, 1.183612, 0, 0.0, "pass"),
    (0.370682, 0.722216, 0, 0.0, "pass"), (0.352148, 0.736105, 0, 0.0, "pass"), (0.894541, 1.179300, 1, -0.089454, "pass"), (-0.055093, 1.200167, 0, 0.0, "pass"),
    (0.393831, 1.060079, 0, 0.0, "pass"), (0.307070, 0.683538, 0, 0.0, "pass"), (0.171716, 0.889361, 0, 0.0, "pass"), (0.361565, 0.842446, 0, 0.0, "pass"),
]


def test_demo_loop(spark):
    tokens = replay(spark, DEMO, 16).select(F.lit(0).alias("key"), "seq", "token", (F.lit(T0_US) + F.col("seq") * 10_000).alias("t_us"))
    positions = mock_positions(spark, DEMO_POSITIONS, T0_US, 10_000).withColumn("key", F.lit(0)).drop("ts")
    x = run_pipeline(tokens, X.default_lexicon(spark), positions, "key", "seq", SignalParams(backtest=True), LIVE_RISK, DedupParams(100))
    got = x.orderBy("seq").collect()
    for r, (bias, vol, toggle, spread, gate) in zip(got, GOLDEN, strict=True):
        assert r.signal_bias == pytest.approx(bias, abs=1e-6) and r.signal_volatility == pytest.approx(vol, abs=1e-6)
        assert (r.strategy_toggle, r.outcome) == (toggle, gate) and r.spread_modifier == pytest.approx(spread, abs=1e-6)
        assert r.strategy_weight == 1.0
    assert got[1].oms_events == [steps.APPROACHING] and got[15].cum_bias == pytest.approx(0.149003, abs=1e-6)


def test_sequence_weight_golden(spark):
    t = spark.createDataFrame([(1, w) for w in ("bullish", "crash", "volatile", "rally")], "k int, token string")
    r = X.sequence_weight(X.lookup(t, X.default_lexicon(spark)), "k", 10).first()
    assert (r.sentiment, r.volatility, r.bias, r.confidence) == pytest.approx((0.0909090909, 0.6636363636, 0.1969696970, 0.825))


def test_lexicon(spark):
    lex = X.default_lexicon(spark)
    assert lex.count() == 44
    changed = X.with_mappings(lex, [("crash", 1.0, 1.0, 1.0, 1.0), ("new", 0.1, 0.2, 0.3, 0.4), ("new", 0.5, 0.5, 0.5, 0.5)])
    assert changed.count() == 45 and changed.where("token = 'new'").first().sentiment == 0.5
    t = spark.createDataFrame([(" BULLISH\n",), ("É",), ("",)], "token string")
    hits = {r.token: r.hit for r in X.lookup(t, lex).collect()}
    assert hits == {" BULLISH\n": True, "É": False, "": False}


@pytest.mark.parametrize("s,h", [("a", "af63dc4c8601ec8c"), ("bullish|", "90570729ca0a004c"), ("crash|", "8473a8c6b791c06c"), ("|", "af63f14c8602103b"), ("neutral|market", "acecdd1a1368fa3c"), ("é|x", "f92d7bc6f2df3ead"), ("", "cbf29ce484222325")])
def test_fnv(spark, s, h):
    assert spark.createDataFrame([(s,)], "s string").select(T.fnv1a64_hex(F.col("s"))).first()[0] == h


def test_normalise(spark):
    r = spark.createDataFrame([(" \t\x0bÉCLAIR Buy\r\n\x0c ",)], "s string").select(T.normalise(F.col("s"))).first()[0]
    assert r == "ÉclÉclair buy"[4:4] + "Éclair buy"


def test_ttl_example(spark):
    x = spark.createDataFrame([(k, t * 1000) for k, t in enumerate((0, 60, 100, 150, 210))], "seq long, t_us long").withColumn("key", F.lit("a"))
    got = dedup(x, ["key"], ["seq"], F.col("t_us"), F.lit(100_000).cast("long")).orderBy("seq").collect()
    assert [r.is_novel for r in got] == [True, False, True, False, True]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 50), max_size=40), st.integers(1, 30))
def test_ttl_model(gaps, ttl):
    t, expires, last_novel = 0, None, None
    for g in gaps:
        t += g
        novel, expires = steps.dedup_step(expires, t, ttl)
        assert novel == (last_novel is None or t - last_novel >= ttl)
        last_novel = t if novel else last_novel


def test_risk_bounds():
    p = RiskParams()
    step = lambda s, t, b, v=0.0, spread=0.0, c=0.9, pos=(0.0, 1.0, 0.0, -10.0): steps.risk_step(s, p, t, b, v, spread, c, *pos)[0]
    assert step(steps.new_risk(p), T0_US, 1.0, 1.0, 0.5, 0.1) == steps.PASS
    assert step(steps.new_risk(p), T0_US, 1.01) == steps.MAGNITUDE
    assert step(steps.new_risk(p), T0_US, 0.1, c=0.05) == steps.CONFIDENCE
    tight = replace(p, max_drawdown=1.0)
    s = steps.new_risk(tight)
    assert [steps.risk_step(s, tight, T0_US, 0.4, 0, 0, 0.9, 0, 1, 0, -10)[0] for _ in range(3)] == [steps.PASS, steps.PASS, steps.DRAWDOWN]
    few = replace(p, rate_limit=3)
    s = steps.new_risk(few)
    got = [steps.risk_step(s, few, T0_US + t, 0.1, 0, 0, 0.9, 0, 1, 0, -10)[0] for t in (0, 1, 2, 3, 1_000_000)]
    assert got == [steps.PASS] * 3 + [steps.RATE, steps.PASS]
    assert steps.position_check(p, 0.2, 0.9, 1.0, 0.0, -10.0) == (False, [steps.BREACHED])
    assert steps.position_check(p, 0.4, 0.5, 1.0, 0.0, -10.0) == (True, [steps.APPROACHING])
    assert steps.position_check(p, 0.4, 0.5, 1.0, -15.0, -10.0) == (False, [steps.APPROACHING, steps.PNL])


def test_cooldown_starts_at_construction():
    p = SignalParams(cooldown_us=1_000)
    s = steps.new_signal(p)
    assert [steps.signal_step(s, p, T0_US + t, 0.1, 0.1)[0] for t in (0, 999, 1000, 1500, 2000)] == [False, False, True, False, True]


def test_latency_card(spark):
    x = spark.range(1, 101).select(F.col("id").alias("n"), F.col("id").alias("us"))
    p = LatencyParams(sample_window=1000)
    s = L.latency_stats(x, "us").first()
    assert (s.measurements, s.avg_us, s.min_us, s.max_us) == (100, 50, 1, 100)
    q = L.latency_percentiles(x, "us", "n", p).first()
    assert (q.p95_us, q.p99_us) == (96, 100)
    assert L.latency_jitter(x, "us", "n", p, 10).first()[0] == pytest.approx(0.0288704001, abs=1e-9)
    assert L.latency_percentiles(x.limit(0), "us", "n", p).first().p95_us == 0
    assert L.latency_percentiles(x, "us", "n", replace(p, profiling=False)).first().p99_us == 0


def test_messages(spark):
    df = spark.range(1).select(F.lit("A").alias("s"), F.lit("B").alias("t"), F.timestamp_seconds(F.lit(1704067200)).alias("ts"), F.lit(7).alias("n"))
    args = [F.col(c) for c in ("s", "t", "ts", "n")]
    logon, beat = df.select(fix.logon(*args), fix.heartbeat(*args)).first()
    for m, kind in ((logon, "A"), (beat, "0")):
        head, check = m[: m.rindex("10=")], m[m.rindex("10=") + 3 : -1]
        body = head.split("\x01", 2)[2]
        assert int(check) == sum(head.encode()) % 256 and int(head.split("\x01")[1][2:]) == len(body)
        assert body.startswith(f"35={kind}\x0149=A\x0156=B\x0134=7\x0152=20240101-00:00:00\x01")
    rows = [("8", "1", "5"), ("8", "2", "2"), ("AP", "10", None), ("8", "1", "1"), ("AP", "0", None), ("8", "1", "3"), ("AP", None, None), ("8", "1", "x")]
    text = lambda k, a, b: f"35={k}\x01" + (f"54={a}\x0132={b}\x01" if k == "8" else f"702={a}\x01" if a else "")
    m = spark.createDataFrame([(1, i, text(*r)) for i, r in enumerate(rows)], "k int, seq int, message string")
    got = [r.net_position for r in fix.net_positions(m, "k", "seq").orderBy("seq").collect()]
    assert got == [5, 3, 10, 11, 0, 3]
    f = spark.createDataFrame([("35=8\x0132=1\x01x=9\x01junk\x0132=2=3\x01",)], "m string").select(fix.fields_of(F.col("m"))).first()[0]
    assert f == {"35": "8", "32": "1"}  # what stands before an equals sign is one tag, "junk", a separator and 32 here


def test_message_numbers(spark):
    """A number may begin with its point; a report with a field that is no number is ignored; tags are number prefixes."""
    rows = ["35=8\x0154=2\x0132=5\x01", "35=AP\x01702=x\x01703=5\x01", "35=8\x0154=1\x0132=.5\x01", "35=AP\x01703=2\x01", "035=8\x0154=1\x0132=1e999\x01", "35=8\x0154z=1\x0132=+4.5e0q\x01", "junk\x0135=8\x0154=1\x0132=9\x01", "", None]
    m = spark.createDataFrame([(1, k, x) for k, x in enumerate(rows)], "k int, seq int, message string")
    got = [(r.seq, r.net_position) for r in fix.net_positions(m, "k", "seq").orderBy("seq").collect()]
    # "junk", a separator and a tag are one field whose tag is no number
    assert got == [(0, -5.0), (2, -4.5), (3, -2.0), (5, 2.5)]
    both = m.select(fix.fields_of(F.col("message")).alias("f"), *[fix.tag(F.col("message"), n).alias(str(n)) for n in (35, 54, 32, 702)]).collect()
    for r in both:
        assert all((r.f or {}).get(t) == r[t] for t in ("35", "54", "32", "702"))
    plan = fix.net_positions(m.select("k", "seq", fix.envelope(F.col("message")).alias("message")), "k", "seq")
    assert len(plan._jdf.queryExecution().executedPlan().toString()) < 10_000


def test_captured_files(spark, tmp_path):
    from tidemark.sources.captured import CapturedBodies, CapturedMessages

    content = lambda x: f'data: {{"choices":[{{"delta":{{"content":"{x}"}}}}]}}'
    for d in ("sse", "bodies", "messages"):
        (tmp_path / d).mkdir()
    lines = ["1f", content("a"), "", "data: {}", content("b"), "data: [DONE]", content("late")]
    (tmp_path / "sse" / "one").write_text("\r\n".join(lines))
    (tmp_path / "sse" / "two").write_text(content("c"))
    (tmp_path / "sse" / "none").write_text("")
    assert sorted(tuple(r) for r in sse.read_responses(spark, str(tmp_path / "sse")).collect()) == [("one", 1, "a"), ("one", 4, "b"), ("two", 0, "c")]
    rows = spark.createDataFrame([("one", k, x) for k, x in enumerate(lines)], "f string, n int, line string")
    assert sorted(tuple(r) for r in sse.decode_sse(rows, "f", "n").collect()) == [("one", 1, "a"), ("one", 4, "b")]
    q = sse.read_responses(spark, str(tmp_path / "sse"), stream=True).writeStream.format("memory").queryName("responses").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("responses").count() == 3
    (tmp_path / "bodies" / "one").write_text('HTTP/1.1 200\r\n\r\n{"net_position":1,"position_limit":2,"pnl":3,"pnl_limit":-4}')
    (tmp_path / "bodies" / "bad").write_text("junk")
    r = CapturedBodies(str(tmp_path / "bodies")).positions(spark).collect()
    assert [(x.feed, x.net_position, x.pnl_limit) for x in r] == [("one", 1.0, -4.0)]
    message = "8=FIX.4.2\x0135=8\x0154={}\x0132={}\x0110=000\x01"
    (tmp_path / "messages" / "one").write_text(message.format(1, 5) + message.format(2, ".5") + "8=FIX.4.2\x0135=8")
    r = CapturedMessages(str(tmp_path / "messages")).positions(spark).orderBy("seq").collect()
    assert [(x.feed, x.seq, x.net_position, x.position_limit) for x in r] == [("one", 0, 5.0, 1.0), ("one", 1, 4.5, 1.0)]


def test_manual_reset():
    p = replace(RiskParams(), rate_limit=1)
    s = steps.new_risk(p)
    step = lambda t: steps.risk_step(s, p, t, 0.4, 0, 0, 0.9, 0, 1, 0, -10)[0]
    assert [step(T0_US + 1), step(T0_US + 2)] == [steps.PASS, steps.RATE]
    steps.reset_risk(s, T0_US + 3)
    assert s == [T0_US + 3, 0, T0_US + 3, 0.0] and step(T0_US + 4) == steps.PASS


def test_load_lexicon(spark, tmp_path):
    (tmp_path / "l.txt").write_text("up 1 0.5 0.2 0.3\nbroken a b c d\nup 0.5 0.5 0.5 0.5\n")
    lex = X.load_lexicon(spark, str(tmp_path / "l.txt"))
    assert [tuple(r) for r in lex.collect()] == [("up", 0.5, 0.5, 0.5, 0.5)]
    plan = lambda bound: X.lookup(spark.createDataFrame([("up",)], "token string"), lex, bounded=bound)._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" in plan(None) and "broadcast" not in plan(False)


def test_position_bodies(spark):
    good = '{"net_position":1.5,"position_limit":2,"pnl":-1e1,"pnl_limit":-3}'
    rows = [(good,), ("HTTP/1.1 200\r\nX: y\r\n\r\n" + good,), ('{"net_position":1}',), ("junk",), (None,)]
    got = spark.createDataFrame(rows, "b string").select(parse_position(F.col("b")).alias("p")).select("p.*").collect()
    assert [r.ok for r in got] == [True, True, False, False, False] and got[1].pnl == -10.0


def test_sse(spark):
    lines = ["HTTP/1.1 200", "1f", "", 'data: {"choices":[{"delta":{"content":"a\\n\\u00e9"}}]}', 'data: {"choices":[{"delta":{}}]}', "data: broken", "data: [DONE]", 'data: {"choices":[{"delta":{"content":"late"}}]}']
    df = spark.createDataFrame([(1, k, x) for k, x in enumerate(lines)], "k int, n int, line string")
    assert [r.token for r in sse.decode_sse(df, "k", "n").collect()] == ["a\né"]


def test_token_file(spark, tmp_path):
    (tmp_path / "t.txt").write_text("one  two\n\n three\tfour\n")
    got = read_token_file(spark, str(tmp_path / "t.txt")).orderBy("line", "pos").collect()
    assert [r.token for r in got] == ["one", "two", "three", "four"]
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        read_token_file(spark, str(tmp_path / "none.txt")).collect()
    assert replay(spark, [], 5).count() == 0


def test_config(tmp_path):
    path = str(tmp_path / "c.yaml")
    c = load_config("signal: {decay: 0.9, unknown: 1}\nrisk:\n  max_bias: 2\n")
    assert c.signal.decay == 0.9 and c.risk.max_bias == 2.0 and c.dedup == DedupParams()
    save_config(c, path)
    assert load_config(path) == c
    w = ConfigWatcher(path)
    assert w.current() == c
    (tmp_path / "c.yaml").write_text(": broken")
    assert w.current() == c
    assert ConfigWatcher(str(tmp_path / "none")).current() == Config()


def test_invariants(spark, sf):
    from tidemark.plans.catalog import QUERIES

    for name in ("pipeline_end_to_end", "pipeline_backtest"):
        n = {r.outcome: r["n"] for r in QUERIES[name](spark, sf).groupBy("outcome").agg(F.count("*").alias("n")).collect()}
        assert sum(n.values()) == 1000 and n.get("cooldown", 0) * (name == "pipeline_backtest") == 0


@pytest.mark.parametrize("parts", [1, 3, 10])
def test_stream_equals_batch(spark, sf, tmp_path, parts):
    from tidemark.params import EVENTS_DEDUP, EVENTS_RISK, EVENTS_SIGNAL
    from tidemark.plans.catalog import _pipeline
    from tidemark.sources.positions import FIELDS
    from tidemark.streaming.processor import pipeline_stream, prepare

    e = V.events(spark, sf).join(V.event_positions(spark, sf), ["event_id", "user_id"], "left").select("user_id", "event_id", "token", "t_us", *FIELDS)
    bounds = [1 + 1000 * k // parts for k in range(parts)] + [10**9]
    folder = tmp_path / "in"
    low = e.agg(F.min("event_id")).first()[0]
    for k in range(parts):
        e.where((F.col("event_id") - low + 1 >= bounds[k]) & (F.col("event_id") - low + 1 < bounds[k + 1])).coalesce(1).write.mode("append").parquet(str(folder / f"f{k:02d}"))
    schema = spark.read.parquet(str(folder / "f00")).schema
    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    for k in range(parts):  # each run reads what is new and starts again from the checkpoint
        if k not in (0, parts - 1) and parts > 3:
            continue
        s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder / "*"))
        x = pipeline_stream(prepare(s, V.event_lexicon(spark), EVENTS_SIGNAL), "user_id", "event_id", EVENTS_SIGNAL, EVENTS_RISK, EVENTS_DEDUP)
        q = x.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(300)
    columns = ["user_id", "event_id", "outcome", "signal_bias", "signal_volatility"]
    got = sorted(map(tuple, spark.read.parquet(out).select(*columns).collect()), key=repr)
    expect = sorted(map(tuple, _pipeline(spark, sf).select(*columns).collect()), key=repr)
    assert got == expect


def test_stream_restarts_late_rows_and_timers(spark, tmp_path):
    """Each run starts from the checkpoint and meets new rows; late rows change nothing; expired keys go without rows of their stream."""
    from tidemark.sources.positions import FIELDS
    from tidemark.streaming.processor import pipeline_stream, prepare

    columns = "key string, seq long, token string, t_us long, " + ", ".join(f"{f} double" for f in FIELDS)
    p, none = SignalParams(backtest=True), [None] * 4
    second = 1_000_000
    batches = [
        [("a", 1, "crash", T0_US, *none), ("b", 1, "rally", T0_US, *none)],
        [("a", 2, "crash", T0_US + 1, *none), ("a", 1, "surge", T0_US + 2, *none), ("a", 3, "surge", T0_US + 3, *none)],
        [("b", 2, "rally", T0_US + 900 * second, *none)],
        [("b", 3, "rally", T0_US + 1800 * second, *none)],
    ]
    folder, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    for rows in batches:
        spark.createDataFrame(rows, columns).coalesce(1).write.mode("append").parquet(folder)
        x = prepare(spark.readStream.schema(columns).parquet(folder), X.default_lexicon(spark), p)
        x = pipeline_stream(x, "key", "seq", p, LIVE_RISK, DedupParams(5_000), expire_after="10 seconds")
        q = x.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(300)
    got = sorted((r.key, r.seq, r.token, r.outcome) for r in spark.read.parquet(out).collect())
    assert [(k, n, t, o == steps.DUPLICATE, o == "late") for k, n, t, o in got] == [
        ("a", 1, "crash", False, False), ("a", 1, "surge", False, True), ("a", 2, "crash", True, False), ("a", 3, "surge", False, False),
        ("b", 1, "rally", False, False), ("b", 2, "rally", False, False), ("b", 3, "rally", False, False),
    ]
    from tidemark.streaming.processor import live_keys

    assert {(r.key["key"], r.token) for r in live_keys(spark, check).collect()} == {("b", "|rally")}


def test_console_and_progress(spark, capsys):
    from tidemark.streaming.sinks import ConsoleSink, ProgressListener

    ConsoleSink(1).write(spark.createDataFrame([(7,), (8,)], "answer int"))
    shown = capsys.readouterr().out
    assert "answer" in shown and "7" in shown and "only showing top 1 row" in shown
    told, ended = [], []
    listener = ProgressListener(told.append, ended.append)
    spark.streams.addListener(listener)
    try:
        q = spark.readStream.format("rate").option("rowsPerSecond", 10).load().writeStream.format("noop").trigger(processingTime="1 second").start()
        for _ in range(60):
            if any("batch" in x for x in told):
                break
            q.awaitTermination(1)
        q.stop()
        for _ in range(30):
            if ended:
                break
            q.awaitTermination(1)
    finally:
        spark.streams.removeListener(listener)
    assert told[0].startswith("started") and any("rows/s" in x for x in told) and ended == [None]


def test_sinks(spark, tmp_path):
    from tidemark.streaming.sinks import CsvSink, MemorySink, NdjsonSink, fan_out

    df = spark.createDataFrame([(1, 0.5), (2, -0.25)], "timestamp_ns long, signal_bias double")
    memory = MemorySink()
    sinks = [CsvSink(str(tmp_path / "c")), NdjsonSink(str(tmp_path / "j")), memory]
    write = fan_out(sinks)
    write(df, 0)
    write(df, 1)
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 4
    lines = [json.loads(x) for f in (tmp_path / "j").glob("*.json") for x in f.read_text().splitlines()]
    assert len(lines) == 4 and {"timestamp_ns": 1, "signal_bias": 0.5} in lines
    assert len(memory.rows) == 4
    memory.clear()
    assert not memory.rows


def test_columns_of_any_name_stay(spark):
    """Helper columns take names that the user's columns don't have."""

    from tidemark.operators.latency import backoff, last_samples, since_reset
    from tidemark.sources.positions import FIELDS, position_asof

    mine = ["_fold_key", "_t", "_ttl", "_evict", "_p", "_side", "_seg", "_r", "_later", "_block"]
    x = spark.createDataFrame([("a", k, 0.9, *[f"{n}{k}" for n in mine]) for k in range(4)], ", ".join(["key string", "seq long", "c double", *[f"{n} string" for n in mine]]))
    p = x.select("key", "seq", *[F.col("c").alias(f) for f in FIELDS]).limit(1)
    outcomes = x.withColumn("outcome", F.lit(steps.RATE)).withColumn("oms_events", F.array().cast("array<string>"))
    for out in (
        dedup(x, ["key"], ["seq"], F.col("seq"), F.lit(2).cast("long"), F.lit(False)), position_asof(x, p, "key", "seq"), backoff(x, "c", ["key"], ["seq"]),
        last_samples(x, "seq", ["key"], 9), since_reset(x.withColumn("reset", F.lit(False)), ["key"], "seq", "reset"), S.gate_labels(outcomes, ["key"], ["seq"]),
    ):
        assert sorted(tuple(r[n] for n in mine) for r in out.collect()) == [tuple(f"{n}{k}" for n in mine) for k in range(4)]


def test_lexicon_with_a_token_twice_is_refused(spark):
    lex = spark.createDataFrame([("a", 1.0, 1.0, 1.0, 1.0), ("a", 2.0, 1.0, 1.0, 1.0)], X.SCHEMA)
    tokens = spark.createDataFrame([("a",)], "token string")
    with pytest.raises(ValueError, match="one row for each token"):
        X.lookup(tokens, lex)
    assert X.lookup(tokens, lex.limit(1)).count() == 1


def test_sums_of_weights(spark):
    """Whole billionths: the order of rows doesn't matter, and what doesn't fit fails."""
    rows = [(1, 0.1, 0.7, 0.3, -0.2)] * 30_000 + [(1, -0.33, 0.111, 0.9, 0.5)] * 7
    df = spark.createDataFrame(rows, "k int, sentiment double, confidence double, volatility double, bias double")
    got = {tuple(r) for n in (1, 7) for r in X.sequence_weight(df.repartition(n), "k", 9).collect()}
    c = 0.7 * 30_000 + 0.111 * 7
    assert len(got) == 1 and abs(next(iter(got))[1] - (0.07 * 30_000 - 0.33 * 0.111 * 7) / c) < 1e-9
    with pytest.raises(Exception, match="OVERFLOW"):
        X.sequence_weight(spark.createDataFrame([(1, 1.0, 9e9, 0.0, 0.0)] * 2, df.schema), "k").collect()


def test_table_replays(spark):
    from tidemark.sources.positions import FIELDS, replay_positions
    from tidemark.sources.tokens import replay_table

    t = spark.createDataFrame([("a", 0, "x"), ("a", 1, "y"), ("b", 0, "z")], "k string, seq long, token string")
    got = sorted((r.k, r.seq, r.token) for r in replay_table(t, "k", "seq", 2).collect())
    assert got == [("a", 0, "x"), ("a", 1, "y"), ("a", 2, "x"), ("a", 3, "y"), ("b", 0, "z"), ("b", 1, "z")]
    p = t.select("k", "seq", *[F.lit(1.5).alias(f) for f in FIELDS])
    assert [(r.k, r.seq, r.t_us) for r in replay_positions(p, "k", "seq", 100, 7).orderBy("k", "seq").collect()] == [("a", 0, 100), ("a", 1, 107), ("b", 0, 100)]


def test_vectorized_weights_move_no_tokens(spark, sf):
    """A document moves a row for each weight that its tokens have, not one for each of its distinct tokens."""
    from tidemark.plans import catalog

    plan = catalog.sequence_weight_vectorized(spark, sf)._jdf.queryExecution().executedPlan().toString()
    moved = [set(re.findall(r"(\w+)#", keys)) for keys in re.findall(r"hashpartitioning\((.*?), \d+\)", plan)]
    assert moved and all(keys <= {"doc_id", *X.WEIGHT} for keys in moved), moved
