"""Streams against their batch twins, and carry-over turn by turn."""

import json
import random
import shutil

import pytest
from pyspark.sql import functions as F

from lectern.functions import ranges
from lectern.operators.turns import applied, carry_context, next_step, segment_function
from lectern.plans import inputs as I
from lectern.plans import text_queries
from lectern.sources import corpus
from lectern.streaming import streams, windows

SF = "/root/testdata/sf0.001"


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset(key)


def drained(stream, tmp_path, name):
    q = stream.writeStream.format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/cp-{name}").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    return stream.sparkSession.table(name)


def in_files(df, tmp_path, order):
    """``df`` as a streamed folder of several files in order."""
    rows = df.orderBy(*order).collect()
    step = max(1, len(rows) // 3)
    for i in range(0, len(rows), step):
        df.sparkSession.createDataFrame(rows[i : i + step], df.schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    return df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(f"{tmp_path}/in")


def test_rate_limit_stream_equals_batch(rocks, tmp_path):
    requests = I.requests(rocks, SF).select("identity", "ts", "request_id")
    got = drained(streams.rate_limit_stream(in_files(requests, tmp_path, ["ts", "request_id"]), 3, 86_400), tmp_path, "limits").collect()
    want = streams.rate_limit_batch(requests, 3, 86_400).collect()
    assert sorted((r.request_id, r.current, r.exceeded) for r in got) == sorted((r.request_id, r.current, r.exceeded) for r in want)


def test_context_stream_equals_batch(rocks, tmp_path):
    turns = text_queries._operations(rocks, SF)
    got = drained(streams.carry_context_stream(in_files(turns, tmp_path, ["turn", "conv_id"])), tmp_path, "turns").collect()
    key = lambda r: (r.conv_id, r.turn, r.resolution, r.type, tuple(r.codes or ()), r.subject or "", r.reason or "")
    assert sorted(map(key, got)) == sorted(map(key, carry_context(turns).collect()))


def test_metric_windows_stream_equals_batch(spark, tmp_path):
    events = I.requests(spark, SF)
    stream = in_files(events, tmp_path, ["ts", "request_id"])
    q = streams.metrics_windows(stream, "1 day", late="40 days").writeStream.format("memory").queryName("windows").option("checkpointLocation", f"{tmp_path}/cp").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    got = spark.table("windows").collect()
    want = streams.metrics_windows(events, "1 day").collect()
    assert sorted((r.window_start, r.outcome, r.n) for r in got) == sorted((r.window_start, r.outcome, r.n) for r in want)


def test_incremental_corpus(spark, tmp_path):
    rows = [(f"c{i}", f"d{i % 3}", "x", "ES", None, "comparator", "en", "s", None, f"text {i}", "f", "docx", "h", 2024) for i in range(9)]
    schema = corpus.CHUNK_SCHEMA
    folder = f"{tmp_path}/new"

    def arrive(part):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
        q = streams.incremental_corpus(spark.readStream.schema(schema).parquet(folder), f"{tmp_path}/table", f"{tmp_path}/cp").start()
        q.processAllAvailable()
        q.stop()
        return {r.chunk_id for r in streams.current_corpus(spark, f"{tmp_path}/table").collect()}

    assert arrive(rows) == {f"c{i}" for i in range(9)}
    changed = [("new", "d0", *rows[0][2:])]
    assert arrive(changed) == {"new"} | {f"c{i}" for i in range(9) if i % 3}
    shutil.rmtree(folder)


def turn(operation=None, codes=(), subject=None, kind="information"):
    return {"operation": operation, "codes": list(codes), "subject": subject, "type": kind}


def test_carry_over_steps():
    state, got = next_step(([], [], None), turn(None, ["ES"], "notice"))
    assert (got["resolution"], state) == ("pass", (["information"], [["ES"]], "notice"))
    state2, got = next_step(state, turn("replace_country", ["PE"]))
    assert (got["resolution"], got["codes"], got["subject"]) == ("carried", ["PE"], "notice")
    assert state2 == (["information"], [["PE"]], "notice")
    _, got = next_step(state, turn("add_country", ["PE"]))
    assert (got["type"], got["codes"]) == ("comparison", ["ES", "PE"])
    _, got = next_step((["comparison"], [["ES", "PE"]], "x"), turn("replace_country", ["IT"]))
    assert got["resolution"] == "pass"
    state, got = next_step((["information"], [["ES"]], None), turn("continue"))
    assert (got["reason"], state) == ("missing_topic", ([], [], None))
    _, got = next_step((["information", "contact"], [["ES"], ["PE"]], "x"), turn("continue", kind="contact"))
    assert (got["resolution"], got["codes"]) == ("carried", ["PE"])
    _, got = next_step((["information", "information"], [["ES"], ["PE"]], "x"), turn("continue"))
    assert got["reason"] == "select_action"


def sequential_windows(rows, limit, seconds):
    out, state = [], {}
    for who, us, rid in sorted(rows, key=lambda r: ((r[0] is not None, r[0] or ""), r[1], r[2])):
        anchor, n = state.get(who, (None, 0))
        if anchor is None or us >= anchor + seconds * 1_000_000:
            anchor, n = us, 0
        state[who] = anchor, n + 1
        out.append((who, us, rid, n + 1, max(0, limit - n - 1), round((anchor - us) / 1e6 + seconds, 6), n + 1 > limit))
    return sorted(out, key=str)


@pytest.mark.parametrize("range_rows", [7, 60, 100_000])
def test_one_busy_identity_is_spread_over_tasks(spark, range_rows):
    rng = random.Random(range_rows)
    rows, t = [], 0
    for i in range(900):
        t += rng.choice((0, 1, 1, 2, 5, 30, 400)) * 1_000_000 // 3
        rows.append(("hot", t, i))
    rows += [(f"u{rng.randrange(40)}", rng.randrange(200_000_000), 1000 + i) for i in range(200)] + [(None, rng.randrange(50_000_000), 2000 + i) for i in range(50)]
    df = spark.createDataFrame(rows, "identity string, us long, request_id long").select("identity", F.timestamp_micros("us").alias("ts"), "request_id")
    for seconds in (2, 25, 100_000):
        got = windows.rate_windows(df, 3, seconds, range_rows).select("identity", F.unix_micros("ts"), "request_id", "current", "remaining", "retry_after", "exceeded").collect()
        assert sorted(((*r[:5], round(r[5], 6), r[6]) for r in got), key=str) == sequential_windows(rows, 3, seconds)
    held = ranges.sorted_ranges(df.select(ranges.key_of("identity").alias("who"), "ts"), ["who", "ts"], 60).groupBy("part").count().collect()
    assert len(held) > 10
    assert max(r["count"] for r in held) < 200
    assert windows.rate_windows(df.where("false"), 3, 2).count() == 0


def random_turns(rng, n):
    out = []
    for i in range(n):
        op = rng.choice(["continue", "replace_country", "add_country", "add_country", "select_action", None, "ambiguous"] if rng.random() < 0.3 else ["continue", "add_country", "replace_country"])
        out.append((i, op, rng.choice(["information", "comparison", "contact", "overview", None]), rng.choice([None, [], ["ES"], ["PE"], ["ES", "FR"], ["IT", "IT"], ["FR", "IT", "PE"]]), rng.choice([None, None, "", " ", "notice", "leave"])))
    return out


def test_functions_of_segments_compose():
    rng = random.Random(3)
    for _ in range(400):
        turns = [dict(zip(("operation", "type", "codes", "subject"), t[1:], strict=True)) for t in random_turns(rng, rng.randrange(0, 7))]
        f = json.loads(json.dumps(segment_function(turns)))
        for kind in ("information", "comparison", "contact", "overview", None):
            for codes in (["ES"], ["PE"], ["XX"], ["ES", "FR"], ["XX", "ES", "PE"]):
                for subject in (None, "", "old"):
                    state = ([kind], [codes], subject)
                    want = state
                    for t in turns:
                        want, _ = next_step(want, t)
                    if turns:
                        assert [list(x) if isinstance(x, list) else x for x in applied(f, state)] == list(want), (turns, state)
        want = ([], [], None)
        for t in turns:
            want, _ = next_step(want, t)
        assert list(applied(f, ([], [], None))) == list(want)


@pytest.mark.parametrize("range_rows", [5, 64, 100_000])
def test_one_long_conversation_is_spread_over_tasks(spark, range_rows):
    rng = random.Random(8)
    rows = [(1, *t) for t in random_turns(rng, 500)] + [(c, *t) for c in range(2, 30) for t in random_turns(rng, 6)] + [(None, *t) for t in random_turns(rng, 20)]
    want = []
    for conv in {r[0] for r in rows}:
        state = ([], [], None)
        for r in sorted((r for r in rows if r[0] == conv), key=lambda r: r[1]):
            state, got = next_step(state, dict(zip(("operation", "type", "codes", "subject"), r[2:], strict=True)))
            want.append((conv, r[1], got["resolution"], got["type"], got["codes"], got["subject"], got["reason"]))
    df = spark.createDataFrame(rows, "conv_id long, turn long, operation string, type string, codes array<string>, subject string").repartition(6)
    assert sorted((tuple(r) for r in carry_context(df, range_rows).collect()), key=str) == sorted(want, key=str)


def sizes_of_state(spark, tmp_path, schema, parts, made, name):
    """Keys with a state after each part has come in."""
    folder, sizes = f"{tmp_path}/in", []
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(folder)
        q = made(spark.readStream.schema(schema).parquet(folder)).writeStream.format("noop").option("checkpointLocation", f"{tmp_path}/cp").outputMode("append").start()
        q.processAllAvailable()
        q.stop()
        sizes.append(spark.read.format("statestore").option("stateVarName", name).load(f"{tmp_path}/cp").count())
    return sizes


def timed(spark, rows, schema):
    return spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_micros(F.col("us") + 1_000_000_000_000)).drop("us")


def test_state_of_closed_windows_goes(rocks, tmp_path):
    parts = [[(f"u{i}", 1_000_000 * (i % 7), i) for i in range(30)], [("late", 3_600_000_000 + i, 100 + i) for i in range(3)], [("late", 7_200_000_000 + i, 200 + i) for i in range(3)]]
    frames = [timed(rocks, p, "identity string, us long, request_id long") for p in parts]
    sizes = sizes_of_state(rocks, tmp_path, frames[0].schema, frames, lambda s: streams.rate_limit_stream(s, 3, 60, "1 minute"), "window")
    assert sizes[0] == 30
    assert sizes[-1] == 1


def test_quiet_conversations_are_forgotten(rocks, tmp_path):
    parts = [[(i, 0, "pass", "information", ["ES"], "notice", 0) for i in range(30)], [(99, k, "continue", "information", [], None, 10_000_000_000 + k) for k in range(2)], [(99, 5, "continue", "information", [], None, 20_000_000_000)]]
    frames = [timed(rocks, p, "conv_id long, turn long, operation string, type string, codes array<string>, subject string, us long") for p in parts]
    sizes = sizes_of_state(rocks, tmp_path, frames[0].schema, frames, lambda s: streams.carry_context_stream(s, "ts", 3600, "1 minute"), "context")
    assert sizes[0] == 30
    assert sizes[-1] == 1


def test_merged_sketches_give_quantiles_within_their_error(spark):
    rows = spark.range(60_000).select(F.timestamp_seconds(F.col("id") % 86_400).alias("ts"), F.when(F.col("id") % 3 == 0, "ok").otherwise("failed").alias("outcome"), F.lit("a").alias("action"), ((F.col("id") * 7919) % 60_000).cast("double").alias("latency"))
    sketches = streams.latency_sketches(rows, "1 hour")
    assert sketches.select(F.max(F.octet_length("sketch"))).first()[0] < 20_000
    for r in streams.merged_quantiles(sketches, "outcome", "action", quantiles={"low": 0.1, "mid": 0.5, "high": 0.95}).collect():
        assert r.n == {"ok": 20_000, "failed": 40_000, None: 60_000}[r.outcome]
        for q, v in ((0.1, r.low), (0.5, r.mid), (0.95, r.high)):
            assert abs(v / 60_000 - q) <= streams.RANK_ERROR
