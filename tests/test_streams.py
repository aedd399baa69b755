"""Keyed stream operators: batch twins, arrival in any order, state that ends, late answers, replayed batches."""

import random
import time

import pytest
from pyspark.sql import functions as F

from textlens.operators import domains
from textlens.sources import files
from textlens.streaming import stateful, streams

EVENTS = "/root/testdata/sf0.001/events.parquet"


@pytest.fixture(scope="module")
def events(spark):
    return spark.read.parquet(EVENTS).withColumn("ts", F.col("ts").cast("timestamp")).cache()


@pytest.fixture(scope="module")
def folder(events, tmp_path_factory):
    """The events in files of 300, by time."""
    path = str(tmp_path_factory.mktemp("events") / "e")
    events.orderBy("ts").coalesce(1).write.option("maxRecordsPerFile", 300).parquet(path)
    return path


def stream(spark, df, path, files_each=50):
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files_each).parquet(path)


def run(df, name, mode="append"):
    """(rows, state rows left at the end)."""
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    left = sum(op["numRowsTotal"] for op in q.lastProgress["stateOperators"]) if q.lastProgress else 0
    return [tuple(r) for r in df.sparkSession.table(name).collect()], left


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def closing(events, days=400):
    """A last event of another user, long after: time for all others to end."""
    end = events.agg(F.max("ts").alias("ts")).select((F.col("ts") + F.expr(f"INTERVAL {days} DAYS")).alias("ts"))
    return end.select(F.lit(-1).cast("long").alias("event_id"), "ts", F.lit(-1).cast("long").alias("user_id"), F.lit("end").alias("event_type"), F.lit(0.0).alias("value"), F.lit("").alias("props")).select(*events.columns)


# --- machines by hand

S = 1_000_000


def feed(machine, steps, until=None):
    """All output of (time, ...) rows, waking what is due before each and up to `until` at the end."""
    state, out = None, []

    def wake(now):
        nonlocal state
        while state is not None and (due := machine.due(state)) is not None and (now is None or due <= now):
            state, found = machine.wake(state)
            out.extend(found)

    for row in steps:
        wake(row[0])
        state, found = machine.step(machine.start if state is None else state, row)
        out.extend(found)
    wake(until)
    return out


def test_debounce_rules():
    m = stateful.Debounce(4 * S, 100 * S)
    typed = [(0, 1, "hei"), (S, 2, "hei "), (2 * S, 3, "he"), (3 * S, 4, "hei på deg"), (4 * S, 5, "hei på deg!"), (5 * S, 6, "hei på dag!"), (20 * S, 7, "hei på dag"), (21 * S, 8, " hei på dag! "), (22 * S, 9, None), (23 * S, 10, "hei på dog!"), (24 * S, 11, "x")]
    # 1 and 4 change the length by much; 2 is unchanged, 3 too short; 6 replaces 5 and ends its burst; 8 takes 7 back; 11 takes 10 back
    assert feed(m, typed) == [(1, "length"), (4, "length"), (6, "burst_end")]
    # after the time to forget the same text passes again
    assert feed(m, [(0, 1, "hei på deg"), (99 * S, 2, "hei på deg"), (199 * S, 3, "hei på deg")]) == [(1, "length"), (3, "length")]
    # exactly 15 % isn't more than 15 %
    assert feed(m, [(0, 1, "a" * 100), (10 * S, 2, "a" * 115), (20 * S, 3, "a" * 133)]) == [(1, "length"), (2, "burst_end"), (3, "length")]


def test_rate_limit_by_hand():
    m = stateful.RateLimit(60 * S, 2)
    steps = [(0, 1), (10 * S, 2), (20 * S, 3), (59 * S + 1, 4), (60 * S, 5), (60 * S + 1, 6)]
    assert feed(m, steps) == [(1, False, 0), (2, False, 0), (3, True, 40), (4, True, 1), (5, True, 0), (6, False, 0)]


def test_user_state_and_reuse_by_hand():
    assert feed(stateful.UserState(10 * S), [(0, 1, "login"), (5 * S, 2, "view"), (15 * S, 3, "view"), (26 * S, 4, "login"), (27 * S, 5, "error")]) == [(0, "login"), (5 * S, "view"), (15 * S, "view"), (25 * S, None), (26 * S, "login"), (27 * S, None)]
    assert feed(stateful.Reuse(), [(0, 1, 5), (7199 * S, 2, 5), (7200 * S, 3, 20_000), (9000 * S, 4, 20_000)]) == [(1, 1), (2, 1), (3, 3), (4, 4)]


def test_status_by_hand():
    steps = [(0, 1, True, True), (1, 2, True, True), (2, 3, False, True), (3, 4, False, False), (20 * S, 5, True, True)]
    assert feed(stateful.StatusChanges(10 * S), steps) == [(1, False, False), (2, False, False), (3, True, False), (4, True, True), (5, False, False)]


# --- tables and streams


def test_batch_twin_is_the_machine(spark):
    rng = random.Random(1)
    data = [(rng.choice([None, 1, 1, 1, 2, 3]), rng.randrange(300), i, rng.choice([None, "", "ab", "abc", "abcd", "abcde", "x" * 40])) for i in range(400)]
    table = spark.createDataFrame(data, "user_id long, t long, event_id long, text string").withColumn("ts", F.timestamp_seconds("t"))
    got = rows(streams.debounce_batch(table, 5, 60))
    want = [(k, *r) for k in (1, 2, 3) for r in feed(stateful.Debounce(5 * S, 60 * S), sorted((t * S, i, x) for u, t, i, x in data if u == k))]
    assert got == sorted(want)
    assert rows(streams.debounce_batch(table.limit(0), 5)) == []


def test_streams_equal_batches(spark, events, folder):
    for name, batch, make in (
        ("rates", streams.rate_limit_batch(events, 86_400, 2), lambda s, **k: streams.rate_limit(s, 86_400, 2, **k)),
        ("status", domains.status_changes(status(events)).select("domain", "event_id", "changed", "became_available"), lambda s, **k: streams.stream_status_changes(status(s), 10**7, **k)),
    ):
        got, _ = run(make(stream(spark, events, folder), watermark="0 seconds", ordered=True), f"{name}_ordered")
        assert sorted(got) == rows(batch), name
        # files in order of time, rows taken as they come
        got, _ = run(make(stream(spark, events, folder)), name)
        assert sorted(got) == rows(batch), name


def status(df):
    return df.select(F.concat(F.lit("d"), F.col("event_id") % 5).alias("domain"), "ts", "event_id", (F.col("event_type") != "error").alias("is_up"), (F.col("event_type") != "click").alias("registered"))


def test_arrival_in_any_order(spark, events, tmp_path):
    """Two files whose times interleave: with `ordered` and a wide watermark nothing is dropped and the batch twin's rows come out."""
    for k in (0, 1):
        events.where(F.col("event_id") % 2 == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "e"))
    closing(events).coalesce(1).write.mode("append").parquet(str(tmp_path / "e"))
    got, _ = run(streams.rate_limit(stream(spark, events, str(tmp_path / "e"), 1), 86_400, 2, watermark="60 days", ordered=True), "any_order")
    assert sorted(r for r in got if r[0] != -1) == rows(streams.rate_limit_batch(events, 86_400, 2))


def test_silent_keys_leave_the_state(spark, events, tmp_path):
    events.coalesce(1).write.parquet(str(tmp_path / "e"))
    closing(events).coalesce(1).write.mode("append").parquet(str(tmp_path / "e"))
    texts = lambda s: s.withColumn("text", F.concat("event_type", F.col("event_id").cast("string")))
    for name, make in (("debounce", lambda s: streams.debounce(texts(s), 60, 3600, watermark="1 minute")), ("rate", lambda s: streams.rate_limit(s, 3600, 1, watermark="1 minute")), ("users", lambda s: streams.user_state(s, 3600, watermark="1 minute")), ("domains", lambda s: streams.stream_status_changes(status(s), 3600, watermark="1 minute")), ("texts", lambda s: streams.dedupe_texts(texts(s), watermark="1 minute"))):
        _, left = run(make(stream(spark, events, str(tmp_path / "e"), 1)), f"silent_{name}")
        assert left <= 4, (name, left)  # the closing user's own state and timer
    # without time to pass, the users stay
    _, left = run(streams.user_state(stream(spark, events, str(tmp_path / "e"), 1), 10**9, watermark="1 minute"), "stay")
    assert left > 10  # users whose last event is no removal


def test_user_state_equals_batch_with_time_to_live(spark, events, folder):
    got, _ = run(streams.user_state(stream(spark, events, folder), 86_400, watermark="0 seconds", ordered=True), "state_of_users")
    last = {}
    for user, at, event in sorted(got, key=lambda r: (r[1], r[2] is None)):
        last[user] = event
    end = events.agg(F.max("ts").cast("timestamp_ntz").alias("t")).first().t
    batch = streams.user_state_batch(events.withColumn("ts", F.col("ts").cast("timestamp_ntz")), str(end), "1 day")
    assert {u: e for u, e in last.items() if e} == {r.user_id: r.last_event for r in batch.collect()}


def test_debounce_on_conversations(spark, tmp_path):
    from textlens.plans import queries_streams

    typed = queries_streams.typed(spark, "/root/testdata/sf0.001")
    typed.orderBy("ts").coalesce(1).write.option("maxRecordsPerFile", 200).parquet(str(tmp_path / "t"))
    far = typed.limit(1).select(F.lit(-1).cast("long").alias("conv_id"), F.timestamp_seconds(F.lit(1_904_067_200)).alias("ts"), F.lit(1).cast("long").alias("number"), F.lit("end of all").alias("text"))
    far.write.mode("append").parquet(str(tmp_path / "t"))
    got, left = run(streams.debounce(stream(spark, typed, str(tmp_path / "t")), 4, 500, "conv_id", "ts", "number", watermark="0 seconds", ordered=True), "typed")
    assert sorted(r for r in got if r[0] != -1) == rows(streams.debounce_batch(typed, 4, 500, "conv_id", "ts", "number")) and left <= 4


def test_debounce_by_the_clock(spark, tmp_path):
    """Timers of the processor's clock end a burst without any further input."""
    data = spark.createDataFrame([(1, 1, 1, "hei på deg"), (1, 2, 2, "hei på dag"), (2, 1, 1, "ja")], "client long, number long, t long, text string").withColumn("ts", F.timestamp_seconds("t"))
    data.coalesce(1).write.parquet(str(tmp_path / "t"))
    out = streams.debounce(stream(spark, data, str(tmp_path / "t")), 1, 3600, "client", "ts", "number", event_time=False)
    q = out.writeStream.format("memory").queryName("clock").outputMode("append").trigger(processingTime="500 milliseconds").start()
    try:
        until, got = time.time() + 60, set()
        while time.time() < until and (1, 2, "burst_end") not in got:
            time.sleep(0.5)
            got = {tuple(r) for r in spark.table("clock").collect()}
    finally:
        q.stop()
    assert got == {(1, 1, "length"), (1, 2, "burst_end")}


def test_late_answers(spark):
    at = lambda rows_: spark.createDataFrame(rows_, "event_id long, user_id long, t long").select("event_id", "user_id", F.timestamp_seconds("t").alias("ts"))
    rng = random.Random(3)
    a = [(i, rng.choice([1, 1, 1, 2]), rng.randrange(1000)) for i in range(150)]
    b = [(1000 + i, rng.choice([1, 1, 1, 2]), rng.randrange(1000)) for i in range(60)]
    got = {r.event_id: tuple(r)[1:] for r in streams.correlate_batch(at(a), at(b), 5, 20).collect()}
    for i, user, t in a:
        timely = [r for r in b if r[1] == user and t <= r[2] <= t + 5]
        late = [r for r in b if r[1] == user and t + 5 < r[2] <= t + 20]
        first = min(timely + late, key=lambda r: (r[2], r[0]), default=(None,))[0]
        assert got[i] == (first, len(timely), len(late), not timely, not timely and bool(late)), i
    assert len(got) == len(a) and streams.correlate_batch(at(a).limit(0), at(b), 5, 20).collect() == []
    plan = streams.correlate_batch(at(a), at(b), 5, 20)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Cartesian" not in plan


def test_late_answers_in_a_stream(spark, tmp_path):
    schema = "event_id long, user_id long, t long"
    put = lambda name, data: spark.createDataFrame(data, schema).select("event_id", "user_id", F.timestamp_seconds("t").alias("ts")).coalesce(1).write.parquet(str(tmp_path / name))
    put("a", [(1, 1, 100), (2, 1, 200), (3, 2, 300), (9, 9, 9_000)])
    put("b", [(11, 1, 103), (12, 1, 215), (19, 9, 9_001)])
    source = lambda name: spark.readStream.schema("event_id long, user_id long, ts timestamp").parquet(str(tmp_path / name))
    got, _ = run(streams.correlate(source("a"), source("b"), 5, 20, watermark="1 second"), "answers")
    assert {(r[0], r[3], r[4], r[5]) for r in got} == {(1, 11, False, False), (2, None, True, False), (2, 12, False, True), (3, None, True, False), (9, 19, False, False)}


def test_replayed_batches_change_nothing(spark, tmp_path):
    path, keys = str(tmp_path / "r"), ("client", "id")
    batch = lambda *rows_: spark.createDataFrame(list(rows_), "client string, id string, ts long, value string")
    assert files.merge_batch(batch(("a", "1", 5, "x"), ("a", "1", 4, "w"), ("b", "1", 1, "y")), 0, path, keys, "ts")
    assert files.merge_batch(batch(("a", "1", 5, "later batch"), ("b", "1", 0, "older")), 1, path, keys, "ts")
    want = [("a", "1", 5, "later batch"), ("b", "1", 1, "y")]
    read = lambda: rows(files.read_results(spark, path, keys, "ts"))
    assert read() == want
    assert not files.merge_batch(batch(("a", "1", 9, "replayed")), 1, path, keys, "ts") and read() == want
    files.compact_results(spark, path, keys, "ts")
    assert read() == want and not files.merge_batch(batch(("a", "1", 9, "replayed")), 0, path, keys, "ts") and read() == want
    assert files.merge_batch(batch(("c", "1", 1, "new")), 2, path, keys, "ts") and read() == [*want, ("c", "1", 1, "new")]
    # a write that was cut short: no end mark, so neither read nor taken as done
    spark.createDataFrame([("d", "1", 1, "half")], "client string, id string, ts long, value string").write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{path}/batch=3")
    assert read() == [*want, ("c", "1", 1, "new")] and files.merge_batch(batch(("d", "1", 1, "whole")), 3, path, keys, "ts") and ("d", "1", 1, "whole") in read()
    with pytest.raises(FileNotFoundError):
        files.read_results(spark, str(tmp_path / "none"), keys, "ts")


def test_results_stream(spark, tmp_path):
    data = spark.createDataFrame([("a", "1", 1, "x"), ("a", "1", 2, "y"), ("b", "2", 1, "z")], "client string, id string, ts long, text string")
    data.coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(data.schema).parquet(str(tmp_path / "in"))
    for _ in range(2):  # started again it has nothing new
        files.write_results(source, str(tmp_path / "out"), str(tmp_path / "log")).awaitTermination()
        assert rows(files.read_results(spark, str(tmp_path / "out"), ("client", "id"), "ts")) == [("a", "1", 2, "y"), ("b", "2", 1, "z")]
