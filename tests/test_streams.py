"""Streams resumed slice by slice equal the batch result."""

import random

from pyspark.sql import functions as F

from spanloom.operators import names, spans
from spanloom.streaming import stateful


def events(seed, n=300):
    pick = random.Random(seed)
    return [(s, s * 10, 0 if pick.random() < 0.34 else pick.randrange(1, 6), 0x040C0010 + 4 * pick.randrange(3) + pick.randrange(4)) for s in range(n)]


def feed(spark, rows, schema, folder, work, slices=3):
    """The rows in slices, the stream started anew for each of them."""
    size = -(-len(rows) // slices)
    for i in range(0, len(rows), size):
        spark.createDataFrame(rows[i : i + size], schema).write.mode("append").parquet(f"{folder}/in")
        stateful.append(work(stateful.landed(spark, f"{folder}/in", schema)), folder).awaitTermination()


EVENTS = "seq long, ts long, tid long, debugid long"


def test_span_stream(spark, tmp_path):
    rows = events(1)
    feed(spark, rows, EVENTS, str(tmp_path), stateful.code_spans)
    batch = spans.code_spans(spark.createDataFrame(rows, EVENTS)).select("seq", "tid", "eventid", "elapsed")
    got = stateful.output(spark, str(tmp_path), stateful.SPANS).drop("state")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, batch.collect()))


def test_span_stream_forgets_old_starts(spark, tmp_path):
    ms, start, end = 1000, 0x040C0011, 0x040C0012
    slices = [
        [(0, 0, 1, start), (1, 10, 2, start), (2, 20, 3, start)],
        # Thread 2 ends too late, thread 3 begins anew too late, thread 4 in time.
        [(3, 1000, 2, end), (4, 1001, 3, start), (5, 1002, 4, start)],
        [(6, 1050, 4, end), (7, 1060, 3, end), (8, 1065, 5, start), (9, 5000, 5, end), (10, 5001, 6, start)],
    ]
    for part in slices:
        rows = [(s, (t + 1_000_000) * ms, tid, code) for s, t, tid, code in part]
        spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stateful.append(stateful.code_spans(stateful.landed(spark, f"{tmp_path}/in", EVENTS), ttl_us=100 * ms), str(tmp_path)).awaitTermination()
    got = stateful.output(spark, str(tmp_path), stateful.SPANS).select("seq", "tid", "elapsed", "state").collect()
    assert sorted(map(tuple, got)) == [
        (0, 1, None, "expired"),
        (1, 2, None, "expired"),
        (2, 3, None, "expired"),
        (3, 2, 0, "closed"),
        (6, 4, 48 * ms, "closed"),
        (7, 3, 59 * ms, "closed"),
        (8, 5, None, "expired"),
        (9, 5, 0, "closed"),
    ]


def test_state_follows_the_keys_touched(spark, tmp_path):
    """Ten thousand open spans, then a few: the second micro-batch writes a few keys."""
    wide = [(s, s, s, 0x040C0011) for s in range(10_000)]
    few = [(10_000 + s, 20_000, s, 0x040C0012) for s in range(5)]
    for part in (wide, few):
        spark.createDataFrame(part, EVENTS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        query = stateful.append(stateful.code_spans(stateful.landed(spark, f"{tmp_path}/in", EVENTS)), str(tmp_path))
        query.awaitTermination()
        state = query.lastProgress["stateOperators"][0]
    assert state["numRowsTotal"] == 9_995
    assert state["numRowsUpdated"] + state["numRowsRemoved"] < 50


def test_name_stream(spark, tmp_path):
    pick = random.Random(3)
    kinds = ["exec", "exit", "term", "hand", "other"]
    rows = [(s, 0 if pick.random() < 0.34 else pick.randrange(1, 7), pick.choice(kinds)) for s in range(240)]
    schema = "seq long, tid long, kind string"
    kind = F.col("kind")
    role = F.when(kind == "exec", names.NAMELESS).when(kind == "exit", names.EXIT).when(kind == "term", names.TERMINATE).when(kind == "hand", names.HANDOFF)
    text = F.concat(F.lit("n"), F.col("seq").cast("string"))
    first = [(tid, f"first{tid}", False) for tid in (0, 4, 5)]
    initial = spark.createDataFrame(first, "tid long, name string, marked boolean")
    feed(spark, rows, schema, str(tmp_path), lambda stream: stateful.thread_names(stream, role, kind == "exec", text, initial=initial))
    df = spark.createDataFrame(rows, schema)
    before = spark.createDataFrame([(1, tid, name) for tid, name, _ in first if tid], "entry long, tid long, name string")
    # The map leaves thread 0 out; here it has its name from a definition before the first record.
    execs = df.filter(kind == "exec").select("seq", "tid", text.alias("name")).unionAll(spark.createDataFrame([(-1, 0, "first0")], "seq long, tid long, name string"))
    batch = names.thread_names(df, names.definitions(before, execs), role)
    got = stateful.output(spark, str(tmp_path), "seq long, name string")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, batch.select("seq", "name").collect()))


def test_creation_stream(spark, tmp_path):
    """Announcements wait for their names over micro-batches."""
    pick = random.Random(4)
    rows = [(s, 0 if pick.random() < 0.34 else pick.randrange(1, 5), pick.choice(["new", "new", "name", "other"])) for s in range(160)]
    schema = "seq long, tid long, kind string"
    kind, text, new_tid, none = F.col("kind"), F.concat(F.lit("n"), F.col("seq").cast("string")), F.col("seq") * 3 % 5, F.lit(None).cast("string")

    def work(stream):
        created = stateful.created_names(stream, kind == "new", kind == "name", new_tid, text)
        return stateful.thread_names(stream, none, F.lit(False), none, created)

    feed(spark, rows, schema, str(tmp_path), work)
    df = spark.createDataFrame(rows, schema)
    before = spark.createDataFrame([], "entry long, tid long, name string")
    execs = df.filter("false").select("seq", "tid", text.alias("name"))
    created = names.new_thread_names(df, kind == "new", kind == "name", new_tid, text)
    batch = names.thread_names(df, names.definitions(before, execs, created), none)
    want = sorted(map(tuple, batch.select("seq", "name").collect()))
    assert sum(name != "" for _, name in want) > 50
    assert sorted(map(tuple, stateful.output(spark, str(tmp_path), "seq long, name string").collect())) == want


def test_capture_ends_in_time(spark, tmp_path):
    folder, schema, second = str(tmp_path), "seq long, ts long", 1_000_000
    slices = [[], [(0, 5 * second), (1, 7 * second)], [(2, 14 * second), (3, 15 * second), (4, 9 * second)], [(5, 6 * second), (6, 90 * second)]]
    over = []
    for part in slices:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        over.append(stateful.capture(stateful.landed(spark, f"{folder}/in", schema), 10, folder))
    # From 5 s up to, not including, 15 s; a record of that time which comes later still counts.
    assert sorted(r.seq for r in stateful.captured(spark, folder, schema).collect()) == [0, 1, 2, 4, 5]
    assert over == [False, False, True, True]


def test_capture_stops_a_running_query(spark, tmp_path):
    folder, schema = str(tmp_path), "seq long, ts long"
    spark.createDataFrame([(0, 0), (1, 3_000_000)], schema).write.parquet(f"{folder}/in")
    assert stateful.capture(stateful.landed(spark, f"{folder}/in", schema), 2, folder, processing_time="1 second")
    assert [r.seq for r in stateful.captured(spark, folder, schema).collect()] == [0]
