"""Streaming queries: the tables land in slices and the stream is resumed after each."""

import os

from pyspark.sql import functions as F

from spanloom import schema
from spanloom.functions import codec
from spanloom.operators import names
from spanloom.plans.naming import LIFE_SQL, initial_map
from spanloom.plans.registry import query
from spanloom.plans.spans import SPANS_SQL
from spanloom.plans.tables import EVENTS_SQL, KEVENTS_SQL, events, kevents, per_type
from spanloom.session import fresh_path
from spanloom.sources import raw
from spanloom.streaming import stateful, windows

SLICES = 3


def land(rows, folder, number):
    """Append one slice in event order, as a collector would drop its next files."""
    count = rows.agg(F.max("seq")).scalar() + 1
    rows.filter(F.floor(F.col("seq") * SLICES / count) == number).write.mode("append").parquet(folder)


SPAN_ROWS = "seq long, ts long, tid long, debugid long"
NAME_ROWS = "seq long, tid long, event_type string"
NAMED = "seq long, tid long, name string"


@query("stream_spans", f"WITH {SPANS_SQL} SELECT seq, tid, eventid, elapsed FROM sp")
def stream_spans(spark, sf_dir):
    folder = fresh_path(spark, "stream-spans")
    source = os.path.join(folder, "in")
    rows = kevents(spark, sf_dir).select("seq", "ts", "tid", "debugid")
    for number in range(SLICES):
        land(rows, source, number)
        stateful.append(stateful.code_spans(stateful.landed(spark, source, SPAN_ROWS)), folder).awaitTermination()
    return stateful.output(spark, folder, stateful.SPANS).drop("state")


def staged(spark, sf_dir, folder):
    """events as raw files, one for each task that writes them."""
    raw.register(spark)
    zero = F.lit(0).cast("long")
    rows = kevents(spark, sf_dir).withColumns({"arg3": zero, "arg4": zero, "cpu": F.col("cpu").cast("int")})
    placed = rows.repartitionByRange("seq").sortWithinPartitions("seq").drop("seq", "pid", "eventid")
    placed.write.format("rawevents").mode("append").save(folder)
    return folder


def grow(spark, source, target, share):
    """The first ``share`` of every file's bytes, as a recorder would have written them so far; copied by tasks."""
    files = raw.read_raw(spark, source, table="header").select("file").distinct()

    def copy(frames):
        for frame in frames:
            for path in frame["file"]:
                raw.copy_start(path, f"{target}/{path.rsplit('/', 1)[1]}", share)
            yield frame

    files.mapInPandas(copy, files.schema).write.format("noop").mode("overwrite").save()


@query(
    "stream_raw_spans",
    f"WITH {SPANS_SQL}, n AS (SELECT tid, eventid, elapsed FROM sp) SELECT tid, eventid, elapsed, count(*) AS n FROM n GROUP BY 1, 2, 3",
)
def stream_raw_spans(spark, sf_dir):
    """Raw files arrive one by one; spans reach across files and slices."""
    folder = fresh_path(spark, "stream-raw")
    source = os.path.join(folder, "in")
    rows = kevents(spark, sf_dir)
    count = rows.agg(F.max("seq")).scalar() + 1
    raw.register(spark)
    zero = F.lit(0).cast("long")
    for number in range(SLICES):
        part = rows.filter(F.floor(F.col("seq") * SLICES / count) == number).withColumns({"arg3": zero, "arg4": zero, "cpu": F.col("cpu").cast("int")})
        placed = part.repartitionByRange("seq").sortWithinPartitions("seq").drop("seq", "pid", "eventid")
        placed.write.format("rawevents").mode("append").save(source)
        stateful.append(stateful.code_spans(raw.stream_raw(spark, source)), folder).awaitTermination()
    out = stateful.output(spark, folder, stateful.SPANS)
    return out.groupBy("tid", "eventid", "elapsed").agg(F.count(F.lit(1)).alias("n"))


@query("stream_raw_growing", f"WITH {KEVENTS_SQL} SELECT ts, tid, debugid, CAST(cpu AS INTEGER) AS cpu, arg1, arg2 FROM k")
def stream_raw_growing(spark, sf_dir):
    """Raw files that grow between triggers, cut within records: every record comes once."""
    folder = fresh_path(spark, "stream-growing")
    source, live = staged(spark, sf_dir, os.path.join(folder, "whole")), os.path.join(folder, "in")
    for share in (0.3, 0.71, 1.0):
        grow(spark, source, live, share)
        stateful.append(raw.stream_raw(spark, live, splitbytes=1 << 20), folder).awaitTermination()
    return stateful.output(spark, folder, schema.EVENT).select("ts", "tid", "debugid", "cpu", "arg1", "arg2")


@query("stream_names", f"WITH {LIFE_SQL} SELECT seq, tid, name FROM named")
def stream_names(spark, sf_dir):
    folder = fresh_path(spark, "stream-names")
    source = os.path.join(folder, "in")
    rows = events(spark, sf_dir).select("seq", "tid", "event_type")
    role = per_type(error=names.EXIT, purchase=names.TERMINATE, click=names.HANDOFF, signup=names.NAMELESS)
    first = initial_map(spark, sf_dir).groupBy("tid").agg(codec.command16(F.max_by("name", "entry")).alias("name"))
    first = first.filter(F.col("tid") != 0).withColumn("marked", F.lit(False))
    kind, text = F.col("event_type"), F.concat(F.lit("c"), F.col("seq").cast("string"))
    for number in range(SLICES):
        land(rows, source, number)
        stream = stateful.landed(spark, source, NAME_ROWS)
        stateful.append(stateful.thread_names(stream, role, kind == "signup", text, initial=first), folder).awaitTermination()
    return stateful.output(spark, folder, NAMED)


@query(
    "stream_creation",
    f"""WITH {EVENTS_SQL}, c AS (SELECT seq, tid AS creator, CASE WHEN event_type = 'click' THEN 1 ELSE -1 END AS way FROM ev WHERE event_type IN ('click', 'signup')),
 s AS (SELECT *, sum(way) OVER (PARTITION BY creator ORDER BY seq) AS sm FROM c),
 l AS (SELECT *, sm - least(0, min(sm) OVER (PARTITION BY creator ORDER BY seq)) + CASE WHEN way = 1 THEN 0 ELSE 1 END AS lvl FROM s),
 p AS (SELECT *, lag(way) OVER w AS pway, lag(seq) OVER w AS pseq FROM l WINDOW w AS (PARTITION BY creator, lvl ORDER BY seq)),
 d AS (SELECT pseq * 7 % 64 AS tid, seq AS o, 'c' || seq AS name FROM p WHERE way = -1 AND pway = 1)
SELECT ev.seq AS seq, ev.tid AS tid, coalesce(d.name, '') AS name FROM ev ASOF LEFT JOIN d ON ev.tid = d.tid AND ev.seq > d.o""",
)
def stream_creation(spark, sf_dir):
    """Threads are announced in one slice and may be named in a later one."""
    folder = fresh_path(spark, "stream-creation")
    source = os.path.join(folder, "in")
    rows = events(spark, sf_dir).select("seq", "tid", "event_type")
    kind, text = F.col("event_type"), F.concat(F.lit("c"), F.col("seq").cast("string"))
    none = F.lit(None).cast("string")
    for number in range(SLICES):
        land(rows, source, number)
        stream = stateful.landed(spark, source, NAME_ROWS)
        created = stateful.created_names(stream, kind == "click", kind == "signup", F.col("seq") * 7 % 64, text)
        stateful.append(stateful.thread_names(stream, none, F.lit(False), none, created), folder).awaitTermination()
    return stateful.output(spark, folder, NAMED)


@query(
    "stream_time_bound",
    f"WITH {EVENTS_SQL} SELECT seq, ts FROM ev WHERE ts < (SELECT min(ts) FROM ev) + 864000000000",
)
def stream_time_bound(spark, sf_dir):
    """The first ten days of a capture; the stream is started anew for every slice, also once the time is over."""
    folder = fresh_path(spark, "stream-bound")
    source = os.path.join(folder, "in")
    rows = events(spark, sf_dir).select("seq", "ts")
    for number in range(SLICES):
        land(rows, source, number)
        stateful.capture(stateful.landed(spark, source, "seq long, ts long"), 864000, folder)
    return stateful.captured(spark, folder, "seq long, ts long")


HOUR_US = 3_600_000_000
WIDTH, LATENESS = "1 hour", "10 minutes"


def land_to_the_end(rows, folder):
    """Land slice after slice, then the end marker; yields after each, for the stream to take it."""
    for number in range(SLICES):
        land(rows, folder, number)
        yield
    windows.end_marker(rows, WIDTH, LATENESS).write.mode("append").parquet(folder)
    yield


@query(
    "stream_window_counts",
    f"WITH {KEVENTS_SQL} SELECT ts // {HOUR_US} * {HOUR_US} AS window_start, debugid >> 24 AS class, count(*) AS n FROM k GROUP BY 1, 2",
)
def stream_window_counts(spark, sf_dir):
    folder = fresh_path(spark, "stream-windows")
    source, out, checkpoint = (os.path.join(folder, name) for name in ("in", "out", "checkpoint"))
    for _ in land_to_the_end(kevents(spark, sf_dir).select("seq", "ts", "debugid"), source):
        stream = stateful.landed(spark, source, "seq long, ts long, debugid long")
        counts = windows.window_counts(stream, WIDTH, LATENESS, codec.event_class(F.col("debugid")).alias("class"))
        windows.to_parquet(counts, out, checkpoint).awaitTermination()
    return spark.read.schema("window_start long, class long, n long").parquet(out)


@query(
    "stream_lost_events",
    f"WITH {EVENTS_SQL} SELECT ts // {HOUR_US} * {HOUR_US} AS window_start, count(*) AS markers FROM ev WHERE event_type = 'error' GROUP BY 1",
)
def stream_lost_events(spark, sf_dir):
    folder = fresh_path(spark, "stream-lost")
    source, out, checkpoint = (os.path.join(folder, name) for name in ("in", "out", "checkpoint"))
    for _ in land_to_the_end(events(spark, sf_dir).select("seq", "ts", "event_type"), source):
        stream = stateful.landed(spark, source, "seq long, ts long, event_type string")
        lost = windows.lost_events(stream, WIDTH, LATENESS, F.col("event_type") == "error")
        windows.to_parquet(lost, out, checkpoint).awaitTermination()
    return spark.read.schema("window_start long, markers long").parquet(out)
