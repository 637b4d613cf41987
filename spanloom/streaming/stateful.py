"""Stateful streams: open spans, thread names and threads being created as keyed state.

Each is a ``transformWithState`` operator: Spark keeps the state of every key
in its RocksDB store, touches only the keys that a micro-batch brings, and
restores both from its checkpoint when a query goes on or is repeated. Output
is appended by Spark's own file sink, which counts every micro-batch once.

A micro-batch's rows of one key come unordered and are sorted in its task, so
the rows that one key may bring are bounded by the source's rate
(``files_per_trigger``), whatever the length of the stream.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from spanloom import fixed_values as fv
from spanloom.functions import codec
from spanloom.operators import names, spans
from spanloom.session import ship

if TYPE_CHECKING:
    import pandas as pd

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def landed(spark: SparkSession, path: str, schema: str, files_per_trigger: int | None = None) -> DataFrame:
    """Stream over Parquet files a collector drops into a folder."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def _sorted(rows: Iterator[pd.DataFrame], by: str) -> pd.DataFrame:
    import pandas as pd

    return pd.concat(list(rows), ignore_index=True).sort_values(by, ignore_index=True)


def _keyed(rows: DataFrame, keys: list[str], processor: StatefulProcessor, schema: str, time: str = "None", initial: DataFrame | None = None) -> DataFrame:
    spark = rows.sparkSession
    ship(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    before = None if initial is None else initial.groupBy(*keys)
    return rows.groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode=time, initialState=before
    )


class OpenSpans(StatefulProcessor):
    """The open START of each (thread, event id); with a time to live, a timer forgets it."""

    def __init__(self, ttl_us: int | None) -> None:
        self.ttl_us = ttl_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "seq long, ts long")

    def _ends(self, ts: int) -> int:
        return (ts + self.ttl_us) // 1000 + 1

    def handleInputRows(self, key, rows, timerValues):
        import numpy as np

        found = _sorted(rows, "seq")
        held = self.open.get()
        opens = found["opens"].to_numpy(bool)
        seq, ts = found["seq"].to_numpy(), found["ts"].to_numpy()
        before = np.concatenate(([held is not None], opens[:-1]))
        started = np.concatenate(([held[1] if held else 0], ts[:-1]))
        if self.ttl_us is not None and held is not None:
            self.handle.deleteTimer(self._ends(held[1]))
        if opens[-1]:
            self.open.update((int(seq[-1]), int(ts[-1])))
            if self.ttl_us is not None:
                self.handle.registerTimer(self._ends(int(ts[-1])))
        elif held is not None:
            self.open.clear()
        owner = np.concatenate(([held[0] if held else 0], seq[:-1]))
        if self.ttl_us is not None:
            # The watermark, which fires the timers, comes after the micro-batch: what has run out within it ends here.
            late = before & (ts - started > self.ttl_us)
            before = before & ~late
            yield self._expired(key, owner[late])
        closed = found[~opens][["seq"]].assign(tid=key[0], eventid=key[1])
        closed["elapsed"] = np.where(before, ts - started, 0)[~opens]
        yield closed.assign(state="closed")[["seq", "tid", "eventid", "elapsed", "state"]]

    def _expired(self, key, starts) -> pd.DataFrame:
        import pandas as pd

        none = pd.array([None] * len(starts), "Int64")
        return pd.DataFrame({"seq": starts, "tid": key[0], "eventid": key[1], "elapsed": none, "state": "expired"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        held = self.open.get()
        self.open.clear()
        yield self._expired(key, [held[0]])

    def close(self) -> None:
        pass


SPANS = "seq long, tid long, eventid long, elapsed long, state string"


def code_spans(stream: DataFrame, ttl_us: int | None = None, lateness: str = "0 seconds") -> DataFrame:
    """Span pairing as in ``spans.code_spans``; ``state`` is 'closed'.

    With a time to live, a START is put out as 'expired' and forgotten once
    event time, less ``lateness``, or the next record of its key has passed it
    by more. Records later than ``lateness`` are then dropped by the watermark.
    """
    debugid = F.col("debugid")
    eventid = codec.event_id(debugid)
    opens = codec.is_start(debugid) & ~spans.never_opens(eventid)
    wanted = (eventid != fv.VFS_LOOKUP) & (opens | codec.is_end_only(debugid))
    if ttl_us is not None:
        stream = stream.withColumn("_time", F.timestamp_micros("ts")).withWatermark("_time", lateness)
    rows = stream.filter(wanted).select("tid", eventid.alias("eventid"), "seq", "ts", opens.alias("opens"), *(["_time"] if ttl_us is not None else []))
    return _keyed(rows, ["tid", "eventid"], OpenSpans(ttl_us), SPANS, "None" if ttl_us is None else "EventTime")


class Creations(StatefulProcessor):
    """Threads that a creator has announced and not named yet: the newest takes the next name."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.depth = handle.getValueState("depth", "n int")
        self.pending = handle.getMapState("pending", "level int", "tid long")

    def handleInputRows(self, key, rows, timerValues):
        import pandas as pd

        held, made = self.depth.get(), []
        before = depth = held[0] if held else 0
        for row in _sorted(rows, "at").itertuples():
            if row.is_new:
                depth += 1
                self.pending.updateValue((depth,), (int(row.new_tid),))
            elif depth:
                made.append((row.at + 1, self.pending.getValue((depth,))[0], row.name))
                self.pending.removeKey((depth,))
                depth -= 1
        if depth != before:
            self.depth.update((depth,))
        yield pd.DataFrame(made, columns=["at", "tid", "name"])

    def close(self) -> None:
        pass


class Names(StatefulProcessor):
    """Each living thread's name and whether its end was announced."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getValueState("known", "name string, marked boolean")

    def handleInitialState(self, key, initialState, timerValues) -> None:
        row = initialState.iloc[-1]
        self.known.update((row["name"], bool(row["marked"])))

    def handleInputRows(self, key, rows, timerValues):
        import pandas as pd

        found = _sorted(rows, "at")
        held = self.known.get()
        name, marked = (held[0], held[1]) if held else (None, False)
        shown = []
        for at, role, given in zip(found["at"], found["role"], found["name"]):
            if role == DEFINE:
                name, marked = given, False
                continue
            shown.append((at // 2, key[0], "" if role == names.NAMELESS or name is None else name))
            if role == names.EXIT or (role == names.HANDOFF and marked):
                name, marked = None, False
            elif role == names.TERMINATE:
                marked = name is not None
        if name is None and held:
            self.known.clear()
        elif name is not None and (name, marked) != (held and (held[0], held[1])):
            self.known.update((name, marked))
        yield pd.DataFrame(shown, columns=["seq", "tid", "name"])

    def close(self) -> None:
        pass


DEFINE = "define"


def created_names(stream: DataFrame, is_new: Column, is_name: Column, new_tid: Column, name: Column) -> DataFrame:
    """(at, tid, name) of threads being created, as in ``names.new_thread_names``; ``at`` is seq * 2 + 1 of the naming record."""
    rows = stream.filter(is_new | is_name).select(
        F.col("tid").alias("creator"), (F.col("seq") * 2).alias("at"), is_new.alias("is_new"), new_tid.alias("new_tid"), name.alias("name")
    )
    return _keyed(rows, ["creator"], Creations(), "at long, tid long, name string")


def thread_names(
    stream: DataFrame, role: Column, is_definition: Column, definition: Column, created: DataFrame | None = None, initial: DataFrame | None = None
) -> DataFrame:
    """(seq, tid, name): each record's thread name as of the record, see ``names.thread_names``.

    ``initial`` (tid, name, marked) is the thread map, ``created`` comes from
    ``created_names`` over the same stream.
    """
    none = F.lit(None).cast("string")
    rows = stream.select("tid", (F.col("seq") * 2).alias("at"), role.cast("string").alias("role"), none.alias("name"))
    told = stream.filter(is_definition).select("tid", (F.col("seq") * 2 + 1).alias("at"), F.lit(DEFINE).alias("role"), codec.command16(definition).alias("name"))
    both = rows.unionByName(told)
    if created is not None:
        both = both.unionByName(created.select("tid", "at", F.lit(DEFINE).alias("role"), codec.command16(F.col("name")).alias("name")))
    return _keyed(both, ["tid"], Names(), "seq long, tid long, name string", initial=initial)


def append(rows: DataFrame, folder: str, processing_time: str | None = None):
    """Start the stream; rows lie in ``folder``/out. Without ``processing_time`` it takes what has arrived and stops."""
    writer = rows.writeStream.format("parquet").outputMode("append").option("checkpointLocation", os.path.join(folder, "checkpoint"))
    writer = writer.option("path", os.path.join(folder, "out"))
    writer = writer.trigger(processingTime=processing_time) if processing_time else writer.trigger(availableNow=True)
    return writer.start()


def output(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(os.path.join(folder, "out"))


def capture(stream: DataFrame, seconds: float, folder: str, ts: str = "ts", processing_time: str | None = None) -> bool:
    """Append the first ``seconds`` of a stream (times in µs) to ``folder``/out; True once they are over.

    The first micro-batch that has records sets the deadline, which is written
    beside the output before any of it, so that a query that goes on, or a
    repeated micro-batch, keeps to it. A micro-batch is written under its
    number, so repeating it counts once. A record at or behind the deadline
    ends the query; later records are dropped if it is started again.
    """
    spark = stream.sparkSession
    at = os.path.join(folder, "deadline")
    over = []

    def deadline() -> int | None:
        place = spark._jvm.org.apache.hadoop.fs.Path(at, "_SUCCESS")
        found = place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(place)
        return spark.read.schema("deadline long").parquet(at).first()[0] if found else None

    def on_batch(batch: DataFrame, number: int) -> None:
        limit = deadline()
        if limit is None:
            first = batch.agg(F.min(ts)).first()[0]
            if first is None:
                return
            limit = first + int(seconds * 1_000_000)
            batch.sparkSession.createDataFrame([(limit,)], "deadline long").coalesce(1).write.mode("overwrite").parquet(at)
        seen = Observation()
        kept = batch.observe(seen, F.max(ts).alias("latest")).filter(F.col(ts) < limit)
        kept.write.mode("overwrite").parquet(os.path.join(folder, "out", f"batch={number:012d}"))
        if (seen.get["latest"] or limit - 1) >= limit:
            over.append(number)

    writer = stream.writeStream.foreachBatch(on_batch).option("checkpointLocation", os.path.join(folder, "checkpoint"))
    query = (writer.trigger(processingTime=processing_time) if processing_time else writer.trigger(availableNow=True)).start()
    while not query.awaitTermination(1):
        if over:
            query.stop()
    return bool(over)


def captured(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """What ``capture`` has written."""
    out = os.path.join(folder, "out")
    return spark.read.schema(schema).option("basePath", out).parquet(os.path.join(out, "batch=*")).select(*[f.split()[0] for f in schema.split(", ")])
