"""From raw records to report rows: the whole decode as one declarative plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom import fixed_values as fv
from spanloom.functions import codec
from spanloom.operators import assemble, codes, names, order, spans
from spanloom.operators.filters import in_ranges, process_filter, visible
from spanloom.session import settle
from spanloom.sources import raw, text


def counted(records: DataFrame, found: DataFrame) -> DataFrame:
    """Records that count: all but look-up rows, and the END row of each finished look-up."""
    lookup = codec.event_id(F.col("debugid")) == fv.VFS_LOOKUP
    ends = records.filter(lookup).join(found.select("seq"), "seq", "left_semi")
    return records.filter(~lookup).unionByName(ends)


def all_spans(records: DataFrame) -> DataFrame:
    """(seq, elapsed) of every ending record: START/END pairs and run-queue waits in one key space."""
    d = F.col("debugid")
    made = d == fv.MAKE_RUNNABLE
    ran = d.isin(fv.STACK_HANDOFF, fv.SCHEDULED)
    eventid = codec.event_id(d)
    opens = (codec.is_start(d) & ~spans.never_opens(eventid)) | made
    closes = codec.is_end_only(d) | ran
    keyed = records.filter(eventid != fv.VFS_LOOKUP).select(
        "seq",
        "ts",
        F.when(made, F.col("arg1")).when(ran, F.col("arg2")).otherwise(F.col("tid")).alias("_tid"),
        F.when(ran, F.lit(fv.MAKE_RUNNABLE).cast("long")).otherwise(eventid).alias("_id"),
        opens.alias("_opens"),
        closes.alias("_closes"),
        ran.alias("_ran"),
    )
    paired = spans.pair(keyed, ["_tid", "_id"], opens=F.col("_opens"), closes=F.col("_closes"))
    return paired.filter(~F.col("_ran") | (F.col("elapsed") != 0)).select("seq", "elapsed")


def created_threads(records: DataFrame) -> DataFrame:
    eventid = codec.event_id(F.col("debugid"))
    text = codec.words_text(*[F.col(f"arg{i}") for i in range(1, 5)])
    return names.new_thread_names(
        records, eventid == fv.NEW_THREAD_DATA, eventid == fv.NEW_THREAD_NAME, F.col("arg1"), text
    )


def exec_names(records: DataFrame) -> DataFrame:
    execs = records.filter(codec.event_id(F.col("debugid")) == fv.EXEC_NAME)
    return execs.select("seq", "tid", codec.words_text(*[F.col(f"arg{i}") for i in range(1, 5)]).alias("name"))


def decode_files(
    spark: SparkSession,
    path: str,
    code_paths: list[str],
    lists_before: str | None = None,
    lists_after: str | None = None,
    bits: int = 64,
    divisor: float = 1.0,
    types: list[tuple[int, int]] | None = None,
    **options,
) -> tuple[DataFrame, DataFrame]:
    """Decode raw files with their side files: (report rows, thread map of the capture).

    The records are settled as Parquet first, so the raw bytes are read once.
    """
    read = raw.read_raw(spark, path, bits=bits)
    records = settle(in_ranges(read, types) if types else read)
    thread_map = raw.read_raw(spark, path, table="threadmap", bits=bits)
    cpu_map = raw.read_raw(spark, path, table="cpumap", bits=bits)
    empty = spark.createDataFrame([], "pid long, command string, line long")
    before, after = (text.read_processes(spark, p) if p else empty for p in (lists_before, lists_after))
    processes = names.overlay(before, after)
    shown = decode(records, text.read_codes(spark, code_paths), thread_map, cpu_map, processes, divisor=divisor, **options)
    shown = settle(shown)
    learned = shown.select(F.col("seq").alias("order"), "tid", F.col("command").alias("name"))
    return shown, names.resolved_map(names.owner_events(records), learned, processes)


def decode(
    records: DataFrame,
    dictionary: DataFrame,
    thread_map: DataFrame,
    cpu_map: DataFrame,
    processes: DataFrame,
    divisor: float = 1.0,
    verbose: bool = False,
    relative: bool = False,
    include: list[int] | None = None,
    exclude: list[int] | None = None,
) -> DataFrame:
    """Decoded records in report form, one row per shown record.

    ``records`` are raw records (schema EVENT), ``dictionary`` the codes,
    ``thread_map`` (entry, tid, command), ``cpu_map`` and ``processes`` the
    side tables. ``relative`` counts time from the first record; ``include``
    and ``exclude`` choose processes among the shown rows.

    Every scan works on the few columns it needs and gives (seq, value); all
    of them meet the whole records in joins on ``seq``, so the wide rows are
    shuffled once. Raw files should be settled as Parquet before.
    """
    if relative:
        records = records.withColumn("ts", F.col("ts") - records.agg(F.min_by("ts", "seq")).scalar())
    found = settle(assemble.paths(records).select(F.col("end_seq").alias("seq"), "dvp", "path"))
    rows = counted(records, found)

    at = order.file_times(rows)
    initial = thread_map.select("tid", F.col("command").alias("name"), "entry")
    defined = names.definitions(initial, exec_names(records), created_threads(records))
    roles = rows.select("seq", "tid", names.name_role(F.col("debugid")).alias("role"))
    named = settle(names.thread_names(roles, defined, F.col("role")).select("seq", "tid", "name"))
    learned = named.select(F.col("seq").alias("order"), "tid", "name")
    shown = rows if verbose else rows.filter(visible())
    ended = all_spans(records if verbose else records.filter(visible()))

    timed = (
        shown.join(at, "seq")
        .join(named.select("seq", "name"), "seq")
        .join(ended, "seq", "left")
        .join(found, "seq", "left")
        .withColumn("eventid", codec.event_id(F.col("debugid")))
    )
    commanded = names.command_as_of(timed, settle(names.owner_events(records)), learned, processes)
    owned = process_filter(commanded, include, exclude, pid="owner_pid")
    commands = owned.drop("name").withColumnRenamed("command", "name")
    labelled = codes.name_codes(names.coprocessor_names(commands, cpu_map), dictionary, name="label")
    return labelled.withColumns(
        {
            "us": codec.ticks_to_us(F.col("ts"), divisor),
            "delta_us": codec.ticks_to_us(F.col("delta"), divisor),
            "elapsed_us": codec.ticks_to_us(F.col("elapsed"), divisor),
        }
    ).withColumnRenamed("name", "command")
