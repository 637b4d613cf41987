"""Values spread over several records: paths, texts, backtraces, call arguments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom import fixed_values as fv
from spanloom.functions import codec
from spanloom.operators.chains import heads
from spanloom.operators.sequence import episodes, first_rows, last, ordered_text, prev, row_numbers, scan, total
from spanloom.session import settle

ARGS = ["arg1", "arg2", "arg3", "arg4"]
# A path holds 3 words of the first record and 4 of each later one while at most 19 are held.
PATH_RECORDS = 1 + (fv.PATH_WORDS - 3) // 4


def paths(df: DataFrame) -> DataFrame:
    """Paths looked up, one row per finished look-up: (tid, start_seq, end_seq, end_ts, dvp, path).

    START begins anew, END finishes; records of a thread with no open look-up
    and words beyond the limit are left out.
    """
    rows = df.filter(codec.event_id(F.col("debugid")) == fv.VFS_LOOKUP)
    ends = codec.bits(F.col("debugid"), fv.END_BIT) != 0
    parts = episodes(rows, ["tid"], "seq", codec.is_start(F.col("debugid")), ends, "start_seq")
    done = parts.filter(ends).groupBy("tid", "start_seq").agg(F.min("seq").alias("end_seq"), F.min("ts").alias("end_ts"))
    kept = first_rows(parts, ["tid", "start_seq"], "seq", PATH_RECORDS)
    hexed = F.when(F.col("idx") == 0, F.concat(*[codec.word_hex(F.col(a)) for a in ARGS[1:]])).otherwise(
        F.concat(*[codec.word_hex(F.col(a)) for a in ARGS])
    )
    words = (
        kept.withColumn("_hex", hexed)
        .groupBy("tid", "start_seq")
        .agg(
            F.max(F.when(F.col("idx") == 0, F.col("arg1"))).alias("dvp"),
            # At most PATH_RECORDS entries per look-up.
            F.array_sort(F.collect_list(F.struct("idx", "_hex"))).alias("_parts"),
        )
    )
    path = codec.text_of_hex(F.array_join(F.transform("_parts", lambda p: p["_hex"]), ""))
    return words.join(done, ["tid", "start_seq"]).withColumn("path", path).drop("_parts")


def chunk_texts(df: DataFrame, tag: Column, chunk: Column, framing: Column | None = None) -> DataFrame:
    """Texts written in chunks: a new tag, or a chunk after one with a NUL, begins the next text.

    ``chunk`` holds bytes (``codec.words_bytes`` of a record's words). They are
    joined first and decoded once, so a character may cross two records;
    broken bytes become U+FFFD. Rows marked by ``framing`` carry no text.
    Returns (tid, start_seq, tag, text, n).
    """
    rows = df if framing is None else df.filter(~framing)
    # One character for each byte until the text is whole.
    rows = rows.select("tid", "seq", tag.alias("tag"), F.decode(chunk.cast("binary"), "ISO-8859-1").alias("_chunk"))
    seen = scan(
        rows,
        ["tid"],
        "seq",
        {"_ptag": prev(F.col("tag")), "_pnul": prev(F.col("_chunk").contains("\0"))},
        shared=True,
        keep=True,
    )
    begins = F.coalesce(F.col("_pnul"), F.lit(True)) | (~F.col("_ptag").eqNullSafe(F.col("tag")))
    texts = scan(seen, ["tid"], "seq", {"start_seq": last(F.when(begins, F.col("seq")))})
    cut = texts.withColumn("_chunk", F.substring_index("_chunk", "\0", 1))
    whole = ordered_text(cut, ["tid", "start_seq", "tag"], "seq", "_chunk", "", "text")
    return whole.withColumn("text", F.make_valid_utf8(F.encode("text", "ISO-8859-1").cast("string")))


def is_frame_marker() -> Column:
    """Rows of all zeros or all ones that frame a library dump."""
    return F.array_min(F.array(*ARGS)).eqNullSafe(F.array_max(F.array(*ARGS))) & F.col("arg1").isin(0, -1)


def backtraces(df: DataFrame, opens: Column, closes: Column) -> DataFrame:
    """Backtraces: first record (tag, n, frame, frame), later ones three frames and a spare word.

    Frames beyond n, and zeros, are dropped. How many records a trace has
    follows from its own n; there is no other bound.
    """
    rows = df.select("tid", "seq", *ARGS, opens.alias("_opens"), closes.alias("_closes"))
    # A record's place in its trace follows from running counts, so both scans and nothing else need the records in order.
    counted = scan(rows, ["tid"], "seq", {"_place": total(F.lit(1).cast("long"))}, shared=True, keep=True)
    head = F.struct(F.col("seq").alias("start_seq"), F.col("_place").alias("place"), F.col("arg2").alias("n"))
    steps = {"_head": last(F.when(F.col("_opens"), head)), "_closed": last(F.when(F.col("_closes"), F.col("seq")), before=True)}
    seen = scan(counted, ["tid"], "seq", steps)
    start = F.col("_head.start_seq")
    alive = seen.filter(start.isNotNull() & (F.col("_closed").isNull() | (F.col("_closed") < start)))
    parts = alive.withColumns({"start_seq": start, "idx": F.col("_place") - F.col("_head.place")})
    parts = parts.filter((F.col("idx") == 0) | (F.col("idx") <= F.ceil((F.col("_head.n") - 2) / 3)))
    return _frames(parts, ["tid", "start_seq"])


def _frames(parts: DataFrame, keys: list[str], *more: Column) -> DataFrame:
    """Frames of each trace from its records, numbered by ``idx``; a trace has no more records than its n needs."""
    head = F.col("idx") == 0
    frames = F.when(head, F.array("arg3", "arg4")).otherwise(F.array("arg2", "arg3", "arg4"))
    whole = parts.groupBy(*keys).agg(
        *more,
        F.max(F.when(head, F.col("arg1"))).alias("tag"),
        F.max(F.when(head, F.col("arg2"))).alias("n"),
        F.array_sort(F.collect_list(F.struct("idx", frames.alias("f")))).alias("_parts"),
    )
    flat = F.flatten(F.transform("_parts", lambda p: p["f"]))
    kept = F.filter(F.slice(flat, F.lit(1), F.col("n").cast("int")), lambda f: f != 0)
    return whole.withColumn("frames", kept).drop("_parts")


def user_backtraces(df: DataFrame, most_frames: int = fv.USER_FRAMES) -> DataFrame:
    """Backtraces of programs: records without qualifiers, laid out as in ``backtraces``.

    Only the count n in a trace's first record tells where the next trace of
    the thread begins, and a frame may look like a count, so counts are
    followed from the thread's first record on. A record found where a trace
    should begin whose n is no number of frames (a capture may start in the
    middle of a trace) is passed over. Returns (tid, start_seq, tag, n, frames).
    """
    numbered = row_numbers(df.select("tid", "seq"), ["tid"], "seq", "_at").withColumn("_at", F.col("_at") - 1)
    rows = settle(df.select("tid", "seq", *ARGS).join(numbered, ["tid", "seq"]))
    counts = F.coalesce(F.col("arg2").between(0, most_frames), F.lit(False))
    jump = F.when(counts & (F.col("arg2") > 2), 1 + F.ceil((F.col("arg2") - 2) / 3)).otherwise(1)
    most = 1 + -(-(most_frames - 2) // 3)
    found = heads(rows, ["tid"], "_at", jump, most)
    places = found.select("tid", F.col("_at").alias("_start"), F.posexplode(F.sequence("_at", F.col("_at") + F.col("jump") - 1)).alias("idx", "_at"))
    parts = rows.join(places, ["tid", "_at"]).withColumn("_sound", counts)
    traces = _frames(parts, ["tid", "_start"], F.min("seq").alias("start_seq"), F.bool_or((F.col("idx") == 0) & F.col("_sound")).alias("_sound"))
    return traces.filter("_sound").drop("_start", "_sound")


def call_arguments(df: DataFrame) -> DataFrame:
    """System calls with their arguments and results on one row.

    The START record has arguments 1-4, the next record 5-8, one more the
    ninth; END has error, two return values and the process.
    """
    debugid = F.col("debugid")
    rows = df.withColumn("eventid", codec.event_id(debugid))
    keys = ["tid", "eventid"]
    start, end = codec.is_start(debugid), codec.is_end_only(debugid)
    calls = episodes(rows, keys, "seq", start, end, "call")
    group = [*keys, "call"]
    heads = first_rows(calls.filter(~end), group, "seq", 3)
    ends = calls.filter(end).withColumn("idx", F.lit(-1))
    both = heads.unionByName(ends)

    def at(idx: int, arg: str) -> Column:
        return F.max(F.when(F.col("idx") == idx, F.col(arg)))

    return both.groupBy(*group).agg(
        *[at(0, a).alias(a) for a in ARGS],
        *[at(1, a).alias(f"arg{i + 5}") for i, a in enumerate(ARGS)],
        at(2, "arg1").alias("arg9"),
        at(-1, "arg1").alias("error"),
        at(-1, "arg2").alias("ret0"),
        at(-1, "arg3").alias("ret1"),
        at(-1, "arg4").alias("end_pid"),
        F.max(F.when(F.col("idx") == -1, F.col("seq"))).alias("end_seq"),
    )
