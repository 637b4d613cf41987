"""Queries on values spread over several records."""

from pyspark.sql import functions as F

from spanloom import fixed_values as fv
from spanloom.functions import codec
from spanloom.operators import assemble
from spanloom.plans.registry import query
from spanloom.plans.tables import EVENTS_SQL, events, table

def lookup_records(spark, sf_dir):
    """Page addresses written as path look-up records, 16 threads at once.

    A record is one row of an exploded range; every fifth page begins with a
    look-up that is started but never finished.
    """
    pages = table(spark, sf_dir, "pages").select("page_id", "url", (F.length("url") + 7).alias("_len"))
    words = F.floor(F.col("_len") / 8)
    pages = pages.withColumn("records", F.when(words <= 3, 1).otherwise(1 + F.ceil((words - 3) / 4)))
    # Room for the longest page's records between two groups of pages.
    room = pages.agg(F.max("records") + 1).scalar()
    rows = pages.withColumn("j", F.explode(F.sequence(F.lit(-1), F.col("records") - 1)))
    rows = rows.filter((F.col("j") >= 0) | (F.col("page_id") % 5 == 0))
    j = F.col("j")
    aborted = j == -1
    first_word = F.when(j == 0, F.lit(0)).otherwise(3 + (j - 1) * 4)
    # The record's words lie one argument further right where arg1 holds the directory.
    word = lambda i: codec.text_word(F.col("url"), first_word + i)
    start = j <= 0
    return rows.select(
        ((F.floor(F.col("page_id") / 16) * room + j + 1) * 16 + F.col("page_id") % 16).alias("seq"),
        (F.col("page_id") % 16).alias("tid"),
        F.col("page_id").alias("ts"),
        (F.lit(fv.VFS_LOOKUP) + F.when(start, 1).otherwise(0) + F.when(~aborted & (j == F.col("records") - 1), 2).otherwise(0))
        .cast("long")
        .alias("debugid"),
        F.when(start, F.when(aborted, -1).otherwise(F.col("page_id"))).otherwise(word(0)).alias("arg1"),
        *[F.when(start, word(i)).otherwise(word(i + 1)).alias(f"arg{i + 2}") for i in range(3)],
    )


@query(
    "path_assembly",
    "SELECT page_id % 16 AS tid, page_id AS dvp, substr(url, 1, 184) AS path, right(substr(url, 1, 184), 51) AS tail FROM pages",
)
def path_assembly(spark, sf_dir):
    found = assemble.paths(lookup_records(spark, sf_dir))
    return found.select("tid", "dvp", "path", codec.tail_text(F.col("path")).alias("tail"))


def text_chunks(spark, sf_dir):
    """documents cut in chunks of 24 bytes, the last one NUL padded.

    One regular expression cuts a text in a single pass, however long it is;
    until then each byte is one character.
    """
    docs = table(spark, sf_dir, "documents")
    flat = F.decode(F.encode("text", "UTF-8"), "ISO-8859-1")
    pieces = F.regexp_extract_all(F.concat(flat, F.lit("\0")), F.lit(r"[\s\S]{1,24}"), F.lit(0))
    rows = docs.select("doc_id", F.posexplode(pieces).alias("j", "piece"))
    # Room for the longest text's chunks between two documents.
    room = docs.agg(F.max(F.octet_length("text")).cast("long") + 1).scalar()
    return rows.select(
        (F.col("doc_id") * room + F.col("j")).alias("seq"),
        (F.col("doc_id") % 8).alias("tid"),
        "doc_id",
        F.encode(F.rpad("piece", 24, "\0"), "ISO-8859-1").alias("chunk"),
    )


@query("chunk_text", "SELECT doc_id, text, strlen(text) // 24 + 1 AS n FROM documents")
def chunk_text(spark, sf_dir):
    whole = assemble.chunk_texts(text_chunks(spark, sf_dir), F.col("doc_id"), F.col("chunk"))
    return whole.select(F.col("tag").alias("doc_id"), "text", "n")


def trace_records(spark, sf_dir):
    """Each event leaves a backtrace of up to 100 frames, 16 threads at once."""
    ev = events(spark, sf_dir).select("seq", (F.col("arg1") % 100 + 1).alias("n"))
    records = F.when(F.col("n") <= 2, 1).otherwise(1 + F.ceil((F.col("n") - 2) / 3))
    rows = ev.withColumn("records", records).withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("records") - 1)))
    j = F.col("j")
    frame = lambda i: F.col("seq") * 128 + i + 1
    rest = lambda i: frame(2 + (j - 1) * 3 + i)
    return rows.select(
        (F.floor(F.col("seq") / 16) * 1024 + j * 16 + F.col("seq") % 16).alias("at"),
        (F.col("seq") % 16).alias("tid"),
        F.when(j == 0, F.col("seq")).otherwise(0).alias("arg1"),
        F.when(j == 0, F.col("n")).otherwise(rest(0)).alias("arg2"),
        F.when(j == 0, frame(0)).otherwise(rest(1)).alias("arg3"),
        F.when(j == 0, frame(1)).otherwise(rest(2)).alias("arg4"),
        (j == 0).alias("opens"),
        (j == F.col("records") - 1).alias("closes"),
    ).withColumnRenamed("at", "seq")


@query(
    "backtraces",
    f"""WITH {EVENTS_SQL} SELECT seq % 16 AS tid, seq AS tag, arg1 % 100 + 1 AS n,
  array_to_string(list_transform(range(arg1 % 100 + 1), lambda i : seq * 128 + i + 1), ',') AS frames FROM ev""",
)
def backtraces(spark, sf_dir):
    traces = assemble.backtraces(trace_records(spark, sf_dir), F.col("opens"), F.col("closes"))
    return traces.select("tid", "tag", "n", F.array_join(F.transform("frames", lambda f: f.cast("string")), ",").alias("frames"))


def user_trace_records(spark, sf_dir):
    """Each event leaves a program's backtrace of up to 32 frames, which may look like counts; 16 threads at once."""
    ev = events(spark, sf_dir).select("seq", (F.col("arg1") % 32 + 1).alias("n"))
    last = F.when(F.col("n") > 2, F.ceil((F.col("n") - 2) / 3)).otherwise(0)
    rows = ev.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    j, n = F.col("j"), F.col("n")
    frame = lambda i: F.when(i < n, (F.col("seq") * 7 + i) % 40 + 1).otherwise(0)
    rest = lambda i: frame(2 + (j - 1) * 3 + i)
    head = j == 0
    return rows.select(
        (F.floor(F.col("seq") / 16) * 1024 + j * 16 + F.col("seq") % 16).alias("at"),
        (F.col("seq") % 16).alias("tid"),
        F.col("seq").alias("arg1"),
        F.when(head, n).otherwise(rest(0)).alias("arg2"),
        F.when(head, frame(F.lit(0))).otherwise(rest(1)).alias("arg3"),
        F.when(head, frame(F.lit(1))).otherwise(rest(2)).alias("arg4"),
    ).withColumnRenamed("at", "seq")


@query(
    "user_backtraces",
    f"""WITH {EVENTS_SQL} SELECT seq % 16 AS tid, seq AS tag, arg1 % 32 + 1 AS n,
  array_to_string(list_transform(range(arg1 % 32 + 1), lambda i : (seq * 7 + i) % 40 + 1), ',') AS frames FROM ev""",
)
def user_backtraces(spark, sf_dir):
    traces = assemble.user_backtraces(user_trace_records(spark, sf_dir))
    return traces.select("tid", "tag", "n", F.array_join(F.transform("frames", lambda f: f.cast("string")), ",").alias("frames"))


@query(
    "syscall_args",
    f"""WITH {EVENTS_SQL}, r AS (SELECT seq, tid, seq % 16 AS pid, arg1, user_id, event_type, CASE event_type WHEN 'click' THEN 1 WHEN 'purchase' THEN 2 ELSE 0 END AS q FROM ev),
 g AS (SELECT *, last_value(CASE WHEN q = 1 THEN seq END IGNORE NULLS) OVER (PARTITION BY tid ORDER BY seq) AS call,
   sum(CASE WHEN q = 2 THEN 1 ELSE 0 END) OVER (PARTITION BY tid ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ends FROM r),
 a AS (SELECT *, first_value(coalesce(ends, 0)) OVER (PARTITION BY tid, call ORDER BY seq) AS ends0 FROM g WHERE call IS NOT NULL),
 n AS (SELECT *, row_number() OVER (PARTITION BY tid, call, q = 2 ORDER BY seq) AS rn FROM a WHERE coalesce(ends, 0) = ends0)
SELECT tid, call, max(arg1) FILTER (q <> 2 AND rn = 1) AS arg1, max(user_id) FILTER (q <> 2 AND rn = 1) AS arg2, max(arg1) FILTER (q <> 2 AND rn = 2) AS arg5,
 max(user_id) FILTER (q <> 2 AND rn = 2) AS arg6, max(arg1) FILTER (q <> 2 AND rn = 3) AS arg9, max(arg1) FILTER (q = 2) AS error, max(user_id) FILTER (q = 2) AS ret0,
 max(pid) FILTER (q = 2) AS end_pid, max(seq) FILTER (q = 2) AS end_seq FROM n GROUP BY tid, call""",
)
def syscall_args(spark, sf_dir):
    kind = F.col("event_type")
    rows = events(spark, sf_dir).select(
        "seq",
        "tid",
        (F.lit(0x040C0000) + F.when(kind == "click", 1).when(kind == "purchase", 2).otherwise(0)).cast("long").alias("debugid"),
        "arg1",
        F.col("user_id").alias("arg2"),
        F.col("user_id").alias("arg3"),
        (F.col("seq") % 16).alias("arg4"),
    )
    calls = assemble.call_arguments(rows)
    return calls.select("tid", "call", "arg1", "arg2", "arg5", "arg6", "arg9", "error", "ret0", "end_pid", "end_seq")
