"""Queries on code dictionaries, event id fields and counts."""

from pyspark.sql import functions as F

from spanloom.fixed_values import CLASS_NAMES
from spanloom.functions import codec
from spanloom.operators import codes
from spanloom.plans.registry import query
from spanloom.plans.tables import EVENTS_SQL, KEVENTS_SQL, events, kevents, table

DICT_SQL = """d AS (SELECT CAST(regexp_extract(p_brand, '[0-9]+', 0) AS BIGINT) * 4 AS debugid, p_name AS name, p_type AS source, p_partkey AS line FROM part)"""


def dictionary(spark, sf_dir):
    """part read as a code dictionary: brand number as id, type as source file."""
    return table(spark, sf_dir, "part").select(
        (F.regexp_extract("p_brand", "[0-9]+", 0).cast("long") * 4).alias("debugid"),
        F.col("p_name").alias("name"),
        F.col("p_type").alias("source"),
        F.col("p_partkey").alias("line"),
    )


@query(
    "code_join",
    f"""WITH {EVENTS_SQL}, {DICT_SQL}, r AS (SELECT debugid, arg_max(name, (source, line)) AS name FROM d GROUP BY debugid)
SELECT seq, arg1 * 4 AS eventid, coalesce(r.name, lower(to_hex(arg1 * 4))) AS name FROM ev LEFT JOIN r ON r.debugid = arg1 * 4""",
)
def code_join(spark, sf_dir):
    coded = events(spark, sf_dir).select("seq", (F.col("arg1") * 4).alias("eventid"))
    return codes.name_codes(coded, dictionary(spark, sf_dir)).select("seq", "eventid", "name")


@query(
    "code_dupes",
    f"""WITH {DICT_SQL}, c AS (SELECT debugid, name, count(*) AS n FROM d GROUP BY 1, 2)
SELECT * FROM (SELECT debugid, name, n, CAST(sum(n) OVER (PARTITION BY debugid) AS BIGINT) AS n_id FROM c) WHERE n_id > 1""",
)
def code_dupes(spark, sf_dir):
    return codes.duplicates(dictionary(spark, sf_dir))


@query("code_sort", f"WITH {DICT_SQL} SELECT debugid, name, source, line FROM d ORDER BY debugid, source, line")
def code_sort(spark, sf_dir):
    both = [dictionary(spark, sf_dir).filter(F.col("line") % 2 == half) for half in (0, 1)]
    return codes.sorted_dictionary(codes.unite(*both))


@query(
    "code_diff",
    """WITH v AS (SELECT p_partkey // 4 AS debugid, p_name AS name, p_type AS source, p_partkey AS line, p_size AS size FROM part),
 o AS (SELECT debugid, arg_max(name, (source, line)) AS old_name FROM v WHERE size > 25 GROUP BY debugid),
 n AS (SELECT debugid, arg_max(name, (source, line)) AS new_name FROM v WHERE size <= 25 GROUP BY debugid)
SELECT coalesce(o.debugid, n.debugid) AS debugid, old_name, new_name,
  CASE WHEN old_name IS NULL THEN 'added' WHEN new_name IS NULL THEN 'removed' ELSE 'renamed' END AS change
FROM o FULL JOIN n ON o.debugid = n.debugid WHERE old_name IS DISTINCT FROM new_name""",
)
def code_diff(spark, sf_dir):
    """Two dictionary versions; every part is in one of them, by its size."""
    rows = table(spark, sf_dir, "part").select(
        F.floor(F.col("p_partkey") / 4).alias("debugid"),
        F.col("p_name").alias("name"),
        F.col("p_type").alias("source"),
        F.col("p_partkey").alias("line"),
        "p_size",
    )
    old, new = rows.filter("p_size > 25"), rows.filter("p_size <= 25")
    return codes.difference(old, new)


CLASS_CASE = " ".join(f"WHEN {n} THEN '{name}'" for n, name in CLASS_NAMES.items())


@query(
    "class_rollup",
    f"""WITH {KEVENTS_SQL}, c AS (SELECT debugid >> 24 AS class, (debugid >> 16) & 255 AS subclass, (debugid >> 2) & 16383 AS code FROM k)
SELECT class, subclass, code, count(*) AS n, CASE class {CLASS_CASE} END AS class_name FROM c GROUP BY ROLLUP (class, subclass, code)""",
)
def class_rollup(spark, sf_dir):
    return codes.class_rollup(kevents(spark, sf_dir))


@query(
    "debugid_codec",
    f"""WITH {KEVENTS_SQL} SELECT seq, debugid >> 24 AS class, (debugid >> 16) & 255 AS subclass, debugid >> 16 AS csc,
  (debugid >> 2) & 16383 AS code, eventid, debugid & 3 AS qualifier, eventid AS encoded, ts * 1000 / 1000.0 AS us,
  lower(to_hex(arg2)) AS arg2_hex, arg1 AS high, arg2 AS low, (debugid >> 24) * 256 + ((debugid >> 16) & 255) AS csc_again, cpu,
  arg1 % 2 = 1 AS mig, arg1 % 3 = 1 AS from_kernel, seq AS msg_id FROM k""",
)
def debugid_codec(spark, sf_dir):
    k = kevents(spark, sf_dir)
    d = F.col("debugid")
    packed = codec.pack_halves(F.col("arg1"), F.col("arg2"))
    stamped = F.shiftleft(F.col("cpu"), 56).bitwiseOR(F.col("ts"))
    flagged = (
        F.shiftleft(F.col("arg1") % 2, 60)
        .bitwiseOR(F.shiftleft((F.col("arg1") % 3 == 1).cast("long"), 58))
        .bitwiseOR(F.col("seq"))
    )
    high, low = codec.split_class_subclass(codec.class_subclass(d))
    return k.select(
        "seq",
        codec.event_class(d).alias("class"),
        codec.event_subclass(d).alias("subclass"),
        codec.class_subclass(d).alias("csc"),
        codec.event_code(d).alias("code"),
        "eventid",
        codec.qualifier(d).alias("qualifier"),
        codec.encode_event_id(codec.event_class(d), codec.event_subclass(d), codec.event_code(d)).alias("encoded"),
        codec.ticks_to_us(codec.clock_without_cpu(stamped) * 1000, codec.clock_divisor()).alias("us"),
        codec.hex_text(F.col("arg2")).alias("arg2_hex"),
        codec.high_half(packed).alias("high"),
        codec.low_half(packed).alias("low"),
        codec.join_class_subclass(high, low).alias("csc_again"),
        codec.cpu_from_clock(stamped).alias("cpu"),
        codec.is_mig(flagged).alias("mig"),
        codec.from_kernel(flagged).alias("from_kernel"),
        codec.plain_msg_id(flagged).alias("msg_id"),
    )


HOUR_US = 3_600_000_000


@query(
    "lost_events",
    f"""WITH {EVENTS_SQL} SELECT ts // {HOUR_US} * {HOUR_US} AS window_start, count(*) AS markers FROM ev
WHERE event_type = 'error' GROUP BY 1""",
)
def lost_events(spark, sf_dir):
    return codes.lost_events(events(spark, sf_dir), HOUR_US, F.col("event_type") == "error")


@query(
    "window_counts",
    f"WITH {KEVENTS_SQL} SELECT ts // {HOUR_US} * {HOUR_US} AS window_start, debugid >> 24 AS class, count(*) AS n FROM k GROUP BY 1, 2",
)
def window_counts(spark, sf_dir):
    return codes.window_counts(kevents(spark, sf_dir), HOUR_US, codec.event_class(F.col("debugid")).alias("class"))


@query(
    "symbol_extract",
    "SELECT page_id, CASE page_id % 3 WHEN 2 THEN 'UNKNOWN_SYM' ELSE split_part(url, '+', 1) END AS symbol FROM pages",
)
def symbol_extract(spark, sf_dir):
    head = F.concat(F.lit("* thread #1: tid = 0x6b39b, 0x00000001040ddd56 lib`"), "url")
    line = (
        F.when(F.col("page_id") % 3 == 0, F.concat(head, F.lit(" + 640, queue = 'main'")))
        .when(F.col("page_id") % 3 == 1, F.concat(head, F.lit(", queue = 'main'")))
        .otherwise(F.col("url"))
    )
    return table(spark, sf_dir, "pages").select("page_id", codec.symbol_of(line).alias("symbol"))


@query("hex_extract", "SELECT event_id AS seq, CASE WHEN event_id % 5 = 0 THEN NULL ELSE user_id * 4096 + event_id END AS address FROM events")
def hex_extract(spark, sf_dir):
    address = codec.hex_text(F.col("user_id") * 4096 + F.col("seq"))
    line = F.when(F.col("seq") % 5 == 0, F.col("props")).otherwise(F.concat("props", F.lit(" 0x12 = 0x"), address))
    return events(spark, sf_dir).select("seq", codec.trailing_hex(line).alias("address"))
