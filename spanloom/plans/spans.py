"""Queries on spans, filters and file order."""

from pyspark.sql import functions as F

from spanloom.functions import codec
from spanloom.operators import codes, filters, order, spans
from spanloom.operators.sequence import sequence
from spanloom.plans.registry import query
from spanloom.plans.tables import EVENTS_SQL, KEVENTS_SQL, events, kevents, per_type, table
from spanloom.session import fresh_path, settle
from spanloom.sources import store

SPANS_SQL = (
    KEVENTS_SQL
    + """, se AS (
  SELECT *, CASE WHEN debugid & 1 <> 0 THEN 1 ELSE 2 END AS side FROM k
  WHERE (debugid & 1 <> 0 AND eventid NOT IN (67896740, 67895300)) OR debugid & 3 = 2),
 pr AS (SELECT *, lag(side) OVER w AS ps, lag(ts) OVER w AS pts FROM se WINDOW w AS (PARTITION BY tid, eventid ORDER BY seq)),
 sp AS (SELECT *, CASE WHEN ps = 1 THEN ts - pts ELSE 0 END AS elapsed FROM pr WHERE side = 2)"""
)

STATS_SQL = """, rk AS (SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY elapsed) AS rn, count(*) OVER (PARTITION BY {k}) AS cnt FROM sp)
SELECT {k}, count(*) AS n, CAST(sum(elapsed) AS BIGINT) AS total_us, max(elapsed) AS max_us,
  min(CASE WHEN rn * 1000 >= cnt * 500 THEN elapsed END) AS p50_us, min(CASE WHEN rn * 1000 >= cnt * 950 THEN elapsed END) AS p95_us
FROM rk GROUP BY {k}"""


@query("span_latency", f"WITH {SPANS_SQL} SELECT seq, tid, eventid, elapsed FROM sp")
def span_latency(spark, sf_dir):
    return spans.code_spans(kevents(spark, sf_dir)).select("seq", "tid", "eventid", "elapsed")


@query("span_stats", f"WITH {SPANS_SQL}" + STATS_SQL.format(k="eventid"))
def span_stats(spark, sf_dir):
    return spans.span_stats(spans.code_spans(kevents(spark, sf_dir)), ["eventid"])


@query("thread_span_stats", f"WITH {SPANS_SQL}" + STATS_SQL.format(k="tid, eventid"))
def thread_span_stats(spark, sf_dir):
    return spans.span_stats(spans.code_spans(kevents(spark, sf_dir)), ["tid", "eventid"])


@query(
    "top_spans",
    f"WITH {SPANS_SQL} SELECT tid, eventid, count(*) AS n, CAST(sum(elapsed) AS BIGINT) AS total_us FROM sp GROUP BY tid, eventid ORDER BY total_us DESC, tid, eventid LIMIT 10",
)
def top_spans(spark, sf_dir):
    """The ten operations that took longest in sum, by thread."""
    sums = spans.code_spans(kevents(spark, sf_dir)).groupBy("tid", "eventid").agg(
        F.count(F.lit(1)).alias("n"), F.sum("elapsed").alias("total_us")
    )
    return codes.top_spans(sums, ["tid", "eventid"])


@query(
    "runqueue_latency",
    f"""WITH {EVENTS_SQL}, s AS (SELECT seq, ts, tid, event_type AS side FROM ev WHERE event_type IN ('view', 'click')),
 p AS (SELECT *, lag(side) OVER w AS ps, lag(ts) OVER w AS pts FROM s WINDOW w AS (PARTITION BY tid ORDER BY seq))
SELECT seq, tid AS ran_tid, ts - pts AS elapsed FROM p WHERE side = 'click' AND ps = 'view' AND ts <> pts""",
)
def runqueue_latency(spark, sf_dir):
    ev = events(spark, sf_dir)
    rows = ev.withColumn("debugid", per_type(view=0x01400018, click=0x01400000).cast("long"))
    rows = rows.withColumns({"arg1": F.col("tid"), "arg2": F.col("tid")})
    return spans.run_queue_spans(rows).select("seq", "ran_tid", "elapsed")


@query(
    "named_pairs",
    f"""WITH {EVENTS_SQL}, d AS (SELECT p_partkey, p_type || '_' || CAST(p_partkey // 2 AS VARCHAR) AS stem, p_partkey % 2 AS side FROM part),
 j AS (SELECT ev.seq, ev.tid, ev.ts, stem, side FROM ev JOIN d ON ev.arg1 = d.p_partkey),
 p AS (SELECT *, lag(side) OVER w AS ps, lag(ts) OVER w AS pts FROM j WINDOW w AS (PARTITION BY tid, stem ORDER BY seq))
SELECT seq, tid, stem, CASE WHEN ps = 0 THEN ts - pts ELSE 0 END AS elapsed FROM p WHERE side = 1""",
)
def named_pairs(spark, sf_dir):
    ending = F.when(F.col("p_partkey") % 2 == 0, "_begin").otherwise("_end")
    names = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("arg1"),
        F.concat("p_type", F.lit("_"), F.floor(F.col("p_partkey") / 2).cast("string"), ending).alias("name"),
    )
    named = events(spark, sf_dir).join(names, "arg1")
    return spans.named_pairs(named).select("seq", "tid", "stem", "elapsed")


def _side_sql(key, opens, closes):
    return f"""WITH {EVENTS_SQL}, s AS (SELECT *, CASE WHEN {opens} THEN 1 ELSE 2 END AS side, {key} AS sub FROM ev WHERE ({opens}) OR ({closes})),
 p AS (SELECT *, lag(side) OVER w AS ps, lag(ts) OVER w AS pts FROM s WINDOW w AS (PARTITION BY tid, sub ORDER BY seq))"""


@query(
    "callout_spans",
    _side_sql("arg1 % 8", "event_type = 'view' AND seq % 2 = 0", "event_type = 'view' AND seq % 2 = 1")
    + " SELECT seq, tid, sub AS func, CASE WHEN ps = 1 THEN ts - pts ELSE 0 END AS elapsed FROM p WHERE side = 2",
)
def callout_spans(spark, sf_dir):
    """Call-outs carry begin/end in arg3, because the end id has the START bit set."""
    rows = events(spark, sf_dir).filter(F.col("event_type") == "view")
    rows = rows.withColumns({"func": F.col("arg1") % 8, "arg3": F.col("seq") % 2})
    paired = spans.pair(rows, ["tid", "func"], opens=F.col("arg3") == 0, closes=F.col("arg3") == 1)
    return paired.select("seq", "tid", "func", "elapsed")


@query(
    "idle_wait",
    _side_sql("0", "event_type = 'signup' AND arg1 % 2 = 0", "event_type = 'signup' AND arg1 % 2 = 1")
    + " SELECT seq, tid, pts AS start_ts, ts - pts AS elapsed FROM p WHERE side = 2 AND ps = 1",
)
def idle_wait(spark, sf_dir):
    """Waits for the next event: arg1 is 0 where the wait begins and 1 where it ends."""
    rows = events(spark, sf_dir).filter(F.col("event_type") == "signup").withColumn("arg1", F.col("arg1") % 2)
    paired = spans.pair(rows, ["tid"], opens=F.col("arg1") == 0, closes=F.col("arg1") == 1)
    return paired.filter(F.col("start_ts").isNotNull()).select("seq", "tid", "start_ts", "elapsed")


@query(
    "interrupts",
    _side_sql("cpu", "event_type = 'error' AND seq % 3 = 1", "event_type = 'error' AND seq % 3 = 2")
    + """ SELECT seq, cpu, tid, CASE WHEN ps = 1 THEN ts - pts ELSE 0 END AS elapsed, user_id AS priority, seq % 16 AS vector
 FROM p WHERE side = 2""",
)
def interrupts(spark, sf_dir):
    rows = events(spark, sf_dir).filter(F.col("event_type") == "error")
    rows = rows.withColumn("arg1", codec.pack_halves(F.col("user_id"), F.col("seq") % 16))
    paired = spans.pair(rows, ["cpu", "tid"], opens=F.col("seq") % 3 == 1, closes=F.col("seq") % 3 == 2)
    return paired.select(
        "seq", "cpu", "tid", "elapsed", codec.high_half(F.col("arg1")).alias("priority"), codec.low_half(F.col("arg1")).alias("vector")
    )


@query(
    "delta_time",
    f"""WITH {KEVENTS_SQL}, d AS (SELECT *, lag(ts) OVER (ORDER BY seq) AS pts FROM k)
SELECT seq, ts, CASE WHEN coalesce(pts, 0) = 0 THEN ts ELSE ts - pts END AS delta FROM d
WHERE debugid >> 24 <> 7 OR (debugid >> 16) & 255 = 2""",
)
def delta_time(spark, sf_dir):
    return order.delta_times(kevents(spark, sf_dir)).select("seq", "ts", "delta")


@query(
    "wrap_segments",
    """WITH r AS (SELECT event_id AS seq, (event_id + 1234) % 5000 AS ts FROM events),
 d AS (SELECT *, CASE WHEN ts < lag(ts) OVER (ORDER BY seq) THEN 1 ELSE 0 END AS w FROM r),
 s AS (SELECT seq, ts, CAST(sum(w) OVER (ORDER BY seq) AS BIGINT) AS segment FROM d)
SELECT seq, ts, segment, (SELECT max(segment) FROM s) - segment AS chrono FROM s""",
)
def wrap_segments(spark, sf_dir):
    rows = events(spark, sf_dir).select("seq", ((F.col("seq") + 1234) % 5000).alias("ts"))
    cut = order.ring_segments(rows)
    return cut.withColumn("chrono", cut.agg(F.max("segment")).scalar() - F.col("segment"))


def rotated(spark, sf_dir, rows):
    """A ring file: two fifths of the records, the newest, lie before the others."""
    count = events(spark, sf_dir).agg(F.max("seq") + 1).scalar()
    return rows.withColumn("seq", F.pmod(F.col("seq") + F.floor(count * 2 / 5), count))


@query("ring_spans", f"WITH {SPANS_SQL} SELECT seq, tid, eventid, elapsed FROM sp")
def ring_spans(spark, sf_dir):
    """Spans across the wrap of a ring file."""
    rows = kevents(spark, sf_dir).select("seq", "ts", "tid", "debugid")
    return spans.code_spans(order.true_order(rotated(spark, sf_dir, rows))).select("seq", "tid", "eventid", "elapsed")


DAY_US = 86_400_000_000


@query("span_sketch", f"WITH {SPANS_SQL} SELECT eventid, count(*) AS n, CAST(sum(elapsed) AS BIGINT) AS total_us, max(elapsed) AS max_us, TRUE AS p50_near, TRUE AS p95_near FROM sp GROUP BY eventid")
def span_sketch(spark, sf_dir):
    """States per code and day merged to codes; their percentiles lie within the stated error of the exact ranks."""
    found = settle(spans.code_spans(kevents(spark, sf_dir)).select("eventid", "ts", "elapsed"))
    daily = settle(spans.span_sketches(found, ["eventid"], DAY_US))
    read = spans.sketch_percentiles(spans.merge_sketches(daily, ["eventid"]), {"p50_us": 500, "p95_us": 950})
    ranked = found.join(read.select("eventid", "p50_us", "p95_us"), "eventid").groupBy("eventid").agg(
        *[
            (
                (F.count_if(F.col("elapsed") < F.col(name)) <= F.count(F.lit(1)) * (share + spans.SKETCH_ERROR))
                & (F.count_if(F.col("elapsed") <= F.col(name)) >= F.count(F.lit(1)) * (share - spans.SKETCH_ERROR))
            ).alias(f"{name[:3]}_near")
            for name, share in (("p50_us", 0.5), ("p95_us", 0.95))
        ]
    )
    return read.join(ranked, "eventid").select("eventid", "n", "total_us", "max_us", "p50_near", "p95_near")


@query(
    "store_filter",
    f"""WITH {KEVENTS_SQL} SELECT seq, debugid FROM k
WHERE debugid >> 24 = 4 OR debugid >> 16 = 320 OR debugid >> 24 BETWEEN 30 AND 40""",
)
def store_filter(spark, sf_dir):
    path = fresh_path(spark, "store")
    store.write_store(kevents(spark, sf_dir).select("seq", "ts", "tid", "debugid"), path)
    types = filters.type_ranges(classes=[4], subclasses=[(1, 0x40)], ranges=[(30, 40)])
    return store.read_store(spark, path, types).select("seq", "debugid")


@query(
    "type_filter",
    f"""WITH {KEVENTS_SQL} SELECT seq, debugid FROM k
WHERE debugid >> 24 = 4 OR debugid >> 16 = 320 OR debugid >> 24 BETWEEN 30 AND 40""",
)
def type_filter(spark, sf_dir):
    kept = filters.type_filter(kevents(spark, sf_dir), classes=[4], subclasses=[(1, 0x40)], ranges=[(30, 40)])
    return kept.select("seq", "debugid")


@query("code_filter", f"WITH {KEVENTS_SQL} SELECT seq, debugid FROM k WHERE eventid IN (18874380, 554303496)")
def code_filter(spark, sf_dir):
    return filters.code_filter(kevents(spark, sf_dir), [0x0120000C, 0x210A0008]).select("seq", "debugid")


@query("pid_filter", f"WITH {KEVENTS_SQL} SELECT seq, pid FROM k WHERE pid IN (1, 5, 9)")
def pid_filter(spark, sf_dir):
    return filters.process_filter(kevents(spark, sf_dir), include=[1, 5, 9]).select("seq", "pid")


@query("pid_exclude", f"WITH {KEVENTS_SQL} SELECT seq, pid FROM k WHERE pid NOT IN (0, 2, 4)")
def pid_exclude(spark, sf_dir):
    return filters.process_filter(kevents(spark, sf_dir), exclude=[0, 2, 4]).select("seq", "pid")


@query(
    "self_filter",
    """SELECT page_id, url FROM pages WHERE url NOT LIKE '%/en/%' AND url NOT LIKE '%page=2%'""",
)
def self_filter(spark, sf_dir):
    return filters.without_paths(table(spark, sf_dir, "pages").select("page_id", "url"), "url", ["/en/", "page=2"])


@query("tracer_calls", f"WITH {KEVENTS_SQL} SELECT seq, eventid FROM k WHERE eventid NOT IN (67895296)")
def tracer_calls(spark, sf_dir):
    return filters.without_calls(kevents(spark, sf_dir), [0x040C0000]).select("seq", "eventid")


@query(
    "time_bound",
    f"WITH {EVENTS_SQL} SELECT seq, ts FROM ev WHERE ts < (SELECT min(ts) FROM ev) + 864000000000",
)
def time_bound(spark, sf_dir):
    return filters.within_seconds(events(spark, sf_dir), 864000).select("seq", "ts")


@query(
    "message_gaps",
    f"""WITH {EVENTS_SQL}, g AS (SELECT seq, user_id, event_type, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY seq) AS gap, value * 100 AS delay,
  CASE event_type WHEN 'click' THEN 'mach_msg_send' WHEN 'view' THEN 'mach_msg_recv' WHEN 'purchase' THEN 'voucher_create'
    WHEN 'signup' THEN 'mach_msg_kernel_request' ELSE 'other' END AS op FROM ev)
SELECT seq, user_id, gap, CASE WHEN gap < 100 THEN '||' || gap || '||' ELSE '... ' || gap || 'micro seconds later ...' END AS label,
  CASE WHEN op IN ('mach_msg_send', 'mach_msg_kernel_request') AND delay > 10000 THEN '-[#0000FF]>'
    WHEN op IN ('mach_msg_send', 'mach_msg_kernel_request', 'voucher_create') THEN '-[#red]>' END AS arrow FROM g""",
)
def message_gaps(spark, sf_dir):
    op = per_type(
        click="mach_msg_send", view="mach_msg_recv", purchase="voucher_create", signup="mach_msg_kernel_request"
    )
    rows = order.message_gaps(events(spark, sf_dir).withColumn("op", F.coalesce(op, F.lit("other"))), ["user_id"])
    return rows.select(
        "seq",
        "user_id",
        "gap",
        codec.gap_label(F.col("gap")).alias("label"),
        codec.message_arrow(F.col("op"), F.col("value") * 100).alias("arrow"),
    )


LINE_ORDER = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
YEAR_US = 365 * 86_400_000_000


@query(
    "parts",
    f"""WITH r AS (SELECT epoch_us(l_shipdate) // {YEAR_US} AS cluster, l_orderkey,
  row_number() OVER (ORDER BY {", ".join(LINE_ORDER)}) AS rn FROM lineitem),
 p AS (SELECT cluster, l_orderkey, CASE WHEN rn // 40000 > (min(rn) OVER (PARTITION BY cluster) - 1) // 40000 THEN rn // 40000 ELSE 0 END AS part FROM r)
SELECT cluster, part, count(*) AS n, CAST(sum(l_orderkey) AS BIGINT) AS keys FROM p GROUP BY ALL""",
)
def parts(spark, sf_dir):
    rows = sequence(table(spark, sf_dir, "lineitem").select(*LINE_ORDER), *LINE_ORDER)
    clustered = rows.select("seq", "l_orderkey", F.floor(F.col("l_shipdate") / YEAR_US).alias("cluster"))
    cut = order.part_numbers(clustered, section="cluster")
    return cut.groupBy("cluster", "part").agg(F.count(F.lit(1)).alias("n"), F.sum("l_orderkey").alias("keys"))


@query(
    "pages_report",
    f"""WITH r AS (SELECT epoch_us(l_shipdate) AS ts, row_number() OVER (ORDER BY {", ".join(LINE_ORDER)}) AS rn FROM lineitem),
 g AS (SELECT (rn - 1) // 64 AS page, arg_min(ts, rn) AS page_ts, count(*) AS lines FROM r GROUP BY 1)
SELECT page, page_ts, lines, page_ts - lag(page_ts) OVER (ORDER BY page) AS since_last FROM g""",
)
def pages_report(spark, sf_dir):
    rows = sequence(table(spark, sf_dir, "lineitem").select(*LINE_ORDER), *LINE_ORDER)
    return order.page_times(rows.withColumnRenamed("l_shipdate", "ts"))


@query(
    "bracket",
    f"""WITH {EVENTS_SQL}, m AS (SELECT *, last_value(CASE event_type WHEN 'signup' THEN 1 WHEN 'error' THEN 0 END IGNORE NULLS)
  OVER (PARTITION BY tid ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS inside FROM ev)
SELECT seq, tid, event_type FROM m WHERE inside = 1""",
)
def bracket(spark, sf_dir):
    kind = F.col("event_type")
    kept = filters.brackets(events(spark, sf_dir), ["tid"], begin=kind == "signup", end=kind == "error")
    return kept.select("seq", "tid", "event_type")


@query(
    "until_end",
    f"""WITH {EVENTS_SQL}, f AS (SELECT tid, min(seq) AS stop FROM ev WHERE event_type = 'error' AND arg1 > 90 GROUP BY tid)
SELECT seq, ev.tid AS tid FROM ev LEFT JOIN f ON ev.tid = f.tid WHERE stop IS NULL OR seq <= stop""",
)
def until_end(spark, sf_dir):
    ended = (F.col("event_type") == "error") & (F.col("arg1") > 90)
    return filters.until_first(events(spark, sf_dir), ["tid"], ended).select("seq", "tid")
