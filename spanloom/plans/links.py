"""Queries on links between records."""

from pyspark.sql import functions as F

from spanloom.functions import codec
from spanloom.operators import links
from spanloom.plans.registry import query
from spanloom.plans.tables import EVENTS_SQL, events, per_type, table

MSG_SQL = """u AS (
  SELECT o_orderkey AS kmsg, epoch_us(o_orderdate) AS ts, 0 AS way, o_custkey AS sender, NULL AS receiver, NULL AS n FROM orders
  UNION ALL SELECT l_orderkey, epoch_us(l_shipdate), 1, NULL, min(l_suppkey), count(*) FROM lineitem GROUP BY 1, 2),
 p AS (SELECT *, lag(way) OVER w AS pw, lag(ts) OVER w AS pts, lag(sender) OVER w AS psender FROM u WINDOW w AS (PARTITION BY kmsg ORDER BY ts, way)),
 msg AS (SELECT kmsg, ts, receiver, n, CASE WHEN pw = 0 THEN psender END AS source_sender, CASE WHEN pw = 0 THEN ts - pts ELSE 0 END AS elapsed,
   kmsg % 2 = 1 AS mig, kmsg % 3 = 0 AS from_kernel FROM p WHERE way = 1)"""


def messages(spark, sf_dir):
    """orders send a message, lineitem receives it; the key is the message pointer."""
    order_key = F.col("o_orderkey")
    flags = F.shiftleft(order_key % 2, 60).bitwiseOR(F.shiftleft((order_key % 3 == 0).cast("long"), 58)).bitwiseOR(order_key)
    sends = table(spark, sf_dir, "orders").select(
        order_key.alias("kmsg"), F.col("o_orderdate").alias("ts"), F.col("o_custkey").alias("sender"), flags.alias("msg_id")
    )
    # Receives at one time under one key are counted before anything is shuffled in whole.
    receives = (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_orderkey").alias("kmsg"), F.col("l_shipdate").alias("ts"))
        .agg(F.min("l_suppkey").alias("receiver"), F.count(F.lit(1)).alias("n"))
    )
    return links.link_next(sends, receives, ["kmsg"], ["sender", "msg_id"])


@query("msg_latency", f"WITH {MSG_SQL} SELECT kmsg, ts, receiver, n, source_sender AS sender, elapsed, CASE WHEN source_sender IS NOT NULL THEN mig END AS mig, CASE WHEN source_sender IS NOT NULL THEN from_kernel END AS from_kernel, CASE WHEN source_sender IS NOT NULL THEN kmsg END AS plain_id FROM msg")
def msg_latency(spark, sf_dir):
    msg_id = F.col("source_msg_id")
    return messages(spark, sf_dir).select(
        "kmsg",
        "ts",
        "receiver",
        "n",
        F.col("source_sender").alias("sender"),
        "elapsed",
        codec.is_mig(msg_id).alias("mig"),
        codec.from_kernel(msg_id).alias("from_kernel"),
        codec.plain_msg_id(msg_id).alias("plain_id"),
    )


@query(
    "msg_edges",
    f"""WITH {MSG_SQL} SELECT source_sender AS sender, receiver, CASE WHEN mig THEN 'mig' ELSE 'send' END AS action, count(*) AS n,
  CAST(sum(elapsed) AS BIGINT) AS total_us, max(elapsed) AS max_us FROM msg WHERE source_sender IS NOT NULL GROUP BY ALL""",
)
def msg_edges(spark, sf_dir):
    linked = messages(spark, sf_dir).filter(F.col("source_sender").isNotNull()).withColumnRenamed("source_sender", "sender")
    linked = linked.withColumn("action", F.when(codec.is_mig(F.col("source_msg_id")), "mig").otherwise("send"))
    return links.edge_summary(linked, "sender", "receiver", "action", "elapsed")


@query(
    "queue_wait",
    """WITH u AS (SELECT l_partkey AS queue, l_suppkey AS item, epoch_us(l_shipdate) AS ts, 1 - l_linenumber % 2 AS way, count(*) AS n FROM lineitem GROUP BY ALL),
 p AS (SELECT *, lag(way) OVER w AS pw, lag(ts) OVER w AS pts FROM u WINDOW w AS (PARTITION BY queue, item ORDER BY ts, way))
SELECT queue, item, ts, n, pts AS enqueued, ts - pts AS waited FROM p WHERE way = 1 AND pw = 0""",
)
def queue_wait(spark, sf_dir):
    rows = (
        table(spark, sf_dir, "lineitem")
        .groupBy(
            F.col("l_partkey").alias("queue"),
            F.col("l_suppkey").alias("item"),
            F.col("l_shipdate").alias("ts"),
            (1 - F.col("l_linenumber") % 2).alias("way"),
        )
        .agg(F.count(F.lit(1)).alias("n"))
    )
    puts, takes = rows.filter("way = 0").drop("way"), rows.filter("way = 1").drop("way")
    linked = links.link_next(puts, takes, ["queue", "item"], ["ts"])
    return linked.filter(F.col("source_ts").isNotNull()).select(
        "queue", "item", "ts", "n", F.col("source_ts").alias("enqueued"), F.col("elapsed").alias("waited")
    )


@query(
    "record_stitch",
    f"""WITH {EVENTS_SQL}, r AS (SELECT seq, tid, event_type, seq % 2 AS part, arg1 % 3 AS variant, user_id AS arg2, ts AS arg3, arg1 AS arg4 FROM ev),
 p AS (SELECT *, lag(seq) OVER w AS a_seq, lag(part) OVER w AS pp, lag(variant) OVER w AS pv, lag(variant) OVER w AS a_arg1, lag(arg2) OVER w AS a_arg2, lag(arg3) OVER w AS a_arg3, lag(arg4) OVER w AS a_arg4 FROM r WINDOW w AS (PARTITION BY tid, event_type ORDER BY seq))
SELECT seq, tid, a_seq, variant, a_arg1, a_arg2, a_arg3, a_arg4, arg2, arg3, arg4 FROM p WHERE part = 1 AND pp = 0 AND pv = variant""",
)
def record_stitch(spark, sf_dir):
    rows = events(spark, sf_dir).select(
        "seq",
        "tid",
        F.col("event_type").alias("eventid"),
        codec.pack_halves(F.col("seq") % 2, F.col("arg1") % 3).alias("arg1"),
        F.col("user_id").alias("arg2"),
        F.col("ts").alias("arg3"),
        F.col("arg1").alias("arg4"),
    )
    return links.stitch_parts(rows).select("seq", "tid", "a_seq", "variant", "a_arg1", "a_arg2", "a_arg3", "a_arg4", "arg2", "arg3", "arg4")


@query(
    "delayed_calls",
    f"""WITH {EVENTS_SQL}, r AS (SELECT seq, ts, tid, arg1 % 4 AS param0, CASE event_type WHEN 'click' THEN 'create' WHEN 'error' THEN 'cancel' WHEN 'view' THEN 'start' WHEN 'signup' THEN 'end' END AS step FROM ev WHERE event_type <> 'purchase'),
 p AS (SELECT *, lag(step) OVER w AS ps, lag(seq) OVER w AS from_seq, lag(ts) OVER w AS pts FROM r WINDOW w AS (PARTITION BY tid, param0 ORDER BY seq)),
 o AS (SELECT seq, tid AS func, param0, from_seq, ts - pts AS waited, CASE WHEN step = 'cancel' AND ps = 'create' THEN 'cancelled' WHEN step = 'start' AND ps = 'create' THEN 'called'
   WHEN step = 'end' AND ps = 'start' THEN 'finished' END AS outcome FROM p)
SELECT * FROM o WHERE outcome IS NOT NULL""",
)
def delayed_calls(spark, sf_dir):
    rows = events(spark, sf_dir).select("seq", "ts", F.col("tid").alias("func"), (F.col("arg1") % 4).alias("param0"), "event_type")
    step = per_type(click="create", error="cancel", view="start", signup="end")
    return links.delayed_calls(rows, ["func", "param0"], step).select("seq", "func", "param0", "from_seq", "waited", "outcome")


@query(
    "wait_wakeup",
    f"""WITH {EVENTS_SQL}, r AS (SELECT seq, ts, tid, event_type, CASE WHEN event_type = 'click' THEN tid ELSE arg1 % 64 END AS woken, user_id % 4 + 1 AS kind FROM ev WHERE event_type IN ('click', 'view')),
 p AS (SELECT *, lag(event_type) OVER w AS pe, lag(ts) OVER w AS pts FROM r WINDOW w AS (PARTITION BY woken ORDER BY seq))
SELECT seq, woken, tid AS waker, ts - pts AS waited, CASE kind WHEN 1 THEN 'WAKEUP_ALL' WHEN 2 THEN 'WAKEUP_ONE' WHEN 3 THEN 'WAKEUP_THR' ELSE 'CLEAR_WAIT' END AS kind
FROM p WHERE event_type = 'view' AND pe = 'click'""",
)
def wait_wakeup(spark, sf_dir):
    kind = F.col("event_type")
    woken = links.wait_wakeups(events(spark, sf_dir), kind == "click", kind == "view", F.col("arg1") % 64, F.col("user_id") % 4 + 1)
    return woken.select("seq", "woken", "waker", F.col("elapsed").alias("waited"), "kind")


@query(
    "voucher_holders",
    f"""WITH {EVENTS_SQL}, h AS (SELECT *, last_value(CASE WHEN event_type = 'purchase' THEN pid END IGNORE NULLS) OVER w AS holder_pid,
   last_value(CASE WHEN event_type = 'purchase' THEN arg1 END IGNORE NULLS) OVER w AS holder_arg1 FROM ev WHERE event_type IN ('purchase', 'click') WINDOW w AS (PARTITION BY user_id ORDER BY seq))
SELECT seq, user_id AS kmsg, holder_pid, holder_arg1 FROM h WHERE event_type = 'click'""",
)
def voucher_holders(spark, sf_dir):
    rows = events(spark, sf_dir).filter(F.col("event_type").isin("purchase", "click")).withColumnRenamed("user_id", "kmsg")
    held = links.attribute(rows, F.col("event_type") == "purchase", ["kmsg"], ["pid", "arg1"])
    return held.select("seq", "kmsg", "holder_pid", "holder_arg1")


@query(
    "event_to_redraw",
    f"""WITH {EVENTS_SQL}, f AS (SELECT *, first_value(CASE WHEN event_type = 'view' THEN seq END IGNORE NULLS) OVER w AS effect_seq,
  first_value(CASE WHEN event_type = 'view' THEN ts END IGNORE NULLS) OVER w AS effect_ts FROM ev
  WINDOW w AS (PARTITION BY tid ORDER BY seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT seq, tid, effect_seq, effect_ts - ts AS delay FROM f WHERE event_type = 'click' AND effect_seq IS NOT NULL""",
)
def event_to_redraw(spark, sf_dir):
    kind = F.col("event_type")
    return links.next_after(events(spark, sf_dir), ["tid"], kind == "click", kind == "view").select("seq", "tid", "effect_seq", "delay")


@query(
    "observer_life",
    f"""WITH {EVENTS_SQL}, g AS (SELECT *, last_value(CASE WHEN event_type = 'signup' THEN seq END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY seq) AS life FROM ev),
 a AS (SELECT user_id AS observer, life, count(*) FILTER (event_type = 'click') AS calls, min(ts) FILTER (event_type = 'purchase') AS added,
  max(ts) FILTER (event_type = 'error') AS removed FROM g WHERE life IS NOT NULL GROUP BY 1, 2)
SELECT *, CASE WHEN removed >= added THEN removed - added END AS live_us FROM a""",
)
def observer_life(spark, sf_dir):
    rows = events(spark, sf_dir).withColumnRenamed("user_id", "observer")
    # views are no observer records but keep the life open
    step = per_type(signup="create", click="call", purchase="add", error="remove", view="other")
    return links.observer_lives(rows, "observer", step)


@query(
    "watch_changes",
    f"""WITH {EVENTS_SQL}, t AS (SELECT seq, tid, tid % 8 AS place, arg1, user_id, CAST(floor(value) AS BIGINT) AS v, row_number() OVER (PARTITION BY tid ORDER BY seq) AS rn FROM ev WHERE event_type = 'view'),
 p AS (SELECT *, seq % 2 AS part, lag(seq % 2) OVER w AS pp, lag(seq) OVER w AS ps, lag(arg1) OVER w AS parg, lag(v) OVER w AS pv, lag(user_id) OVER w AS pu FROM t WINDOW w AS (PARTITION BY tid ORDER BY seq)),
 w AS (SELECT * FROM p WHERE part = 1 AND pp = 0),
 s AS (SELECT ps AS seq, tid, 0 AS slot, parg % 5 AS address, pv % 3 AS watched FROM w
  UNION ALL SELECT ps, tid, 1, arg1 % 5, parg % 4 FROM w UNION ALL SELECT ps, tid, 2, arg1 % 7, pu % 4 FROM w UNION ALL SELECT ps, tid, 3, 9, pv % 2 FROM w),
 c AS (SELECT *, lag(watched) OVER (PARTITION BY address ORDER BY seq, slot) AS old FROM s WHERE address <> 0)
SELECT seq, tid, CAST(slot AS BIGINT) AS slot, address, watched, old FROM c WHERE old <> watched""",
)
def watch_changes(spark, sf_dir):
    first = F.col("seq") % 2 == 0
    v = F.floor("value")
    rows = (
        events(spark, sf_dir)
        .filter(F.col("event_type") == "view")
        .select(
            "seq",
            "tid",
            (F.col("seq") % 2).alias("part"),
            (F.col("tid") % 8).alias("arg1"),
            F.when(first, codec.pack_halves(v % 3, F.col("arg1") % 4)).otherwise(F.col("arg1") % 5).alias("arg2"),
            F.when(first, codec.pack_halves(F.col("user_id") % 4, v % 2)).otherwise(F.col("arg1") % 7).alias("arg3"),
            F.when(first, F.col("arg1") % 5).otherwise(F.lit(9)).cast("long").alias("arg4"),
        )
    )
    changed = links.value_changes(links.watch_values(rows))
    return changed.select("seq", "tid", "slot", "address", "watched", "old")


@query(
    "symbol_address",
    """WITH i AS (SELECT 'Brand#' || CAST(1 + s_suppkey % 20 AS VARCHAR) AS image, 4294967296 + max(s_suppkey) * 4096 AS base, 4293918720 + max(s_suppkey) * 4096 AS slide FROM supplier GROUP BY 1),
 s AS (SELECT p_brand AS image, p_name AS symbol, min(p_partkey * 16) AS off FROM part GROUP BY 1, 2)
SELECT p_partkey AS request, p.p_brand AS image, p_name AS symbol, slide + off AS address, slide + off - base AS "offset"
FROM part p JOIN s ON s.image = p.p_brand AND s.symbol = p_name JOIN i ON i.image = p.p_brand""",
)
def symbol_address(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    symbols = parts.select(F.col("p_brand").alias("image"), F.col("p_name").alias("symbol"), (F.col("p_partkey") * 16).alias("vm_offset"))
    requests = parts.select(F.col("p_partkey").alias("request"), F.col("p_brand").alias("image"), F.col("p_name").alias("symbol"))
    at = F.max("s_suppkey") * 4096
    images = (
        table(spark, sf_dir, "supplier")
        .groupBy(F.concat(F.lit("Brand#"), (1 + F.col("s_suppkey") % 20).cast("string")).alias("image"))
        .agg((at + 4294967296).alias("base"), (at + 4293918720).alias("slide"))
    )
    return links.symbol_addresses(requests, symbols, images)


@query(
    "address_image",
    """WITH i AS (SELECT p_partkey % 16 AS pid, CAST(floor((p_retailprice - 850) * 100) AS BIGINT) AS load_addr, arg_max(p_name, p_partkey) AS image FROM part GROUP BY 1, 2),
 a AS (SELECT l_suppkey % 16 AS pid, CAST(floor(l_extendedprice) AS BIGINT) AS address, count(*) AS n FROM lineitem GROUP BY 1, 2)
SELECT a.pid AS pid, address, n, image, load_addr, address - load_addr AS "offset" FROM a ASOF LEFT JOIN i ON a.pid = i.pid AND a.address >= i.load_addr""",
)
def address_image(spark, sf_dir):
    images = table(spark, sf_dir, "part").select(
        (F.col("p_partkey") % 16).alias("pid"),
        F.floor((F.col("p_retailprice") - 850) * 100).alias("load_addr"),
        F.col("p_name").alias("image"),
        F.col("p_partkey").alias("line"),
    )
    addresses = table(spark, sf_dir, "lineitem").select(
        (F.col("l_suppkey") % 16).alias("pid"), F.floor("l_extendedprice").alias("address")
    )
    return links.image_of_address(addresses, images)
