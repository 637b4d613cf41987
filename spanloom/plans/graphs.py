"""Queries on causal clusters, lanes and diagram text."""

from pyspark.sql import functions as F

from spanloom.functions import codec
from spanloom.operators import graph, order
from spanloom.plans.registry import query
from spanloom.plans.tables import EVENTS_SQL, events, table


def turns(spark, sf_dir):
    """conversations in file order, with room for the longest one's turns between two of them."""
    rows = table(spark, sf_dir, "conversations")
    room = rows.agg(F.max("turn").cast("long") + 1).scalar()
    return rows.select(
        (F.col("conv_id") * room + F.col("turn")).alias("seq"), "conv_id", "turn", "role", "text"
    )


@query("carry_header", "SELECT conv_id * (SELECT max(turn) + 1 FROM conversations) + turn AS seq, turn, conv_id AS header FROM conversations")
def carry_header(spark, sf_dir):
    """Only a conversation's first row names it; the others take it from above."""
    rows = turns(spark, sf_dir).withColumn("_id", F.when(F.col("turn") == 0, F.col("conv_id")))
    return order.carry_header(rows, F.col("_id")).select("seq", "turn", "header")


@query(
    "symbol_runs",
    f"""WITH {EVENTS_SQL}, d AS (SELECT *, lag(event_type) OVER (PARTITION BY tid ORDER BY seq) AS p FROM ev),
 r AS (SELECT *, max(CASE WHEN p IS DISTINCT FROM event_type THEN seq END) OVER (PARTITION BY tid ORDER BY seq) AS run FROM d)
SELECT tid, run, event_type, count(*) AS insts FROM r GROUP BY ALL""",
)
def symbol_runs(spark, sf_dir):
    return graph.symbol_runs(events(spark, sf_dir), ["tid"], "event_type")


@query(
    "action_runs",
    f"""WITH {EVENTS_SQL}, e AS (SELECT seq, pid, user_id % 2 AS gid, event_type = 'error' AS note, CASE WHEN event_type = 'error' THEN 'backtrace' ELSE event_type END AS action FROM ev),
 d AS (SELECT *, lag(gid) OVER w AS pg, lag(note) OVER w AS pn FROM e WINDOW w AS (PARTITION BY pid ORDER BY seq)),
 r AS (SELECT *, max(CASE WHEN pg IS DISTINCT FROM gid OR note OR coalesce(pn, TRUE) THEN seq END) OVER (PARTITION BY pid ORDER BY seq) AS box FROM d)
SELECT pid, box, gid, note, string_agg(action, '\\n' ORDER BY seq) AS actions, count(*) AS n FROM r GROUP BY pid, box, gid, note""",
)
def action_runs(spark, sf_dir):
    action = F.when(F.col("event_type") == "error", "backtrace").otherwise(F.col("event_type"))
    rows = events(spark, sf_dir).select("seq", "pid", (F.col("user_id") % 2).alias("gid"), action.alias("action"))
    return graph.action_boxes(rows, ["pid"], "gid", "action")


@query(
    "group_spans",
    """WITH e AS (SELECT o_orderkey % 97 AS cluster, o_orderkey AS host_gid, epoch_us(o_orderdate) AS ts, 'activate' AS action FROM orders
  UNION ALL SELECT l_orderkey % 97, l_orderkey, epoch_us(l_shipdate), 'deactivate' FROM lineitem)
SELECT cluster, host_gid, min(ts) FILTER (action = 'activate') AS start, max(ts) FILTER (action = 'deactivate') AS "end",
  max(ts) FILTER (action = 'deactivate') - min(ts) FILTER (action = 'activate') AS duration FROM e GROUP BY 1, 2""",
)
def group_spans(spark, sf_dir):
    begins = table(spark, sf_dir, "orders").select(
        (F.col("o_orderkey") % 97).alias("cluster"), F.col("o_orderkey").alias("host_gid"), F.col("o_orderdate").alias("ts"), F.lit("activate").alias("action")
    )
    ends = table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") % 97).alias("cluster"), F.col("l_orderkey").alias("host_gid"), F.col("l_shipdate").alias("ts"), F.lit("deactivate").alias("action")
    )
    return graph.group_spans(begins.unionByName(ends))


@query(
    "cluster_check",
    """WITH e AS (SELECT l_orderkey % 97 AS cluster, l_orderkey AS host_gid, l_partkey AS peer_gid FROM lineitem),
 h AS (SELECT o_orderkey % 97 AS cluster, count(*) AS declared FROM orders GROUP BY 1),
 g AS (SELECT DISTINCT cluster, host_gid FROM e), r AS (SELECT cluster, count(*) AS real FROM g GROUP BY 1),
 p AS (SELECT DISTINCT cluster, peer_gid FROM e), d AS (SELECT p.cluster AS cluster, count(*) AS dangling FROM p ANTI JOIN g ON p.cluster = g.cluster AND p.peer_gid = g.host_gid GROUP BY 1)
SELECT h.cluster AS cluster, declared, coalesce(real, 0) AS real, declared = coalesce(real, 0) AS agrees, coalesce(dangling, 0) AS dangling
FROM h LEFT JOIN r ON h.cluster = r.cluster LEFT JOIN d ON h.cluster = d.cluster""",
)
def cluster_check(spark, sf_dir):
    edges = table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") % 97).alias("cluster"), F.col("l_orderkey").alias("host_gid"), F.col("l_partkey").alias("peer_gid")
    )
    declared = table(spark, sf_dir, "orders").groupBy((F.col("o_orderkey") % 97).alias("cluster")).agg(F.count(F.lit(1)).alias("declared"))
    return graph.cluster_check(edges, declared)


def order_edges(spark, sf_dir):
    """orders as edges: customer to customer, every fifth row an activation without a peer."""
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    alone = key % 5 == 0
    return table(spark, sf_dir, "orders").select(
        key.alias("seq"),
        (cust % 16).alias("cluster"),
        F.concat(F.lit("n"), cust.cast("string")).alias("host_name"),
        F.when(alone, "activate").otherwise("send").alias("action"),
        F.when(~alone, F.concat(F.lit("n"), ((cust * 7 + key) % 500).cast("string"))).alias("peer_name"),
    )


ORDER_EDGES_SQL = """e AS (SELECT o_orderkey AS seq, o_custkey % 16 AS cluster, 'n' || o_custkey AS host_name, CASE WHEN o_orderkey % 5 = 0 THEN 'activate' ELSE 'send' END AS action,
  CASE WHEN o_orderkey % 5 <> 0 THEN 'n' || ((o_custkey * 7 + o_orderkey) % 500) END AS peer_name FROM orders),
 s AS (SELECT cluster, host_name AS name, seq * 2 AS pos FROM e UNION ALL SELECT cluster, peer_name, seq * 2 + 1 FROM e WHERE peer_name IS NOT NULL),
 f AS (SELECT cluster, name, min(pos) // 2 AS first_seq, min(pos) % 2 = 1 AS created FROM s GROUP BY 1, 2)"""


@query("nodes", f"WITH {ORDER_EDGES_SQL} SELECT * FROM f")
def nodes(spark, sf_dir):
    return graph.first_seen(order_edges(spark, sf_dir), ["cluster"])


@query(
    "diagram_text",
    f"""WITH {ORDER_EDGES_SQL}, h AS (SELECT DISTINCT cluster FROM f)
SELECT cluster, 0 AS place, CAST(0 AS BIGINT) AS pos, '' AS who, '@startuml' AS value FROM h
UNION ALL SELECT cluster, 1, 0, name, 'activate ' || name FROM f
UNION ALL SELECT cluster, 2, first_seq * 2, name, 'create ' || name FROM f WHERE created
UNION ALL SELECT cluster, 2, seq * 2 + 1, '', CASE WHEN action = 'activate' THEN 'activate ' || host_name ELSE host_name || ' -> ' || peer_name || ': ' || action END FROM e
UNION ALL SELECT cluster, 3, 0, name, 'deactivate ' || name FROM f
UNION ALL SELECT cluster, 4, 0, '', '@enduml' FROM h""",
)
def diagram_text(spark, sf_dir):
    return graph.participant_lines(order_edges(spark, sf_dir), ["cluster"])


CHART_SQL = f"""{EVENTS_SQL}, e AS (SELECT seq, pid, user_id % 2 AS gid, 'p ' || tid AS node, event_type = 'error' AS note, CASE WHEN event_type = 'error' THEN 'backtrace' ELSE event_type END AS action FROM ev),
 d AS (SELECT *, lag(gid) OVER w AS pg, lag(note) OVER w AS pn FROM e WINDOW w AS (PARTITION BY pid ORDER BY seq)),
 r AS (SELECT *, max(CASE WHEN pg IS DISTINCT FROM gid OR note OR coalesce(pn, TRUE) THEN seq END) OVER (PARTITION BY pid ORDER BY seq) AS box FROM d),
 b AS (SELECT pid, box, gid, note, arg_min(node, seq) AS node, string_agg(action, '\\n' ORDER BY seq) AS actions FROM r GROUP BY pid, box, gid, note),
 nd AS (SELECT DISTINCT pid, node FROM e), lst AS (SELECT pid, max(node) AS l FROM nd GROUP BY 1),
 c AS (SELECT *, CASE gid WHEN 0 THEN 'blue' ELSE 'aquamarine' END AS colour FROM b)"""


@query(
    "chart_text",
    f"""WITH {CHART_SQL} SELECT pid, 0 AS place, CAST(0 AS BIGINT) AS pos, '' AS who, 'msc {{' AS value FROM lst
UNION ALL SELECT nd.pid, 1, 0, node, node || ' [label="' || node || '", textbgcolor = "orange"]' || CASE WHEN node = l THEN ';' ELSE ',' END FROM nd JOIN lst ON nd.pid = lst.pid
UNION ALL SELECT pid, 2, box, '', CASE WHEN note THEN node || ' note ' || node || '[label="' || actions || '", textbgcolour="' || colour || '"];'
  ELSE node || ' abox ' || node || ' [label="' || gid || '\\n' || actions || '\\n", textbgcolor="' || colour || '"];' END FROM c
UNION ALL SELECT pid, 3, 0, '', '}}' FROM lst""",
)
def chart_text(spark, sf_dir):
    return graph.chart_lines(chart_edges(spark, sf_dir), ["pid"])


@query(
    "chart_pieces",
    f"""WITH {CHART_SQL},
 q AS (SELECT pid, box, gid, note, (seq >> 2) - (box >> 2) AS piece, string_agg(action, '\\n' ORDER BY seq) AS actions FROM r GROUP BY ALL),
 z AS (SELECT q.*, max(piece) OVER (PARTITION BY q.pid, q.box) AS latest, e.node AS node, CASE q.gid WHEN 0 THEN 'blue' ELSE 'aquamarine' END AS colour FROM q JOIN e ON e.pid = q.pid AND e.seq = q.box)
SELECT pid, 0 AS place, CAST(0 AS BIGINT) AS pos, CAST(0 AS BIGINT) AS piece, '' AS who, 'msc {{' AS value FROM lst
UNION ALL SELECT nd.pid, 1, 0, 0, node, node || ' [label="' || node || '", textbgcolor = "orange"]' || CASE WHEN node = l THEN ';' ELSE ',' END FROM nd JOIN lst ON nd.pid = lst.pid
UNION ALL SELECT pid, 2, box, piece, '', CASE WHEN piece > 0 THEN '\\n' WHEN note THEN node || ' note ' || node || '[label="' ELSE node || ' abox ' || node || ' [label="' || gid || '\\n' END || actions
  || CASE WHEN piece < latest THEN '' WHEN note THEN '", textbgcolour="' || colour || '"];' ELSE '\\n", textbgcolor="' || colour || '"];' END FROM z
UNION ALL SELECT pid, 3, 0, 0, '', '}}' FROM lst""",
)
def chart_pieces(spark, sf_dir):
    """Boxes cut every four positions."""
    return graph.chart_pieces(chart_edges(spark, sf_dir), ["pid"], piece_bits=2)


def chart_edges(spark, sf_dir):
    action = F.when(F.col("event_type") == "error", "backtrace").otherwise(F.col("event_type"))
    return events(spark, sf_dir).select(
        "seq", "pid", (F.col("user_id") % 2).alias("gid"), F.concat(F.lit("p "), F.col("tid").cast("string")).alias("node"), action.alias("action")
    )


@query(
    "message_log_text",
    f"""WITH {EVENTS_SQL}, g AS (SELECT seq, user_id, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY seq), 0) AS gap, 'u' || pid AS f, 't' || tid AS t, event_type AS label,
  CASE event_type WHEN 'view' THEN NULL WHEN 'error' THEN NULL WHEN 'purchase' THEN '-[#red]>' ELSE CASE WHEN value * 100 > 10000 THEN '-[#0000FF]>' ELSE '-[#red]>' END END AS arrow FROM ev)
SELECT user_id, 0 AS place, seq * 2 AS pos, '' AS who, CASE WHEN gap < 100 THEN '||' || gap || '||' ELSE '... ' || gap || 'micro seconds later ...' END AS value FROM g
UNION ALL SELECT user_id, 0, seq * 2 + 1, '', CASE WHEN arrow IS NOT NULL THEN f || arrow || t || ':' || label ELSE 'hnote over ' || t || ':' || label END FROM g""",
)
def message_log_text(spark, sf_dir):
    kind = F.col("event_type")
    op = F.when(kind == "purchase", "voucher_create").when(kind == "view", "mach_msg_recv").when(kind == "error", "other").otherwise("mach_msg_send")
    rows = order.message_gaps(events(spark, sf_dir), ["user_id"]).select(
        "seq",
        "user_id",
        "gap",
        codec.message_arrow(op, F.col("value") * 100).alias("arrow"),
        F.concat(F.lit("u"), F.col("pid").cast("string")).alias("from_name"),
        F.concat(F.lit("t"), F.col("tid").cast("string")).alias("to_name"),
        kind.alias("label"),
    )
    return graph.message_log_lines(rows, ["user_id"])


@query(
    "cluster_names",
    """WITH e AS (SELECT o_orderkey AS seq, 'g ' || o_orderpriority AS cluster, o_custkey AS tid, o_custkey % 50 AS peer_tid, 'c' || o_orderkey % 100 AS node FROM orders WHERE o_orderpriority LIKE '%H%'),
 n AS (SELECT cluster, tid, arg_max(node, seq) AS peer_node FROM e GROUP BY 1, 2)
SELECT e.seq AS seq, replace(e.cluster, ' ', '_') AS file, e.node AS node, n.peer_node AS peer_node, ['blue', 'aquamarine', 'burlywood', 'cadetblue', 'cornflowerblue', 'darkgrey', 'darkgreen',
  'darkorange', 'mediumpurple', 'gold', 'forestgreen', 'sienna', 'yellowgreen'][1 + e.seq % 13] AS colour
FROM e LEFT JOIN n ON e.cluster = n.cluster AND e.peer_tid = n.tid""",
)
def cluster_names(spark, sf_dir):
    """Clusters whose header holds a pattern, with peer nodes, colours and file-safe names."""
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("seq"),
        F.concat(F.lit("g "), "o_orderpriority").alias("cluster"),
        F.col("o_custkey").alias("tid"),
        (F.col("o_custkey") % 50).alias("peer_tid"),
        F.concat(F.lit("c"), (F.col("o_orderkey") % 100).cast("string")).alias("node"),
    )
    chosen = graph.peer_nodes(rows.filter(F.col("cluster").contains("H")), ["cluster"])
    return chosen.select(
        "seq", codec.space_to_underscore(F.col("cluster")).alias("file"), "node", "peer_node", codec.palette(F.col("seq")).alias("colour")
    )


def lane_arrows(spark, sf_dir):
    """lineitem as arrows between supplier lanes; the second end is another supplier of the list."""
    sup = table(spark, sf_dir, "supplier")
    count = sup.agg(F.count(F.lit(1))).scalar()
    rows = table(spark, sf_dir, "lineitem").select(
        "l_suppkey",
        (F.col("l_partkey") % count).alias("to_key"),
        F.col("l_orderkey").alias("order_key"),
        F.col("l_linenumber").cast("long").alias("line"),
        F.col("l_shipdate").alias("time_from"),
        (F.col("l_shipdate") + F.col("l_quantity").cast("long") * 1000).alias("time_to"),
        F.when(F.col("l_returnflag") == "R", "recv").otherwise("send").alias("label"),
    )
    named = rows.join(sup.select("s_suppkey", F.col("s_name").alias("lane_from")), F.col("l_suppkey") == F.col("s_suppkey")).drop("s_suppkey")
    return named.join(sup.select("s_suppkey", F.col("s_name").alias("lane_to")), F.col("to_key") == F.col("s_suppkey")).drop("s_suppkey", "l_suppkey", "to_key")


LANES_SQL = """ln AS (SELECT s_name AS name, row_number() OVER (ORDER BY s_name) - 1 AS lane FROM (SELECT DISTINCT s_name FROM supplier)),
 ar AS (SELECT f.s_name AS lane_from, t.s_name AS lane_to, l_orderkey AS order_key, CAST(l_linenumber AS BIGINT) AS line, epoch_us(l_shipdate) AS time_from,
  epoch_us(l_shipdate) + CAST(l_quantity AS BIGINT) * 1000 AS time_to, CASE WHEN l_returnflag = 'R' THEN 'recv' ELSE 'send' END AS label
  FROM lineitem JOIN supplier f ON f.s_suppkey = l_suppkey JOIN supplier t ON t.s_suppkey = l_partkey % (SELECT count(*) FROM supplier))"""


@query(
    "lanes",
    f"""WITH {LANES_SQL} SELECT order_key, line, f.lane AS from_lane, t.lane AS to_lane, CASE WHEN lane_from <> lane_to THEN 'line' WHEN label = 'recv' THEN 'label' ELSE 'curve' END AS style
FROM ar JOIN ln f ON f.name = lane_from JOIN ln t ON t.name = lane_to""",
)
def lanes(spark, sf_dir):
    numbered = graph.lane_numbers(table(spark, sf_dir, "supplier"), "s_name")
    placed = graph.on_lanes(lane_arrows(spark, sf_dir), numbered)
    style = codec.arrow_style(F.col("lane_from"), F.col("lane_to"), F.col("label"))
    return placed.select("order_key", "line", "from_lane", "to_lane", style.alias("style"))


@query(
    "pixels",
    """WITH g AS (SELECT o_orderkey AS id, epoch_us(o_orderdate) AS start, epoch_us(o_orderdate) + o_custkey * 1000 AS "end" FROM orders),
 x AS (SELECT min(start) AS lo, max("end") AS hi FROM g)
SELECT id, CAST((start - (lo + (hi - lo) * 0.25::DOUBLE)) * (1600.0::DOUBLE / (hi - lo)) AS DOUBLE) AS y0, CAST(("end" - (lo + (hi - lo) * 0.25::DOUBLE)) * (1600.0::DOUBLE / (hi - lo)) AS DOUBLE) AS y1,
  printf('%.4fms', ("end" - start) / 10000.0::DOUBLE) AS label FROM g, x""",
)
def pixels(spark, sf_dir):
    groups = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("start"), (F.col("o_orderdate") + F.col("o_custkey") * 1000).alias("end")
    )
    least, greatest = graph.extent(groups)
    at = lambda c: graph.to_pixel(F.col(c), least, greatest, height=800.0, zoom=2.0, scroll=0.5)
    return groups.select("id", at("start").alias("y0"), at("end").alias("y1"), codec.duration_label(F.col("end") - F.col("start")).alias("label"))


POINTS = [(10.0, 120.0), (25.5, 300.25), (60.0, 41.0), (90.0, 77.5)]


@query(
    "arrow_hits",
    f"""WITH p AS (SELECT * FROM (VALUES {", ".join(f"({i}, {x}::DOUBLE, {y}::DOUBLE)" for i, (x, y) in enumerate(POINTS))}) v(point, px, py)),
 a AS (SELECT o_orderkey AS seq, (o_custkey % 100)::DOUBLE AS x0, (o_custkey % 100 + o_orderkey % 40)::DOUBLE AS x1, (o_orderkey % 500)::DOUBLE AS y0, (o_orderkey % 500 + o_custkey % 90)::DOUBLE AS y1 FROM orders),
 i AS (SELECT *, x1 - x0 AS dx, y1 - y0 AS dy FROM a, p WHERE px >= x0 AND px <= x1 AND py >= y0 AND py <= y1),
 t AS (SELECT *, coalesce(((px - x0) * dx + (py - y0) * dy) / nullif(dx * dx + dy * dy, 0), 0) AS s FROM i),
 d AS (SELECT point, seq, sqrt((px - (x0 + s * dx)) * (px - (x0 + s * dx)) + (py - (y0 + s * dy)) * (py - (y0 + s * dy))) AS distance FROM t)
SELECT CAST(point AS BIGINT) AS point, arg_min(seq, (distance, seq)) AS arrow, min(distance) AS distance FROM d WHERE distance < 5 GROUP BY point""",
)
def arrow_hits(spark, sf_dir):
    return graph.hit_test(order_arrows(spark, sf_dir), POINTS, 5.0)


def order_arrows(spark, sf_dir):
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    return table(spark, sf_dir, "orders").select(
        key.alias("seq"),
        (cust % 100).cast("double").alias("x0"),
        (cust % 100 + key % 40).cast("double").alias("x1"),
        (key % 500).cast("double").alias("y0"),
        (key % 500 + cust % 90).cast("double").alias("y1"),
    )


@query(
    "arrow_hits_table",
    """WITH p AS (SELECT c_custkey AS point, (c_custkey * 37 % 1400) / 10.0::DOUBLE AS px, (c_custkey * 7919 % 59000) / 100.0::DOUBLE AS py FROM customer),
 a AS (SELECT o_orderkey AS seq, (o_custkey % 100)::DOUBLE AS x0, (o_custkey % 100 + o_orderkey % 40)::DOUBLE AS x1, (o_orderkey % 500)::DOUBLE AS y0, (o_orderkey % 500 + o_custkey % 90)::DOUBLE AS y1 FROM orders),
 i AS (SELECT *, x1 - x0 AS dx, y1 - y0 AS dy FROM a JOIN p ON px BETWEEN x0 AND x1 AND py BETWEEN y0 AND y1),
 t AS (SELECT *, coalesce(((px - x0) * dx + (py - y0) * dy) / nullif(dx * dx + dy * dy, 0), 0) AS s FROM i),
 d AS (SELECT point, seq, sqrt((px - (x0 + s * dx)) * (px - (x0 + s * dx)) + (py - (y0 + s * dy)) * (py - (y0 + s * dy))) AS distance FROM t)
SELECT point, arg_min(seq, (distance, seq)) AS arrow, min(distance) AS distance FROM d WHERE distance < 5 GROUP BY point""",
)
def arrow_hits_table(spark, sf_dir):
    """Every customer is a point on the chart of all orders."""
    key = F.col("c_custkey")
    points = table(spark, sf_dir, "customer").select(
        key.alias("point"), ((key * 37 % 1400) / F.lit(10.0)).alias("px"), ((key * 7919 % 59000) / F.lit(100.0)).alias("py")
    )
    return graph.hit_test_table(order_arrows(spark, sf_dir), points, 5.0)


@query(
    "lane_json",
    f"""WITH {LANES_SQL} SELECT 'lanes' AS kind, '{{"lane":' || lane || ',"name":"' || name || '","main_lane":' || (name = 'Supplier#000000000') || '}}' AS value FROM ln
UNION ALL SELECT 'groups', '{{"start":' || min(time_from) || ',"end":' || max(time_to) || ',"lane":"' || lane_from || '","duration":' || max(time_to) - min(time_from) || ',"name":"' || order_key || '"}}' FROM ar GROUP BY order_key, lane_from
UNION ALL SELECT 'arrows', '{{"timeFrom":' || time_from || ',"timeTo":' || time_to || ',"laneFrom":"' || lane_from || '","laneTo":"' || lane_to || '","label":"' || label || '"}}' FROM ar""",
)
def lane_json(spark, sf_dir):
    arrows = lane_arrows(spark, sf_dir)
    spans = arrows.groupBy("order_key", F.col("lane_from").alias("lane")).agg(F.min("time_from").alias("start"), F.max("time_to").alias("end"))
    groups = spans.select("start", "end", "lane", (F.col("end") - F.col("start")).alias("duration"), F.col("order_key").cast("string").alias("name"))
    numbered = graph.lane_numbers(table(spark, sf_dir, "supplier"), "s_name")
    return graph.lane_records(groups, arrows, numbered, "Supplier#000000000")
