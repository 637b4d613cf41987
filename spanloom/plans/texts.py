"""Queries on text files: lines are written from the tables, read back and compared with them."""

from pyspark.sql import functions as F

from spanloom import fixed_values as fv
from spanloom.functions import codec
from spanloom.operators import codes, filters, graph, order
from spanloom.plans import decode
from spanloom.plans.registry import query
from spanloom.plans.tables import KEVENTS_SQL, kevents, table
from spanloom.session import fresh_path, settle
from spanloom.sinks.text import report_lines, write_lines, write_report
from spanloom.sources import text


def written(spark, name, lines, *order):
    path = fresh_path(spark, name)
    write_lines(lines, path, list(order))
    return path


def code_lines(spark, sf_dir):
    digits = F.hex(F.col("p_partkey") * 4)
    shown = F.when(F.col("p_partkey") % 2 == 0, F.lower(digits)).otherwise(digits)
    line = F.concat(F.lit("0x"), shown, F.when(F.col("p_partkey") % 3 == 0, "\t").otherwise("  "), F.col("p_name"), F.lit(" "))
    named = F.when(F.col("p_partkey") % 50 == 49, F.concat(F.lit("0x"), digits)).otherwise(line)
    return table(spark, sf_dir, "part").select("p_partkey", named.alias("value"))


CODE_FILE_SQL = "SELECT p_partkey * 4 AS debugid, p_name AS name, p_partkey + 1 AS line FROM part WHERE p_partkey <> 0 AND p_partkey % 50 <> 49"


@query("code_file", CODE_FILE_SQL)
def code_file(spark, sf_dir):
    path = written(spark, "codes", code_lines(spark, sf_dir), "p_partkey")
    return text.read_codes(spark, [path]).select("debugid", "name", "line")


@query(
    "code_file_counts",
    f"WITH c AS ({CODE_FILE_SQL}) SELECT source, count(*) AS n FROM c, (VALUES ('0000'), ('0001')) s(source) GROUP BY source",
)
def code_file_counts(spark, sf_dir):
    path = written(spark, "codes", code_lines(spark, sf_dir), "p_partkey")
    return text.read_codes(spark, [path, path]).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query(
    "filter_file",
    f"""WITH {KEVENTS_SQL} SELECT seq, debugid FROM k WHERE EXISTS (SELECT 1 FROM nation WHERE
  CASE WHEN n_nationkey % 2 = 0 THEN debugid >> 24 = n_nationkey ELSE debugid >> 16 = n_nationkey * 256 + 32 END)""",
)
def filter_file(spark, sf_dir):
    key = F.col("n_nationkey")
    line = F.when(key % 2 == 0, F.concat(F.lit("C 0x"), codec.hex_text(key))).otherwise(F.concat(F.lit("S 0x"), F.hex(key * 256 + 32)))
    rows = table(spark, sf_dir, "nation").select("n_nationkey", F.explode(F.array(line, F.concat(F.lit("# "), "n_name"), F.lit(""))).alias("value"))
    path = written(spark, "filters", rows, "n_nationkey")
    return filters.type_filter(kevents(spark, sf_dir), pairs=text.read_filters(spark, path)).select("seq", "debugid")


@query(
    "process_file",
    "SELECT c_custkey AS pid, substr(c_name || ' of ' || c_mktsegment, 1, 16) AS command FROM customer",
)
def process_file(spark, sf_dir):
    line = F.concat(F.col("c_custkey").cast("string"), F.lit(" "), F.col("c_name"), F.lit(" of "), F.col("c_mktsegment"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", line.alias("value"))
    return text.read_processes(spark, written(spark, "procs", rows, "c_custkey")).select("pid", "command")


@query(
    "image_list_file",
    """SELECT s_suppkey AS pid, 'x86_64' AS arch, s_name AS comm, 4294967296 + p_partkey * 4096 AS load_addr, '/lib/' || p_name AS path
FROM part JOIN supplier ON p_partkey % (SELECT count(*) FROM supplier) = s_suppkey""",
)
def image_list_file(spark, sf_dir):
    key = F.col("s_suppkey")
    sup = table(spark, sf_dir, "supplier")
    heads = sup.select(
        key.alias("pid"), F.lit(-1).cast("long").alias("at"), F.concat(F.lit("DumpProcess "), codec.hex_text(key), F.lit(" x86_64 "), F.col("s_name")).alias("value")
    )
    owned = table(spark, sf_dir, "part").withColumn("pid", F.col("p_partkey") % sup.agg(F.count(F.lit(1))).scalar())
    entries = owned.select(
        "pid",
        F.col("p_partkey").alias("at"),
        F.concat(F.lit("0x"), codec.hex_text(F.col("p_partkey") * 4096 + 4294967296), F.lit(" /lib/"), F.col("p_name")).alias("value"),
    )
    path = written(spark, "images", heads.unionByName(entries), "pid", "at")
    return text.read_images(spark, path).select("pid", "arch", "comm", "load_addr", "path")


def cluster_lines(spark, sf_dir):
    """orders as the rows of one cluster per customer, every tenth a row of five words."""
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    orders = table(spark, sf_dir, "orders")
    heads = orders.groupBy(cust.alias("cust")).agg(F.count(F.lit(1)).alias("n")).select(
        "cust",
        F.lit(-1).cast("long").alias("at"),
        F.concat(F.lit("#Cluster "), codec.hex_text(F.col("cust")), F.lit("(num of groups = "), codec.hex_text(F.col("n")), F.lit(")")).alias("value"),
    )
    host = [F.concat(key.cast("string"), F.lit(".5")), codec.hex_text(key), F.concat(F.lit("App_"), codec.hex_text(cust))]
    peer = [key.cast("string"), codec.hex_text(key + 1), F.lit("Peer_1")]
    tab = lambda *cells: F.concat_ws("\t", *cells)
    line = (
        F.when(key % 10 == 9, tab(*host, F.lit("send"), F.lit("odd")))
        .when(key % 2 == 0, tab(*host, F.lit("activate")))
        .otherwise(tab(*host, F.lit("send"), *peer))
    )
    return heads.unionByName(orders.select(cust.alias("cust"), key.alias("at"), line.alias("value")))


CLUSTER_SQL = """SELECT lower(to_hex(o_custkey)) AS cluster, o_orderkey + 0.5::DOUBLE AS ts, o_orderkey AS host_gid, 'App_' || lower(to_hex(o_custkey)) AS host_name,
  CASE WHEN o_orderkey % 2 = 0 THEN 'activate' ELSE 'send' END AS action, CASE WHEN o_orderkey % 2 = 1 THEN o_orderkey::DOUBLE END AS peer_ts,
  CASE WHEN o_orderkey % 2 = 1 THEN o_orderkey + 1 END AS peer_gid, CASE WHEN o_orderkey % 2 = 1 THEN 'Peer_1' END AS peer_name FROM orders WHERE o_orderkey % 10 <> 9"""


@query("cluster_file", CLUSTER_SQL)
def cluster_file(spark, sf_dir):
    path = written(spark, "clusters", cluster_lines(spark, sf_dir), "cust", "at")
    return text.read_clusters(spark, path)[1].drop("seq")


@query(
    "cluster_file_check",
    f"""WITH e AS ({CLUSTER_SQL}), h AS (SELECT lower(to_hex(o_custkey)) AS cluster, count(*) AS declared FROM orders GROUP BY 1),
 r AS (SELECT cluster, count(DISTINCT host_gid) AS real FROM e GROUP BY 1),
 d AS (SELECT p.cluster AS cluster, count(DISTINCT p.peer_gid) AS dangling FROM e p WHERE p.peer_gid IS NOT NULL AND NOT EXISTS (SELECT 1 FROM e g WHERE g.cluster = p.cluster AND g.host_gid = p.peer_gid) GROUP BY 1)
SELECT h.cluster AS cluster, declared, coalesce(real, 0) AS real, declared = coalesce(real, 0) AS agrees, coalesce(dangling, 0) AS dangling
FROM h LEFT JOIN r ON h.cluster = r.cluster LEFT JOIN d ON h.cluster = d.cluster""",
)
def cluster_file_check(spark, sf_dir):
    path = written(spark, "clusters", cluster_lines(spark, sf_dir), "cust", "at")
    headers, edges, _ = text.read_clusters(spark, path)
    return graph.cluster_check(edges, headers.select("cluster", "declared"))


@query("cluster_file_rejects", "SELECT lower(to_hex(o_custkey)) AS cluster, count(*) AS n FROM orders WHERE o_orderkey % 10 = 9 GROUP BY 1")
def cluster_file_rejects(spark, sf_dir):
    path = written(spark, "clusters", cluster_lines(spark, sf_dir), "cust", "at")
    return text.read_clusters(spark, path)[2].groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))


@query(
    "chart_file",
    """SELECT '#Cluster ' || (s_suppkey % 10) AS cluster, s_suppkey AS gid, s_suppkey + 0.25::DOUBLE AS ts, s_suppkey + 4096 AS tid, 'Proc' AS proc,
  'act' || s_nationkey AS action, CASE WHEN s_suppkey % 3 = 0 THEN 0 ELSE s_suppkey + 4095 END AS peer_tid, 'Proc' || (s_suppkey + 4096) AS node FROM supplier WHERE (s_suppkey % 10) = 3""",
)
def chart_file(spark, sf_dir):
    path = written(spark, "charts", supplier_charts(spark, sf_dir), "cluster", "at")
    # The header holds the pattern; rows of one cluster may lie in several files of the folder.
    return text.read_chart_clusters(spark, path, "Cluster 3").drop("seq")


def supplier_charts(spark, sf_dir):
    """Lines of a chart cluster for each last digit of the suppliers."""
    key = F.col("s_suppkey")
    sup = table(spark, sf_dir, "supplier")
    cluster = key % 10
    heads = sup.select(cluster.alias("cluster"), F.lit(-1).cast("long").alias("at")).distinct()
    heads = heads.select("cluster", "at", F.concat(F.lit("#Cluster "), F.col("cluster").cast("string")).alias("value"))
    cells = [codec.hex_text(key), F.concat(key.cast("string"), F.lit(".25")), codec.hex_text(key + 4096), F.lit("Proc"), F.concat(F.lit("act"), F.col("s_nationkey").cast("string"))]
    line = F.when(key % 3 == 0, F.concat_ws(" ", *cells)).otherwise(F.concat_ws(" ", *cells, codec.hex_text(key + 4095)))
    return heads.unionByName(sup.select(cluster.alias("cluster"), key.alias("at"), line.alias("value")))


@query(
    "chart_files",
    """WITH c AS (SELECT *, s_suppkey % 10 AS cluster FROM supplier),
 b AS (SELECT cluster, min(s_suppkey) AS bad FROM c WHERE cluster % 3 = 2 AND s_suppkey // 10 % 4 = 2 GROUP BY cluster)
SELECT '#Cluster ' || c.cluster AS cluster, s_suppkey AS gid, s_suppkey + 0.25::DOUBLE AS ts, s_suppkey + 4096 AS tid, 'Proc' AS proc,
  'act' || s_nationkey AS action, CASE WHEN s_suppkey % 3 = 0 THEN 0 ELSE s_suppkey + 4095 END AS peer_tid, 'Proc' || (s_suppkey + 4096) AS node
FROM c LEFT JOIN b ON c.cluster = b.cluster WHERE bad IS NULL OR s_suppkey < bad""",
)
def chart_files(spark, sf_dir):
    """A file for every cluster; three of them have a row that does not parse, which ends the file."""
    broken = (F.col("cluster") % 3 == 2) & (F.floor(F.col("at") / 10) % 4 == 2)
    lines = supplier_charts(spark, sf_dir).withColumn("value", F.when(broken, F.concat(F.lit("row "), F.col("at").cast("string"))).otherwise(F.col("value")))
    path = fresh_path(spark, "charts")
    # One file a cluster is what is to be read here.
    lines.repartition("cluster").sortWithinPartitions("cluster", "at").select("cluster", "value").write.partitionBy("cluster").text(path)
    return text.read_chart_clusters(spark, f"{path}/*").drop("seq")


@query(
    "message_log_file",
    """WITH m AS (SELECT c_custkey, c_custkey // 100 AS section, c_custkey % 4 AS k, 'p' || c_nationkey AS f, 'q' || (c_custkey % 7) AS t, c_custkey * 3 AS delay FROM customer WHERE c_custkey % 5 <> 4)
SELECT section, CASE k WHEN 0 THEN 'mach_msg_send' WHEN 1 THEN 'mach_msg_kernel_request' WHEN 2 THEN 'mach_msg_recv' ELSE 'voucher_create' END AS op, c_custkey + 0.5::DOUBLE AS ts,
  CASE k WHEN 2 THEN t ELSE f END AS from_name, CASE WHEN k IN (1, 2) THEN f ELSE t END AS to_name,
  CASE k WHEN 0 THEN 'b ' || delay || '.0' WHEN 1 THEN 'a b ' || delay || '.0' ELSE 'b' END AS label, CASE WHEN k IN (0, 1) THEN delay::DOUBLE END AS delay FROM m""",
)
def message_log_file(spark, sf_dir):
    key = F.col("c_custkey")
    cust = table(spark, sf_dir, "customer")
    section = F.floor(key / 100)
    op = (
        F.when(key % 5 == 4, "other")
        .when(key % 4 == 0, "mach_msg_send")
        .when(key % 4 == 1, "mach_msg_kernel_request")
        .when(key % 4 == 2, "mach_msg_recv")
        .otherwise("voucher_create")
    )
    cells = [
        F.lit(""), op, F.concat(key.cast("string"), F.lit(".5")), F.concat(F.lit("p"), F.col("c_nationkey").cast("string")), F.lit("-"),
        F.concat(F.lit("q"), (key % 7).cast("string")), F.lit("a"), F.lit("b"), F.concat((key * 3).cast("string"), F.lit(".0")),
    ]
    heads = cust.select(section.alias("section"), F.lit(-1).cast("long").alias("at")).distinct()
    heads = heads.select("section", "at", F.concat(F.lit("####part "), F.col("section").cast("string"), F.lit("####")).alias("value"))
    lines = heads.unionByName(cust.select(section.alias("section"), key.alias("at"), F.concat_ws("    ", *cells).alias("value")))
    path = written(spark, "messages", lines, "section", "at")
    return text.read_message_log(spark, path)[0].drop("seq")


@query(
    "step_log_runs",
    """WITH s AS (SELECT event_id AS seq, event_type AS sym FROM events), d AS (SELECT *, CASE WHEN lag(sym) OVER (ORDER BY seq) IS DISTINCT FROM sym THEN 1 ELSE 0 END AS c FROM s),
 r AS (SELECT *, sum(c) OVER (ORDER BY seq) AS run FROM d), g AS (SELECT run, sym, count(*) AS insts FROM r GROUP BY 1, 2)
SELECT sym AS symbol, insts, count(*) AS n FROM g GROUP BY 1, 2""",
)
def step_log_runs(spark, sf_dir):
    """Run lengths of symbols in a step log with one thread and one instruction line per event."""
    thread = F.concat(F.lit("* thread #1: tid = 0x1, 0x2 lib`"), F.col("event_type"), F.lit(" + 12, queue = 'main'"))
    asm = F.concat(F.lit("->  0x2 <+12>: "), F.when(F.col("event_id") % 7 == 0, "retq").otherwise("movq"))
    rows = table(spark, sf_dir, "events").select("event_id", F.posexplode(F.array(thread, asm)).alias("i", "value"))
    steps = text.read_steps(spark, written(spark, "steps", rows, "event_id", "i"))
    counted = graph.symbol_runs(steps, [], "symbol")
    return counted.groupBy("symbol", "insts").agg(F.count(F.lit(1)).alias("n"))


@query(
    "watch_log_file",
    "SELECT s_suppkey AS pid, s_name AS process, '_sym' || s_nationkey AS symbol, s_suppkey % 4 AS register, 'WO' AS mode, 'Byte' AS width FROM supplier",
)
def watch_log_file(spark, sf_dir):
    key = F.col("s_suppkey")
    row = F.concat_ws("\t", key.cast("string"), F.col("s_name"), F.concat(F.lit("_sym"), F.col("s_nationkey").cast("string")), (key % 4).cast("string"), F.lit("WO"), F.lit("Byte"))
    lines = table(spark, sf_dir, "supplier").select(
        "s_suppkey", F.posexplode(F.array(F.lit("Hardware Breakpoints are set at: now"), row, F.lit("====="))).alias("i", "value")
    )
    return text.read_watch_log(spark, written(spark, "watch", lines, "s_suppkey", "i"))


REPORT_SQL = (
    KEVENTS_SQL
    + """, d AS (SELECT *, lag(ts) OVER (ORDER BY seq) AS pts FROM k),
 vis AS (SELECT *, CASE WHEN coalesce(pts, 0) = 0 THEN ts ELSE ts - pts END AS delta FROM d WHERE debugid >> 24 <> 7 OR (debugid >> 16) & 255 = 2),
 sd AS (SELECT seq, ts, CASE WHEN debugid = 20971544 THEN arg1 ELSE tid END AS kt, eventid, CASE WHEN debugid & 1 <> 0 OR debugid = 20971544 THEN 1 ELSE 2 END AS side FROM vis
   WHERE debugid & 3 <> 0 OR debugid = 20971544),
 sl AS (SELECT *, lag(side) OVER w AS ps, lag(ts) OVER w AS p2 FROM sd WINDOW w AS (PARTITION BY kt, eventid ORDER BY seq)),
 el AS (SELECT seq, CASE WHEN ps = 1 THEN ts - p2 ELSE 0 END AS elapsed FROM sl WHERE side = 2),
 cn AS (SELECT eventid, max(event_type) AS label FROM k JOIN ev USING (seq) WHERE event_type <> 'purchase' GROUP BY 1),
 tm AS (SELECT c_custkey % 64 * 2 AS tid, substr(arg_max(c_name, c_custkey), 1, 16) AS nm FROM customer WHERE c_custkey % 64 <> 0 GROUP BY 1),
 rw AS (SELECT v.*, elapsed, coalesce(label, lower(to_hex(v.eventid))) AS label, CASE WHEN v.cpu = 3 THEN 'IOP' ELSE coalesce(nm, '') END AS command
   FROM vis v LEFT JOIN el ON v.seq = el.seq LEFT JOIN cn ON cn.eventid = v.eventid LEFT JOIN tm ON tm.tid = v.tid)
SELECT seq, CAST(0 AS BIGINT) AS segment, printf('%13.1f %10.1f', ts / 1.0::DOUBLE, delta / 1.0::DOUBLE) || printf('%-12s', CASE WHEN elapsed IS NULL THEN '' ELSE printf('(%.1f)', elapsed / 1.0::DOUBLE) END) || ' '
  || printf('%-28s  ', label) || CASE WHEN debugid = 117571600 THEN rpad(CASE WHEN arg1 = 0 THEN '' ELSE chr(CAST(arg1 AS INTEGER)) END, 68, ' ') || ' '
    ELSE printf('%-16s %-16s %-16s %-16s  ', lower(to_hex(arg1)), lower(to_hex(arg2)), '0', '0') END || printf('%-16s  %-2d %s', lower(to_hex(tid)), cpu, command) AS value FROM rw"""
)


@query("report_text", "WITH " + REPORT_SQL)
def report_text(spark, sf_dir):
    """The whole decode, over events as records and names derived from the tables."""
    zero = F.lit(0).cast("long")
    # As in a conversion of raw files, records are settled before the scans that each read a few of their columns.
    records = settle(kevents(spark, sf_dir).withColumns({"arg3": zero, "arg4": zero}))
    typed = records.join(table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), "event_type"), "seq")
    dictionary = (
        typed.filter(F.col("event_type") != "purchase")
        .groupBy(F.col("eventid").alias("debugid"))
        .agg(F.max("event_type").alias("name"))
        .withColumns({"source": F.lit("0"), "line": zero})
    )
    cust = table(spark, sf_dir, "customer")
    thread_map = cust.select((F.col("c_custkey") % 64 * 2).alias("tid"), F.col("c_name").alias("command"), F.col("c_custkey").alias("entry"))
    cpu_map = cust.select((F.col("c_custkey") % 4).alias("cpu_id"), (F.col("c_custkey") % 4 == 3).cast("long").alias("flags"), F.lit("IOP").alias("name"))
    processes = cust.select((F.col("c_custkey") + 1000).alias("pid"), F.col("c_name").alias("command"))
    plan = decode.decode(records, dictionary, thread_map, cpu_map, processes)
    return report_lines(plan).select("seq", "segment", "value")


DAY_US = 86_400_000_000


@query(
    "report_segments",
    f"""WITH {KEVENTS_SQL}, t AS (SELECT seq, ts % {DAY_US} AS t FROM k), l AS (SELECT *, lag(t) OVER (ORDER BY seq) AS p FROM t),
 g AS (SELECT *, CAST(sum(CASE WHEN t < p THEN 1 ELSE 0 END) OVER (ORDER BY seq) AS BIGINT) AS segment FROM l)
SELECT segment, count(*) + CASE WHEN segment > 0 THEN 1 ELSE 0 END AS lines, CAST(CASE WHEN segment > 0 THEN 1 ELSE 0 END AS BIGINT) AS marks,
  min(printf('%13.1f', t / 1.0::DOUBLE)) AS first, max(printf('%13.1f', t / 1.0::DOUBLE)) AS last FROM g GROUP BY segment""",
)
def report_segments(spark, sf_dir):
    """A ring file whose clock begins anew every day, written as a report and read back: lines of each segment and its marker."""
    none = F.lit(None)
    rows = kevents(spark, sf_dir).withColumns({"ts": F.col("ts") % DAY_US, "arg1": F.col("seq") % 26 + 65})
    cut = order.ring_segments(rows).withColumns(
        {
            "us": F.col("ts").cast("double"),
            "delta_us": F.lit(0.0),
            "elapsed_us": none.cast("double"),
            "label": codec.hex_text(F.col("eventid")),
            "dvp": none.cast("long"),
            "path": none.cast("string"),
            "arg3": F.lit(0).cast("long"),
            "arg4": F.lit(0).cast("long"),
            "command": F.lit(""),
        }
    )
    path = fresh_path(spark, "report")
    write_report(cut, path)
    lines = spark.read.schema("value string, segment long").text(path)
    mark = F.col("value") == fv.WRAP_MARKER
    time = F.when(~mark, F.substring("value", 1, 13))
    return lines.groupBy("segment").agg(
        F.count(F.lit(1)).alias("lines"), F.count_if(mark).alias("marks"), F.min(time).alias("first"), F.max(time).alias("last")
    )
