"""Queries on thread names, owners and process lists."""

from pyspark.sql import functions as F

from spanloom.functions import codec
from spanloom.operators import names, order
from spanloom.plans.registry import query
from spanloom.plans.spans import rotated
from spanloom.plans.tables import EVENTS_SQL, events, per_type, table
from spanloom.session import settle

INITIAL_SQL = "init AS (SELECT c_custkey % 64 * 2 AS tid, substr(arg_max(c_name, c_custkey), 1, 16) AS name FROM customer WHERE c_custkey % 64 <> 0 GROUP BY 1)"


def initial_map(spark, sf_dir):
    """customer as thread map: only even threads are named at the start."""
    return table(spark, sf_dir, "customer").select(
        (F.col("c_custkey") % 64 * 2).alias("tid"), F.col("c_name").alias("name"), F.col("c_custkey").alias("entry")
    )


LIFE_SQL = (
    EVENTS_SQL
    + ", "
    + INITIAL_SQL
    + """, u AS (
  SELECT seq, tid, cpu, seq * 2 AS o, CASE event_type WHEN 'error' THEN 'exit' WHEN 'purchase' THEN 'term' WHEN 'click' THEN 'hand' WHEN 'signup' THEN 'less' END AS role, NULL AS nm FROM ev
  UNION ALL SELECT NULL, tid, NULL, seq * 2 + 1, 'def', 'c' || seq FROM ev WHERE event_type = 'signup'
  UNION ALL SELECT NULL, tid, NULL, -1, 'def', name FROM init),
 g AS (SELECT *, sum(CASE WHEN role = 'def' THEN 1 ELSE 0 END) OVER (PARTITION BY tid ORDER BY o) AS gen FROM u),
 t AS (SELECT *, max(CASE WHEN role = 'term' THEN 1 ELSE 0 END) OVER w AS marked, first_value(nm) OVER (PARTITION BY tid, gen ORDER BY o) AS gname
   FROM g WINDOW w AS (PARTITION BY tid, gen ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 z AS (SELECT *, max(CASE WHEN role = 'exit' OR (role = 'hand' AND marked = 1) THEN 1 ELSE 0 END)
   OVER (PARTITION BY tid, gen ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS dead FROM t),
 named AS (SELECT seq, tid, cpu, CASE WHEN gen = 0 OR role = 'less' OR dead = 1 THEN '' ELSE gname END AS name FROM z WHERE seq IS NOT NULL)"""
)


def life(spark, sf_dir, ev=None):
    ev = events(spark, sf_dir).select("seq", "tid", "cpu", "event_type") if ev is None else ev
    role = per_type(error=names.EXIT, purchase=names.TERMINATE, click=names.HANDOFF, signup=names.NAMELESS)
    execs = ev.filter(F.col("event_type") == "signup").select("seq", "tid", F.concat(F.lit("c"), F.col("seq").cast("string")).alias("name"))
    return names.thread_names(ev, names.definitions(initial_map(spark, sf_dir), execs), role)


@query(
    "thread_names",
    f"""WITH {LIFE_SQL} SELECT seq, tid, CASE WHEN r.r_regionkey IS NOT NULL THEN r_name ELSE name END AS name
FROM named LEFT JOIN region r ON r.r_regionkey = cpu AND r.r_regionkey % 4 = 3""",
)
def thread_names(spark, sf_dir):
    cpu_map = table(spark, sf_dir, "region").select(
        F.col("r_regionkey").cast("long").alias("cpu_id"),
        F.when(F.col("r_regionkey") % 4 == 3, 1).otherwise(0).cast("long").alias("flags"),
        F.col("r_name").alias("name"),
    )
    return names.coprocessor_names(life(spark, sf_dir), cpu_map).select("seq", "tid", "name")


@query("ring_names", f"WITH {LIFE_SQL} SELECT seq, tid, name FROM named")
def ring_names(spark, sf_dir):
    """Names across the wrap of a ring file: those learned before it hold behind it."""
    rows = events(spark, sf_dir).select("seq", "ts", "tid", "cpu", "event_type")
    ordered = settle(order.true_order(rotated(spark, sf_dir, rows)).drop("file_seq", "ts"))
    return life(spark, sf_dir, ordered).select("seq", "tid", "name")


@query(
    "thread_creation",
    f"""WITH {EVENTS_SQL}, c AS (SELECT seq, tid AS creator, CASE WHEN event_type = 'click' THEN 1 ELSE -1 END AS way FROM ev WHERE event_type IN ('click', 'signup')),
 s AS (SELECT *, sum(way) OVER (PARTITION BY creator ORDER BY seq) AS sm FROM c),
 l AS (SELECT *, sm - least(0, min(sm) OVER (PARTITION BY creator ORDER BY seq)) + CASE WHEN way = 1 THEN 0 ELSE 1 END AS lvl FROM s),
 p AS (SELECT *, lag(way) OVER w AS pway, lag(seq) OVER w AS pseq FROM l WINDOW w AS (PARTITION BY creator, lvl ORDER BY seq))
SELECT seq, creator, pseq + 1000 AS tid, 'c' || seq AS name FROM p WHERE way = -1 AND pway = 1""",
)
def thread_creation(spark, sf_dir):
    kind = F.col("event_type")
    return names.new_thread_names(
        events(spark, sf_dir),
        kind == "click",
        kind == "signup",
        F.col("seq") + 1000,
        F.concat(F.lit("c"), F.col("seq").cast("string")),
    ).drop("new_seq")


OWNED_SQL = """ow AS (
  SELECT seq * 2 AS o, seq * 7 % 64 AS tid, user_id % 16 AS pid FROM ev WHERE event_type = 'view'
  UNION ALL SELECT seq * 2 + 1, tid, seq % 16 FROM ev WHERE event_type = 'view'
  UNION ALL SELECT seq * 2 + 1, tid, user_id % 16 FROM ev WHERE event_type = 'click'),
 own AS (SELECT tid, arg_max(pid, o) AS pid FROM ow GROUP BY tid)"""


def owned(spark, sf_dir):
    ev = events(spark, sf_dir)
    rows = ev.select(
        "seq",
        "tid",
        per_type(view=0x01400108, click=0x32400040).cast("long").alias("debugid"),
        (F.col("seq") * 7 % 64).alias("arg1"),
        (F.col("user_id") % 16).alias("arg2"),
        codec.pack_halves(F.col("user_id") % 16, F.col("seq") % 16).alias("arg4"),
    )
    return names.owner_events(rows)


PROCS_SQL = "procs AS (SELECT c_custkey % 32 * 3 AS pid, substr(arg_max(c_name, c_custkey), 1, 16) AS command FROM customer GROUP BY 1)"


def processes(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select((F.col("c_custkey") % 32 * 3).alias("pid"), "c_name", "c_custkey")
    return rows.groupBy("pid").agg(codec.command16(F.max_by("c_name", "c_custkey")).alias("command"))


@query("owner_map", f"WITH {EVENTS_SQL}, {OWNED_SQL} SELECT tid, pid FROM own")
def owner_map(spark, sf_dir):
    return names.owners(owned(spark, sf_dir))


@query(
    "owner_as_of",
    f"""WITH {EVENTS_SQL}, {OWNED_SQL}, t AS (SELECT tid, o, max(pid) AS pid FROM ow GROUP BY 1, 2)
SELECT seq, ev.tid AS tid, t.pid AS owner_pid FROM ev ASOF LEFT JOIN t ON ev.tid = t.tid AND ev.seq * 2 + 1 >= t.o""",
)
def owner_as_of(spark, sf_dir):
    return names.owner_as_of(events(spark, sf_dir).select("seq", "tid"), owned(spark, sf_dir))


LEARNED_SQL = "nm AS (SELECT user_id % 64 AS tid, arg_max('n' || seq, seq) AS name, max(seq) AS o FROM ev WHERE event_type = 'signup' GROUP BY 1)"

RESOLVED_SQL = f"""{EVENTS_SQL}, {OWNED_SQL}, {PROCS_SQL}, {LEARNED_SQL},
 taught AS (SELECT pid, arg_max(name, nm.o) AS name FROM own JOIN nm USING (tid) GROUP BY pid),
 res AS (SELECT own.tid AS tid, own.pid AS pid, coalesce(procs.command, taught.name) AS command
   FROM own LEFT JOIN procs ON own.pid = procs.pid LEFT JOIN taught ON own.pid = taught.pid WHERE coalesce(procs.command, taught.name) IS NOT NULL)"""


def learned(spark, sf_dir):
    ev = events(spark, sf_dir).filter(F.col("event_type") == "signup")
    return ev.select(F.col("seq").alias("order"), "tid", F.concat(F.lit("n"), F.col("seq").cast("string")).alias("name"))


def resolved(spark, sf_dir):
    return names.resolved_map(owned(spark, sf_dir), learned(spark, sf_dir), processes(spark, sf_dir))


@query(
    "resolved_map",
    f"WITH {RESOLVED_SQL} SELECT lower(to_hex(tid)) || chr(9) || lower(to_hex(pid)) || chr(9) || command AS value FROM res",
)
def resolved_map(spark, sf_dir):
    return names.map_lines(resolved(spark, sf_dir))


@query(
    "event_commands",
    f"""WITH {RESOLVED_SQL} SELECT seq, ev.tid AS tid, CASE WHEN arg1 % 4 = 0 THEN 'own' ELSE coalesce(command, '') END AS command
FROM ev LEFT JOIN res ON ev.tid = res.tid""",
)
def event_commands(spark, sf_dir):
    ev = events(spark, sf_dir).select("seq", "tid", F.when(F.col("arg1") % 4 == 0, "own").otherwise("").alias("name"))
    return names.command_of(ev, resolved(spark, sf_dir)).select("seq", "tid", "command")


@query(
    "missing_threads",
    f"""WITH {RESOLVED_SQL}, asked AS (SELECT DISTINCT user_id * 5 % 160 AS tid FROM ev)
SELECT 'tid' AS kind, tid AS id FROM asked WHERE tid NOT IN (SELECT tid FROM res) AND tid NOT IN (SELECT tid FROM own)
UNION ALL SELECT DISTINCT 'pid', pid FROM own WHERE tid IN (SELECT tid FROM asked) AND pid NOT IN (SELECT pid FROM res) AND pid NOT IN (SELECT pid FROM procs)""",
)
def missing_threads(spark, sf_dir):
    asked = events(spark, sf_dir).select((F.col("user_id") * 5 % 160).alias("tid"))
    return names.missing(asked, owned(spark, sf_dir), resolved(spark, sf_dir), processes(spark, sf_dir))


CUT_US = 883_612_800_000_000  # 1998-01-01


def _lists(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("pid"), F.col("o_orderpriority").alias("command"), F.col("o_orderkey").alias("line"), "o_orderdate"
    )
    early = F.col("o_orderdate") < CUT_US
    return rows.filter(early).drop("o_orderdate"), rows.filter(~early).drop("o_orderdate")


@query(
    "snapshot_diff",
    f"""WITH b AS (SELECT o_custkey AS pid, arg_max(o_orderpriority, o_orderkey) AS old FROM orders WHERE epoch_us(o_orderdate) < {CUT_US} GROUP BY 1),
 a AS (SELECT o_custkey AS pid, arg_max(o_orderpriority, o_orderkey) AS new FROM orders WHERE epoch_us(o_orderdate) >= {CUT_US} GROUP BY 1)
SELECT coalesce(a.pid, b.pid) AS pid, old, new, CASE WHEN old IS NULL THEN 'started' WHEN new IS NULL THEN 'ended' WHEN old <> new THEN 'renamed' ELSE 'same' END AS change
FROM b FULL JOIN a ON a.pid = b.pid""",
)
def snapshot_diff(spark, sf_dir):
    return names.snapshot_diff(*_lists(spark, sf_dir))


@query(
    "snapshot_overlay",
    f"SELECT o_custkey AS pid, arg_max(o_orderpriority, (CASE WHEN epoch_us(o_orderdate) < {CUT_US} THEN 0 ELSE 1 END, o_orderkey)) AS command FROM orders GROUP BY 1",
)
def snapshot_overlay(spark, sf_dir):
    return names.overlay(*_lists(spark, sf_dir))
