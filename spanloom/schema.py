"""Schemas of event records and their side tables.

64-bit arguments keep their bit pattern in a signed LONG; timestamps of the
driver tables are read as LONG microseconds, so no session time zone matters.
"""

EVENT = "seq long, ts long, arg1 long, arg2 long, arg3 long, arg4 long, tid long, debugid long, cpu int"
THREAD_MAP = "tid long, valid int, command string"
CPU_MAP = "cpu_id long, flags long, name string"
CODES = "debugid long, name string, source string, line long"
PROCESSES = "pid long, command string"
IMAGES = "pid long, arch string, comm string, load_addr long, path string"

TABLES = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey long, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate long, "
    "o_orderpriority string",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate long",
    "events": "event_id long, ts long, user_id long, event_type string, value double, props string",
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "pages": "page_id long, url string, html string",
    "conversations": "conv_id long, turn long, role string, text string",
}
