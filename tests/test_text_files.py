"""Text readers and sinks on small files with exact results."""

import pytest
from pyspark.sql import functions as F

from spanloom.operators import graph
from spanloom.sinks.text import report_lines, write_lines, write_report
from spanloom.sources import text


def put(tmp_path, name, content):
    path = tmp_path / name
    path.write_text(content)
    return str(path)


def test_line_positions_over_many_splits(spark, tmp_path):
    lines = [f"line {i} {'x' * (i % 50)}" for i in range(5000)]
    for n in range(3):
        put(tmp_path, f"part{n}.txt", "\n".join(lines[n * 2000 : (n + 1) * 2000]) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        got = [(r.seq, r.line) for r in text.read_lines(spark, str(tmp_path)).orderBy("seq").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == list(enumerate(lines))


def test_codes(spark, tmp_path):
    first = put(tmp_path, "a.codes", "0x010C007C\tMSC_trap  \n\n  10 spaced name\n0x0\tzero\n0x20\nbad line? no\n0xAbC x\n")
    second = put(tmp_path, "b.codes", "0x10\tagain\n")
    rows = text.read_codes(spark, [first, second]).orderBy("source", "line").collect()
    assert [(r.debugid, r.name, r.source, r.line) for r in rows] == [
        (0x010C007C, "MSC_trap", "0000", 1),
        (0x10, "spaced name", "0000", 3),
        (0xBAD, "line? no", "0000", 6),
        (0xABC, "x", "0000", 7),
        (0x10, "again", "0001", 1),
    ]


def test_filters(spark, tmp_path):
    good = put(tmp_path, "good", "# note\n\nC 0x01\nS 0x0321\n")
    assert sorted(tuple(r) for r in text.read_filters(spark, good).collect()) == [(256, 511), (0x321, 0x321)]
    for line in ("C 0x100", "S 0x10000", "X 1", "C one"):
        with pytest.raises(Exception, match="bad filter line"):
            text.read_filters(spark, put(tmp_path, "bad", line + "\n")).collect()


def test_processes_and_images(spark, tmp_path):
    procs = put(tmp_path, "procs", " 12 Some App With A Long Name\n13 \n7 sh\nnot a pid\n")
    assert [(r.pid, r.command) for r in text.read_processes(spark, procs).orderBy("line").collect()] == [(12, "Some App With A "), (7, "sh")]
    images = put(tmp_path, "images", "0x1 /early\nDumpProcess 1f x86_64 My App\n0xffffffffff000000 /usr/lib/a b\nDumpProcess 20 i386 other\n0x10 /b\n")
    got = [tuple(r)[1:] for r in text.read_images(spark, images).orderBy("seq").collect()]
    assert got == [(0x1F, "x86_64", "My App", -0x1000000, "/usr/lib/a b"), (0x20, "i386", "other", 0x10, "/b")]


CLUSTER = """before any header
#Cluster ab1(num of groups = 2)
1.5\tab1\tApp_1\tactivate
2.5\tab1\tApp_1\tsend\t3.5\tcd2\tPeer_2
broken row
3.0\tcd2\tPeer_2\tactivate
#Cluster ef(num of groups = 1f)
9.0\tef\tLone\tsend\t9.5\t99\tGone
"""


def test_clusters(spark, tmp_path):
    headers, edges, rejected = text.read_clusters(spark, put(tmp_path, "c.pic", CLUSTER))
    assert [(r.cluster, r.declared) for r in headers.orderBy("seq").collect()] == [("ab1", 2), ("ef", 0x1F)]
    rows = edges.orderBy("seq").collect()
    assert [(r.cluster, r.ts, r.host_gid, r.action, r.peer_gid, r.peer_name) for r in rows] == [
        ("ab1", 1.5, 0xAB1, "activate", None, None),
        ("ab1", 2.5, 0xAB1, "send", 0xCD2, "Peer_2"),
        ("ab1", 3.0, 0xCD2, "activate", None, None),
        ("ef", 9.0, 0xEF, "send", 0x99, "Gone"),
    ]
    assert [r.line for r in rejected.collect()] == ["broken row"]
    check = {r.cluster: tuple(r)[1:] for r in graph.cluster_check(edges, headers.select("cluster", "declared")).collect()}
    assert check == {"ab1": (2, 2, True, 0), "ef": (0x1F, 1, False, 1)}


def test_diagram_text(spark, tmp_path):
    edges = text.read_clusters(spark, put(tmp_path, "c.pic", CLUSTER))[1]
    lines = graph.participant_lines(edges, ["cluster"]).orderBy("cluster", "place", "pos", "who")
    assert [r.value for r in lines.filter("cluster = 'ab1'").collect()] == [
        "@startuml",
        "activate App_1",
        "activate Peer_2",
        "activate App_1",
        "create Peer_2",
        "App_1 -> Peer_2: send",
        "activate Peer_2",
        "deactivate App_1",
        "deactivate Peer_2",
        "@enduml",
    ]
    out = tmp_path / "diagrams"
    write_lines(graph.participant_lines(edges, ["cluster"]), str(out), ["place", "pos", "who"], ["cluster"])
    files = sorted((out / "cluster=ef").glob("part-*"))
    assert "".join(f.read_text() for f in files).splitlines()[0] == "@startuml"


def test_chart_file_ends_at_first_bad_row(spark, tmp_path):
    content = "#Cluster 103 one(x)\n1 0.5 a proc act 0xb\n1 0.6 b proc act\n2 0.7 a proc backtrace_1\n2 0.8 a proc more\nbad\n1 0.9 a proc late\n#Cluster 5\n1 1 1 p q\n"
    rows = text.read_chart_clusters(spark, put(tmp_path, "m.pic", content), "103")
    got = [(r.gid, r.ts, r.tid, r.action, r.peer_tid) for r in rows.orderBy("seq").collect()]
    assert got == [(1, 0.5, 10, "act", 11), (1, 0.6, 11, "act", 0), (2, 0.7, 10, "backtrace_1", 0), (2, 0.8, 10, "more", 0)]
    lines = graph.chart_lines(rows, ["cluster"]).orderBy("place", "pos", "who").collect()
    assert [r.value for r in lines] == [
        "msc {",
        'proc10 [label="proc10", textbgcolor = "orange"],',
        'proc11 [label="proc11", textbgcolor = "orange"];',
        'proc10 abox proc10 [label="1\\nact\\nact\\n", textbgcolor="aquamarine"];',
        'proc10 note proc10[label="backtrace_1", textbgcolour="burlywood"];',
        'proc10 abox proc10 [label="2\\nmore\\n", textbgcolor="burlywood"];',
        "}",
    ]


def test_message_log(spark, tmp_path):
    gap = "    "
    rows = [
        "####one####",
        gap.join(["", "mach_msg_send", "10.0", "a", "x", "b", "l6", "l7", "20000"]),
        gap.join(["", "mach_msg_kernel_request", "60.0", "a", "x", "b", "l6", "l7", "5"]),
        gap.join(["", "mach_msg_recv", "500.0", "c", "x", "a", "l6", "l7"]),
        gap.join(["", "mystery", "600.0", "c", "x", "a", "l6", "l7"]),
        "####two####",
        gap.join(["", "voucher_create", "700.0", "v", "x", "w", "l6", "l7"]),
    ]
    messages, unknown = text.read_message_log(spark, put(tmp_path, "log", "\n".join(rows) + "\n"))
    from spanloom.functions import codec
    from spanloom.operators.order import message_gaps

    timed = message_gaps(messages, ["section"]).withColumn("arrow", codec.message_arrow(F.col("op"), F.col("delay")))
    lines = graph.message_log_lines(timed, ["section"]).orderBy("section", "pos").collect()
    assert [r.value for r in lines] == [
        "||0||", "a-[#0000FF]>b:l7 20000", "||50||", "a-[#red]>a:l6 l7 5", "... 440micro seconds later ...", "hnote over c:l7", "||0||", "v-[#red]>w:l7",
    ]
    assert unknown.count() == 1


def test_steps(spark, tmp_path):
    content = "* thread #1: x`f + 4, queue = 'q'\n-> 0x1: push\n-> 0x2: mov\n* thread #1: x`g, queue = 'q'\n-> 0x3: retq\n"
    steps = text.read_steps(spark, put(tmp_path, "steps", content))
    assert [(r.symbol, r.asm) for r in steps.orderBy("seq").collect()] == [("f", "-> 0x1: push"), ("f", "-> 0x2: mov"), ("g", "-> 0x3: retq")]
    assert sorted((r.symbol, r.insts) for r in graph.symbol_runs(steps, [], "symbol").collect()) == [("f", 2), ("g", 1)]


def decoded(spark):
    rows = [
        (0, 0, 12.34, 12.34, None, "0x name", None, None, 1, 2, 3, 255, 16, 1, 0x040C0000, "cmd"),
        (1, 0, 20.0, 7.66, 5.25, "a" * 40, None, None, -1, 0, 0, 0, 16, 12, 0x040C0002, ""),
        (2, 1, 3.0, -17.0, None, "lookup", 10, "/" + "p" * 60, 0, 0, 0, 0, 17, 0, 0x03010092, "cmd"),
        (3, 1, 4.0, 1.0, 24448749356.25, "info", None, None, 0x6F6C6C6568, 0, 0, 0, 17, 0, 0x07020010, "cmd"),
    ]
    names = "seq long, segment long, us double, delta_us double, elapsed_us double, label string, dvp long, path string"
    return spark.createDataFrame(rows, names + ", arg1 long, arg2 long, arg3 long, arg4 long, tid long, cpu long, debugid long, command string")


def test_report_lines(spark, tmp_path):
    got = [r.value for r in report_lines(decoded(spark)).orderBy("seq").collect()]
    args = lambda *a: "".join(f"{x:<16} " for x in a) + " "
    blank = " " * 13
    assert got == [
        f"{12.3:13.1f} {12.3:10.1f}{blank}{'0x name':<28}  " + args("1", "2", "3", "ff") + f"{'10':<16}  1  cmd",
        f"{20.0:13.1f} {7.7:10.1f}{'(5.3)':<12} {'a' * 28}  " + args("f" * 16, "0", "0", "0") + f"{'10':<16}  12 ",
        f"{3.0:13.1f} {-17.0:10.1f}{blank}{'lookup':<28}  {'a':<16} {'p' * 51} {'11':<16}  0  cmd",
        f"{4.0:13.1f} {1.0:10.1f}(24448749356.3) {'info':<28}  {'hello':<32}{'':<36} {'11':<16}  0  cmd",
    ]
    write_report(decoded(spark), str(tmp_path / "report"))
    tail = "".join(f.read_text() for f in sorted((tmp_path / "report" / "segment=1").glob("part-*"))).splitlines()
    assert tail == ["Begin the next line", *got[2:]]
