"""From files to files: raw decode with all side files, and cluster files to diagrams."""

from pyspark.sql import functions as F
from test_raw import encode
from test_state_machines import text_words

from spanloom import fixed_values as fv
from spanloom.operators.filters import in_ranges, type_ranges
from spanloom.plans import decode, diagrams
from spanloom.sinks.text import write_report, write_thread_map
from spanloom.sources import raw


def lines_of(folder):
    return "".join(f.read_text() for f in sorted(folder.glob("part-*"))).splitlines()


def capture(tmp_path):
    path = text_words("/usr/lib/libSystem.dylib")
    rows = [
        (100, 1, 2, 3, 4, 7, 0x040C0011, 0),  # start on thread 7
        (110, 9, *path[:3], 7, fv.VFS_LOOKUP + 1, 0),  # look-up begins
        (120, *[path[3], 0, 0, 0], 7, fv.VFS_LOOKUP + 2, 0),  # and ends
        (130, 0, 0, 0, 0, 7, 0x040C0012, 0),  # end on thread 7: 30 ticks
        (140, 55, 0, 0, 0, 7, fv.NEW_THREAD_DATA, 0),  # thread 55 announced, suppressed
        (150, *text_words("child"), 7, fv.NEW_THREAD_NAME, 0),  # and named, suppressed
        (160, 0, 0, 0, 0, 55, 0x01020304, 1),
        (170, 8, 0, 0, (42 << 32) | 43, 60, 0x01400108, 0),  # threads 8 and 60 belong to 42 and 43
        (180, 0, 0, 0, 0, 8, 0x01020304, 0),
        (190, 0, 0, 0, 0, 8, 0x01020304, 3),  # on the coprocessor
        (50, *text_words("note"), 7, fv.INFO_STRING, 0),  # ring wrapped
    ]
    (tmp_path / "trace.raw").write_bytes(encode(rows, threads=[(7, 1, "parent")], cpus=[(3, 1, "IOP3")]))
    (tmp_path / "codes").write_text("0x040C0010\tBSC_call\n0x03010090\tVFS_LOOKUP\n0x01020304\tTICK\n")
    (tmp_path / "before").write_text("42 old name\n")
    (tmp_path / "after").write_text("42 daemon\n")
    return str(tmp_path / "trace.raw"), [str(tmp_path / "codes")], str(tmp_path / "before"), str(tmp_path / "after")


def test_decode_files(spark, tmp_path, small_blocks):
    raw_path, codes, before, after = capture(tmp_path)
    shown, threads = decode.decode_files(spark, raw_path, codes, before, after, divisor=10.0)
    rows = {r.seq: r for r in shown.collect()}
    assert sorted(rows) == [0, 2, 3, 6, 7, 8, 9, 10]
    assert (rows[2].path, rows[2].dvp, rows[2].delta_us) == ("/usr/lib/libSystem.dylib", 9, 2.0)
    assert (rows[3].elapsed_us, rows[3].label) == (3.0, "BSC_call") and rows[0].elapsed_us is None
    assert [rows[s].command for s in (0, 6, 7, 8, 9, 10)] == ["parent", "child", "", "daemon", "IOP3", "parent"]
    # The suppressed records count as the ones before.
    assert rows[6].delta_us == 1.0 and rows[7].label == "1400108"
    assert [rows[s].segment for s in (9, 10)] == [0, 1] and rows[10].delta_us == -14.0
    write_report(shown, str(tmp_path / "report"), paged=True)
    body = lines_of(tmp_path / "report" / "segment=0")
    assert body[0].startswith("   AbsTime(Us)") and body[1] == "" and body[2].startswith("         10.0       10.0")
    assert lines_of(tmp_path / "report" / "segment=1")[0] == fv.WRAP_MARKER
    assert write_thread_map(threads, str(tmp_path / "maps")) == 1
    assert lines_of(tmp_path / "maps") == ["8\t2a\tdaemon"]


def test_decode_verbose_and_relative(spark, tmp_path):
    raw_path, codes, before, after = capture(tmp_path)
    shown, _ = decode.decode_files(spark, raw_path, codes, before, after, verbose=True, relative=True)
    rows = {r.seq: r for r in shown.collect()}
    assert sorted(rows) == [0, 2, 3, 4, 5, 6, 7, 8, 9, 10]
    assert (rows[0].us, rows[0].delta_us, rows[3].us) == (0.0, 0.0, 30.0)


def test_decode_of_some_processes(spark, tmp_path):
    raw_path, codes, before, after = capture(tmp_path)
    only, _ = decode.decode_files(spark, raw_path, codes, before, after, include=[42])
    assert sorted(r.seq for r in only.collect()) == [8, 9]
    others, _ = decode.decode_files(spark, raw_path, codes, before, after, exclude=[42])
    assert sorted(r.seq for r in others.collect()) == [0, 2, 3, 6, 7, 10]


def test_raw_type_filter(spark, tmp_path):
    raw_path, *_ = capture(tmp_path)
    kept = in_ranges(raw.read_raw(spark, raw_path, splitbytes=100), type_ranges(classes=[4], subclasses=[(1, 2)]))
    assert sorted(r.seq for r in kept.collect()) == [0, 3, 6, 8, 9]


def test_sequence_diagrams_in_parts(spark, tmp_path, small_blocks):
    rows = []
    for c in (1, 2):
        rows.append(f"#Cluster c{c}(num of groups = 1)")
        rows += [f"{c}.{i}\t{c}\tHost_{c}\tsend\t9.9\t{c}\tPeer_{c}{i}" for i in range(6)]
    rows.insert(3, "an unknown row here now")
    (tmp_path / "in.pic").write_text("\n".join(rows) + "\n")
    lines = diagrams.sequence_diagrams(spark, str(tmp_path / "in.pic"), rows=5)
    sent = lines.filter(F.col("value").contains("->")).orderBy("pos").collect()
    # Thirteen data rows, the third unknown: row 5 opens part 1 and row 10 opens part 2.
    assert [r.diagram[8:] for r in sent] == ["c1_part_0"] * 3 + ["c1_part_1"] * 3 + ["c2_part_0"] * 2 + ["c2_part_2"] * 4
    diagrams.write_sequence_diagrams(spark, str(tmp_path / "in.pic"), str(tmp_path / "out"))
    assert sorted(p.name for p in (tmp_path / "out").glob("diagram=*")) == ["diagram=Cluster_c1_part_0", "diagram=Cluster_c2_part_0"]


def test_message_charts(spark, tmp_path):
    (tmp_path / "m.pic").write_text("#Cluster 103 two(x)\n1 0.5 a proc act\n#Cluster 7(y)\n1 0.5 a proc act\n")
    charts = diagrams.message_charts(spark, str(tmp_path / "m.pic"), "103")
    assert {r.chart for r in charts.collect()} == {"Cluster_103_two"}


def test_message_log_diagrams(spark, tmp_path):
    gap = " " * 4
    rows = ["####a####", gap.join(["", "mach_msg_send", "1.0", "p", "-", "q", "x", "y", "3.0"])]
    (tmp_path / "log").write_text("\n".join(rows) + "\n")
    assert [r.value for r in diagrams.message_log_diagrams(spark, str(tmp_path / "log")).orderBy("pos").collect()] == ["||0||", "p-[#red]>q:y 3.0"]
