"""Span pairing, naming, paths and ring order against sequential state machines."""

import random

import pytest
from pyspark.sql import functions as F

from spanloom import fixed_values as fv
from spanloom.functions import codec
from spanloom.operators import assemble, filters, links, names, order, spans
from spanloom.plans import decode

IDS = [0x040C0010, fv.MAKE_RUNNABLE, fv.THREAD_TERMINATE, fv.SYSCALL_EXIT, fv.SCHEDULED, fv.STACK_HANDOFF]
RECORD = "seq long, ts long, arg1 long, arg2 long, arg3 long, arg4 long, tid long, debugid long, cpu int"


def records(seed, n=600):
    pick = random.Random(seed)
    ts, out = 10, []
    for seq in range(n):
        ts += pick.randrange(0, 4)
        tid = 0 if pick.random() < 0.34 else pick.randrange(1, 5)
        out.append((seq, ts, pick.randrange(5), pick.randrange(5), 0, 0, tid, pick.choice(IDS) + pick.randrange(4), 0))
    return out


def paired(data):
    """Open STARTs by (thread, id); ending records and their elapsed time."""
    opened, ended = {}, {}
    for seq, ts, arg1, arg2, _, _, tid, debugid, _ in data:
        base = debugid & 0xFFFFFFFC
        if debugid & 1 or debugid == fv.MAKE_RUNNABLE:
            if base not in (fv.THREAD_TERMINATE, fv.SYSCALL_EXIT):
                opened[arg1 if debugid == fv.MAKE_RUNNABLE else tid, base] = ts
        elif debugid & 2 or debugid in (fv.STACK_HANDOFF, fv.SCHEDULED):
            ran = debugid in (fv.STACK_HANDOFF, fv.SCHEDULED)
            start = opened.pop((arg2, fv.MAKE_RUNNABLE) if ran else (tid, base), None)
            elapsed = 0 if start is None else ts - start
            if not ran or elapsed:
                ended[seq] = elapsed
    return ended


@pytest.mark.parametrize("seed", [11, 12, 13])
def test_all_spans(spark, small_blocks, seed):
    data = records(seed)
    df = spark.createDataFrame(data, RECORD).repartition(3)
    assert {r.seq: r.elapsed for r in decode.all_spans(df).collect()} == paired(data)


def test_code_spans_and_run_queue(spark, small_blocks):
    data = records(14)
    df = spark.createDataFrame(data, RECORD)
    plain = [r for r in data if r[7] not in (fv.MAKE_RUNNABLE, fv.SCHEDULED, fv.STACK_HANDOFF)]
    assert {r.seq: r.elapsed for r in spans.code_spans(df).collect()} == paired(plain)
    exact = [r for r in data if r[7] in (fv.MAKE_RUNNABLE, fv.SCHEDULED, fv.STACK_HANDOFF)]
    assert {r.seq: r.elapsed for r in spans.run_queue_spans(df).collect()} == paired(exact)


def test_exact_percentiles(spark, small_blocks):
    pick = random.Random(15)
    data = [("a" if pick.random() < 0.7 else "b", pick.randrange(40)) for _ in range(300)]
    df = spark.createDataFrame(data, "k string, elapsed long")
    got = {r.k: (r.n, r.total_us, r.max_us, r.p50_us, r.p95_us) for r in spans.span_stats(df, ["k"]).collect()}
    for k in "ab":
        v = sorted(x for key, x in data if key == k)
        at = lambda share: next(x for i, x in enumerate(v, 1) if i * 1000 >= len(v) * share)
        assert got[k] == (len(v), sum(v), v[-1], at(500), at(950))


def text_words(text):
    raw = text.encode().ljust(32, b"\0")[:32]
    return [int.from_bytes(raw[i : i + 8], "little", signed=True) for i in range(0, 32, 8)]


def named(data, initial):
    """Names as of each record: pending stack per creator, marks, deletions."""
    name, marked, pending, out = dict(initial), set(), [], {}
    for seq, _, arg1, _, _, _, tid, debugid, _, text in data:
        base = debugid & 0xFFFFFFFC
        out[seq] = ""
        if base in (fv.SYSCALL_EXIT, fv.STACK_HANDOFF):
            out[seq] = name.get(tid, "")
            if base == fv.SYSCALL_EXIT or tid in marked:
                name.pop(tid, None)
                marked.discard(tid)
        elif base == fv.NEW_THREAD_DATA:
            pending.append((arg1, tid))
        elif base == fv.NEW_THREAD_NAME:
            for i in range(len(pending) - 1, -1, -1):
                if pending[i][1] == tid:
                    name[pending[i][0]] = text[:16]
                    marked.discard(pending[i][0])
                    del pending[i]
                    break
        elif base == fv.EXEC_NAME:
            name[tid] = text[:16]
            marked.discard(tid)
        else:
            out[seq] = name.get(tid, "")
            if base == fv.THREAD_TERMINATE and tid in name:
                marked.add(tid)
    return out


@pytest.mark.parametrize("seed", [21, 22, 23])
@pytest.mark.parametrize("wide", [False, True])
def test_thread_names(spark, small_blocks, seed, wide):
    pick = random.Random(seed)
    kinds = [fv.SYSCALL_EXIT, fv.STACK_HANDOFF, fv.NEW_THREAD_DATA, fv.NEW_THREAD_NAME, fv.EXEC_NAME, fv.THREAD_TERMINATE, 0x040C0010, 0x01400020]
    data = []
    for seq in range(400):
        tid = 0 if pick.random() < 0.34 else pick.randrange(1, 6)
        kind, text = pick.choice(kinds), f"name-{seq}-of-a-thread"
        words = text_words(text)
        if kind == fv.NEW_THREAD_DATA:
            words[0] = pick.randrange(0, 6)
        data.append((seq, seq, *words, tid, kind, 0, text))
    initial = {t: f"first{t}" for t in (1, 3, 4)}
    df = spark.createDataFrame([r[:9] for r in data], RECORD).repartition(3)
    first = spark.createDataFrame([(i, t, "old") for i, t in enumerate(initial)] + [(9, t, n) for t, n in initial.items()], "entry long, tid long, name string")
    defined = names.definitions(first, decode.exec_names(df), decode.created_threads(df))
    rows = df if wide else df.select("seq", "tid", names.name_role(F.col("debugid")).alias("role"))
    role = names.name_role(F.col("debugid")) if wide else F.col("role")
    got = {r.seq: r["name"] for r in names.thread_names(rows, defined, role).collect()}
    assert got == named(data, initial)


def paths_of(data):
    held, out = {}, {}
    for seq, _, *args, tid, debugid, _ in data:
        if debugid & 1:
            held[tid] = [args[0], list(args[1:])]
        elif tid not in held:
            continue
        elif len(held[tid][1]) <= fv.PATH_WORDS - 4:
            held[tid][1] += args
        if debugid & 2:
            dvp, words = held.pop(tid)
            raw = b"".join(w.to_bytes(8, "little", signed=True) for w in words)
            out[seq] = (dvp, raw.split(b"\0")[0].decode("utf-8", "replace"))
    return out


@pytest.mark.parametrize("seed", [31, 32])
def test_paths(spark, small_blocks, seed):
    pick = random.Random(seed)
    data = []
    for seq in range(500):
        tid = 0 if pick.random() < 0.34 else pick.randrange(1, 5)
        words = [int.from_bytes(bytes(pick.choices(b"abcdefg/", k=8)), "little") for _ in range(4)]
        if pick.random() < 0.1:
            words[3] = int.from_bytes(b"xyz\0\xff\0\0\0", "little")
        q = pick.choices([0, 1, 2, 3], weights=[10, 3, 2, 1])[0]
        data.append((seq, seq, *words, tid, fv.VFS_LOOKUP + q, 0))
    df = spark.createDataFrame(data, RECORD).repartition(3)
    got = {r.end_seq: (r.dvp, r.path) for r in assemble.paths(df).collect()}
    assert got == paths_of(data)


def test_chunk_texts(spark, small_blocks):
    rows = [
        (0, 1, 5, "abc"), (1, 1, 5, "def"), (2, 2, 5, "other thread\0"), (3, 1, 6, "new tag"), (4, 1, 5, "old tag"),
        (5, 1, 5, "end\0junk"), (6, 1, 5, "next"), (7, 2, 9, "x"),
    ]
    df = spark.createDataFrame(rows, "seq long, tid long, tag long, chunk string")
    got = assemble.chunk_texts(df, F.col("tag"), F.col("chunk")).collect()
    assert sorted((r.tid, r.start_seq, r.tag, r.text, r.n) for r in got) == [
        (1, 0, 5, "abcdef", 2),
        (1, 3, 6, "new tag", 1),
        (1, 4, 5, "old tagend", 2),
        (1, 6, 5, "next", 1),
        (2, 2, 5, "other thread", 1),
        (2, 7, 9, "x", 1),
    ]


def test_characters_cross_records(spark, small_blocks):
    text = "x" * 31 + "\u00e9" + "y" * 30 + "\u6f22\U0001f600 end"
    data = text.encode()
    rows = [(k, 1, data[32 * k : 32 * k + 32].ljust(32, b"\0")) for k in range(len(data) // 32 + 1)]
    rows.append((90, 2, b"broken \xff\xc3\0"))
    df = spark.createDataFrame([(s, t, bytearray(c)) for s, t, c in rows], "seq long, tid long, chunk binary")
    got = assemble.chunk_texts(df, F.lit(1), F.col("chunk")).collect()
    assert {r.tid: r.text for r in got} == {1: text, 2: "broken \ufffd\ufffd"}


def test_stitched_parts_keep_all_arguments(spark):
    rows = [(0, 1, 8, 2, 5, 6, 7), (1, 1, 8, (1 << 32) + 2, 15, 16, 17), (2, 1, 8, (1 << 32) + 2, 1, 1, 1)]
    df = spark.createDataFrame(rows, "seq long, tid long, eventid long, arg1 long, arg2 long, arg3 long, arg4 long")
    got = links.stitch_parts(df).collect()
    assert [(r.seq, r.a_seq, r.variant, r.a_arg1, r.a_arg2, r.a_arg3, r.a_arg4, r.arg4) for r in got] == [(1, 0, 2, 2, 5, 6, 7, 17)]


def test_command_as_of(spark, small_blocks):
    told = spark.createDataFrame([(11, 1, 100), (41, 1, 200), (51, 2, 300)], "order long, tid long, pid long")
    listed = spark.createDataFrame([(100, "one"), (200, "two"), (900, "none")], "pid long, command string")
    learned = spark.createDataFrame([(60, 2, "taught"), (9, 1, "")], "order long, tid long, name string")
    rows = [(1, 1, ""), (5, 1, ""), (19, 1, ""), (20, 1, ""), (30, 1, "own"), (31, 2, ""), (32, 3, "")]
    df = spark.createDataFrame(rows, "seq long, tid long, name string")
    got = names.command_as_of(df, told, learned, listed).orderBy("seq").collect()
    assert [(r.owner_pid, r.command) for r in got] == [
        (100, "one"), (100, "one"), (100, "one"), (200, "two"), (200, "own"), (300, "taught"), (None, ""),
    ]


def test_library_dump_frames(spark):
    rows = [(0, 0, 0, 0, 0), (1, *text_words("/usr/lib/one.dylib")), (2, -1, -1, -1, -1), (3, 0, 1, 0, 0)]
    df = spark.createDataFrame(rows, "seq long, arg1 long, arg2 long, arg3 long, arg4 long").withColumn("tid", F.lit(1))
    kept = [r.seq for r in df.filter(~assemble.is_frame_marker()).orderBy("seq").collect()]
    assert kept == [1, 3]
    words = codec.words_bytes(*[F.col(f"arg{i}") for i in range(1, 5)])
    framed = assemble.chunk_texts(df.filter("seq < 3"), F.lit(7), words, assemble.is_frame_marker()).collect()
    assert [r.text for r in framed] == ["/usr/lib/one.dylib"]


def test_ring_and_delta(spark, small_blocks):
    times = [5, 9, 9, 20, 3, 4, 8, 1, 2]
    df = spark.createDataFrame(list(enumerate(times)), "seq long, ts long").withColumn("debugid", F.lit(0x040C0000).cast("long"))
    rows = {r.seq: (r.delta, r.segment) for r in order.file_times(df).collect()}
    assert [rows[i] for i in range(9)] == [(5, 0), (4, 0), (0, 0), (11, 0), (-17, 1), (1, 1), (4, 1), (-7, 2), (1, 2)]
    zero = spark.createDataFrame([(0, 0), (1, 7)], "seq long, ts long").withColumn("debugid", F.lit(0x040C0000).cast("long"))
    assert {r.seq: r.delta for r in order.delta_times(zero).collect()} == {0: 0, 1: 7}


def test_owner_events(spark):
    rows = [
        (1, 0, 7, 0, 0, (5 << 32) | 6, 2, 0x01400108, 0),
        (2, 0, 0, 9, 0, 0, 3, 0x32400040, 0),
        (3, 0, 0, 8, 0, 0, 7, 0x01400040, 0),
        (4, 0, 0, 8, 0, 0, 7, 0x01400040 + 1, 0),
    ]
    told = names.owner_events(spark.createDataFrame(rows, RECORD))
    assert sorted((r.order, r.tid, r.pid) for r in told.collect()) == [(2, 7, 5), (3, 2, 6), (5, 3, 9), (7, 7, 8)]
    assert {r.tid: r.pid for r in names.owners(told).collect()} == {7: 8, 2: 6, 3: 9}


def test_filter_arguments(spark):
    df = spark.createDataFrame(records(41, 50), RECORD).withColumn("pid", F.lit(1))
    with pytest.raises(ValueError):
        filters.type_filter(df)
    with pytest.raises(ValueError):
        filters.type_filter(df, classes=[256])
    with pytest.raises(ValueError):
        filters.code_filter(df, [1, 2, 3, 4, 5])
    with pytest.raises(ValueError):
        filters.process_filter(df, include=[1], exclude=[2])
    kept = filters.type_filter(df, ranges=[(1, 3)]).select(codec.event_class(F.col("debugid")).alias("c")).distinct().collect()
    assert [r.c for r in kept] == [1]


def test_codec_bits(spark):
    high_bit = -(1 << 63)
    row = spark.range(1).select(
        codec.hex_text(codec.long_lit(0xFFFFFFFFFFFFFFFE)).alias("h"),
        codec.parse_hex(F.lit("0xFFFFFFFFFFFFFFFE")).alias("p"),
        codec.high_half(codec.long_lit(0xF000000100000002)).alias("hi"),
        codec.low_half(codec.long_lit(0xF0000001F0000002)).alias("lo"),
        codec.is_mig(codec.long_lit((1 << 60) | 5)).alias("mig"),
        codec.plain_msg_id(codec.long_lit((1 << 60) | (1 << 58) | 5)).alias("plain"),
        codec.symbol_of(F.lit("* thread #1: tid = 0x1, 0x2 lib`-[App run] + 640, queue = 'q'")).alias("s1"),
        codec.symbol_of(F.lit("* thread #1: lib`start, queue = 'q'")).alias("s2"),
        codec.symbol_of(F.lit("nothing")).alias("s3"),
        codec.trailing_hex(F.lit("rax = 0x10 0xff")).alias("t"),
        codec.words_text(codec.text_word(F.lit("grüße an alle"), 0), codec.text_word(F.lit("grüße an alle"), 1)).alias("w"),
        codec.wakeup_kind(F.lit(3)).alias("wk"),
        codec.class_name(F.lit(99)).alias("none"),
    ).first()
    assert row.h == "fffffffffffffffe" and row.p == -2 and row.hi == 0xF0000001 and row.lo == 0xF0000002
    assert row.mig and row.plain == 5 and (row.s1, row.s2, row.s3) == ("-[App run]", "start", "UNKNOWN_SYM")
    assert row.t == 255 and row.w == "grüße an alle" and row.wk == "WAKEUP_THR" and row.none is None
    assert high_bit == spark.range(1).select(codec.long_lit(1 << 63).alias("x")).first().x
    assert codec.clock_divisor(125, 3) == 24.0 and codec.clock_divisor(frequency=24_000_000) == 24.0


def test_symbols_of_odd_lines(spark):
    lines = {
        "a`b`-[App run] + 640, queue = 'q+'": "-[App run]",
        "lib`operator+ + 8, queue = 'q'": "operator",
        "lib`start, queue = 'q'": "start",
        "lib`+[App new], queue = 'q'": "+[App new]",
        "lib`, queue = 'q'": "UNKNOWN_SYM",
        "start + 8, queue = 'q'": "UNKNOWN_SYM",
        "": "UNKNOWN_SYM",
    }
    df = spark.createDataFrame([(k,) for k in lines], "line string")
    assert {r.line: r.s for r in df.select("line", codec.symbol_of(F.col("line")).alias("s")).collect()} == lines


def test_links_at_one_time(spark, small_blocks):
    sources = [(1, 10, s, f"a{s}") for s in range(3)] + [(1, 20, 7, "b"), (2, 10, 5, "c")]
    targets = [(1, 10, t) for t in (4, 3)] + [(1, 20, 9), (1, 21, 1), (2, 9, 0)]
    from spanloom.operators import links

    got = links.link_next(
        spark.createDataFrame(sources, "k long, ts long, n long, name string").repartition(3),
        spark.createDataFrame(targets, "k long, ts long, n long").repartition(3),
        ["k"],
        ["name"],
        tie="n",
    )
    assert sorted((r.k, r.ts, r.n, r.source_name or "") for r in got.collect()) == [(1, 10, 3, "a2"), (1, 10, 4, ""), (1, 20, 9, "b"), (1, 21, 1, ""), (2, 9, 0, "")]
