"""Raw files of every layout, encoded here and read back in many small ranges."""

import random
import struct

import pytest
from pyspark.sql import functions as F

from spanloom.fixed_values import RAW_MAGIC
from spanloom.sources import raw


def events(seed, n, bits=64):
    pick = random.Random(seed)
    top = (1 << bits) - 1
    return [(pick.randrange(1 << 50), *[pick.randrange(top) for _ in range(4)], pick.randrange(1, top), pick.randrange(1 << 32), pick.randrange(8)) for _ in range(n)]


def encode(rows, threads=(), cpus=(), version=1, bits=64):
    word = "Q" if bits == 64 else "I"
    maps = b"".join(struct.pack(f"<{word}i20s", t, v, c.encode()) for t, v, c in threads)
    if version == 0:
        head = struct.pack("<I", len(threads)) + maps
    else:
        head = struct.pack("<IIQI" + ("4x" if bits == 64 else ""), RAW_MAGIC, len(threads), 1_700_000_000, 42) + maps
        room = 4096 - len(head) % 4096
        cpu = struct.pack("<II", RAW_MAGIC, len(cpus)) + b"".join(struct.pack("<II8s", i, f, n.encode()) for i, f, n in cpus) if cpus else b""
        head += cpu.ljust(room, b"\0")
    if bits == 64:
        body = b"".join(struct.pack("<6QIIQ", *r, 0) for r in rows)
    else:
        body = b"".join(struct.pack("<Q5II", r[0] | r[7] << 56, *r[1:7]) for r in rows)
    return head + body


def signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def read(spark, path, **options):
    df = raw.read_raw(spark, str(path), **options).orderBy("seq")
    return [tuple(r)[1:] for r in df.collect()]


@pytest.mark.parametrize("version,bits", [(1, 64), (0, 64), (1, 32), (0, 32)])
@pytest.mark.parametrize("splitbytes", [1000, 1 << 20])
def test_layouts(spark, tmp_path, version, bits, splitbytes):
    rows = events(version + bits, 300, bits)
    threads = [(7, 1, "alpha"), (0, 0, "unused"), (9, 1, "beta\0junk")]
    path = tmp_path / "one.raw"
    # A cut-off record at the end is no record.
    path.write_bytes(encode(rows, threads, version=version, bits=bits) + b"tail")
    got = read(spark, path, bits=bits, splitbytes=splitbytes)
    assert got == [(r[0], *[signed(x) for x in r[1:6]], r[6], r[7]) for r in rows]
    named = raw.read_raw(spark, str(path), table="threadmap", bits=bits).orderBy("entry").collect()
    assert [(r.tid, r.valid, r.command) for r in named] == [(7, 1, "alpha"), (9, 1, "beta")]
    head = raw.read_raw(spark, str(path), table="header", bits=bits).first()
    assert (head.version, head.thread_count, head.records) == (version, 3, 300)
    if version == 1:
        assert (head.secs, head.usecs) == (1_700_000_000, 42)


def test_cpu_map(spark, tmp_path):
    (tmp_path / "with.raw").write_bytes(encode([], cpus=[(0, 0, "CPU0"), (1, 1, "IOP")]))
    (tmp_path / "without.raw").write_bytes(encode([]))
    # The thread map reaches into the second page, the CPU map lies behind it.
    (tmp_path / "zlong.raw").write_bytes(encode([], threads=[(i, 1, "x") for i in range(1, 150)], cpus=[(2, 1, "ANE")]))
    rows = raw.read_raw(spark, str(tmp_path), table="cpumap").collect()
    assert sorted((r.cpu_id, r.flags, r.name) for r in rows) == [(0, 0, "CPU0"), (1, 1, "IOP"), (2, 1, "ANE")]


def test_several_files_keep_order(spark, tmp_path):
    parts = [events(s, 50) for s in (1, 2, 3)]
    for i, rows in enumerate(parts):
        (tmp_path / f"part{i}.raw").write_bytes(encode(rows, version=i % 2))
    got = read(spark, tmp_path, splitbytes=777)
    assert [r[0] for r in got] == [r[0] for rows in parts for r in rows]


def test_write_then_read(spark, tmp_path):
    raw.register(spark)
    rows = [(s, signed(r[0]), *[signed(x) for x in r[1:6]], r[6], r[7], "cmd" if s % 2 else None) for s, r in enumerate(events(9, 200))]
    df = spark.createDataFrame(rows, "seq long, ts long, arg1 long, arg2 long, arg3 long, arg4 long, tid long, debugid long, cpu int, command string")
    placed = df.repartitionByRange(3, "seq").sortWithinPartitions("seq").drop("seq")
    placed.write.format("rawevents").mode("append").option("cpus", "0:1:IOP").save(str(tmp_path / "out"))
    got = read(spark, tmp_path / "out", splitbytes=900)
    assert got == [r[1:9] for r in rows]
    named = raw.read_raw(spark, str(tmp_path / "out"), table="threadmap")
    assert named.count() == 100 and named.filter(F.col("command") != "cmd").count() == 0


def test_appends_add_up(spark, tmp_path):
    from spanloom.sources.raw import read_raw, register

    register(spark)
    names = "ts long, arg1 long, arg2 long, arg3 long, arg4 long, tid long, debugid long, cpu int"
    folder = str(tmp_path / "twice")
    for first, count in ((0, 100), (1000, 200)):
        rows = spark.range(first, first + count, 1, 3).selectExpr(
            "id AS ts", "id AS arg1", "0L AS arg2", "0L AS arg3", "0L AS arg4", "7L AS tid", "16L AS debugid", "CAST(0 AS INT) AS cpu"
        )
        assert set(rows.columns) == {n.split()[0] for n in names.split(", ")}
        rows.write.format("rawevents").mode("append").save(folder)
    got = [r.arg1 for r in read_raw(spark, folder).orderBy("seq").collect()]
    assert got == [*range(100), *range(1000, 1200)]


@pytest.mark.parametrize("bits, version", [(64, 0), (32, 1), (32, 0)])
def test_other_layouts_are_written(spark, tmp_path, bits, version):
    raw.register(spark)
    schema = "ts long, arg1 long, arg2 long, arg3 long, arg4 long, tid long, debugid long, cpu int, command string"
    data = [((1 << 40) + i, i, (1 << 32) - 1, 0, 5, 7 + i % 2, 0xFFFFFFFF, i % 200, f"c{i % 2}") for i in range(500)]
    folder = str(tmp_path / "out")
    rows = spark.createDataFrame(data, schema)
    rows.coalesce(1).write.format("rawevents").mode("append").options(bits=bits, version=version).save(folder)
    got = raw.read_raw(spark, folder, bits=bits, splitbytes=1000).orderBy("seq").drop("seq").collect()
    assert [tuple(r) for r in got] == [r[:-1] for r in data]
    threads = raw.read_raw(spark, folder, table="threadmap", bits=bits)
    assert sorted((r.tid, r.command) for r in threads.collect()) == [(7, "c0"), (8, "c1")]
    assert all(not f.name.endswith("-body") for f in (tmp_path / "out").iterdir())
    if bits == 32:
        for column, value in (("arg1", 1 << 32), ("tid", -1), ("cpu", 256), ("ts", 1 << 56)):
            with pytest.raises(Exception, match="too large"):
                rows.limit(1).withColumn(column, F.lit(value).cast("int" if column == "cpu" else "long")).write.format("rawevents").mode("append").options(bits=32).save(folder)


@pytest.mark.parametrize("bits", [64, 32])
def test_pushed_filters(spark, tmp_path, bits):
    rows = events(9, 400, bits)
    (tmp_path / "one.raw").write_bytes(encode(rows, bits=bits))
    df = raw.read_raw(spark, str(tmp_path), bits=bits, splitbytes=1000)
    whole = {tuple(r) for r in df.collect()}
    ids = sorted(r.debugid for r in df.collect())
    tests = {
        "debugid BETWEEN %d AND %d" % (ids[50], ids[300]): True,
        "cpu IN (1, 2, 7) AND tid > 0": True,
        "ts < %d AND seq >= 17 AND seq <= 380" % (1 << 49): True,
        "arg1 = arg1 AND cpu = 3": None,
        "cpu > 2.5": None,
        "cpu <> 3 AND arg2 IS NOT NULL": None,
        "cpu = 1 OR debugid > %d" % ids[200]: None,
    }
    for text, all_pushed in tests.items():
        kept = df.filter(text)
        plain = spark.createDataFrame(sorted(whole), df.schema).filter(text)
        assert {tuple(r) for r in kept.collect()} == {tuple(r) for r in plain.collect()}, text
        plan = kept._jdf.queryExecution().executedPlan().toString()
        if all_pushed:
            assert "Filter (" not in plan, plan


def test_hand_back():
    from pyspark.sql.datasource import EqualTo, GreaterThan, IsNotNull, StringContains

    reader = raw.RawReader({"path": "x"})
    others = [StringContains(("tid",), "1"), EqualTo(("tid",), None), GreaterThan(("cpu",), 2.5), EqualTo(("tid",), 1 << 70), EqualTo(("a", "tid"), 1)]
    assert list(reader.pushFilters([*others, IsNotNull(("tid",)), GreaterThan(("cpu",), 2)])) == others
    assert reader.tests == [("cpu", GreaterThan, 2)]
    side = [EqualTo(("tid",), 3)]
    assert list(raw.RawReader({"path": "x", "table": "threadmap"}).pushFilters(side)) == side


def collected(spark, folder, out, **options):
    query = raw.stream_raw(spark, str(folder), **options).writeStream.format("parquet").option("checkpointLocation", f"{out}/checkpoint")
    query.option("path", f"{out}/rows").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{out}/rows").orderBy("seq").collect()


@pytest.mark.parametrize("version", [0, 1])
def test_growing_files(spark, tmp_path, version):
    folder = tmp_path / "live"
    folder.mkdir()
    first, second = events(1, 200), events(2, 90)
    data = encode(first, [(7, 1, "alpha")], version=version)
    # Before the magic is there, in the midst of the head, of a record, and whole; a second file comes later.
    (folder / "a.raw").write_bytes(data[:10])
    query_rows = []
    for upto in (30, len(data) - 64 * 150 - 13, len(data) - 64 * 20 + 1, len(data)):
        (folder / "a.raw").write_bytes(data[:upto])
        query_rows.append(len(collected(spark, folder, tmp_path, splitbytes=1000)))
    assert query_rows[0] == 0 and query_rows[1:] == [49, 180, 200]
    (folder / "b.raw").write_bytes(encode(second))
    got = collected(spark, folder, tmp_path, splitbytes=1000)
    assert [r.seq for r in got] == [*range(200), *((1 << raw.FILE_SHIFT) + i for i in range(90))]
    assert [r.ts for r in got] == [r[0] for r in first + second]


def test_files_in_the_wrong_place():
    reader = raw.RawStreamReader({"path": "x"})
    for start, end in ({"b": "0:100"}, {"a": "0:50", "b": "1:100"}), ({"b": "0:100"}, {"b": "0:90"}), ({"b": "0:100"}, {"c": "0:100"}):
        with pytest.raises(ValueError):
            reader.partitions(start, end)
    assert reader.partitions({"b": "0:100"}, {"b": "0:100"}) == []
