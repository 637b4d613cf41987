"""Raw event files as a Spark data source.

``register(spark)`` adds the format ``rawevents``. Reading is split by byte
ranges aligned to records; numpy decodes a range, Arrow batches hand it over.
Options: ``table`` = events | threadmap | cpumap | header, ``bits`` = 64 | 32,
``splitbytes``, ``firstfile`` (number of the first file). Comparisons of
numbers with constants are pushed into the reader, which tests them on numpy
columns before rows leave Python; what it can't test, Spark tests. As a
stream, the format reads growing files from where they ended at the last
trigger. Writing lays down one file per task: the thread map is taken from the
column ``command``, the CPU map from the option ``cpus`` (``id:flags:name``
separated by commas). Its options ``bits`` (64 | 32) and ``version`` (1 | 0)
choose the layout.
"""

from __future__ import annotations

import struct
import time
import uuid
from dataclasses import dataclass
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    DataSourceStreamReader,
    EqualTo,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    LessThan,
    LessThanOrEqual,
    WriterCommitMessage,
)

from spanloom import schema
from spanloom.fixed_values import RAW_MAGIC, RAW_PAGE
from spanloom.session import ship

# Record layouts, little endian.
RECORD = {
    64: np.dtype(
        [("ts", "<u8"), ("arg1", "<u8"), ("arg2", "<u8"), ("arg3", "<u8"), ("arg4", "<u8"), ("tid", "<u8"), ("debugid", "<u4"), ("cpu", "<u4"), ("unused", "<u8")]
    ),
    32: np.dtype(
        [("ts", "<u8"), ("arg1", "<u4"), ("arg2", "<u4"), ("arg3", "<u4"), ("arg4", "<u4"), ("tid", "<u4"), ("debugid", "<u4")]
    ),
}
MAP_ENTRY = {64: np.dtype([("tid", "<u8"), ("valid", "<i4"), ("command", "S20")]), 32: np.dtype([("tid", "<u4"), ("valid", "<i4"), ("command", "S20")])}
CPU_ENTRY = np.dtype([("cpu_id", "<u4"), ("flags", "<u4"), ("name", "S8")])
HEADER = {64: struct.Struct("<IIQI4x"), 32: struct.Struct("<IIQI")}

SCHEMAS = {
    "events": schema.EVENT,
    "threadmap": "number long, entry long, " + schema.THREAD_MAP,
    "cpumap": "number long, " + schema.CPU_MAP,
    "header": "number long, file string, version int, thread_count long, secs long, usecs long, records long",
}
BATCH_RECORDS = 1 << 16
# seq = file number in the high bits, record number below. 2**28 records are twice what a recorder
# writes to one file; the bits left over let operators interleave positions (seq * 4).
FILE_SHIFT = 28


def _text(raw: bytes) -> str:
    return raw.split(b"\0", 1)[0].decode("utf-8", "replace")


def _open(path: str):
    filesystem, inner = pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path.removeprefix("file:"))
    return filesystem, inner


def _files(path: str) -> list[tuple[str, int]]:
    """(path, size) of a file, or of the files of a folder in name order."""
    filesystem, inner = _open(path)
    info = filesystem.get_file_info(inner)
    if info.type == pafs.FileType.Directory:
        found = filesystem.get_file_info(pafs.FileSelector(inner, recursive=True))
        files = sorted((f.path, f.size) for f in found if f.type == pafs.FileType.File and not f.base_name.startswith(("_", ".")))
    elif info.type == pafs.FileType.File:
        files = [(info.path, info.size)]
    else:
        raise FileNotFoundError(path)
    # Absolute paths come back without the host of the store, others with their bucket.
    place = urlsplit(path) if "://" in path and not path.startswith("file") else None
    prefix = lambda p: f"{place.scheme}://{place.netloc if p.startswith('/') else ''}" if place else ""
    return [(prefix(p) + p, s) for p, s in files]


def copy_start(source: str, target: str, share: float) -> None:
    """Copy the first part of a file, block by block."""
    filesystem, inner = _open(source)
    there, place = _open(target)
    there.create_dir(place.rsplit("/", 1)[0], recursive=True)
    left = int(filesystem.get_file_info(inner).size * share)
    with filesystem.open_input_stream(inner) as stream, there.open_output_stream(place) as out:
        while left and (block := stream.read(min(left, 8 << 20))):
            out.write(block)
            left -= len(block)


@dataclass
class Layout:
    version: int
    threads: int
    secs: int
    usecs: int
    map_at: int
    data_at: int


def layout(stream, bits: int) -> Layout:
    """Where the parts of a raw file lie; no magic means the oldest layout."""
    head = HEADER[bits]
    first = stream.read(head.size)
    if len(first) >= head.size and struct.unpack_from("<I", first)[0] == RAW_MAGIC:
        _, threads, secs, usecs = head.unpack(first)
        end = head.size + threads * MAP_ENTRY[bits].itemsize
        return Layout(1, threads, secs, usecs, head.size, end + RAW_PAGE - end % RAW_PAGE)
    threads = struct.unpack_from("<I", first)[0] if len(first) >= 4 else 0
    return Layout(0, threads, int(time.time()), 0, 4, 4 + threads * MAP_ENTRY[bits].itemsize)


@dataclass
class Range(InputPartition):
    path: str
    number: int
    start: int
    end: int
    size: int


#: Tests of a column against a constant that numpy makes as Spark does; there are no nulls in raw records.
TESTS = {
    EqualTo: np.equal,
    GreaterThan: np.greater,
    GreaterThanOrEqual: np.greater_equal,
    LessThan: np.less,
    LessThanOrEqual: np.less_equal,
    In: lambda values, wanted: np.isin(values, np.array(wanted, "<i8")),
}
LEAST, GREATEST = -(1 << 63), (1 << 63) - 1


def _testable(wanted) -> bool:
    values = wanted if isinstance(wanted, (tuple, list)) else [wanted]
    return all(isinstance(v, int) and not isinstance(v, bool) and LEAST <= v <= GREATEST for v in values)


class RecordReader:
    """Ranges of records as Arrow batches, for reading and for streams."""

    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.table = options.get("table", "events")
        self.bits = int(options.get("bits", "64"))
        self.split = int(options.get("splitbytes", str(128 << 20)))
        self.first_file = int(options.get("firstfile", "0"))
        self.tests: list[tuple[str, type, object]] = []

    def files(self) -> list[tuple[str, int]]:
        found = [f for path in self.path.split("\n") for f in _files(path)]
        if any(size >> FILE_SHIFT >= RECORD[self.bits].itemsize for _, size in found):
            raise ValueError("a raw file holds at most 2**28 records")
        return found

    def ranges(self, path: str, number: int, start: int, end: int) -> list[Range]:
        return [Range(path, number, at, min(at + self.split, end), end) for at in range(start, max(end, start + 1), self.split)]

    def read(self, part: Range):
        filesystem, inner = _open(part.path)
        with filesystem.open_input_file(inner) as stream:
            where = layout(stream, self.bits)
            yield from getattr(self, f"_{self.table}")(stream, where, part)

    def _events(self, stream, where: Layout, part: Range):
        kind = RECORD[self.bits]
        width = kind.itemsize
        # A range owns the records that end inside it, so a record still being written waits for the range that completes it.
        first, stop = (max(0, place - where.data_at) // width for place in (part.start, part.end))
        for at in range(first, stop, BATCH_RECORDS):
            count = min(BATCH_RECORDS, stop - at)
            stream.seek(where.data_at + at * width)
            rows = np.frombuffer(stream.read(count * width), dtype=kind)
            places = np.arange(at, at + len(rows), dtype="<i8")
            if self.tests:
                keep = np.ones(len(rows), dtype=bool)
                for name, test, wanted in self.tests:
                    keep &= TESTS[test](self._column(rows, places, part, name), wanted)
                rows, places = rows[keep], places[keep]
            if len(rows):
                yield self._batch(rows, places, part)

    def _column(self, rows: np.ndarray, places: np.ndarray, part: Range, name: str) -> np.ndarray:
        """A column of the result as signed numbers."""
        if name == "seq":
            return (np.int64(part.number) << FILE_SHIFT) + places
        if self.bits == 32 and name == "ts":
            return (rows["ts"] & np.uint64(0x00FFFFFFFFFFFFFF)).astype("<i8")
        if name == "cpu":
            return (rows["cpu"] if self.bits == 64 else rows["ts"] >> np.uint64(56)).astype("<i4")
        return rows[name].astype("<u8").view("<i8")

    def _batch(self, rows: np.ndarray, places: np.ndarray, part: Range) -> pa.RecordBatch:
        names = [field.split()[0] for field in schema.EVENT.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(self._column(rows, places, part, name)) for name in names], names=names)

    def _threadmap(self, stream, where: Layout, part: Range):
        kind = MAP_ENTRY[self.bits]
        stream.seek(where.map_at)
        for at in range(0, where.threads, BATCH_RECORDS):
            raw = stream.read(min(BATCH_RECORDS, where.threads - at) * kind.itemsize)
            rows = np.frombuffer(raw[: len(raw) // kind.itemsize * kind.itemsize], dtype=kind)
            for i, row in enumerate(rows):
                if row["tid"]:
                    tid = int(np.uint64(row["tid"]).astype(np.int64))
                    entry = (part.number << FILE_SHIFT) + at + i
                    yield (part.number, entry, tid, int(row["valid"]), _text(bytes(row["command"])))

    def _cpumap(self, stream, where: Layout, part: Range):
        """The CPU map lies in the padding before the records and carries the magic itself."""
        if where.version != 1:
            return
        at = where.map_at + where.threads * MAP_ENTRY[self.bits].itemsize
        stream.seek(at)
        padding = stream.read(where.data_at - at)
        if len(padding) < 8:
            return
        magic, count = struct.unpack_from("<II", padding)
        if magic != RAW_MAGIC:
            return
        count = min(count, (len(padding) - 8) // CPU_ENTRY.itemsize)
        for row in np.frombuffer(padding, dtype=CPU_ENTRY, count=count, offset=8):
            yield (part.number, int(row["cpu_id"]), int(row["flags"]), _text(bytes(row["name"])))

    def _header(self, stream, where: Layout, part: Range):
        records = max(0, part.size - where.data_at) // RECORD[self.bits].itemsize
        yield (part.number, part.path, where.version, where.threads, where.secs, where.usecs, records)


class RawReader(RecordReader, DataSourceReader):
    def pushFilters(self, filters):
        """Takes comparisons of record columns with numbers, hands all others back."""
        columns = {field.split()[0] for field in schema.EVENT.split(", ")}
        for test in filters:
            name = test.attribute[0] if self.table == "events" and len(getattr(test, "attribute", ())) == 1 else None
            if name in columns and type(test) in TESTS and _testable(test.value):
                self.tests.append((name, type(test), test.value))
            elif name not in columns or not isinstance(test, IsNotNull):
                yield test

    def partitions(self):
        """Byte ranges from the file listing alone; headers are read in the tasks."""
        files = enumerate(self.files(), self.first_file)
        if self.table != "events":
            return [Range(path, number, 0, size, size) for number, (path, size) in files]
        return [part for number, (path, size) in files for part in self.ranges(path, number, 0, size)]


class RawStreamReader(RecordReader, DataSourceStreamReader):
    """Records of raw files that grow and of files that are added.

    An offset holds the number and size of every file, as ``number:size``. A
    file's number is its place in name order, so new files must have names
    behind those already read, and none may go while the stream is used.
    """

    def initialOffset(self):
        return {}

    def latestOffset(self):
        try:
            return {path: f"{number}:{size}" for number, (path, size) in enumerate(self.files(), self.first_file)}
        except FileNotFoundError:
            return {}

    def partitions(self, start, end):
        parts = []
        for path, place in end.items():
            number, size = map(int, place.split(":"))
            before, done = map(int, start.get(path, f"{number}:0").split(":"))
            if number != before or size < done:
                raise ValueError(f"{path} was cut or moved to another place in name order")
            # Before the magic and the number of threads are there, nothing is known of a file.
            if size > done and size >= HEADER[self.bits].size:
                parts += self.ranges(path, number, done, size)
        if any(path not in end for path in start):
            raise ValueError("files of a stream must not be removed")
        return parts


@dataclass
class Written(WriterCommitMessage):
    temporary: str
    final: str


class RawWriter(DataSourceArrowWriter):
    """One file per task, renamed into place when the whole write commits.

    The thread map lies before the records but is known after them, so records
    go to a file beside the target first and are copied behind the finished map.
    """

    def __init__(self, options: dict[str, str], overwrite: bool):
        self.path = options["path"]
        self.bits, self.version = int(options.get("bits", "64")), int(options.get("version", "1"))
        self.secs = int(options.get("secs", "0"))
        self.usecs = int(options.get("usecs", "0"))
        # Names rise along writes and tasks, at any number of tasks, so reading in name order is the order of writing.
        self.write_id = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
        self.cpus = [c.split(":") for c in options.get("cpus", "").split(",") if c]
        if overwrite:
            raise ValueError("raw files are only added to a folder")
        if self.cpus and self.version == 0:
            raise ValueError("the oldest layout has no CPU map")

    def _records(self, batch: pa.RecordBatch) -> np.ndarray:
        rows = np.zeros(batch.num_rows, dtype=RECORD[self.bits])
        for field in ("ts", "arg1", "arg2", "arg3", "arg4", "tid", "debugid", "cpu"):
            values = batch.column(field).to_numpy(zero_copy_only=False).astype("<i8").view("<u8")
            if field == "cpu" and self.bits == 32:
                # The CPU is the clock's upper byte.
                if (values >> np.uint64(8)).any() or (rows["ts"] >> np.uint64(56)).any():
                    raise ValueError("clock or CPU too large for 32-bit records")
                rows["ts"] |= values << np.uint64(56)
                continue
            room = 8 * rows.dtype[field].itemsize
            if room < 64 and (values >> np.uint64(room)).any():
                raise ValueError(f"{field} too large for {self.bits}-bit records")
            rows[field] = values
        return rows

    def _head(self, names: dict[int, bytes]) -> bytes:
        entries = [(t & ((1 << self.bits) - 1), 1, c) for t, c in sorted(names.items())]
        threads = np.array(entries, dtype=MAP_ENTRY[self.bits]).tobytes()
        if self.version == 0:
            return struct.pack("<I", len(entries)) + threads
        head = HEADER[self.bits].pack(RAW_MAGIC, len(entries), self.secs, self.usecs) + threads
        room, cpus = RAW_PAGE - len(head) % RAW_PAGE, self._cpu_map()
        if len(cpus) > room:
            raise ValueError(f"a CPU map of {len(cpus)} bytes doesn't fit in the {room} bytes before the records")
        return head + cpus + b"\0" * (room - len(cpus))

    def _cpu_map(self) -> bytes:
        rows = np.array([(int(i), int(f), n.encode()[:7]) for i, f, n in self.cpus], dtype=CPU_ENTRY)
        return struct.pack("<II", RAW_MAGIC, len(rows)) + rows.tobytes() if len(rows) else b""

    def write(self, iterator):
        from pyspark import TaskContext

        context = TaskContext.get()
        name = f"part-{self.write_id}-{context.partitionId():010d}.raw"
        names: dict[int, bytes] = {}
        filesystem, inner = _open(self.path)
        filesystem.create_dir(inner, recursive=True)
        temporary = f"{inner}/_{name}-{context.taskAttemptId()}"
        with filesystem.open_output_stream(f"{temporary}-body") as body:
            for batch in iterator:
                body.write(self._records(batch).tobytes())
                if "command" in batch.schema.names:
                    pairs = pa.table({"t": batch.column("tid"), "c": batch.column("command")}).group_by(["t", "c"]).aggregate([])
                    for row in pairs.to_pylist():
                        if row["c"]:
                            names[row["t"]] = row["c"].encode()[:19]
        with filesystem.open_output_stream(temporary) as out, filesystem.open_input_stream(f"{temporary}-body") as body:
            out.write(self._head(names))
            while chunk := body.read(8 << 20):
                out.write(chunk)
        filesystem.delete_file(f"{temporary}-body")
        return Written(temporary, f"{inner}/{name}")

    def commit(self, messages):
        filesystem, _ = _open(self.path)
        for m in messages:
            if m is not None:
                if filesystem.get_file_info(m.final).type != pafs.FileType.NotFound:
                    raise FileExistsError(m.final)
                filesystem.move(m.temporary, m.final)

    def abort(self, messages):
        filesystem, _ = _open(self.path)
        for m in messages:
            if m is not None:
                filesystem.delete_file(m.temporary)


class RawEvents(DataSource):
    @classmethod
    def name(cls):
        return "rawevents"

    def schema(self):
        return SCHEMAS[self.options.get("table", "events")]

    def reader(self, schema):
        return RawReader(dict(self.options))

    def streamReader(self, schema):
        return RawStreamReader(dict(self.options))

    def writer(self, schema, overwrite):
        return RawWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    """Add the format to a session and ship this package to its Python workers."""
    if getattr(spark, "_spanloom_raw", False):
        return
    ship(spark)
    spark.dataSource.register(RawEvents)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark._spanloom_raw = True


def file_number(seq: Column) -> Column:
    return F.shiftright(seq, FILE_SHIFT)


def read_raw(
    spark: SparkSession,
    path: str | list[str],
    table: str = "events",
    bits: int = 64,
    splitbytes: int = 128 << 20,
    first_file: int = 0,
) -> DataFrame:
    """Records or side tables of raw files; ``path`` is a file, a folder or a list of these.

    Files are numbered from ``first_file`` in the order given; ``seq`` rises
    along files and records, ``file_number`` reads the file's number off it.
    Filters on the result reach the reader where they compare a column with
    numbers.
    """
    register(spark)
    joined = path if isinstance(path, str) else "\n".join(path)
    options = {"table": table, "bits": bits, "splitbytes": splitbytes, "firstfile": first_file, "path": joined}
    return spark.read.format("rawevents").options(**options).load()


def stream_raw(spark: SparkSession, path: str, bits: int = 64, splitbytes: int = 128 << 20) -> DataFrame:
    """Records of a folder's raw files as they are written; a file is read on from where it ended at the last trigger."""
    register(spark)
    return spark.readStream.format("rawevents").options(bits=bits, splitbytes=splitbytes, path=path).load()
