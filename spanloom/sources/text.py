"""Readers of the text side files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.functions import codec
from spanloom.operators.sequence import high, last, scan, total


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Lines with ``file`` and their dense 0-based position ``seq`` over all files in name order.

    Inside an input split, rows keep the order of the file. Splits are counted
    first; the running count over the splits (the same list the driver plans
    with) gives each split its first position.
    """
    raw = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_id"),
        F.col("value").alias("line"),
    )
    splits = raw.groupBy("file", "_start").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(F.lit(0)).orderBy("file", "_start").rowsBetween(Window.unboundedPreceding, -1)
    placed = splits.select("file", "_start", "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base"))
    joined = raw.join(placed, ["file", "_start"])
    return joined.select("file", (F.col("_base") + F.col("_id") - F.col("_first")).alias("seq"), "line")


def _group(pattern: str, index: int, column: str = "line") -> Column:
    return F.nullif(F.regexp_extract(column, pattern, index), F.lit(""))


def read_codes(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Code dictionaries, later paths overriding earlier ones: id in hex, blanks, name."""
    pattern = r"^[ \t]*(?:0[xX])?([0-9a-fA-F]+)[ \t]*(.*)$"
    out = None
    for number, path in enumerate(paths):
        rows = read_lines(spark, path).select(
            codec.parse_hex(_group(pattern, 1)).alias("debugid"),
            F.trim(_group(pattern, 2)).alias("name"),
            F.lit(f"{number:04d}").alias("source"),
            (F.col("seq") + 1).alias("line"),
        )
        rows = rows.filter((F.col("debugid") != 0) & (F.col("name") != ""))
        out = rows if out is None else out.unionByName(rows)
    return out


def read_filters(spark: SparkSession, path: str) -> DataFrame:
    """Type filters as class-subclass ranges; any other line is an error."""
    rows = spark.read.text(path).withColumnRenamed("value", "line")
    cls = codec.parse_hex(_group(r"^C\s+0[xX]([0-9a-fA-F]+)\s*$", 1))
    csc = codec.parse_hex(_group(r"^S\s+0[xX]([0-9a-fA-F]+)\s*$", 1))
    wanted = rows.filter(~F.col("line").rlike(r"^(#.*)?$"))
    good = F.coalesce((cls <= 0xFF) | (csc <= 0xFFFF), F.lit(False))
    checked = F.when(good, F.coalesce(cls * 256, csc)).otherwise(
        F.raise_error(F.concat(F.lit("bad filter line: "), F.col("line"))).cast("long")
    )
    return wanted.select(checked.alias("csc_from"), F.when(cls.isNotNull(), cls * 256 + 255).otherwise(csc).alias("csc_to"))


def read_processes(spark: SparkSession, path: str) -> DataFrame:
    """Process list with the line number, for later-line-wins."""
    pattern = r"^\s*(-?[0-9]+)\s+(\S.*)$"
    return (
        read_lines(spark, path)
        .select(_group(pattern, 1).try_cast("long").alias("pid"), codec.command16(_group(pattern, 2)).alias("command"), F.col("seq").alias("line"))
        .filter(F.col("pid").isNotNull())
    )


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Loaded images under their process headers."""
    head = r"^DumpProcess ([0-9a-fA-F]+) (\S+) (.*)$"
    entry = r"^(0x[0-9a-fA-F]+) (.*)$"
    rows = read_lines(spark, path)
    names = {"pid": codec.parse_hex(_group(head, 1)), "arch": _group(head, 2), "comm": _group(head, 3)}
    carried = scan(rows, [], "seq", {n: last(c) for n, c in names.items()})
    images = carried.filter(F.col("line").rlike(entry) & F.col("pid").isNotNull())
    return images.select(
        "seq", "pid", "arch", "comm", codec.parse_hex(_group(entry, 1)).alias("load_addr"), _group(entry, 2).alias("path")
    )


def read_clusters(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Cluster file: (headers, edges, rejected lines).

    Data rows have four words, or seven with a peer; the row before the first
    header belongs to no cluster and is left out.
    """
    head = r"^#Cluster\s+([^\s(]+)(?:\(num of groups = ([0-9a-fA-F]+)\))?"
    lines = read_lines(spark, path)
    is_head = F.col("line").startswith("#Cluster")
    carried = scan(lines, [], "seq", {"cluster": last(F.when(is_head, F.regexp_extract("line", head, 1)))})
    headers = lines.filter(is_head).select(
        "seq", F.regexp_extract("line", head, 1).alias("cluster"), codec.parse_hex(_group(head, 2)).alias("declared")
    )
    words = carried.filter(~is_head & F.col("cluster").isNotNull()).withColumn("w", F.split(F.rtrim("line"), r"\s+"))
    w = lambda i: F.get("w", F.lit(i))
    # A row with a number that does not parse is rejected like one with another count of words.
    number = lambda i: w(i).try_cast("double")
    hexed = lambda i: w(i).rlike("^(0[xX])?[0-9a-fA-F]{1,16}$")
    four = (F.size("w") == 4) & number(0).isNotNull() & hexed(1)
    known = F.coalesce(four | ((F.size("w") == 7) & number(0).isNotNull() & hexed(1) & number(4).isNotNull() & hexed(5)), F.lit(False))
    edges = words.filter(known).select(
        "seq",
        "cluster",
        number(0).alias("ts"),
        codec.parse_hex(w(1)).alias("host_gid"),
        w(2).alias("host_name"),
        w(3).alias("action"),
        number(4).alias("peer_ts"),
        codec.parse_hex(w(5)).alias("peer_gid"),
        w(6).alias("peer_name"),
    )
    return headers, edges, words.filter(~known).select("seq", "cluster", "line")


def read_chart_clusters(spark: SparkSession, path: str, header_has: str | None = None) -> DataFrame:
    """Chart cluster file; the first row that does not parse ends its file."""
    row = r"^\s*(?:0[xX])?([0-9a-fA-F]+)\s+([0-9.eE+-]+)\s+(?:0[xX])?([0-9a-fA-F]+)\s+(\S+)\s+(\S+)(?:\s+(?:0[xX])?([0-9a-fA-F]+))?.*$"
    lines = read_lines(spark, path)
    is_head = F.col("line").contains("Cluster")
    carried = scan(lines, ["file"], "seq", {"cluster": last(F.when(is_head, F.col("line")))})
    chosen = F.col("cluster").isNotNull()
    if header_has is not None:
        chosen = chosen & F.col("cluster").contains(header_has)
    rows = carried.filter(chosen & ~is_head)
    checked = scan(rows, ["file"], "seq", {"_ended": high(F.when(F.col("line").rlike(row) & _group(row, 2).try_cast("double").isNotNull(), 0).otherwise(1))})
    return checked.filter(F.col("_ended") == 0).select(
        "seq",
        "cluster",
        codec.parse_hex(_group(row, 1)).alias("gid"),
        _group(row, 2).try_cast("double").alias("ts"),
        codec.parse_hex(_group(row, 3)).alias("tid"),
        _group(row, 4).alias("proc"),
        _group(row, 5).alias("action"),
        F.coalesce(codec.parse_hex(_group(row, 6)), F.lit(0).cast("long")).alias("peer_tid"),
        F.concat(_group(row, 4), codec.parse_hex(_group(row, 3)).cast("string")).alias("node"),
    )


def read_message_log(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Message log in sections: (messages, lines with an unknown operation)."""
    lines = read_lines(spark, path)
    is_head = F.col("line").rlike("^####.*####$")
    counted = scan(lines, [], "seq", {"section": total(is_head.cast("long"))})
    rows = counted.filter(~is_head & (F.col("section") > 0)).withColumn("w", F.split("line", r"\s{4,}"))
    w = lambda i: F.get("w", F.lit(i))
    op = w(1)
    sent, asked, got, made = (op == o for o in ("mach_msg_send", "mach_msg_kernel_request", "mach_msg_recv", "voucher_create"))
    # A message needs its time, sent and asked ones their delay; rows without count as unknown.
    timed = w(2).try_cast("double").isNotNull() & (got | made | w(8).try_cast("double").isNotNull())
    known = F.coalesce((sent | asked | got | made) & timed, F.lit(False))
    messages = rows.filter(known).select(
        "seq",
        (F.col("section") - 1).alias("section"),
        op.alias("op"),
        w(2).try_cast("double").alias("ts"),
        F.when(got, w(5)).otherwise(w(3)).alias("from_name"),
        F.when(got | asked, w(3)).otherwise(w(5)).alias("to_name"),
        F.when(sent, F.concat_ws(" ", w(7), w(8))).when(asked, F.concat_ws(" ", w(6), w(7), w(8))).otherwise(w(7)).alias("label"),
        F.when(sent | asked, w(8).try_cast("double")).alias("delay"),
    )
    unknown = rows.filter(~known).select("seq", "line")
    return messages, unknown


def read_steps(spark: SparkSession, path: str) -> DataFrame:
    """Debugger steps: each instruction line under the symbol of the thread line above it."""
    lines = read_lines(spark, path)
    is_thread = F.col("line").contains("thread #")
    carried = scan(lines, [], "seq", {"symbol": last(F.when(is_thread, codec.symbol_of(F.col("line"))))})
    return carried.filter(F.col("line").rlike(r"^\s*->") & F.col("symbol").isNotNull()).select(
        "file", "seq", "symbol", F.trim("line").alias("asm")
    )


def read_watch_log(spark: SparkSession, path: str) -> DataFrame:
    """Watchpoint set-up rows; banner lines have no tabs."""
    cells = F.split("value", "\t")
    names = ["pid", "process", "symbol", "register", "mode", "width"]
    rows = spark.read.text(path).filter(F.size(cells) == len(names))
    return rows.select(*[F.get(cells, F.lit(i)).alias(n) for i, n in enumerate(names)]).withColumns(
        # A number that does not parse is null; the row stays.
        {"pid": F.col("pid").try_cast("long"), "register": F.col("register").try_cast("long")}
    )
