"""Text sinks: ordered lines, report rows, thread map."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom import fixed_values as fv
from spanloom.functions import codec
from spanloom.operators.names import map_lines
from spanloom.operators.order import page_times
from spanloom.operators.sequence import row_numbers
from spanloom.session import settle


def write_lines(df: DataFrame, path: str, order: list[str], parts: list[str] | None = None, value: str = "value") -> None:
    """Write lines in order, as files whose name order is the line order.

    Rows are range partitioned by part and order, so a part of any size is
    spread over files; ``parts`` become folders.
    """
    keys = [*(parts or []), *order]
    placed = df.repartitionByRange(*keys).sortWithinPartitions(*keys).select(*(parts or []), F.col(value).alias("value"))
    writer = placed.write
    if parts:
        writer = writer.partitionBy(*parts)
    writer.text(path)


def _elapsed_text(elapsed: Column) -> Column:
    return F.when(elapsed.isNull(), F.lit(" " * 12)).otherwise(F.format_string("%-12s", F.format_string("(%.1f)", elapsed)))


def report_lines(decoded: DataFrame) -> DataFrame:
    """Report row of each decoded record.

    Needs ``us``, ``delta_us``, ``elapsed_us`` (null where nothing ends),
    ``label``, ``dvp`` and ``path`` (null outside look-ups), arguments,
    ``tid``, ``cpu`` and ``command``.
    """
    hexed = lambda name: codec.hex_text(F.col(name))
    head = F.concat(
        F.format_string("%13.1f %10.1f", "us", "delta_us"),
        _elapsed_text(F.col("elapsed_us")),
        F.lit(" "),
        F.format_string("%-28s  ", F.substring("label", 1, 28)),
    )
    tail = F.format_string("%-16s  %-2d %s", hexed("tid"), "cpu", "command")
    looked_up = F.format_string("%-16s %-51s ", hexed("dvp"), codec.tail_text(F.col("path")))
    told = F.format_string("%-32s%-36s ", codec.words_text(*[F.col(f"arg{i}") for i in range(1, 5)]), F.lit(""))
    plain = F.format_string("%-16s %-16s %-16s %-16s  ", *[hexed(f"arg{i}") for i in range(1, 5)])
    body = (
        F.when(F.col("path").isNotNull(), looked_up).when(F.col("debugid") == fv.INFO_STRING, told).otherwise(plain)
    )
    line = F.concat(head, body, tail)
    return decoded.select("segment", "seq", line.alias("value"))


def page_heads(decoded: DataFrame) -> DataFrame:
    """Heading of each 64-line page: time since the page before, then the column names."""
    shown = decoded.select("seq", "segment", F.col("us").alias("ts"))
    pages = page_times(shown)
    firsts = row_numbers(shown, [], "seq", "_rn").filter((F.col("_rn") - 1) % fv.PAGE_LINES == 0)
    at = firsts.select(F.floor((F.col("_rn") - 1) / fv.PAGE_LINES).alias("page"), "segment", "seq")
    since = F.when(
        F.col("since_last").isNotNull(),
        F.concat(F.lit("\n\n"), F.format_string(fv.PAGE_GAP, F.col("since_last")), F.lit("\n")),
    ).otherwise("")
    return at.join(pages, "page").select("segment", "seq", F.concat(since, F.lit(fv.PAGE_COLUMNS + "\n")).alias("value"))


def write_report(decoded: DataFrame, path: str, paged: bool = False) -> None:
    """Report text, one folder per ring segment; later segments begin with a marker line.

    ``paged`` puts a heading before every 64 lines.
    """
    lines = report_lines(decoded).withColumn("seq", F.col("seq") * 2 + 1)
    if paged:
        lines = lines.unionByName(page_heads(decoded).withColumn("seq", F.col("seq") * 2))
    marks = lines.filter(F.col("segment") > 0).select("segment").distinct()
    marked = marks.select("segment", F.lit(-1).cast("long").alias("seq"), F.lit(fv.WRAP_MARKER).alias("value"))
    write_lines(lines.unionByName(marked), path, ["seq"], ["segment"])


def write_thread_map(resolved: DataFrame, path: str) -> int:
    """Write the thread map file and return the number of its rows."""
    lines = settle(map_lines(resolved))
    write_lines(lines, path, ["value"])
    return lines.count()
