"""File order: deltas, ring segments, parts and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom import fixed_values as fv
from spanloom.operators.filters import visible
from spanloom.operators.sequence import last, prev, row_numbers, scan, total
from spanloom.session import settle


def _delta() -> Column:
    none_before = F.coalesce(F.col("_pts") == 0, F.lit(True))
    return F.when(none_before, F.col("ts")).otherwise(F.col("ts") - F.col("_pts"))


def _wrapped() -> Column:
    return F.coalesce((F.col("ts") < F.col("_pts")).cast("long"), F.lit(0).cast("long"))


def delta_times(df: DataFrame, counted: Column | None = None, verbose: bool = False) -> DataFrame:
    """Time since the previous counted row of the file.

    The first row, and one after time 0, has its own time as delta. Suppressed
    internal rows count for the row after them, so they go afterwards.
    """
    rows = df if counted is None else df.filter(counted)
    seen = scan(rows, [], "seq", {"_pts": prev(F.col("ts"))})
    out = seen.withColumn("delta", _delta()).drop("_pts")
    return out if verbose else out.filter(visible())


def ring_segments(df: DataFrame) -> DataFrame:
    """Number the segments of a ring file: a new one begins where time runs backwards."""
    seen = scan(df, [], "seq", {"_pts": prev(F.col("ts"))}, shared=set(df.columns) == {"seq", "ts"}, keep=True)
    return scan(seen.withColumn("_wrapped", _wrapped()), [], "seq", {"segment": total(F.col("_wrapped"))}).drop("_pts", "_wrapped")


def true_order(df: DataFrame, name: str = "seq") -> DataFrame:
    """Records of a ring file in the order in which they were recorded.

    A ring file is written on from its beginning once it is full, so its first
    segment is the newest. ``name`` becomes the dense position from 0 on,
    oldest segment first; the place in the file stays as ``file_seq``. All
    operators along ``seq`` then reach across the wrap.
    """
    cut = settle(ring_segments(df.select("seq", "ts")).select("seq", "segment"))
    numbered = row_numbers(cut, ["segment"], "seq", "_rn")
    sizes = cut.groupBy("segment").agg(F.count(F.lit(1)).alias("_n"))
    older = scan(sizes.withColumn("_back", -F.col("segment")), [], "_back", {"_before": total(F.col("_n"), before=True)})
    placed = numbered.join(older.select("segment", "_before"), "segment")
    at = (F.coalesce("_before", F.lit(0).cast("long")) + F.col("_rn") - 1).alias(name)
    places = placed.select(F.col("seq").alias("file_seq"), at)
    return df.withColumnRenamed("seq", "file_seq").join(places, "file_seq")


def file_times(df: DataFrame) -> DataFrame:
    """(seq, delta, segment) of each counted row, from its time and the one before."""
    seen = scan(df.select("seq", "ts"), [], "seq", {"_pts": prev(F.col("ts"))}, shared=True, keep=True)
    both = seen.select("seq", "_blk", _delta().alias("delta"), _wrapped().alias("_wrapped"))
    return scan(both, [], "seq", {"segment": total(F.col("_wrapped"))}).drop("_wrapped")


def carry_header(df: DataFrame, header: Column, order: str = "seq", name: str = "header") -> DataFrame:
    """Give each row the latest section header at or before it."""
    return scan(df, [], order, {name: last(header)})


def part_numbers(df: DataFrame, rows: int = fv.PART_ROWS, order: str = "seq", section: str | None = None) -> DataFrame:
    """Part of each data row; the row that fills a part opens the next one.

    Rows are counted over the whole file. With a ``section`` (a column that is
    constant between two headers) each section starts with part 0 and takes
    the file's part number from the first row that opens a part in it.
    """
    numbered = row_numbers(df, [], order, "_rn")
    part = F.floor(F.col("_rn") / rows)
    if section is None:
        return numbered.withColumn("part", part).drop("_rn")
    before = row_numbers(df.select(section, order), [], order, "_rn").groupBy(section).agg((F.min("_rn") - 1).alias("_before"))
    opened = part > F.floor(F.col("_before") / rows)
    zero = F.lit(0).cast("long")
    return numbered.join(before, section).withColumn("part", F.when(opened, part).otherwise(zero)).drop("_rn", "_before")


def page_times(df: DataFrame, lines: int = fv.PAGE_LINES, order: str = "seq", ts: str = "ts") -> DataFrame:
    """First time of each report page and the time since the page before."""
    paged = row_numbers(df, [], order, "_rn").withColumn("page", F.floor((F.col("_rn") - 1) / lines))
    firsts = paged.groupBy("page").agg(
        F.min_by(ts, order).alias("page_ts"), F.count(F.lit(1)).alias("lines")
    )
    seen = scan(firsts, [], "page", {"_p": prev(F.col("page_ts"))})
    return seen.withColumn("since_last", F.col("page_ts") - F.col("_p")).drop("_p")


def message_gaps(df: DataFrame, keys: list[str], order: str = "seq", ts: str = "ts") -> DataFrame:
    """Rounded time since the message before."""
    seen = scan(df, keys, order, {"_pts": prev(F.col(ts))})
    return seen.withColumn("gap", F.round(F.col(ts) - F.col("_pts")).cast("long")).drop("_pts")
