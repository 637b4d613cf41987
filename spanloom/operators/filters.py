"""Record filters."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom import fixed_values as fv
from spanloom.functions import codec
from spanloom.operators.sequence import high, last, scan

# Up to this many ranges are compared one by one, which a Parquet scan can use to skip data.
MOST_RANGES = 24


def type_ranges(
    classes: Iterable[int] = (),
    subclasses: Iterable[tuple[int, int]] = (),
    ranges: Iterable[tuple[int, int]] = (),
    pairs: DataFrame | None = None,
) -> list[tuple[int, int]]:
    """Inclusive class-subclass ranges of a type filter, merged and in order.

    Any given class, (class, subclass) or inclusive class range counts;
    ``pairs`` adds filters read from a file (columns ``csc_from``, ``csc_to``).
    """
    spans = [(c, c) for c in classes] + list(ranges)
    subs = list(subclasses)
    if any(not 0 <= a <= b <= 0xFF for a, b in spans):
        raise ValueError("classes lie between 0 and 255, ranges run upwards")
    if any(not 0 <= c <= 0xFF or not 0 <= s <= 0xFF for c, s in subs):
        raise ValueError("classes and subclasses lie between 0 and 255")
    wanted = {n for a, b in spans for n in range(a << 8, (b << 8) + 0x100)} | {(c << 8) + s for c, s in subs}
    if pairs is not None:
        if not pairs.filter(~F.expr("coalesce(csc_from BETWEEN 0 AND csc_to AND csc_to <= 65535, false)")).isEmpty():
            raise ValueError("class-subclass numbers lie between 0 and 65535, ranges run upwards")
        # So there are 2**16 different numbers at most.
        csc = F.explode(F.sequence("csc_from", "csc_to")).alias("csc")
        wanted |= {r.csc for r in pairs.select(csc).distinct().collect()}
    if not wanted:
        raise ValueError("a filter needs at least one class, subclass or range")
    firsts = sorted(n for n in wanted if n - 1 not in wanted)
    lasts = sorted(n for n in wanted if n + 1 not in wanted)
    return list(zip(firsts, lasts))


def type_filter(df: DataFrame, **wanted) -> DataFrame:
    """Rows of a type filter, see ``type_ranges`` for the arguments."""
    return in_ranges(df, type_ranges(**wanted))


def in_ranges(df: DataFrame, merged: list[tuple[int, int]]) -> DataFrame:
    """Rows whose class and subclass lie in one of the ranges, as ``type_ranges`` gives them.

    Few ranges become comparisons on debugid, which reach a Parquet scan; the
    least and greatest id reach the raw reader too.
    """
    least, greatest = codec.long_lit(merged[0][0] << 16), codec.long_lit((merged[-1][1] << 16) + 0xFFFF)
    near = df.filter(F.col("debugid").between(least, greatest))
    if len(merged) == 1:
        return near
    if len(merged) > MOST_RANGES:
        # A table of 2**15 ranges at most, 2**16 numbers in all: small enough for a broadcast by construction.
        ranges = df.sparkSession.createDataFrame(merged, "low long, high long")
        wanted_csc = F.broadcast(ranges.select(F.explode(F.sequence("low", "high")).alias("_csc")))
        return near.join(wanted_csc, codec.class_subclass(F.col("debugid")) == F.col("_csc"), "left_semi")
    tests = [F.col("debugid").between(codec.long_lit(a << 16), codec.long_lit((b << 16) + 0xFFFF)) for a, b in merged]
    return near.filter(any_of(tests))


def any_of(tests: list[Column]) -> Column:
    while len(tests) > 1:
        tests = [a | b for a, b in zip(tests[::2], tests[1::2])] + (tests[-1:] if len(tests) % 2 else [])
    return tests[0]


def code_filter(df: DataFrame, codes: list[int]) -> DataFrame:
    """Rows with exactly one of up to four event ids, any qualifier."""
    if not 1 <= len(codes) <= 4:
        raise ValueError("one to four codes")
    return df.filter(codec.event_id(F.col("debugid")).isin([c & fv.EVENTID_MASK for c in codes]))


def process_filter(
    df: DataFrame, include: list[int] | None = None, exclude: list[int] | None = None, pid: str = "pid"
) -> DataFrame:
    """Rows of the processes given, or of all others; rows of no known process count as others."""
    if include and exclude:
        raise ValueError("include or exclude processes, not both")
    if include:
        return df.filter(F.col(pid).isin(include))
    if not exclude:
        return df
    return df.filter(~F.coalesce(F.col(pid).isin(exclude), F.lit(False)))


def visible() -> Column:
    """False for the tracer's own records, apart from its information subclass."""
    debugid = F.col("debugid")
    return (codec.event_class(debugid) != fv.TRACE_CLASS) | (codec.event_subclass(debugid) == fv.TRACE_INFO_SUBCLASS)


def within_seconds(df: DataFrame, seconds: float, ts: str = "ts") -> DataFrame:
    """Rows of the first ``seconds`` of a capture (times in µs)."""
    start = df.agg(F.min(ts)).scalar()
    return df.filter(F.col(ts) < start + F.lit(int(seconds * 1_000_000)))


def without_calls(df: DataFrame, eventids: list[int]) -> DataFrame:
    """Drop system calls made by the tracer itself."""
    return df.filter(~codec.event_id(F.col("debugid")).isin(eventids))


def without_paths(df: DataFrame, path: str, parts: list[str]) -> DataFrame:
    return df.filter(~any_of([F.col(path).contains(p) for p in parts]))


def brackets(df: DataFrame, keys: list[str], begin: Column, end: Column, order: str = "seq") -> DataFrame:
    """Rows after a begin row, up to and including the next end row."""
    mark = F.when(begin, 1).when(end, 0)
    return scan(df, keys, order, {"_in": last(mark, before=True)}).filter(F.col("_in") == 1).drop("_in")


def until_first(df: DataFrame, keys: list[str], end: Column, order: str = "seq") -> DataFrame:
    """Rows up to and including the first end row."""
    ended = high(F.when(end, 1).otherwise(0), before=True)
    return scan(df, keys, order, {"_ended": ended}).filter(F.coalesce(F.col("_ended"), F.lit(0)) == 0).drop("_ended")
