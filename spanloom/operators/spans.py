"""Start/end pairing and span statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom import fixed_values as fv
from spanloom.functions import codec
from spanloom.operators.sequence import prev, scan, total
from spanloom.session import settle

OPEN, CLOSE = 1, 2


def pair(
    df: DataFrame,
    keys: list[str],
    opens: Column,
    closes: Column,
    order: str = "seq",
    ts: str = "ts",
    split: str = "all",
    carry: dict[str, Column] | None = None,
) -> DataFrame:
    """Closing rows with the time since the opening row just before them in their key.

    An opening row overwrites an open one and a closing row consumes it, so
    the state depends on the previous opening or closing row alone. Adds
    ``start_ts`` (null if nothing was open) and ``elapsed`` (then 0).
    ``carry`` names further values taken from the opening row.
    """
    carry = carry or {}
    side = F.when(opens, OPEN).when(closes, CLOSE)
    rows = df.withColumn("_side", side).filter(F.col("_side").isNotNull())
    steps = {"_pside": prev(F.col("_side")), "_pts": prev(F.col(ts))}
    steps |= {f"_p_{name}": prev(value) for name, value in carry.items()}
    seen = scan(rows, keys, order, steps, split=split)
    was_open = F.coalesce(F.col("_pside") == OPEN, F.lit(False))
    return (
        seen.filter(F.col("_side") == CLOSE)
        .withColumn("start_ts", F.when(was_open, F.col("_pts")))
        .withColumn("elapsed", F.when(was_open, F.col(ts) - F.col("_pts")).otherwise(F.lit(0).cast("long")))
        .withColumns({name: F.when(was_open, F.col(f"_p_{name}")) for name in carry})
        .drop("_side", "_pside", "_pts", *[f"_p_{name}" for name in carry])
    )


def never_opens(eventid: Column) -> Column:
    return eventid.isin(fv.THREAD_TERMINATE, fv.SYSCALL_EXIT)


def code_spans(df: DataFrame) -> DataFrame:
    """Spans per (thread, event id): START opens, END without START closes.

    Path look-up records and the two ids that end a thread never open.
    """
    debugid = F.col("debugid")
    rows = df.withColumn("eventid", codec.event_id(debugid)).filter(F.col("eventid") != fv.VFS_LOOKUP)
    return pair(
        rows,
        ["tid", "eventid"],
        opens=codec.is_start(debugid) & ~never_opens(F.col("eventid")),
        closes=codec.is_end_only(debugid),
    )


def run_queue_spans(df: DataFrame) -> DataFrame:
    """Time from make-runnable to running, per woken thread ``ran_tid``.

    The make-runnable record names the thread in arg1, the hand-off and
    scheduled records in arg2; all three count with qualifier 0 only. Rows
    without a wait are left out.
    """
    made = F.col("debugid") == fv.MAKE_RUNNABLE
    ran = F.col("debugid").isin(fv.STACK_HANDOFF, fv.SCHEDULED)
    rows = df.filter(made | ran).withColumn("ran_tid", F.when(made, F.col("arg1")).otherwise(F.col("arg2")))
    return pair(rows, ["ran_tid"], opens=made, closes=ran).filter(F.col("elapsed") != 0)


def named_pairs(df: DataFrame, name: str = "name") -> DataFrame:
    """Spans between two ids whose names differ in the ending _begin / _end only."""
    rows = (
        df.withColumn("stem", F.regexp_extract(name, "^(.+)_(begin|end)$", 1))
        .withColumn("_ending", F.regexp_extract(name, "^(.+)_(begin|end)$", 2))
        .filter(F.col("stem") != "")
    )
    begins, ends = F.col("_ending") == "begin", F.col("_ending") == "end"
    return pair(rows, ["tid", "stem"], opens=begins, closes=ends).drop("_ending")


def value_counts(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """How often each value occurs per key; all statistics below read these counts."""
    return df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))


def exact_percentiles(counts: DataFrame, keys: list[str], value: str, permille: dict[str, int]) -> DataFrame:
    """Discrete percentiles per key: the least value with at least that share at or below it.

    ``counts`` come from ``value_counts``, so a key is summed over its distinct
    values in blocks instead of being sorted as one group. Values are sparse,
    so keys with very many of them are cut by row numbers.
    """
    reached = scan(counts, keys, value, {"_upto": total(F.col("_n"))}, split="hot")
    sizes = counts.groupBy(*keys).agg(F.sum("_n").alias("_all"))
    return (
        reached.join(sizes, keys)
        .groupBy(*keys)
        .agg(
            *[
                F.min(F.when(F.col("_upto") * 1000 >= F.col("_all") * share, F.col(value))).alias(name)
                for name, share in permille.items()
            ]
        )
    )


#: A quantile read from a merged state is off by at most this share of all values, all but surely (k = 800).
SKETCH_K, SKETCH_ERROR = 800, 0.01


def span_sketches(spans: DataFrame, keys: list[str], width_us: int | None = None, value: str = "elapsed", ts: str = "ts") -> DataFrame:
    """Mergeable states of ``value`` per key, and per window of ``width_us`` if given.

    A state (``sketch``) holds a few thousand values however many it has seen,
    is made with map-side combine and can be stored, merged to coarser keys
    and windows (``merge_sketches``) and read (``sketch_percentiles``).
    """
    window = [] if width_us is None else [(F.floor(F.col(ts) / width_us) * width_us).alias("window_start")]
    return spans.groupBy(*keys, *window).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(value).alias("total_us"),
        F.max(value).alias("max_us"),
        F.kll_sketch_agg_bigint(value, F.lit(SKETCH_K)).alias("sketch"),
    )


def merge_sketches(states: DataFrame, keys: list[str]) -> DataFrame:
    """States of coarser keys, windows or later slices from finer ones."""
    return states.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.sum("total_us").alias("total_us"), F.max("max_us").alias("max_us"), F.kll_merge_agg_bigint("sketch").alias("sketch")
    )


def sketch_percentiles(states: DataFrame, permille: dict[str, int]) -> DataFrame:
    """Approximate percentiles in place of the states, off by ``SKETCH_ERROR`` of the values at most."""
    read = {name: F.kll_sketch_get_quantile_bigint("sketch", F.lit(share / 1000.0)) for name, share in permille.items()}
    return states.withColumns(read).drop("sketch")


def span_stats(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Count, total, maximum, median and 95th percentile of ``elapsed``."""
    # Written once: three readers would pair the spans anew.
    counts = settle(value_counts(spans, keys, "elapsed"))
    sums = counts.groupBy(*keys).agg(
        F.sum("_n").alias("n"), F.sum(F.col("elapsed") * F.col("_n")).alias("total_us"), F.max("elapsed").alias("max_us")
    )
    return sums.join(exact_percentiles(counts, keys, "elapsed", {"p50_us": 500, "p95_us": 950}), keys)
