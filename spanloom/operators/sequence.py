"""Ordered scans over event sequences.

Every stateful question about an event log (what came before, which header is
in force, how many so far) is a window over ``(key, position)``. A plain
``Window.partitionBy(key)`` puts each key into one task, and a window without
a key puts the whole log into one task. ``scan`` cuts every key into blocks of
consecutive positions instead:

1. window functions run inside ``(key, block)``;
2. one small row per ``(key, block)`` is aggregated with map-side combine;
3. a window over these block rows gives what earlier blocks hand over;
4. the hand-over is joined back on ``(key, block)``, the partitioning the
   window already has.

A position is a unique LONG within its key, so a block holds at most
``2**span_bits`` rows, whatever share of the log one key has. Positions of one
key should also be dense, or blocks are too many; where they are times or
addresses, or keys are many and short, ``split='hot'`` cuts by row numbers.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.session import settle

SPAN_BITS = 22
HOT_ROWS = 1 << 22


@dataclass(frozen=True)
class Step:
    kind: str
    value: Column
    before: bool = False


def prev(value: Column) -> Step:
    """Value of the row just before, null if there is none."""
    return Step("prev", value)


def last(value: Column, before: bool = False) -> Step:
    """Latest non-null value so far; ``before`` leaves the current row out."""
    return Step("last", value, before)


def total(value: Column, before: bool = False) -> Step:
    """Running sum of a non-null number."""
    return Step("total", value, before)


def low(value: Column, before: bool = False) -> Step:
    return Step("low", value, before)


def high(value: Column, before: bool = False) -> Step:
    return Step("high", value, before)


def _combine(kind: str, carried: Column, local: Column) -> Column:
    if kind == "last":
        return F.coalesce(local, carried)
    if kind == "total":
        return F.coalesce(carried, F.lit(0)) + F.coalesce(local, F.lit(0))
    return {"low": F.least, "high": F.greatest}[kind](carried, local)


_WINDOW_FN = {
    "last": lambda c: F.last(c, ignorenulls=True),
    "total": F.sum,
    "low": F.min,
    "high": F.max,
}


def _hot_keys(df: DataFrame, keys: list[str], hot_rows: int) -> DataFrame:
    """Keys with more than ``hot_rows`` rows: at most rows / hot_rows of them."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > hot_rows).drop("_n")


def scan(
    df: DataFrame,
    keys: list[str],
    order: str,
    steps: dict[str, Step],
    span_bits: int | None = None,
    split: str = "all",
    hot_rows: int | None = None,
    shared: bool = False,
    keep: bool = False,
) -> DataFrame:
    """Add one column per step, computed along ``order`` within ``keys``.

    ``order`` is a LONG, unique within ``keys``; keys are never null.
    ``split='all'`` cuts every key into blocks, right for the few, long keys
    of an event log (threads, thread and code, the whole file).
    ``split='hot'`` is for many short keys (message pointers) and for sparse
    positions (times, addresses): a narrow count, settled, finds the keys above
    ``hot_rows``. Only their rows are numbered along ``order`` and cut by that
    number, so blocks are full whatever the positions are. Without hot keys the
    scan is one bare window and nothing is handed over.

    ``shared`` says that the steps use all columns of ``df``. Rows are then
    shuffled once and both the windows and the block rows read that shuffle,
    so a chain of scans computes its input once. With further columns the
    block rows come from the input instead, combined before their shuffle.

    ``keep`` leaves the block number in the result. A next scan over the same
    keys, order and span takes it up: its rows already lie where it needs
    them, so the whole chain shuffles them once.
    """
    span_bits = SPAN_BITS if span_bits is None else span_bits
    hot_rows = HOT_ROWS if hot_rows is None else hot_rows
    names = list(steps)
    block = F.shiftright(F.col(order), span_bits)
    if split == "hot":
        hot = settle(_hot_keys(df, keys, hot_rows))
        # Short keys all sit in one block each; the constant keeps the join key non-null.
        rows, cut = df.withColumn("_blk", F.lit(-1).cast("long")), None
        if not hot.isEmpty():
            placed = sequence(df.join(F.broadcast(hot), keys, "left_semi"), *keys, order, name="_place")
            cut = placed.withColumn("_blk", F.shiftright("_place", span_bits)).drop("_place")
            rows = rows.join(F.broadcast(hot), keys, "left_anti").unionByName(cut)
    elif "_blk" in df.columns:
        rows = cut = df
    else:
        rows = df.withColumn("_blk", block)
        if shared:
            rows = rows.repartition(*keys, "_blk")
        cut = rows
    values = [steps[n].value.alias(f"_v_{n}") for n in names]
    rows = rows.select("*", *values)

    inside = Window.partitionBy(*keys, "_blk").orderBy(order)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto_before = inside.rowsBetween(Window.unboundedPreceding, -1)
    local = rows.select(
        "*",
        F.row_number().over(inside).alias("_rn"),
        *[
            F.lag(f"_v_{n}").over(inside).alias(f"_l_{n}")
            if steps[n].kind == "prev"
            else _WINDOW_FN[steps[n].kind](F.col(f"_v_{n}"))
            .over(upto_before if steps[n].before else upto)
            .alias(f"_l_{n}")
            for n in names
        ],
    )

    def block_value(n: str) -> Column:
        v, kind = F.col(f"_v_{n}"), steps[n].kind
        if kind == "prev":
            return F.max_by(v, F.col(order))
        if kind == "last":
            return F.max_by(v, F.when(v.isNotNull(), F.col(order)))
        return _WINDOW_FN[kind](v)

    def handed_over() -> DataFrame:
        blocks = cut.select("*", *values).groupBy(*keys, "_blk").agg(*[block_value(n).alias(f"_b_{n}") for n in names])
        # One row per block, so the window below is 2**span_bits times shorter than the log.
        along = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_blk")
        earlier = along.rowsBetween(Window.unboundedPreceding, -1)
        carried = blocks.select(
            *keys,
            "_blk",
            *[
                (
                    F.lag(f"_b_{n}").over(along)
                    if steps[n].kind == "prev"
                    else _WINDOW_FN[steps[n].kind](F.col(f"_b_{n}")).over(earlier)
                ).alias(f"_c_{n}")
                for n in names
            ],
        )
        return local.join(carried, [*keys, "_blk"], "left")

    joined = local.withColumns({f"_c_{n}": F.lit(None) for n in names}) if cut is None else handed_over()
    out = [
        (
            F.when(F.col("_rn") == 1, F.col(f"_c_{n}")).otherwise(F.col(f"_l_{n}"))
            if steps[n].kind == "prev"
            else _combine(steps[n].kind, F.col(f"_c_{n}"), F.col(f"_l_{n}"))
        ).alias(n)
        for n in names
    ]
    kept = [c for c in df.columns if c not in names and c != "_blk"]
    return joined.select(*[F.col(f"`{c}`") for c in kept], *(["_blk"] if keep else []), *out)


def sequence(df: DataFrame, *order: str, name: str = "seq") -> DataFrame:
    """Give rows a position along a total order that has no integer position yet.

    Range partitions are sorted and numbered within; partition number in the
    high bits makes the numbers rise along the whole order. The result is
    settled, because sampled range bounds may differ on recomputation.
    """
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return settle(placed.withColumn(name, F.monotonically_increasing_id()))


def row_numbers(df: DataFrame, keys: list[str], order: str, name: str = "rn") -> DataFrame:
    """1-based position within ``keys`` along ``order``."""
    return scan(df, keys, order, {name: total(F.lit(1).cast("long"))})


def runs(df: DataFrame, keys: list[str], order: str, value: str, name: str = "run", breaks: Column | None = None) -> DataFrame:
    """Number runs of equal consecutive ``value``: ``name`` is the position of the run's first row.

    ``breaks`` marks rows that stand alone, whatever their neighbours hold.
    """
    if breaks is None and set(df.columns) == {*keys, order, value}:
        seen = scan(df, keys, order, {"_px": prev(F.col(value)), "_pat": prev(F.col(order))}, shared=True, keep=True)
        starts = F.col("_pat").isNull() | ~F.col("_px").eqNullSafe(F.col(value))
        return scan(seen, keys, order, {name: last(F.when(starts, F.col(order)))}).drop("_px", "_pat")
    lone = F.lit(False) if breaks is None else breaks
    seen = scan(
        df.withColumn("_x", F.col(value)).withColumn("_lone", lone),
        keys,
        order,
        {"_px": prev(F.col("_x")), "_plone": prev(F.col("_lone"))},
        keep=True,
    )
    starts = (~F.col("_px").eqNullSafe(F.col("_x"))) | F.col("_lone") | F.coalesce("_plone", F.lit(True))
    return scan(seen, keys, order, {name: last(F.when(starts, F.col(order)))}).drop("_x", "_lone", "_px", "_plone")


def episodes(df: DataFrame, keys: list[str], order: str, opens: Column, closes: Column, name: str = "episode") -> DataFrame:
    """Rows from an opening row to the first closing row after it.

    An opening row always begins a new episode. A row may open and close at
    once. Rows outside any episode are dropped. ``name`` is the position of
    the opening row.
    """
    seen = scan(
        df,
        keys,
        order,
        {
            name: last(F.when(opens, F.col(order))),
            "_closed": last(F.when(closes, F.col(order)), before=True),
        },
    )
    alive = F.col(name).isNotNull() & (F.col("_closed").isNull() | (F.col("_closed") < F.col(name)))
    return seen.filter(alive).drop("_closed")


def first_rows(df: DataFrame, keys: list[str], order: str, count: int, name: str = "idx") -> DataFrame:
    """The first ``count`` rows per group with a 0-based index.

    A row-number bound on a window lets Spark drop the rest before the shuffle.
    """
    at = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn(name, F.row_number().over(at)).filter(F.col(name) <= count).withColumn(name, F.col(name) - 1)


def ordered_text(df: DataFrame, keys: list[str], order: str, value: str, sep: str, name: str, piece_bits: int = 12) -> DataFrame:
    """Concatenate ``value`` along ``order`` per group, in pieces first.

    The pieces hold at most ``2**piece_bits`` positions each, so only finished
    pieces meet in the group that holds the whole text.
    """
    pieces = (
        df.groupBy(*keys, F.shiftright(F.col(order), piece_bits).alias("_piece"))
        .agg(
            F.array_join(
                F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v")))), lambda s: s["v"]), sep
            ).alias("_text"),
            F.count(F.lit(1)).alias("_n"),
        )
    )
    return pieces.groupBy(*keys).agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("_piece", "_text"))), lambda s: s["_text"]), sep
        ).alias(name),
        F.sum("_n").alias("n"),
    )
