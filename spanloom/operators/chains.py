"""Chains: every row says how many rows ahead the next head lies, and only heads are to be believed.

Rows behind a head may hold any values, also such that look like a head, so
nothing but following the pointers from a key's first row tells heads from
other rows. Following is sequential; what makes it parallel is that a pointer
never reaches further than ``most`` rows:

1. a block of ``2**BLOCK_BITS`` rows becomes a map: for each of the ``most``
   rows at which its first head may lie, where the first head of the next
   block lies;
2. maps of consecutive blocks are put together to maps of larger blocks, level
   by level, until one covers the key; coming back down, every block learns
   where its own first head lies;
3. a block then follows its pointers from there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.session import settle

BLOCK_BITS = 8


def _ordered(rows: DataFrame, keys: list[str], at: str, value: str, bits: int) -> DataFrame:
    """One row a block: ``block`` and ``parts``, its values in order."""
    found = F.array_sort(F.collect_list(F.struct(at, value)))
    return rows.groupBy(*keys, F.shiftright(at, bits).alias("block")).agg(F.transform(found, lambda r: r[value]).alias("parts"))


def _first_heads(maps: DataFrame, keys: list[str], most: int, bits: int) -> DataFrame:
    """(keys, block, entry): where in each block its first head lies, from the maps of the blocks."""
    grouped = settle(_ordered(maps, keys, "block", "exits", bits))
    if not grouped.agg(F.max("block")).first()[0]:
        started = grouped.withColumn("entry", F.lit(0))
    else:
        same = F.array(*map(F.lit, range(most)))
        through = F.aggregate("parts", same, lambda m, part: F.transform(m, lambda x: F.get(part, x)))
        started = grouped.join(_first_heads(grouped.select(*keys, "block", through.alias("exits")), keys, most, bits), [*keys, "block"])
    none = F.array().cast("array<int>")
    walked = F.aggregate(
        "parts",
        F.struct(F.col("entry").alias("next"), none.alias("seen")),
        lambda s, part: F.struct(F.get(part, s["next"]).alias("next"), F.concat(s["seen"], F.array(s["next"])).alias("seen")),
        lambda s: s["seen"],
    )
    each = started.select(*keys, F.col("block").alias("above"), F.posexplode(walked).alias("at", "entry"))
    return each.select(*keys, (F.shiftleft("above", bits) + F.col("at")).alias("block"), "entry")


def heads(rows: DataFrame, keys: list[str], at: str, jump: Column, most: int, bits: int | None = None) -> DataFrame:
    """(keys, ``at``, ``jump``) of the rows reached from the first row of each key.

    ``at`` is a dense position from 0 on within ``keys``, ``jump`` the distance
    to the next head, 1 to ``most``.
    """
    bits = BLOCK_BITS if bits is None else bits
    slim = rows.select(*keys, F.col(at).alias("_at"), jump.cast("int").alias("_jump"))
    blocks = settle(_ordered(slim, keys, "_at", "_jump", bits))
    # Going through a block from its end, the list holds the exits from the rows just behind.
    beyond = F.array(*map(F.lit, range(most)))
    exits = F.aggregate(F.reverse("parts"), beyond, lambda m, j: F.slice(F.concat(F.array(F.element_at(m, j)), m), 1, most))
    entries = _first_heads(blocks.select(*keys, "block", exits.alias("exits")), keys, most, bits)
    none = F.array().cast("array<struct<row:int,jump:int>>")
    numbered = F.transform("parts", lambda j, i: F.struct(i.alias("row"), j.alias("jump")))
    walked = F.aggregate(
        numbered,
        F.struct(F.col("entry").alias("next"), none.alias("seen")),
        lambda s, part: F.when(
            part["row"] == s["next"],
            F.struct((part["row"] + part["jump"]).alias("next"), F.concat(s["seen"], F.array(part)).alias("seen")),
        ).otherwise(s),
        lambda s: s["seen"],
    )
    found = blocks.join(entries, [*keys, "block"]).select(*keys, "block", F.explode(walked).alias("head"))
    return found.select(*keys, (F.shiftleft("block", bits) + F.col("head.row")).alias(at), F.col("head.jump").alias("jump"))
