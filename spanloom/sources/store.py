"""Decoded events as stored tables that type filters read in small part.

Records lie in one folder for each class, sorted by class-subclass number and
time. A type filter then lists the folders of its classes only, and in these
skips row groups by the statistics of ``csc`` and ``ts``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions import codec
from spanloom.operators.filters import any_of


def write_store(records: DataFrame, path: str, mode: str = "append") -> None:
    """Add records (with ``debugid`` and ``ts``) to a store.

    A range sort spreads a class that holds most records over many files, each
    of them with a range of its own.
    """
    debugid = F.col("debugid")
    keyed = records.withColumns({"class": codec.event_class(debugid).cast("int"), "csc": codec.class_subclass(debugid).cast("int")})
    order = ["class", "csc", "ts"]
    keyed.repartitionByRange(*order).sortWithinPartitions(*order).write.partitionBy("class").mode(mode).parquet(path)


def read_store(spark: SparkSession, path: str, types: list[tuple[int, int]] | None = None) -> DataFrame:
    """Records of a store; ``types`` are ranges as ``filters.type_ranges`` gives them."""
    rows = spark.read.parquet(path)
    if types is None:
        return rows.drop("class", "csc")
    classes = F.col("class").isin(sorted({c for low, high in types for c in range(low >> 8, (high >> 8) + 1)}))
    within = any_of([F.col("csc").between(low, high) for low, high in types])
    return rows.filter(classes & within).drop("class", "csc")
