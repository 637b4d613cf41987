"""Helpers the operators of this subpackage share."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.session import settle


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Give the session's Python workers this package, once a session."""
    if getattr(spark, "_spanloom_llm", False):
        return
    package = Path(__file__).resolve().parent.parent
    archive = os.path.join(tempfile.mkdtemp(prefix="spanloom-"), "spanloom_llm.zip")
    with zipfile.ZipFile(archive, "w") as packed:
        for source in sorted(package.rglob("*.py")):
            packed.write(source, source.relative_to(package.parent))
    spark.sparkContext.addPyFile(archive)
    spark._spanloom_llm = True


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, also where the body uses it in a lambda."""
    return F.transform(F.array(value), body)[0]


def spans(*keys: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of equal consecutive key tuples."""
    n = len(keys[0])
    if n == 0:
        return []
    change = np.zeros(n - 1, bool)
    for k in keys:
        change |= k[1:] != k[:-1]
    cuts = [0, *(np.flatnonzero(change) + 1).tolist(), n]
    return list(zip(cuts[:-1], cuts[1:]))


def pack_lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    sizes = np.fromiter((len(a) for a in arrays), np.int64, len(arrays))
    offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    flat = np.concatenate(arrays) if arrays else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, kind))


def components(nodes_edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Smallest node of each connected component: columns ``node``, ``root`` for every node of an edge.

    Every node takes the smallest label among its neighbours and then that
    label's own label, so labels run down long chains in few rounds. Rounds are
    written to the shared folder; the driver sees one number a round.
    """
    edges = nodes_edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a <> b")
    both = settle(edges.union(edges.select("b", "a")).distinct())
    labels = settle(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")))
    while True:
        near = (
            both.join(labels, both.b == labels.node)
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("root").alias("low"))
        )
        stepped = labels.join(near, "node").select("node", F.least("root", "low").alias("root"), F.col("root").alias("was"))
        heads = stepped.select(F.col("node").alias("head"), F.col("root").alias("up"))
        jumped = stepped.join(heads, stepped.root == heads["head"], "left").select(
            "node", F.least("root", F.coalesce("up", "root")).alias("root"), "was"
        )
        labels = settle(jumped)
        if labels.filter("root <> was").isEmpty():
            return labels.select("node", "root")
        labels = labels.select("node", "root")
