"""Session set-up and lineage cutting."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int = 8, **conf: str) -> SparkSession:
    """A session for tests and the bench; on a cluster the caller brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("spanloom")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Give the session's Python workers this package, once a session."""
    if getattr(spark, "_spanloom_shipped", False):
        return
    package = Path(__file__).resolve().parent
    archive = os.path.join(tempfile.mkdtemp(prefix="spanloom-"), "spanloom.zip")
    with zipfile.ZipFile(archive, "w") as packed:
        for source in sorted(package.rglob("*.py")):
            packed.write(source, source.relative_to(package.parent))
    spark.sparkContext.addPyFile(archive)
    spark._spanloom_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by the cluster in ``spark.checkpoint.dir``.

    Only where that is unset in a local session (a test) a temporary folder is
    made and registered, so every later caller sees the same one. On a cluster
    each machine would see a folder of its own, so there an unset folder is an
    error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(configured)
        return configured
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        if not re.match(r"local(\[[^-]*\])?$", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spanloom-"))
        current = spark.sparkContext.getCheckpointDir()
    return current


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new, unused path below the shared folder."""
    return os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")


#: Tables this process has settled and not removed yet.
_SETTLED: list[str] = []


def remove(spark: SparkSession, path: str) -> None:
    """Remove a folder this package wrote, on whatever file system it lies."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(place, True)


def remove_settled(spark: SparkSession) -> int:
    """Remove all settled tables once the results that read them are written; gives their number."""
    paths = [_SETTLED.pop() for _ in range(len(_SETTLED))]
    for path in paths:
        remove(spark, path)
    return len(paths)


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder once and go on from there.

    Used where values must not change on recomputation (positions assigned
    after a range sort) or where a long chain would be planned repeatedly.
    Later readers prune columns and rows, and a lost executor costs nothing.
    """
    path = fresh_path(df.sparkSession, "settled")
    _SETTLED.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
