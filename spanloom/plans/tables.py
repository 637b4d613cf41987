"""Event views over the driver's tables, for Spark and as SQL text for the oracle."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom import schema
from spanloom.functions import codec


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(schema.TABLES[name]).parquet(os.path.join(sf_dir, f"{name}.parquet"))


def per_type(**by_type: Column | str | int) -> Column:
    """A value chosen by ``event_type``; null for types not named."""
    out = None
    for kind, value in by_type.items():
        value = value if isinstance(value, Column) else F.lit(value)
        test = F.col("event_type") == kind
        out = F.when(test, value) if out is None else out.when(test, value)
    return out


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events with ``seq`` as position, folded thread, process and CPU numbers."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"),
        "ts",
        (F.col("user_id") % 64).alias("tid"),
        (F.col("user_id") % 16).alias("pid"),
        (F.col("event_id") % 4).alias("cpu"),
        "user_id",
        "event_type",
        "value",
        "props",
        F.regexp_extract("props", "[0-9]+", 0).cast("long").alias("arg1"),
    )


EVENTS_SQL = """ev AS (
  SELECT event_id AS seq, epoch_us(ts) AS ts, user_id % 64 AS tid, user_id % 16 AS pid, event_id % 4 AS cpu,
    user_id, event_type, value, props, CAST(regexp_extract(props, '[0-9]+', 0) AS BIGINT) AS arg1
  FROM events)"""


def kevents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The decoded-record view: every event type stands for one event id."""
    base = per_type(click=0x040C0000, view=0x01400018, purchase=0x0120000C, signup=0x210A0008)
    base = F.coalesce(base, F.when(F.col("seq") % 2 == 0, 0x07020010).otherwise(0x07000004)).cast("long")
    ev = events(spark, sf_dir)
    return ev.select(
        "seq", "tid", "pid", "cpu", (base + F.col("seq") % 3).alias("debugid"), "ts", "arg1", F.col("user_id").alias("arg2")
    ).withColumn("eventid", codec.event_id(F.col("debugid")))


KEVENTS_SQL = (
    EVENTS_SQL
    + """, kevents AS (
  SELECT seq, tid, pid, cpu, ts, arg1, user_id AS arg2,
    CASE WHEN event_type='click' THEN 67895296 WHEN event_type='view' THEN 20971544
      WHEN event_type='purchase' THEN 18874380 WHEN event_type='signup' THEN 554303496
      WHEN seq % 2 = 0 THEN 117571600 ELSE 117440516 END + seq % 3 AS debugid
  FROM ev), k AS (SELECT *, debugid & 4294967292 AS eventid FROM kevents)"""
)
