"""Queries on raw event files written from the tables."""

from pyspark.sql import functions as F

from spanloom.operators.filters import type_filter
from spanloom.operators.sequence import row_numbers
from spanloom.plans.registry import query
from spanloom.plans.tables import KEVENTS_SQL, kevents, table
from spanloom.session import fresh_path
from spanloom.sources import raw


def narrow(spark, sf_dir, path, by=None, **options):
    """events whose values fit in 32 bits, added to a folder of raw files."""
    raw.register(spark)
    rows = kevents(spark, sf_dir)
    rows = (rows if by is None else rows.filter(by)).select(
        "seq", "ts", "arg1", "arg2", F.lit(0).cast("long").alias("arg3"), F.col("seq").alias("arg4"), "tid", "debugid", F.col("cpu").cast("int").alias("cpu")
    )
    placed = rows.repartitionByRange("seq").sortWithinPartitions("seq").drop("seq")
    placed.write.format("rawevents").mode("append").options(**options).save(path)
    return path


NARROW_SQL = f"WITH {KEVENTS_SQL} SELECT ts, arg1, arg2, CAST(0 AS BIGINT) AS arg3, seq AS arg4, tid, debugid, CAST(cpu AS INTEGER) AS cpu FROM k"


@query("raw_oldest", NARROW_SQL)
def raw_oldest(spark, sf_dir):
    """The oldest layout: no magic, no padding before the records."""
    return raw.read_raw(spark, narrow(spark, sf_dir, fresh_path(spark, "raw"), version=0), splitbytes=1 << 20).drop("seq")


@query("raw_32bit", NARROW_SQL)
def raw_32bit(spark, sf_dir):
    """32-bit records, which carry the CPU in the upper byte of the clock."""
    return raw.read_raw(spark, narrow(spark, sf_dir, fresh_path(spark, "raw"), bits=32), bits=32, splitbytes=1 << 20).drop("seq")


@query("raw_append", f"WITH {KEVENTS_SQL} SELECT row_number() OVER (ORDER BY seq % 3 = 0 DESC, seq) - 1 AS at, seq AS event FROM k")
def raw_append(spark, sf_dir):
    """Two writes into one folder: all rows are there, those of the first write before the others."""
    path = fresh_path(spark, "raw")
    narrow(spark, sf_dir, path, F.col("seq") % 3 == 0)
    narrow(spark, sf_dir, path, F.col("seq") % 3 != 0)
    rows = raw.read_raw(spark, path).select("seq", F.col("arg4").alias("event"))
    return row_numbers(rows, [], "seq", "at").select((F.col("at") - 1).alias("at"), "event")


def written(spark, sf_dir):
    """events as raw records, with the customer of each thread number as its command."""
    raw.register(spark)
    names = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("tid"), F.col("c_name").alias("command"))
    zero = F.lit(0).cast("long")
    rows = kevents(spark, sf_dir).join(names, "tid", "left").select(
        "seq", "ts", "arg1", "arg2", zero.alias("arg3"), (-F.col("seq")).alias("arg4"), "tid", "debugid", F.col("cpu").cast("int").alias("cpu"), "command"
    )
    path = fresh_path(spark, "raw")
    placed = rows.repartitionByRange("seq").sortWithinPartitions("seq").drop("seq")
    placed.write.format("rawevents").mode("append").option("cpus", "0:0:CPU0,3:1:IOP").option("secs", "1700000000").save(path)
    return path


@query(
    "raw_roundtrip",
    f"WITH {KEVENTS_SQL} SELECT ts, arg1, arg2, CAST(0 AS BIGINT) AS arg3, -seq AS arg4, tid, debugid, CAST(cpu AS INTEGER) AS cpu FROM k",
)
def raw_roundtrip(spark, sf_dir):
    return raw.read_raw(spark, written(spark, sf_dir), splitbytes=1 << 20).drop("seq")


@query(
    "raw_order",
    f"WITH {KEVENTS_SQL} SELECT seq AS at, seq AS event FROM k",
)
def raw_order(spark, sf_dir):
    """Positions in file order, made dense over all files, are the event order."""
    rows = raw.read_raw(spark, written(spark, sf_dir), splitbytes=1 << 20).select("seq", (-F.col("arg4")).alias("event"))
    return row_numbers(rows, [], "seq", "at").select((F.col("at") - 1).alias("at"), "event")


@query("raw_threadmap", f"WITH {KEVENTS_SQL} SELECT DISTINCT tid, CAST(1 AS INTEGER) AS valid, c_name AS command FROM k JOIN customer ON c_custkey = tid WHERE tid <> 0")
def raw_threadmap(spark, sf_dir):
    return raw.read_raw(spark, written(spark, sf_dir), table="threadmap").select("tid", "valid", "command").distinct()


@query(
    "raw_cpumap",
    f"WITH {KEVENTS_SQL} SELECT CASE cpu WHEN 0 THEN 'CPU0' WHEN 3 THEN 'IOP' END AS name, CASE cpu WHEN 0 THEN CAST(0 AS BIGINT) WHEN 3 THEN CAST(1 AS BIGINT) END AS flags, count(*) AS n FROM k GROUP BY cpu IN (0, 3), 1, 2",
)
def raw_cpumap(spark, sf_dir):
    """Records per CPU of the map in their own file."""
    path = written(spark, sf_dir)
    cpus = raw.read_raw(spark, path, table="cpumap").withColumnRenamed("cpu_id", "cpu")
    number = raw.file_number(F.col("seq")).alias("number")
    counted = raw.read_raw(spark, path).groupBy(number, F.col("cpu").cast("long").alias("cpu")).agg(F.count(F.lit(1)).alias("n"))
    return counted.join(cpus, ["number", "cpu"], "left").groupBy("name", "flags").agg(F.sum("n").alias("n"))


@query(
    "raw_pushed",
    f"WITH {KEVENTS_SQL} SELECT ts, arg1, arg2, tid, debugid, CAST(cpu AS INTEGER) AS cpu FROM k WHERE (debugid >> 24 = 4 OR debugid >> 16 = 320) AND cpu IN (1, 2) AND tid < 40 AND ts >= 1704700000000000",
)
def raw_pushed(spark, sf_dir):
    """Types, processors, threads and times of interest: tested in the reader, but for what lies between two types."""
    rows = raw.read_raw(spark, written(spark, sf_dir), splitbytes=1 << 20)
    kept = type_filter(rows, classes=[4], subclasses=[(1, 0x40)])
    kept = kept.filter(F.col("cpu").isin(1, 2) & (F.col("tid") < 40) & (F.col("ts") >= 1704700000000000))
    return kept.select("ts", "arg1", "arg2", "tid", "debugid", "cpu")


@query("raw_header", "SELECT CAST(1 AS INTEGER) AS version, CAST(1700000000 AS BIGINT) AS secs, count(*) AS records FROM events")
def raw_header(spark, sf_dir):
    heads = raw.read_raw(spark, written(spark, sf_dir), table="header")
    return heads.groupBy("version", "secs").agg(F.sum("records").alias("records"))
