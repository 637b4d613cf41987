"""From cluster files to diagram text: the whole conversion as one plan each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions import codec
from spanloom.operators import graph, order
from spanloom.operators.sequence import last, scan
from spanloom.session import settle
from spanloom.sinks.text import write_lines
from spanloom.sources import text


def sequence_diagrams(spark: SparkSession, path: str, rows: int | None = None) -> DataFrame:
    """Diagram lines of a cluster file, per cluster and part of at most ``rows`` data rows."""
    headers, edges, rejected = text.read_clusters(spark, path)
    heads = headers.select("seq", F.col("seq").alias("_head"))
    # Unknown rows count towards the parts as well.
    data = edges.unionByName(rejected.drop("line"), allowMissingColumns=True)
    under = scan(data.unionByName(heads, allowMissingColumns=True), [], "seq", {"section": last(F.col("_head"))})
    counted = under.filter(F.col("_head").isNull()).drop("_head")
    sized = {} if rows is None else {"rows": rows}
    parted = settle(order.part_numbers(counted, section="section", **sized))
    named = F.concat(F.lit("Cluster_"), F.col("cluster"), F.lit("_part_"), F.col("part").cast("string"))
    known = parted.filter(F.col("host_name").isNotNull()).withColumn("diagram", named)
    return graph.participant_lines(known, ["diagram"])


def write_sequence_diagrams(spark: SparkSession, path: str, out: str) -> None:
    """One folder per diagram below ``out``."""
    write_lines(sequence_diagrams(spark, path), out, ["place", "pos", "who"], ["diagram"])


def message_charts(spark: SparkSession, path: str, header_has: str | None = None) -> DataFrame:
    """Message chart lines per cluster, under a file-safe name."""
    edges = text.read_chart_clusters(spark, path, header_has)
    name = codec.space_to_underscore(F.regexp_extract("cluster", r"^.([^(]*)", 1))
    return graph.chart_lines(edges.withColumn("chart", name), ["chart"])


def message_log_diagrams(spark: SparkSession, path: str) -> DataFrame:
    """Diagram lines of a message log, per section."""
    messages, _ = text.read_message_log(spark, path)
    timed = order.message_gaps(messages, ["section"])
    return graph.message_log_lines(timed.withColumn("arrow", codec.message_arrow(F.col("op"), F.col("delay"))), ["section"])
