"""Code dictionaries: look-up, duplicates, differences; event counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom import fixed_values as fv
from spanloom.functions import codec


def unite(*dictionaries: DataFrame) -> DataFrame:
    """All rows of several dictionaries, duplicates kept."""
    out = dictionaries[0]
    for d in dictionaries[1:]:
        out = out.unionByName(d)
    return out


def resolve(dictionary: DataFrame) -> DataFrame:
    """One name per id: the last line of the last source."""
    return dictionary.groupBy("debugid").agg(F.max_by("name", F.struct("source", "line")).alias("name"))


def duplicates(dictionary: DataFrame) -> DataFrame:
    """Ids defined more than once: one row per name, with its own and the id's count."""
    names = dictionary.groupBy("debugid", "name").agg(F.count(F.lit(1)).alias("n"))
    repeated = names.groupBy("debugid").agg(F.sum("n").alias("n_id")).filter(F.col("n_id") > 1)
    return names.join(repeated, "debugid")


def name_codes(df: DataFrame, dictionary: DataFrame, id_column: str = "eventid", name: str = "name") -> DataFrame:
    """Name of each event id, its hex digits where the dictionary has none.

    The side is one row per id; Spark broadcasts it while it is below the
    configured threshold and splits hot ids of a shuffled join otherwise.
    """
    known = resolve(dictionary).withColumnsRenamed({"debugid": id_column, "name": "_name"})
    joined = df.join(known, id_column, "left")
    return joined.withColumn(name, F.coalesce("_name", codec.hex_text(F.col(id_column)))).drop("_name")


def sorted_dictionary(dictionary: DataFrame) -> DataFrame:
    return dictionary.orderBy("debugid", "source", "line")


def difference(old: DataFrame, new: DataFrame) -> DataFrame:
    """Added, removed and renamed ids between two dictionaries."""
    before = resolve(old).withColumnRenamed("name", "old_name")
    after = resolve(new).withColumnRenamed("name", "new_name")
    change = (
        F.when(F.col("old_name").isNull(), "added")
        .when(F.col("new_name").isNull(), "removed")
        .when(F.col("old_name") != F.col("new_name"), "renamed")
    )
    return before.join(after, "debugid", "full").withColumn("change", change).filter(F.col("change").isNotNull())


def class_rollup(df: DataFrame) -> DataFrame:
    """Event counts by class, subclass and code with sub-totals.

    Events are counted per code first; the roll-up then works on those counts.
    """
    debugid = F.col("debugid")
    per_code = df.groupBy(
        codec.event_class(debugid).alias("class"), codec.event_subclass(debugid).alias("subclass"), codec.event_code(debugid).alias("code")
    ).agg(F.count(F.lit(1)).alias("_n"))
    return (
        per_code.rollup("class", "subclass", "code")
        .agg(F.sum("_n").alias("n"))
        .withColumn("class_name", codec.class_name(F.col("class")))
    )


def lost_events(df: DataFrame, window_us: int, is_marker: Column | None = None, ts: str = "ts") -> DataFrame:
    """Lost-event markers per time window."""
    marker = (codec.event_id(F.col("debugid")) == fv.LOST_EVENTS) if is_marker is None else is_marker
    start = (F.floor(F.col(ts) / window_us) * window_us).alias("window_start")
    return df.filter(marker).groupBy(start).agg(F.count(F.lit(1)).alias("markers"))


def window_counts(df: DataFrame, window_us: int, by: Column, ts: str = "ts") -> DataFrame:
    """Events per time window and class."""
    start = (F.floor(F.col(ts) / window_us) * window_us).alias("window_start")
    return df.groupBy(start, by).agg(F.count(F.lit(1)).alias("n"))


def top_spans(stats: DataFrame, keys: list[str], count: int = 10) -> DataFrame:
    """The keys with the greatest total, in order; ties go by key."""
    return stats.orderBy(F.desc("total_us"), *keys).limit(count)
