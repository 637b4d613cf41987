"""URL filter: allow and block rules, and gradient-boosted trees on lexical features for the other URLs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import let
from spanloom.session import settle

#: Most labelled URLs the trees are trained on.
SAMPLE = 20_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Verdict and rule, host and path.
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
FEATURES = ["size", "host_size", "path_size", "depth", "labels", "digit_ratio", "host_digits", "dashes", "entropy", "params", "fragment", "secure", "suffix_rate", "host_rate", "start_rate"]


@dataclass(frozen=True)
class Smoothed:
    """Share of blocked among a group's labelled URLs, drawn to the overall share as by ``weight`` further URLs."""

    weight: float = 5.0


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host_col: Column, path_col: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest rule that fits, as a struct of rule and verdict; null if none does."""
    fits = None
    for verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        name, _, rest = rule.partition("/")
        test = ((host_col == name) | host_col.endswith("." + name)) & path_col.startswith("/" + rest)
        value = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        fits = F.when(test, value) if fits is None else fits.when(test, value)
    return fits if fits is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def entropy(text: Column) -> Column:
    """Bits per character of a text, 0 for an empty one."""
    size = F.length(text).cast("double")
    share = lambda c: (size - F.length(F.replace(text, c, F.lit("")))) / size
    kinds = F.array_distinct(F.filter(F.split(text, ""), lambda c: c != ""))
    return F.aggregate(kinds, F.lit(0.0), lambda s, c: s - let(share(c), lambda p: p * F.log2(p)))


def lexical(pages: DataFrame) -> DataFrame:
    """Adds the features that follow from a URL alone."""
    url = F.coalesce(F.col("url"), F.lit(""))
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    count = lambda text, pattern: F.regexp_count(text, F.lit(pattern)).cast("double")
    host_col, path_col = F.col("host"), F.col("path")
    return pages.withColumns(
        {
            "size": F.length(url).cast("double"),
            "host_size": F.length(host_col).cast("double"),
            "path_size": F.length(path_col).cast("double"),
            "depth": count(path_col, "/+[^/]"),
            "labels": count(host_col, "[^.]+"),
            "digit_ratio": count(url, "[0-9]") / F.greatest(F.length(url), F.lit(1)),
            "host_digits": count(host_col, "[0-9]"),
            "dashes": count(url, "[-_]"),
            "entropy": entropy(url),
            "params": F.when(query == "", 0.0).otherwise(count(query, "&") + 1),
            "fragment": count(url, "#"),
            "secure": url.startswith("https").cast("double"),
            "suffix": F.substring_index(host_col, ".", -1),
            "start": F.substring_index(F.substring(path_col, 2, 1 << 30), "/", 1),
        }
    )


def rates(rows: DataFrame, training: DataFrame, overall: float, smoothed: Smoothed = Smoothed()) -> DataFrame:
    """Adds the blocked shares of a URL's host suffix, host and first folder among the training URLs.

    The tables joined have a row at most for each training URL, whose number is bounded.
    """
    for key, name in (("suffix", "suffix_rate"), ("host", "host_rate"), ("start", "start_rate")):
        w = smoothed.weight
        table = training.groupBy(key).agg(((F.sum("label") + w * overall) / (F.count(F.lit(1)) + w)).alias(name))
        rows = rows.join(F.broadcast(table), key, "left").withColumn(name, F.coalesce(name, F.lit(overall)))
    return rows


def judge(pages: DataFrame, rules: list[tuple[str, str]] = RULES, labelled: DataFrame | None = None, sample: int = SAMPLE) -> DataFrame:
    """Verdict for every URL: that of the longest rule that fits, else that of the trees.

    The trees are trained on ``labelled`` (``url``, ``label`` 1 for block); by
    default on the URLs the rules decide, at most ``sample`` distinct ones
    that come first by a hash. If these have one label only, it holds
    for all URLs; without any, all are allowed.

    Null URLs and those without ``://`` have an empty host and path and go
    to the trees. Repeated and null page ids are passed through; an empty table
    gives no rows; other columns are ignored.
    """
    url = F.col("url").cast("string")
    rows = pages.select("page_id", url.alias("url"), host(url).alias("host"), path(url).alias("path"))
    rows = rows.withColumn("_fit", rule_of(F.col("host"), F.col("path"), rules))
    if labelled is None:
        known = rows.filter("_fit is not null").select("url", "host", "path", (F.col("_fit.verdict") == "block").cast("double").alias("label"))
    else:
        known = labelled.select("url", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), F.col("label").cast("double").alias("label"))
    known = known.filter("url is not null and label is not null").groupBy("url", "host", "path").agg(F.max("label").alias("label"))
    training = settle(lexical(known.orderBy(F.xxhash64("url"), "url").limit(sample)))
    n, blocked = training.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    if blocked in (0, n):
        guess = F.lit("block" if n and blocked else "allow")
        return rows.select("page_id", "host", "path", F.col("_fit.rule").alias("rule"), F.coalesce(F.col("_fit.verdict"), guess).alias("verdict"))
    gather = VectorAssembler(inputCols=FEATURES, outputCol="_x")
    ready = rates(training, training, blocked / n).orderBy(F.xxhash64("url"), "url").coalesce(1)
    model = GBTClassifier(featuresCol="_x", labelCol="label", maxIter=15, maxDepth=4, seed=7).fit(gather.transform(ready))
    judged = model.transform(gather.transform(rates(lexical(rows), training, blocked / n)))
    guess = F.when(F.col("prediction") == 1, "block").otherwise("allow")
    return judged.select("page_id", "host", "path", F.col("_fit.rule").alias("rule"), F.coalesce(F.col("_fit.verdict"), guess).alias("verdict"))
