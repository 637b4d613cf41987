"""Quality classifier by positive-unlabelled learning.

Trusted positives and unlabelled web text train a small network on statistics
of a text's form. The loss is the non-negative unbiased risk
``prior * R+(positives) + max(0, R-(unlabelled) - prior * R-(positives))``:
unlabelled text counts as negative, corrected by the share of it that is
positive (the class prior); once the corrected part falls below zero, which
only overfitting can cause, its gradient is reversed.
"""

from __future__ import annotations

import math
import operator
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import ship

#: Most rows of trusted positives, and of unlabelled text, the model is fitted on.
SAMPLE = 20_000
FOLDS = 5
THRESHOLD = 0.3
HIDDEN = 12
N_FEATURES = 21


def features(text: str) -> list[float]:
    """Statistics of a text's form, none of them of its language or topic. An empty text has zeros throughout."""
    words = text.split()
    n = len(words)
    if n == 0:
        return [0.0] * N_FEATURES
    counts = Counter(words)
    sizes = list(map(len, words))
    mean = sum(sizes) / n
    lines = [x for x in text.split("\n") if x.strip()]
    data = np.bincount(np.frombuffer(text.encode(), np.uint8), minlength=256) / len(text)
    pairs = len(set(zip(words, words[1:]))) / max(1, n - 1)
    per_word = len(text) / n
    distinct = len(counts) / n
    return [
        math.log1p(n),
        distinct,
        distinct * math.log1p(n),
        counts.most_common(1)[0][1] / n,
        sum(map(operator.eq, words, words[1:])) / n,
        pairs,
        sum(map(str.isupper, words)) / n,
        sum(map(str.istitle, words)) / n,
        float(data[65:91].sum()),
        float(data[97:123].sum()),
        float(data[128:].sum()),
        float(data[48:58].sum()),
        float(data[33]) * per_word,
        float(data[124]) * per_word,
        float(data[[35, 36, 37, 38, 42, 43, 60, 62, 64, 94, 95, 126]].sum()) * per_word,
        float(data[44] + data[46]) * per_word,
        mean,
        math.log1p(max(sizes)),
        len(lines) / n,
        1 - len(set(lines)) / len(lines),
        float(np.std(sizes)),
    ]


def matrix(texts: list[str | None]) -> np.ndarray:
    return np.array([features(t or "") for t in texts], float).reshape(-1, N_FEATURES)


@dataclass(frozen=True)
class Model:
    centre: np.ndarray
    scale: np.ndarray
    first: np.ndarray
    second: np.ndarray
    prior: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.centre) / self.scale, -8, 8)
        return np.tanh(np.c_[z, np.ones(len(z))] @ self.first) @ self.second[:-1] + self.second[-1]

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x), -30, 30)))


def train(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 1500, batch: int = 512, seed: int = 7) -> Model:
    """Minimise the non-negative risk with Adam; the result depends on the rows and the seed alone."""
    rng = np.random.default_rng(seed)
    centre, scale = unlabelled.mean(0), unlabelled.std(0) + 1e-6
    ready = lambda x: np.c_[np.clip((x - centre) / scale, -8, 8), np.ones(len(x))]
    p_all, u_all = ready(positive), ready(unlabelled)
    first = rng.normal(0, 0.3, (p_all.shape[1], HIDDEN))
    second = rng.normal(0, 0.3, HIDDEN + 1)
    second[-1] = math.log(prior / (1 - prior))
    moments = [np.zeros_like(w) for w in (first, second, first, second)]
    sigmoid = lambda g: 1 / (1 + np.exp(-g))
    for step in range(1, steps + 1):
        p = p_all[rng.integers(0, len(p_all), batch)]
        u = u_all[rng.integers(0, len(u_all), batch)]
        x = np.r_[p, u]
        h = np.tanh(x @ first)
        g = np.clip(h @ second[:-1] + second[-1], -30, 30)
        gp, gu = g[:batch], g[batch:]
        negative = np.log1p(np.exp(gu)).mean() - prior * np.log1p(np.exp(gp)).mean()
        slope_p_negative, slope_u = -prior * sigmoid(gp) / batch, sigmoid(gu) / batch
        if negative >= 0:
            slope = np.r_[-prior * sigmoid(-gp) / batch + slope_p_negative, slope_u]
        else:
            slope = -np.r_[slope_p_negative, slope_u]
        hidden = np.outer(slope, second[:-1]) * (1 - h * h)
        slopes = (x.T @ hidden + 1e-3 * first, np.r_[h.T @ slope, slope.sum()] + 1e-3 * np.r_[second[:-1], 0])
        rate = 0.01 * (1 - step / (steps + 1))
        for i, (w, d) in enumerate(zip((first, second), slopes)):
            moments[i] = 0.9 * moments[i] + 0.1 * d
            moments[i + 2] = 0.999 * moments[i + 2] + 0.001 * d * d
            w -= rate * (moments[i] / (1 - 0.9**step)) / (np.sqrt(moments[i + 2] / (1 - 0.999**step)) + 1e-8)
    return Model(centre, scale, first, second, prior)


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept for testing: crc32 of its id's text divisible by FOLDS; not if it has no id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    """A model from the labels outside the held-out fold; None if there are no trusted positives or no texts.

    Positives are the ``sample`` labelled rows of quality 1 that come first by
    a hash of their id, unlabelled text as many documents by the same hash; the
    labels' share of positives, smoothed, is the class prior. Ids with
    contradicting labels count as quality 0; rows without id or label are
    ignored. Only features of at most 2 * ``sample`` rows reach the driver.
    """
    ship(docs.sparkSession)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    known = known.filter("doc_id is not null and quality is not null").filter(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    n, good = known.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.when(F.col("quality") == 1, 1)), F.lit(0))).first()
    rows = docs.count()
    if not good or not rows:
        return None
    prior = (good + 1) / (n + 2)
    trusted = known.filter("quality = 1").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).select("doc_id")
    # At most ``sample`` ids of 8 bytes: the bound that allows a broadcast.
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    kinds = texts.join(F.broadcast(trusted.withColumn("trusted", F.lit(True))), "doc_id", "left")
    share = min(1.0, sample / rows)
    drawn = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < math.ceil(share * (1 << 20))
    chosen = kinds.select("doc_id", "text", F.coalesce("trusted", F.lit(False)).alias("trusted"), drawn.alias("drawn")).filter("trusted or drawn")

    def measure(frames):
        for frame in frames:
            yield pd.DataFrame({"doc_id": frame["doc_id"], "trusted": frame["trusted"], "drawn": frame["drawn"], "x": list(matrix(frame["text"].tolist()))})

    got = chosen.mapInPandas(measure, "doc_id long, trusted boolean, drawn boolean, x array<double>")
    got = got.orderBy(F.xxhash64("doc_id"), "doc_id").limit(4 * sample).collect()
    positive = np.array([r["x"] for r in got if r["trusted"]][: 2 * sample])
    unlabelled = np.array([r["x"] for r in got if r["drawn"]][: 2 * sample])
    if not len(positive) or not len(unlabelled):
        return None
    return train(positive, unlabelled, prior)


def score(model: Model | None, text: Column) -> Column:
    """The model's probability of quality 1; without a model 1, so nothing is rejected."""
    if model is None:
        return F.lit(1.0)

    @F.pandas_udf("double")
    def judge(texts: pd.Series) -> pd.Series:
        return pd.Series(model.scores(matrix(texts.tolist())))

    return judge(F.coalesce(text, F.lit("")))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Score and decision for every row of ``docs``, also those with null or repeated ids.

    The whole text is scored; null texts are empty ones. Labels, lang, source
    and ids are no inputs of a score. An empty table gives no rows; other
    columns are ignored.
    """
    scored = docs.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), score(fit(docs, labels), F.col("text")).alias("score")
    )
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not rejected, with all their columns."""
    return docs.filter(score(fit(docs, labels), F.col("text")) >= THRESHOLD)
