"""The pipeline's near-duplicate stage against a plain join at 0.8."""

import numpy as np

import corpus_pipeline
from spanloom.llm import hyperminhash


def plain_kept(texts, share):
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in map(str.split, texts)]
    low = list(range(len(texts)))
    pairs = [(a, b) for a in low for b in low[:a] if 100 * len(sets[a] & sets[b]) >= share * len(sets[a] | sets[b])]
    for _ in texts:
        for a, b in pairs:
            low[a] = low[b] = min(low[a], low[b])
    return {i for i, x in enumerate(low) if i == x}


def test_stage_links_from_80(spark):
    rng = np.random.default_rng(8)
    texts = []
    for n in [*range(104, 304, 5)]:
        own = [f"w{x}" for x in rng.integers(0, 50_000, n)]
        # Another end takes that many shingles from both sides: similarities of 0.78 to 0.88.
        cut = round((n - 4) * (1 - (s := rng.uniform(0.78, 0.88))) / (1 + s))
        texts += [" ".join(own), " ".join([*own[: n - cut], *(f"x{x}" for x in rng.integers(0, 50_000, cut))])]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id for r in corpus_pipeline.single(spark, rows, "").collect()}
    assert got == plain_kept(texts, 80) != plain_kept(texts, 85)
    assert {r.doc_id for r in hyperminhash.keep_one(rows, share=85).collect()} == plain_kept(texts, 85)


def test_bands_and_cuts_of_a_share():
    assert [hyperminhash.band_width(s) for s in (85, 80)] == [7, 6]
    assert [round(x, 2) for x in hyperminhash.cuts(85)] == [0.70, 0.55] and round(hyperminhash.cuts(80)[0], 2) == 0.63
