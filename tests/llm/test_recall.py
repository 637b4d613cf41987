"""Pairs at the near-duplicate limit, and how few links a group of near copies leaves."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.llm import hyperminhash


def pair(rng, size, share):
    """Two sets of hashes with just the share of common ones that makes a link."""
    common = -(-2 * size * share // (100 + share))
    own = rng.integers(0, 1 << 63, 2 * size - common, np.uint64) * np.uint64(2) + np.uint64(1)
    a, b = np.sort(own[:size]), np.sort(np.concatenate([own[:common], own[size:]]))
    assert hyperminhash.similar(a, b, share)
    return a, b


@pytest.mark.parametrize("share, sizes", [(85, (12, 30, 63, 64, 300, 2000)), (80, (10, 30, 63, 64, 300))])
def test_pairs_at_the_limit_share_a_band_and_pass_the_estimate(share, sizes):
    rng, found, tried = np.random.default_rng(share), 0, 0
    for size in sizes:
        for _ in range(200):
            a, b = pair(rng, size, share)
            rows = np.array([hyperminhash.signature(a), hyperminhash.signature(b)])
            keys = hyperminhash.bands(rows, share)
            n, side = np.array([len(a), len(b)]), np.array([0, 0])
            tried += 1
            found += bool((keys[0] == keys[1]).any()) and len(hyperminhash.candidate_rows(1, rows, n, side, False, share)) == 1
    assert found >= 0.998 * tried


@pytest.mark.parametrize("block", [16, 1024])
def test_near_copies_leave_few_links(spark, monkeypatch, block):
    monkeypatch.setattr(hyperminhash, "BLOCK_DOCUMENTS", block)
    rng = np.random.default_rng(5)
    base = [f"w{x}" for x in rng.integers(0, 50_000, 300)]
    texts = []
    for _ in range(240):
        own = list(base)
        for at in rng.integers(0, 300, 2):
            own[at] = f"x{rng.integers(1 << 30)}"
        texts.append(" ".join(own))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    rows = hyperminhash.summaries(docs)
    classes = rows.groupBy("cid").agg(F.min("doc_id").alias("rep"), F.min("n_shingles").alias("n_shingles"), F.min("registers").alias("registers"))
    loose = hyperminhash.loose_links(classes).collect()
    assert all(r.a < r.b for r in loose) and 239 <= len(loose) < 2 * 240
    got = hyperminhash.near_duplicates(docs).collect()
    assert {r.component_id for r in got} == {0} and sum(r.kept for r in got) == 1
