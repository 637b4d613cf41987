"""Scans against a sequential walk, with one key holding a third of all rows."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from spanloom.operators.sequence import (
    episodes,
    high,
    last,
    low,
    ordered_text,
    prev,
    row_numbers,
    runs,
    scan,
    sequence,
    total,
)


def rows(seed, n=400, hot=0.34):
    pick = random.Random(seed)
    spread = sorted(pick.sample(range(n * 5), n))
    return [
        (seq, "hot" if pick.random() < hot else f"k{pick.randrange(12)}", pick.choice([None, 1, 2, 3, 5]), pick.randrange(-3, 4))
        for seq in spread
    ]


def walk(data):
    state, out = {}, {}
    for seq, key, maybe, n in data:
        s = state.setdefault(key, {"prev": None, "last": None, "sum": 0, "low": None, "high": None})
        before = s["last"]
        total_before = s["sum"]
        s["last"] = maybe if maybe is not None else s["last"]
        s["sum"] += n
        s["low"] = n if s["low"] is None else min(s["low"], n)
        s["high"] = n if s["high"] is None else max(s["high"], n)
        out[seq] = (s["prev"], s["last"], before, s["sum"], total_before, s["low"], s["high"])
        s["prev"] = maybe
    return out


@pytest.mark.parametrize("split,shared", [("all", False), ("all", True), ("hot", False)])
@pytest.mark.parametrize("seed", [1, 2])
def test_scan_equals_walk(spark, small_blocks, split, shared, seed):
    data = rows(seed)
    df = spark.createDataFrame(data, "seq long, k string, v int, n int").repartition(5)
    steps = {
        "p": prev(F.col("v")),
        "l": last(F.col("v")),
        "lb": last(F.col("v"), before=True),
        "t": total(F.col("n")),
        "tb": total(F.col("n"), before=True),
        "lo": low(F.col("n")),
        "hi": high(F.col("n")),
    }
    got = {r.seq: tuple(r)[4:] for r in scan(df, ["k"], "seq", steps, split=split, shared=shared).collect()}
    assert got == walk(data)


def test_scan_without_key(spark, small_blocks):
    data = [(s, "one", v, n) for s, _, v, n in rows(3)]
    df = spark.createDataFrame(data, "seq long, k string, v int, n int").repartition(5)
    got = {r.seq: (r.p, r.t) for r in scan(df, [], "seq", {"p": prev(F.col("v")), "t": total(F.col("n"))}).collect()}
    assert got == {s: (w[0], w[3]) for s, w in walk(data).items()}


def test_scan_backwards(spark, small_blocks):
    data = rows(4)
    df = spark.createDataFrame(data, "seq long, k string, v int, n int").withColumn("back", -F.col("seq"))
    got = {r.seq: r.nxt for r in scan(df, ["k"], "back", {"nxt": last(F.col("v"))}).collect()}
    mirrored = walk([(s, k, v, n) for s, k, v, n in reversed(data)])
    assert got == {s: w[1] for s, w in mirrored.items()}


def test_sequence_follows_total_order(spark):
    data = [(random.Random(i).randrange(50), i) for i in range(500)]
    df = sequence(spark.createDataFrame(data, "a int, b int").repartition(7), "a", "b")
    placed = [(r.a, r.b) for r in df.orderBy("seq").collect()]
    assert placed == sorted(data)
    numbered = {(r.a, r.b): r.rn for r in row_numbers(df, [], "seq").collect()}
    assert numbered == {pair: i + 1 for i, pair in enumerate(sorted(data))}


@pytest.mark.parametrize("narrow", [True, False])
def test_runs(spark, small_blocks, narrow):
    data = [(s, k, v) for s, k, v, _ in rows(5)]
    df = spark.createDataFrame(data, "seq long, k string, v int")
    if not narrow:
        df = df.withColumn("more", F.lit(1))
    got = {r.seq: r.run for r in runs(df, ["k"], "seq", "v").collect()}
    want, state = {}, {}
    for s, k, v in data:
        if k not in state or state[k][0] != v:
            state[k] = (v, s)
        want[s] = state[k][1]
    assert got == want


def test_episodes(spark, small_blocks):
    pick = random.Random(6)
    data = [(i, pick.choice("aab"), pick.randrange(4)) for i in range(400)]
    df = spark.createDataFrame(data, "seq long, k string, q int")
    opens, closes = F.col("q").bitwiseAND(F.lit(1)) != 0, F.col("q").bitwiseAND(F.lit(2)) != 0
    got = {r.seq: r.episode for r in episodes(df, ["k"], "seq", opens, closes).collect()}
    want, open_at = {}, {}
    for s, k, q in data:
        if q & 1:
            open_at[k] = s
        if open_at.get(k) is not None:
            want[s] = open_at[k]
            if q & 2:
                open_at[k] = None
    assert got == want


def test_ordered_text(spark):
    data = [(i, i % 3, f"<{i}>") for i in range(300)]
    random.Random(7).shuffle(data)
    df = spark.createDataFrame(data, "seq long, k int, v string")
    got = {r.k: (r.text, r.n) for r in ordered_text(df, ["k"], "seq", "v", "", "text", piece_bits=4).collect()}
    assert got == {k: ("".join(f"<{i}>" for i in range(k, 300, 3)), 100) for k in range(3)}


def test_hot_keys_of_sparse_positions_fill_their_blocks(spark, small_blocks):
    """Times in microseconds and addresses far apart: a hot key still lies in full blocks of 8 rows, a cold one in one."""
    pick = random.Random(9)
    data = [("hot" if i % 3 else f"k{i % 90}", i * 10**12 + pick.randrange(10**11), i % 7) for i in range(600)]
    df = spark.createDataFrame(data, "k string, at long, v long")
    seen = scan(df, ["k"], "at", {"sum": total(F.col("v")), "before": prev(F.col("v"))}, split="hot", keep=True).collect()
    walk, before, want = {}, {}, []
    for k, at, v in sorted(data, key=lambda r: r[1]):
        walk[k] = walk.get(k, 0) + v
        want.append((k, at, walk[k], before.get(k)))
        before[k] = v
    assert sorted((r.k, r.at, r["sum"], r.before) for r in seen) == sorted(want, key=lambda r: r[:2])
    blocks = Counter((r.k, r._blk) for r in seen)
    hot = [n for (k, _), n in blocks.items() if k == "hot"]
    assert max(hot) <= 8 and len(hot) <= 400 // 8 + 2 * 8
    assert all(b == -1 for k, b in blocks if k != "hot")
