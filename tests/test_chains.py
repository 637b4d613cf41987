"""Chains of counted records and backtraces of programs against sequential walks."""

import random

import pytest
from pyspark.sql import functions as F

from spanloom.operators import assemble, chains

SCHEMA = "seq long, tid long, arg1 long, arg2 long, arg3 long, arg4 long, debugid long"


def walk(rows):
    """Traces of each thread, one record after the other."""
    threads, out = {}, []
    for row in sorted(rows):
        threads.setdefault(row[1], []).append(row)
    for tid, records in threads.items():
        at = 0
        while at < len(records):
            seq, _, tag, n, *frames = records[at][:6]
            if n is None or not 0 <= n <= 32:
                at += 1
                continue
            more = -(-(n - 2) // 3) if n > 2 else 0
            for record in records[at + 1 : at + 1 + more]:
                frames += record[3:6]
            out.append((tid, seq, tag, n, [f for f in frames[:n] if f]))
            at += 1 + more
    return sorted(out)


def log(seed, size=700, broken=False):
    pick, rows = random.Random(seed), []
    while len(rows) < size:
        tid = 0 if pick.random() < 0.4 else pick.randrange(1, 6)
        if broken and pick.random() < 0.1:
            rows.append((len(rows), tid, 7, pick.choice([-5, 33, 10**12, None]), 1, 2, 0))
            continue
        n = pick.randrange(33)
        frames = [pick.randrange(1, 40) for _ in range(n)] + [0] * 40
        tag = pick.randrange(9)
        rows.append((len(rows), tid, tag, n, frames[0], frames[1], 0))
        for i in range(2, n, 3):
            rows.append((len(rows), tid, tag, *frames[i : i + 3], 0))
    return rows


@pytest.mark.parametrize("seed, broken", [(1, False), (2, True)])
def test_user_backtraces(spark, small_blocks, seed, broken):
    rows = log(seed, broken=broken)
    got = assemble.user_backtraces(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    assert sorted((r.tid, r.start_seq, r.tag, r.n, list(r.frames)) for r in got) == walk(rows)
    assert len(got) > 50


def test_cut_off_and_empty(spark):
    rows = log(3, 60)[:-1]
    got = assemble.user_backtraces(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.tid, r.start_seq, r.tag, r.n, list(r.frames)) for r in got) == walk(rows)
    assert assemble.user_backtraces(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("most, bits, size", [(1, 1, 40), (2, 2, 65), (11, 3, 600), (11, 8, 600)])
def test_heads(spark, most, bits, size):
    pick = random.Random(most)
    jumps = {key: [pick.randint(1, most) for _ in range(n)] for key, n in ((1, size), (2, 1), (3, most))}
    rows = [(key, at, j) for key, found in jumps.items() for at, j in enumerate(found)]
    df = spark.createDataFrame(rows, "k long, at long, j int").repartition(4)
    want = set()
    for key, found in jumps.items():
        at = 0
        while at < len(found):
            want.add((key, at, found[at]))
            at += found[at]
    assert set(map(tuple, chains.heads(df, ["k"], "at", F.col("j"), most, bits).collect())) == want
