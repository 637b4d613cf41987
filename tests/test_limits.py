"""Values and states beyond what earlier limits allowed."""

import pytest
from pyspark.sql import functions as F

from spanloom.operators.assemble import backtraces
from spanloom.operators.filters import type_filter, type_ranges


def test_many_ranges(spark):
    pairs = spark.range(0, 1 << 16, 2).selectExpr("id AS csc_from", "id AS csc_to")
    rows = spark.range(0, 1 << 16, 7).selectExpr("id << 16 AS debugid", "id AS csc")
    got = {r.csc for r in type_filter(rows, pairs=pairs).collect()}
    assert got == {n for n in range(0, 1 << 16, 7) if n % 2 == 0}
    wide = spark.createDataFrame([(0, 65535)], "csc_from long, csc_to long")
    assert type_ranges(pairs=wide) == [(0, 65535)]


@pytest.mark.parametrize("pair", [(-1, 5), (5, 70000), (9, 3), (None, 4)])
def test_filter_domain(spark, pair):
    with pytest.raises(ValueError):
        type_ranges(pairs=spark.createDataFrame([pair], "csc_from long, csc_to long"))


def test_long_backtrace(spark):
    frames = list(range(1, 101))
    rows = [(0, 1, 77, 100, 1, 2, True, False)]
    for k in range(2, 100, 3):
        a = [*frames[k : k + 3], 0, 0][:3]
        rows.append((k, 1, 0, *a, False, k + 3 > 99))
    rows.append((500, 1, 0, 9, 9, 9, False, False))
    df = spark.createDataFrame(rows, "seq long, tid long, arg1 long, arg2 long, arg3 long, arg4 long, opens boolean, closes boolean")
    got = backtraces(df, F.col("opens"), F.col("closes")).collect()
    assert [(r.tag, r.n, r.frames) for r in got] == [(77, 100, frames)]


def test_settled_tables_are_removed(spark):
    import os

    from spanloom import session

    df = session.settle(spark.range(5))
    path = session._SETTLED[-1]
    assert os.path.isdir(path) and df.count() == 5
    kept = list(session._SETTLED)
    session._SETTLED[:] = [path]
    assert session.remove_settled(spark) == 1 and not os.path.exists(path)
    session._SETTLED[:] = [p for p in kept if p != path]
