"""Every query that has SQL against that SQL on DuckDB, over the smallest tables.

All queries of the library itself have one; corpus operators that SQL cannot
express are held against plain versions in their own tests.
"""

import importlib.util
from pathlib import Path

import pytest

import __spark_entry__ as entry
from spanloom.plans import registry

SF_DIR = "/root/testdata/sf0.001"
spec = importlib.util.spec_from_file_location("check", Path(__file__).resolve().parent.parent / "tools" / "check.py")
check = importlib.util.module_from_spec(spec)
spec.loader.exec_module(check)

pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="tables not there")


@pytest.fixture(scope="module")
def duck():
    return check.connect(SF_DIR)


@pytest.mark.parametrize("name", list(entry.oracle_sql()))
def test_query(spark, duck, small_blocks, name):
    state, rows, _, note = check.compare(spark, duck, SF_DIR, name)
    assert state == "ok", note
    assert rows > 0


def test_entry(spark):
    assert entry.entry(spark).columns == ["eventid", "n", "total_us", "max_us", "p50_us", "p95_us"]


def test_every_query_has_sql():
    assert set(registry.queries()) == set(registry.oracle_sql())
    assert set(registry.oracle_sql()) <= set(entry.oracle_sql()) <= set(entry.queries())
