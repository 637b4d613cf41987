import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from spanloom.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session(8, **{"spark.sql.shuffle.partitions": "4"})


@pytest.fixture
def small_blocks(monkeypatch):
    """Blocks of 8 positions and hot keys from 10 rows on, so hand-overs between blocks are used."""
    from spanloom.operators import chains, sequence

    monkeypatch.setattr(chains, "BLOCK_BITS", 3)
    monkeypatch.setattr(sequence, "SPAN_BITS", 3)
    monkeypatch.setattr(sequence, "HOT_ROWS", 10)
