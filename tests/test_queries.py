"""Every registered query of the recommendation operators against its SQL."""

from __future__ import annotations

import zlib

import pytest

from sessionforge import queries
from sessionforge.plans import registry
from sessionforge.sources.scratch import saved

from .oracle import same

_SHARED: dict[tuple[str, str], object] = {}


@pytest.fixture(autouse=True)
def shared_frames(monkeypatch):
    """The frames that queries keep are the same for all of them, so they are written once for all tests."""

    def kept(self, name, build):
        key = (self.sf_dir, name)
        if key not in _SHARED:
            _SHARED[key] = saved(build())
        return _SHARED[key]

    monkeypatch.setattr(registry.Bench, "kept", kept)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, sf_dir, name):
    df = queries.QUERIES[name](spark, sf_dir)
    if name in queries.ORACLE_SQL:
        same(df, sf_dir, queries.ORACLE_SQL[name])
    else:
        assert name == "crc_split"
        assert {(r["session_id"], r["split"]) for r in df.collect()} == {(r["session_id"], "validation" if zlib.crc32(f"0:{r['session_id']}".encode()) / 2**32 < 0.3 else "test") for r in df.collect()}


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 8
    assert set(entry.oracle_sql()) <= set(entry.queries())
