"""Every catalog query against its SQL, over the smallest tables."""

from __future__ import annotations

import math

import pytest

from sluice.plans import catalog, catalog_more  # noqa: F401  registers more queries

duckdb = pytest.importorskip("duckdb")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
AT = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def database():
    found = duckdb.connect()
    for t in TABLES:
        found.execute(f"create view {t} as select * from read_parquet('{AT}/{t}.parquet')")
    return found


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6)
    return tuple(map(plain, x)) if isinstance(x, (list, tuple)) else x


@pytest.mark.parametrize("key", list(catalog.QUERIES))
def test_query(spark, database, key):
    df = catalog.QUERIES[key](spark, AT)
    names = sorted(df.columns)
    rows = [tuple(plain(r[c]) for c in names) for r in df.collect()]
    if key not in catalog.ORACLE_SQL:
        assert rows
        return
    found = database.execute(catalog.ORACLE_SQL[key])
    theirs = [d[0] for d in found.description]
    assert sorted(theirs) == names
    want = [tuple(plain(r[theirs.index(c)]) for c in names) for r in found.fetchall()]
    assert sorted(map(repr, rows)) == sorted(map(repr, want))
