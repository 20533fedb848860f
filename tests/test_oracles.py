"""Each query against its SQL, over the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from tracequarry import catalog

DATA = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels")


def plain(value):
    if isinstance(value, float):
        return round(value, 6)
    return tuple(map(plain, value)) if isinstance(value, list) else value


@pytest.mark.skipif(not Path(DATA).exists(), reason="needs the given tables")
@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        p = Path(f"{DATA}/{t}.parquet")
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{p / '*.parquet' if p.is_dir() else p}'")
    want, got = con.sql(catalog.ORACLES[name]), catalog.QUERIES[name](spark, DATA)
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    place = [want.columns.index(c) for c in cols]
    assert sorted((tuple(plain(r[c]) for c in cols) for r in got.collect()), key=repr) == sorted((tuple(plain(r[i]) for i in place) for r in want.fetchall()), key=repr)
