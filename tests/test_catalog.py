"""Every query of the catalogue against its SQL in DuckDB."""

import math

import duckdb
import pytest

from tidemark.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])

    def plain(v):
        if isinstance(v, float):
            return None if math.isnan(v) else (0.0 if v == 0 else v)
        return v

    return sorted([columns[k] for k in order]), sorted((tuple(plain(r[k]) for k in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf, duck, name):
    df = catalog.QUERIES[name](spark, sf)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    rel = duck.execute(catalog.ORACLES[name])
    expect = rows_of([d[0] for d in rel.description], rel.fetchall())
    assert got[0] == expect[0]
    assert len(got[1]) == len(expect[1]) > 0
    for a, b in zip(got[1], expect[1]):
        assert a == b or all(x == y or (isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, rel_tol=1e-12)) for x, y in zip(a, b))
