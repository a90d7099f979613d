"""Every registered query of the engine against its SQL in DuckDB, row by row."""

import math

import duckdb
import pytest

from factorloom.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    clean = lambda x: None if isinstance(x, float) and math.isnan(x) else x
    return sorted((tuple(clean(r[i]) for i in order) for r in values), key=lambda r: [(x is None, str(x)) for x in r])


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(name, spark, sf_dir, duck):
    df = registry.queries()[name](spark, sf_dir)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    spark.catalog.clearCache()
    if name not in registry.oracles():
        assert got
        return
    res = duck.execute(registry.oracles()[name])
    columns = [d[0] for d in res.description]
    assert sorted(columns) == sorted(df.columns)
    assert got == rows(columns, res.fetchall())
