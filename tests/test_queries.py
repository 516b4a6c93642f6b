"""Every registered query against its SQL in DuckDB."""

import duckdb
import pytest

from terraframe.plans import registry

TABLES = "region nation customer supplier part orders lineitem events".split() + ["embeddings"]


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def plain(rows):
    return sorted(repr(tuple(float(v) if isinstance(v, float) or type(v).__name__ == "Decimal" else v for v in r)) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sf, con, name):
    df = registry.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    got = df.select(*cols).collect()
    if name not in registry.ORACLE:
        assert got
        return
    found = con.execute(registry.ORACLE[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == cols
    want = [tuple(r[names.index(c)] for c in cols) for r in found.fetchall()]
    assert plain(map(tuple, got)) == plain(want)


def test_entry_module(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 6
    assert set(e.oracle_sql()) <= set(e.queries())
