"""Every shoreline query that has SQL gives the same rows as DuckDB."""

import math

import duckdb
import pytest

from strandline import catalog

TABLES = "region nation customer supplier part orders lineitem events embeddings labels".split()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else 0.0 if v == 0 else round(v, 9)
    return str(v)[:26] if hasattr(v, "isoformat") else v


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_equals_sql(name, spark, con, sf_dir):
    df = catalog.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted(str([plain(r[c]) for c in columns]) for r in df.collect())
    cur = con.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == columns
    want = sorted(str([plain(r[names.index(c)]) for c in columns]) for r in cur.fetchall())
    assert got == want


def test_every_query_has_rows(spark, sf_dir):
    for name in set(catalog.queries()) - set(catalog.oracle_sql()):
        assert catalog.queries()[name](spark, sf_dir).head(1), name
