"""Each engine query against its SQL on the smallest tables."""

import duckdb
import pytest

from tessera.plans.catalogue import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(small_tables):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small_tables}/{t}.parquet'")
    return c


def tidy(names, rows):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(names), sorted(([round(r[i], 6) + 0.0 if isinstance(r[i], float) else r[i] for i in order] for r in rows), key=repr)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, small_tables, name):
    df = QUERIES[name](spark, small_tables)
    rows = [tuple(r) for r in df.collect()]
    assert rows
    if name in SQL:
        found = con.execute(SQL[name])
        assert tidy(df.columns, rows) == tidy([c[0] for c in found.description], found.fetchall())


def test_mixed_precision_rounds_halves_as_its_sql(spark, tmp_path):
    """125.5 exactly, which single precision takes for 125.49999."""
    con = duckdb.connect()
    con.execute(f"COPY (SELECT 736::BIGINT AS s_suppkey, 4218.2::DOUBLE AS s_acctbal) TO '{tmp_path}/supplier.parquet'")
    con.execute(f"CREATE VIEW supplier AS SELECT * FROM '{tmp_path}/supplier.parquet'")
    df = QUERIES["mixed_precision_lu"](spark, str(tmp_path))
    found = con.execute(SQL["mixed_precision_lu"])
    assert tidy(df.columns, [tuple(r) for r in df.collect()]) == tidy([c[0] for c in found.description], found.fetchall())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 3
    assert set(e.oracle_sql()) <= set(e.queries())
