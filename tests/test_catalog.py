"""Every registered query against its SQL on the smallest tables."""

import math

import duckdb
import pytest

from tessella import catalog, plans  # noqa: F401

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Queries whose result may be empty on the smallest tables.
MAY_BE_EMPTY = {"decontam_hits", "kill_superset", "multiset_diff", "dup_components", "jaccard_pairs"}


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_sql(spark, duck, sf_dir, name):
    found = catalog.QUERIES[name](spark, sf_dir)
    columns = sorted(found.columns)
    rows = sorted(repr(tuple(plain(x) for x in r)) for r in found.select(*columns).collect())
    assert rows or name in MAY_BE_EMPTY
    wanted = duck.sql(catalog.ORACLES[name])
    assert columns == sorted(wanted.columns)
    order = sorted(range(len(columns)), key=lambda i: wanted.columns[i])
    assert rows == sorted(repr(tuple(plain(r[i]) for i in order)) for r in wanted.fetchall())


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLES)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
