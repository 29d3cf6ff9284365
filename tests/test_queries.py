"""Every query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from docspark.plans.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def plain(x):
    if isinstance(x, float):
        return float(f"{x:.9g}") + 0.0
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    if hasattr(x, "isoformat"):
        return str(x)
    if type(x).__name__ == "Decimal":
        return float(f"{float(x):.9g}")
    return x


def table(rows, columns):
    at = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(plain(r[i]) for i in at) for r in rows), key=repr), sorted(columns)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in os.listdir(SF):
        con.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{t}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = table([tuple(r) for r in df.collect()], df.columns)
    cur = duck.execute(ORACLES[name])
    assert got == table(cur.fetchall(), [c[0] for c in cur.description])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_gives_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
