"""Every registered query of the library proper against its SQL, on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from wordtide.plans import catalog

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def value(v):
    return v.isoformat() if hasattr(v, "isoformat") else float(v) if v.__class__.__name__ == "Decimal" else v


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(columns), sorted((tuple(value(r[k]) for k in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_gives_what_its_sql_gives(spark, sql, name):
    df = catalog.QUERIES[name](spark, DATA)
    got = table(df.columns, df.collect())
    rel = sql.sql(catalog.ORACLE_SQL[name])
    assert got == table(rel.columns, rel.fetchall())


def test_the_rest_gives_rows(spark):
    for name in sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)):
        df = catalog.QUERIES[name](spark, DATA)
        assert df.count() > 0, name
        assert all(t != "void" for _, t in df.dtypes)


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["seq", "label", "p0", "p1", "pred"] and df.count() == 87
    assert all(abs(r["p0"] + r["p1"] - 1) < 2e-6 or r["p0"] == r["p1"] == 0 for r in df.collect())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert not any(math.isnan(r["p0"]) for r in df.collect())
