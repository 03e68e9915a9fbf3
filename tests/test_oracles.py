"""Every registered query with SQL text, on the smallest tables, against DuckDB."""

import math
import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")


def key(row):
    return tuple((v is not None, f"{v:.9g}" if isinstance(v, float) else str(v)) for v in row)


def same(a, b):
    if isinstance(a, float) and b is not None:
        return a == b or (math.isnan(a) and math.isnan(b)) or abs(a - float(b)) <= 1e-6 * max(1, abs(a))
    return a == b


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in os.listdir(SF):
        con.sql(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{SF}/{t}'")
    return con


@pytest.mark.parametrize("name", sorted(k for k in entry.oracle_sql() if not k.startswith("op")))
def test_same_as_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(map(tuple, df.select(*[f"`{c}`" for c in cols]).collect()), key=key)
    rel = duck.sql(entry.oracle_sql()[name])
    assert sorted(rel.columns) == cols
    want = sorted((tuple(row[rel.columns.index(c)] for c in cols) for row in rel.fetchall()), key=key)
    assert len(got) == len(want)
    assert all(same(x, y) for a, b in zip(got, want, strict=True) for x, y in zip(a, b, strict=True))


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
