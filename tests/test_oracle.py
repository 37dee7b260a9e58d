"""Every registered query against its SQL on the same tables."""

import math

import duckdb
import pytest

from lodestrata.plans.queries import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events pages".split()


def cell(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 4) + 0.0
    return x


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(cell(r[i]) for i in order) for r in data), key=str)


def differing(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = con.execute(ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    df = QUERIES[name](spark, sf_dir)
    assert sorted(df.columns) == sorted(columns)
    a, b = rows(df.columns, df.collect()), rows(columns, want.fetchall())
    assert len(a) == len(b)
    return [(x, y) for x, y in zip(a, b, strict=True) if not all(p == q or (isinstance(p, float) and isinstance(q, float) and abs(p - q) <= 2e-4 * max(1, abs(p))) for p, q in zip(x, y, strict=True))]


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(spark, sf_dir, name):
    assert differing(spark, sf_dir, name)[:3] == []
