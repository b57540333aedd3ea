"""Every query with SQL against DuckDB on the same tables."""

import math
import os

import duckdb
import pytest

from quern.plans.queries import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def normal(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5)
    return v


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{os.path.join(data, 'sf0.001', t)}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, duck, name):
    got = QUERIES[name](spark, f"{data}/sf0.001")
    rows = got.collect()
    if name not in SQL:
        assert rows
        return
    found = duck.execute(SQL[name])
    columns = [c[0] for c in found.description]
    want = found.fetchall()
    assert sorted(got.columns) == sorted(columns)
    a = sorted([tuple(normal(r[c]) for c in sorted(columns)) for r in rows], key=repr)
    b = sorted([tuple(normal(r[columns.index(c)]) for c in sorted(columns)) for r in want], key=repr)
    assert len(a) == len(b)
    assert a == b
