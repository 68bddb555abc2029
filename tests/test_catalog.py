from __future__ import annotations

import math
import os

import duckdb
import pytest

from stratalist.plans.catalog import ORACLES, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 5)
    if isinstance(x, (list, tuple)):
        return [plain(y) for y in x]
    return float(x) if type(x).__name__ == "Decimal" else x


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    names = sorted(got.columns)
    own = sorted((str([plain(r[c]) for c in names]) for r in got.collect()))
    cur = duck.execute(ORACLES[name])
    at = [d[0] for d in cur.description]
    assert sorted(at) == names
    want = sorted(str([plain(r[at.index(c)]) for c in names]) for r in cur.fetchall())
    assert own == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_other_queries_give_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
