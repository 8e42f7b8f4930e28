"""Each query with SQL against DuckDB, order-insensitively; the others for rows at all (their values are in the brute-force tests)."""

import math
from decimal import Decimal

import duckdb
import pytest

from weirflow.plans.catalog import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
#: No label is exposed among the 15 accounts there, so what starts from such accounts is rightly empty.
LARGER = {"time_resp_distance": "/root/testdata/sf0.01"}


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    c.execute(f"CREATE VIEW events AS SELECT * FROM '{SF}/events.parquet'")
    return c


def plain(v):
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5) + 0.0
    return v


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_oracle(spark, db, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    r = db.execute(ORACLE[name])
    names = [x[0] for x in r.description]
    assert sorted(names) == cols
    want = sorted(str([plain(row[names.index(c)]) for c in cols]) for row in r.fetchall())
    got = sorted(str([plain(row[c]) for c in cols]) for row in df.collect())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_rows(spark, name):
    assert QUERIES[name](spark, LARGER.get(name, SF)).count() > 0
