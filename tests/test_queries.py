"""Queries against their SQL on the smallest tables."""

import duckdb
import pytest
from conftest import SMALL

from mosaiq.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in ("events", "orders"):
        con.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, SMALL)
    columns = sorted(df.columns)
    rows = db.execute(ORACLES[name])
    order = [d[0] for d in rows.description]
    assert sorted(order) == columns
    want = sorted(tuple(r[order.index(c)] for c in columns) for r in rows.fetchall())
    assert sorted(tuple(r[c] for c in columns) for r in df.collect()) == want


def test_every_op_is_registered():
    from mosaiq.plans.script import OPS

    assert len(OPS) == 57
