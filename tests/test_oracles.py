"""Each registered query of the reference's own operators against its oracle in DuckDB."""

from __future__ import annotations

import math
import os
from pathlib import Path

import duckdb
import pytest

from heliogable.plans import all_oracles, all_queries
from heliogable.plans.base import TABLES

DATA = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))
pytestmark = pytest.mark.skipif(not DATA.is_dir(), reason="no test data")


def plain(value):
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, float):
        return None if math.isnan(value) else value + 0.0
    return float(value) if hasattr(value, "as_tuple") else value


def rows(found, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(plain(r[i]) for i in order) for r in found]
    return sorted(out, key=lambda r: tuple((x is None, isinstance(x, str), x if x is not None else 0) for x in r))


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_query(spark, db, name):
    df = all_queries()[name](spark, str(DATA))
    own = rows(df.collect(), df.columns)
    oracle = all_oracles().get(name)
    if oracle is None:
        assert own
        return
    cursor = db.execute(oracle)
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    assert own == rows(cursor.fetchall(), names)
