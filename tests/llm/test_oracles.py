"""The llm queries that have an oracle, against it."""

from __future__ import annotations

import os
from pathlib import Path

import duckdb
import pytest

from heliogable.llm.queries import ORACLES, QUERIES

DATA = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))
pytestmark = pytest.mark.skipif(not DATA.is_dir(), reason="no test data")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, name):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{DATA}/documents.parquet'")
    cursor = con.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    want = sorted(tuple(float(x) if hasattr(x, "as_tuple") else x for x in r) for r in cursor.fetchall())
    df = QUERIES[name](spark, str(DATA))
    assert sorted(names) == sorted(df.columns)
    assert sorted(tuple(r[n] for n in names) for r in df.collect()) == want


def test_all_ten():
    assert [int(n[2:].split("_")[0]) for n in QUERIES] == list(range(1, 11))
