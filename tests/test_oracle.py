"""Every catalogue query against its SQL twin on the smallest tables."""

import contextlib
import io
import math
import os
import re

import duckdb
import pytest

from plumbline.plans.catalogue import ORACLE, QUERIES
from plumbline.plans.catalogue.registry import _TABLES

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not there")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in _TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.10g}")
    return value


def ordered(rows):
    return sorted(rows, key=lambda r: [(v is None, str(v)) for v in r])


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    plan = io.StringIO()
    with contextlib.redirect_stdout(plan):
        df.explain()
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin", plan.getvalue())
    columns = sorted(df.columns)
    found = ordered([tuple(plain(r[c]) for c in columns) for r in df.collect()])
    if name not in ORACLE:
        assert found
        return
    cursor = duck.execute(ORACLE[name])
    names = [d[0] for d in cursor.description]
    at = sorted(range(len(names)), key=lambda i: names[i])
    wanted = ordered([tuple(plain(r[i]) for i in at) for r in cursor.fetchall()])
    assert sorted(names) == columns
    assert found == wanted


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLE)
