"""Every query with an oracle agrees with DuckDB on sf0.001 (rows, columns, values)."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as E  # noqa: E402
from oracle_check import norm, sort_key  # noqa: E402

from sf import SF_SMALL  # noqa: E402

ORACLE = E.oracle_sql()
QUERIES = E.queries()


def test_every_query_is_registered_with_a_builder():
    assert set(ORACLE) <= set(QUERIES)
    assert len(QUERIES) >= 100


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 1 and rows[0]["status"] in ("ok", "no_data")


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF_SMALL)
    cols = df.columns
    got = sorted([tuple(norm(r[c]) for c in cols) for r in df.collect()], key=sort_key)
    cur = duck.execute(ORACLE[name])
    ocols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(ocols)
    idx = [ocols.index(c) for c in cols]
    want = sorted([tuple(norm(r[i]) for i in idx) for r in cur.fetchall()], key=sort_key)
    assert len(got) == len(want)
    assert got == want
