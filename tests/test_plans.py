"""Every registered query against its DuckDB oracle (sf0.001), and the entry point."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as E  # noqa: E402
from oracle_check import digest  # noqa: E402

from caliper.plans.registry import load_all  # noqa: E402
from caliper.plans.tables import TABLES  # noqa: E402

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def test_entry(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 8 and "roc_auc" in df.columns


def test_every_query_has_an_oracle():
    plans, sqls = load_all()
    assert set(plans) == set(sqls)
    assert set(plans) <= set(E.queries()) and set(sqls) <= set(E.oracle_sql())


@pytest.mark.parametrize("name", sorted(load_all()[0]))
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    res = con.execute(E.oracle_sql()[name])
    ocols = [d[0] for d in res.description]
    orows = res.fetchall()
    assert sorted(df.columns) == sorted(ocols)
    assert len(rows) == len(orows)
    assert digest(df.columns, rows)[0] == digest(ocols, orows)[0]
