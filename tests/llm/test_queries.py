"""The registered queries over the smallest driver tables: SQL where there is some, plans."""

import json
import os
import sys
from collections import Counter

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), "tools"))

import __spark_entry__ as E  # noqa: E402
from oracle_check import digest  # noqa: E402

from caliper.llm import registry  # noqa: E402
from caliper.plans.tables import TABLES, table  # noqa: E402
from tests.llm import brute  # noqa: E402

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")
QUERIES, SQL = registry.load()
KEYS = {"op8_html_text": ("pages", "page_id")}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = E.queries()[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    rows = [tuple(r) for r in df.collect()]
    if name in SQL:
        res = con.execute(SQL[name])
        cols = [d[0] for d in res.description]
        want = res.fetchall()
        assert sorted(df.columns) == sorted(cols) and len(rows) == len(want)
        assert digest(df.columns, rows)[0] == digest(cols, want)[0]
    elif name == "op9_tool_chat":       # every turn is a message of one row
        messages = [m for r in rows for m in json.loads(r[df.columns.index("message")])]
        texts = Counter(t for m in messages for t in (
            [m["content"]] if "content" in m else [c["arguments"]["text"] for c in m["tool_calls"]]))
        assert texts == Counter(r.text for r in table(spark, SF, "conversations").select("text").collect())
    else:
        source, key = KEYS.get(name, ("documents", "doc_id"))
        at = df.columns.index(key)
        ids = [r[0] for r in table(spark, SF, source).select(key).collect()]
        assert sorted(r[at] for r in rows) == sorted(ids)


def test_near_and_substring_equal_brute_force(spark):
    docs = [tuple(r) for r in table(spark, SF, "documents").select("doc_id", "text").collect()]
    near = {r.doc_id: (r.n_shingles, r.component_id) for r in QUERIES["op4_near_dedup"](spark, SF).collect()}
    assert near == brute.near(docs)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in QUERIES["op5_substring_dedup"](spark, SF).collect()}
    assert got == {d: (n, k, brute.sha(t)) for (d, _), (n, k, t) in zip(docs, brute.substring(docs))}
