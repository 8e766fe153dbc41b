"""Every query runs on the smallest tables, has distinct columns, and none stands alone without reason."""

from __future__ import annotations

import os

import pytest

from minutespark.catalog import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
#: Models and approximate search, which SQL cannot express.
ROWS_ONLY = {"summarize_documents", "lsh_search"}


def test_oracles():
    assert set(QUERIES) - set(ORACLES) == ROWS_ONLY


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are absent")
@pytest.mark.parametrize("name", ["chunk_search_topk", "chunk_fixed", "bm25_scores", "compare_runs_union", "upsert_metadata", "digest_embedding"])
def test_runs(spark, name):
    first = QUERIES[name](spark, DATA)
    assert len(set(first.columns)) == len(first.columns)
    rows = sorted(map(str, first.collect()))
    assert rows and rows == sorted(map(str, QUERIES[name](spark, DATA).collect()))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are absent")
def test_plans(spark):
    plan = lambda name: QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    found = plan("chunk_search_ministry")
    assert "EqualTo(source,src3)" in found and "TakeOrderedAndProject" in found
    # the texts of the meetings are not read for a chunk search
    assert not any("text:string" in line for line in found.splitlines() if "ReadSchema" in line)
    assert "LeftAnti" in plan("pending_embed") and "IsNotNull(text)" in plan("pending_embed")
    for name in ("chunk_fixed", "bm25_scores", "html_regex_text", "cosine_scores", "json_strict_parse"):
        assert ("ArrowEvalPython" in plan(name)) == (name == "html_regex_text"), name  # NFKC alone is Python
    # small inputs are dealt to all cores; nothing is exchanged by a key
    assert "hashpartitioning" not in plan("chunk_fixed") + plan("term_postings")
    for name in ("chunk_search_topk", "summary_search_topk"):
        ordered = QUERIES[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString().split("GlobalLimit 5")[1]
        assert "chunk_text" not in ordered and "summary" not in ordered, name  # ids and scores alone are ordered


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are absent")
def test_parity(spark):
    """All queries with SQL against DuckDB on the smallest tables."""
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{DATA}/{f}')")
    for name, sql in ORACLES.items():
        df = QUERIES[name](spark, DATA)
        columns = sorted(df.columns)
        want = con.execute(sql)
        names = [c[0] for c in want.description]
        assert sorted(names) == columns, name
        at = [names.index(c) for c in columns]
        rows = sorted(repr(tuple(r[i] for i in at)) for r in want.fetchall())
        assert sorted(repr(tuple(r[c] for c in columns)) for r in df.collect()) == rows, name
