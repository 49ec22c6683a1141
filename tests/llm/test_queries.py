"""The registered queries: names, and DuckDB's rows where SQL can express them."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), "tools"))

import __spark_entry__ as entry
from oracle_check import TABLES, compare
from rollbook.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
EXPRESSIBLE = [n for n, (_, sql) in QUERIES.items() if sql]


def test_one_query_for_each_operator_and_the_pipeline():
    numbers = sorted(int(n[2:].split("_")[0]) for n in QUERIES)
    assert numbers == list(range(1, 14)) and {*QUERIES, "pipeline"} <= set(entry.queries())
    assert set(EXPRESSIBLE) <= set(entry.oracle_sql()) and "pipeline" not in entry.oracle_sql()


@pytest.mark.parametrize("name", EXPRESSIBLE)
def test_matches_duckdb(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = QUERIES[name][0](spark, SF)
    cur = con.execute(QUERIES[name][1])
    assert compare(name, df.columns, [tuple(r) for r in df.collect()], [d[0] for d in cur.description], cur.fetchall()) is None
