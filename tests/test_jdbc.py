"""JDBC source: the read query selects the declared columns only (never the password)."""

from __future__ import annotations

from rollbook.sources.jdbc import table_query
from rollbook.sources.schema import SCHEMAS


def test_queries_select_declared_columns_only():
    q = table_query("users")
    assert "password" not in q and q.startswith("(SELECT user_id, username, role, status, created_at FROM users)")
    for t, schema in SCHEMAS.items():
        cols = table_query(t).split("SELECT ", 1)[1].split(" FROM ", 1)[0].split(", ")
        assert cols == [f.name for f in schema.fields]
