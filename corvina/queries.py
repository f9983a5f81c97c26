"""All core queries with the SQL they are held against."""

from __future__ import annotations

from corvina import queries_catalog, queries_data, queries_detail

QUERIES = {**queries_catalog.QUERIES, **queries_data.QUERIES, **queries_detail.QUERIES}
SQL = {**queries_catalog.SQL, **queries_data.SQL, **queries_detail.SQL}
