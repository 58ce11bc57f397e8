"""All named queries outside the optional training-data subpackage."""

from __future__ import annotations

from . import core_problems, io_queries, table_queries, vector_queries

MODULES = [core_problems, vector_queries, table_queries, io_queries]
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
SQL = {k: v for m in MODULES for k, v in m.SQL.items()}
FLAGSHIP = "ds_within_label"
