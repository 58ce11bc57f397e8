import ast
import os
from pathlib import Path

import pytest

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent
DATA = "/root/testdata/sf0.001"


def test_sql_belongs_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_nothing_imports_the_optional_subpackage():
    for p in (ROOT / "morphex").rglob("*.py"):
        if "llm" in p.relative_to(ROOT).parts:
            continue
        for node in ast.walk(ast.parse(p.read_text())):
            if isinstance(node, ast.ImportFrom):
                assert "llm" not in (node.module or "").split(".") and all(a.name != "llm" for a in node.names), p


@pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are not here")
@pytest.mark.parametrize("name", ["p1_found", "p1_valid", "p5_found", "ds_within_label", "q_external", "pl_decisions", "div_table", "ann_summary", "t_partitions", "t_diversity"])
def test_queries_match_sql(spark, name):
    import duckdb

    db = duckdb.connect()
    for f in os.listdir(DATA):
        db.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{DATA}/{f}'")
    df = entry.queries()[name](spark, DATA)
    rows = df.collect()
    if name not in entry.oracle_sql():
        assert rows
        return
    out = db.sql(entry.oracle_sql()[name])
    assert sorted(out.columns) == sorted(df.columns)
    plain = lambda v: round(float(v), 5) + 0.0 if isinstance(v, float) or type(v).__name__ == "Decimal" else v
    at = [out.columns.index(c) for c in sorted(df.columns)]
    assert sorted((tuple(plain(r[c]) for c in sorted(df.columns)) for r in rows), key=str) == sorted((tuple(plain(r[i]) for i in at) for r in out.fetchall()), key=str)
