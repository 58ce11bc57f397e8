import os

import pytest

import __spark_entry__ as entry
from morphex.llm import queries

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are not here")
@pytest.mark.parametrize("name, columns", [("p2_found", {"id_a", "id_b"}), ("p4_found", {"group_id", "id"}), ("p6_found", {"field_name", "term", "mark"}), ("p9_found", {"doc_id"}), ("p3_label_percentiles", {"label", "n", "prob", "estimate", "rank_error"}), ("p7_report", {"pack_name", "capacity", "containers", "tokens", "used", "least"}), ("p8_shares", None)])
def test_queries_run(spark, name, columns):
    df = entry.queries()[name](spark, DATA)
    assert df.count() >= 0 and (columns is None or set(df.columns) == columns)


def test_too_many_pack_limits_are_an_error(spark, tmp_path):
    spark.range(1001).selectExpr("concat('p', id) AS pack_name", "id + 1 AS capacity_tokens").write.parquet(f"{tmp_path}/pack_limits.parquet")
    spark.createDataFrame([(1, "a", "word")], "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    with pytest.raises(ValueError, match="pack limits"):
        queries._packed(spark, str(tmp_path))
