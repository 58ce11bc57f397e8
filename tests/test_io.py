import json

import pytest
from pyspark.sql import functions as F

from morphex.sources import sinks as K
from morphex.sources import tables as S
from morphex.streaming.ingest import assign_stream, nearest_centroid


def test_csv_with_mark_and_ragged_rows(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text("﻿id,dim_0,dim_1\n01,1,2\n\nx,3\ny,4,5,6\n")
    rows, ragged = S.read_rectangular(spark, str(p))
    assert [r.id for r in rows.collect()] == ["01"] and ragged.count() == 2
    assert S.vectors_from_wide(rows).first().v == [1.0, 2.0]
    assert {r.id for r in S.rewritten_ids(spark.createDataFrame([("01",), ("1",), ("1e3",), ("a",)], "id string")).collect()} == {"01", "1e3"}
    (tmp_path / "e.csv").write_text("")
    with pytest.raises(ValueError):
        S.header_of(spark, str(tmp_path / "e.csv"))


def test_embedding_rules(spark):
    v = spark.createDataFrame([("a", [1.0]), ("a", [2.0]), (" ", [1.0]), ("b", [float("nan")])], "id string, v array<double>")
    assert {r.reason for r in S.invalid_embeddings(v).collect()} == {"blank_id", "repeated_id", "invalid_dimension"}


def test_label_and_assignment_tables(spark):
    df = spark.createDataFrame([("x", " A ", 1), ("x", "A", 2), ("y", " ", 3)], "image string, label string, other int")
    assert [(r.id, r.label) for r in S.label_table(df).collect()] == [("x", "A")]
    assert S.assignment_table(spark.createDataFrame([("x", "c")], "Image string, CLUSTER string")).columns == ["id", "cluster"]
    with pytest.raises(ValueError):
        S.assignment_table(spark.createDataFrame([("x", "x", "c")], "id string, image string, cluster string"))


def test_otu_table_file(spark, tmp_path):
    (tmp_path / "t.csv").write_text("sample,OTU_1,OTU_2\ns1,2,1\ns2,x,3.7\n")
    got = {(r["sample"], r.cluster): r.n for r in S.read_otu_table(spark, str(tmp_path / "t.csv")).collect()}
    assert got == {("s1", "OTU_1"): 2, ("s1", "OTU_2"): 1, ("s2", "OTU_1"): 0, ("s2", "OTU_2"): 3}


def test_images(spark, tmp_path):
    for p, c in (("s1/a.jpg", b"1"), ("s1/b.PNG", b"2"), ("s2/a.jpg", b"1"), ("top.tif", b"3"), ("s1/note.txt", b"4")):
        (tmp_path / p).parent.mkdir(exist_ok=True)
        (tmp_path / p).write_bytes(c)
    images = S.read_images(spark, str(tmp_path))
    assert {(r.ref, r["sample"]) for r in images.collect()} == {("s1/a.jpg", "s1"), ("s1/b.PNG", "s1"), ("s2/a.jpg", "s2"), ("top.tif", "")}
    wanted = spark.createDataFrame([("s1/a.jpg",), ("x/b.PNG",), ("a.jpg",), ("no.png",)], "ref string")
    assert {(r.ref, r.resolved, r.how) for r in S.resolve_references(wanted, images).collect()} == {("s1/a.jpg", "s1/a.jpg", "path"), ("x/b.PNG", "s1/b.PNG", "name"), ("a.jpg", None, "ambiguous"), ("no.png", None, "missing")}
    experts = images.where("ref = 's1/a.jpg'").select("ref", "identity")
    assert {(r.ref, r.reason) for r in S.discover_candidates(images, experts, str(tmp_path)).collect()} == {("s1/b.PNG", None), ("s2/a.jpg", None), ("top.tif", None)}
    assert {(r.ref, r.reason) for r in S.discover_candidates(images, experts, str(tmp_path / "s2"), ["s1"]).collect()} == {("s2/a.jpg", None), ("top.tif", "escapes_image_root")}
    named = spark.createDataFrame([("a", "/r/x"), ("b", "/r/x"), ("c", "/r2/y"), ("d", None), ("b", "/r/x")], "ref string, identity string")
    assert {(r.ref, r.reason) for r in S.discover_candidates(named, experts.limit(0), "/r/").collect()} == {("a", None), ("b", "duplicate_file_identity"), ("c", "escapes_image_root"), ("d", "escapes_image_root")}
    assert S.discover_candidates(named.limit(0), experts, "/r").count() == 0
    assert S.is_batch(images).first().batch


def test_partitions_matrix_and_log(spark, tmp_path):
    (tmp_path / "partition_0.25_assignments.csv").write_text("id,cluster\na,OTU_1\n")
    assert S.read_partitions(spark, str(tmp_path)).first() == (0.25, "a", "OTU_1")
    (tmp_path / "m.csv").write_text(",a,b\na,0,0.5\nb,0.5,0\n")
    pairs = S.read_distance_matrix(spark, str(tmp_path / "m.csv"))
    assert pairs.collect() == [("a", "b", 0.5)]
    assert {(r.i, r.a, r.b) for r in K.square_matrix(pairs, ["a", "b"]).collect()} == {("a", 0.0, 0.5), ("b", 0.5, 0.0)}
    (tmp_path / "run.log").write_text('[2026] start\n[2026] Parameters: {\n[2026] "k": {"a": 1}}\n[2026] end }\n')
    assert S.parameters_of_log(spark, str(tmp_path / "run.log")) == {"k": {"a": 1}}


@pytest.mark.parametrize("before", [99_999, 100_001])
def test_parameters_far_down_a_log(spark, tmp_path, before):
    (tmp_path / "run.log").write_text("[2026] step\n" * before + '[2026] Parameters: {\n[2026] "k": {"a": 1}}\n[2026] end\n')
    assert S.parameters_of_log(spark, str(tmp_path / "run.log")) == {"k": {"a": 1}}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a b", 1), ("c", 2)], "sample string, n int")
    K.write_table(df, str(tmp_path / "out"), "json")
    with pytest.raises(Exception):
        K.write_table(df, str(tmp_path / "out"), "json")
    with pytest.raises(ValueError):
        K.write_table(df, str(tmp_path / "in" / "sub"), inputs=[str(tmp_path / "in")])
    assert [json.loads(x)["n"] for p in (tmp_path / "out").glob("*.json") for x in p.read_text().splitlines()].__len__() == 2
    K.write_by_sample(df, str(tmp_path / "by"))
    assert {p.name for p in (tmp_path / "by").iterdir() if p.is_dir()} == {"sample_dir=a_b", "sample_dir=c"}
    K.append_metrics(df, str(tmp_path / "log"))
    K.append_metrics(df.withColumn("more", F.lit(1.5)), str(tmp_path / "log"))
    assert spark.read.option("mergeSchema", True).parquet(str(tmp_path / "log")).count() == 4
    with pytest.raises(ValueError):
        K.append_metrics(df.withColumn("n", F.lit("x")), str(tmp_path / "log"))
    assert [K.cutoff_tag(x) for x in (0.5, 0.05, 1.0)] == ["0.5", "0.05", "1"]


def test_stream_assignment(spark, tmp_path):
    centroids = spark.createDataFrame([("x", [1.0, 0.0]), ("y", [0.0, 1.0])], "cluster string, centroid array<double>")
    rows = spark.createDataFrame([("a", [2.0, 0.1]), ("b", [0.0, 5.0]), ("z", [0.0, 0.0]), ("n", None)], "id string, v array<double>")
    assert {(r.id, r.cluster) for r in nearest_centroid(rows, centroids).collect()} == {("a", "x"), ("b", "y"), ("z", None), ("n", None)}
    rows.write.parquet(str(tmp_path / "src"))
    assign_stream(spark, str(tmp_path / "src"), "id string, v array<double>", centroids, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4


def test_run_layout(spark):
    paths = ["x/r/UPGMA/partitions/tables/partition_0.5_assignments.csv", "x/r/logs/cluster.log", "UPGMA/partitions/tables/partition_0.5_assignments.csv", "x/r/UPGMA/partitions/tables/partition_5._assignments.csv"]
    got = {r.path: (r.run, r.cutoff, r.reason) for r in S.run_context(spark.createDataFrame([(p,) for p in paths], "path string")).collect()}
    assert got == {paths[0]: ("x/r", "0.5", None), paths[2]: (None, None, "layout"), paths[3]: (None, None, "name")}


def test_first_last_and_unique_rows(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 3, "y"), ("b", None, "z"), ("a", None, "w"), ("b", None, "z"), (None, 2, "n")], "k string, o int, v string")
    assert {(r.k, r.o, r.v) for r in S.last_rows(df, "k", "o").collect()} == {("a", 3, "y"), ("b", None, "z"), (None, 2, "n")}
    assert [(r.k, r.position) for r in S.unique_in_order(df, "k", "o").orderBy("position").collect()] == [("b", 0), ("a", 1)]
    assert [r.o for r in S.first_rows(df.where("o IS NOT NULL"), [F.desc("o")], 2).collect()] == [3, 2]
    assert S.last_rows(df.limit(0), "k", "o").count() == 0


def test_metric_log_keeps_types_and_reports_other_errors(spark, tmp_path):
    out = str(tmp_path / "m")
    K.append_metrics(spark.createDataFrame([(1, 0.5)], "epoch int, loss double"), out)
    with pytest.raises(ValueError, match="loss"):
        K.append_metrics(spark.createDataFrame([(2, "x")], "epoch int, loss string"), out)
    K.append_json(spark.createDataFrame([(1,)], "a int"), str(tmp_path / "j"))
    K.write_newick(spark.createDataFrame([("(a,b);",)], "newick string"), str(tmp_path / "t"))
    assert spark.read.text(str(tmp_path / "t")).first().value == "(a,b);" and spark.read.json(str(tmp_path / "j")).count() == 1
