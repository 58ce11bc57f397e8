import numpy as np
import pytest
from pyspark.sql import functions as F

from morphex.operators import annotate as A
from morphex.operators import distances as D
from morphex.operators import quality as Q
from morphex.operators import retrieval as R
from morphex.operators import skew, trees
from morphex.runtime import shared_path
from morphex.streaming.ingest import windowed_counts


def frame(spark, x, labels=None):
    rows = [(i, v.tolist(), None if labels is None else labels[i]) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "id long, v array<double>, label string").repartition(3)


@pytest.mark.parametrize("few", [500_000, 3])
@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_summary_in_blocks_is_exact(spark, monkeypatch, few, metric):
    monkeypatch.setattr(D, "FEW_VALUES", few)
    monkeypatch.setattr(D, "BLOCK_ROWS", 20)
    x = np.random.default_rng(1).normal(size=(70, 5))
    x = np.vstack([x, x[:8], x[:8], np.zeros((2, 5))])  # ties, and vectors of no length
    df = frame(spark, x).select("id", "v")
    one, two = D.cohort_summary(df, metric).first(), D.distance_summary(D.pair_distances(df, metric)).first()
    assert set(one.asDict()) == set(two.asDict()) and all(abs(one[c] - two[c]) < 1e-7 for c in one.asDict())
    scaled = D.cohort_summary(D.local_scales(df, 3, metric), metric, scale="scale").first()
    again = D.distance_summary(D.local_scaling(D.pair_distances(df, metric), 3)).first()
    assert all(abs(scaled[c] - again[c]) <= 1e-7 * max(1, abs(again[c])) for c in ("n_pairs", "min", "median", "p99"))


def test_small_cohorts(spark):
    df = frame(spark, np.ones((1, 3))).select("id", "v")
    assert D.cohort_summary(df).first().n_pairs == 0 and D.cohort_summary(df).first().median is None and D.cohort_summary(df.limit(0)).first().n_pairs == 0
    assert D.local_scales(df, 1).count() == 0 and D.local_scales(frame(spark, np.eye(3)).select("id", "v"), 3).count() == 0
    with pytest.raises(ValueError):
        D.cohort_summary(frame(spark, np.eye(4)).select("id", "v"), budget=5)


def test_ranks_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(R, "BLOCK_ROWS", 15)
    x = np.random.default_rng(2).normal(size=(50, 4))
    x = np.vstack([x, x[:6]])
    labels = [None if i % 11 == 5 else "one" if i == 7 else "abc"[i % 3] for i in range(len(x))]
    df = frame(spark, x, labels)
    ranks = {r.i: (r.first, r.ap) for r in R.query_ranks(df).collect()}
    slow = R.ranked_neighbours(D.pair_distances(df.where("label IS NOT NULL").select("id", "v")), df.select("id", "label"))
    first = {r.i: r.first for r in slow.groupBy("i").agg(F.min(F.when(F.col("same"), F.col("rank"))).alias("first")).collect()}
    assert set(ranks) == set(first) and {i: f for i, (f, _) in ranks.items()} == first and ranks[7] == (None, None)
    got = np.mean([a for _, a in ranks.values() if a is not None])
    assert abs(got - R.mean_average_precision(slow).first().mAP) < 1e-9
    assert {(r.k, round(r.recall, 9)) for r in R.recall_of(R.query_ranks(df), [1, 5], 50).collect()} == {(r.k, round(r.recall, 9)) for r in R.recall_at(slow, [1, 5], 50).collect()}
    assert R.query_ranks(df.limit(0)).count() == 0


def test_text_ids_keep_their_order(spark):
    x = np.random.default_rng(3).normal(size=(12, 3))
    names = ["é", "z", "A", "a", "10", "9", "ß", "中", "b b", "", "Z", "~"]
    df = spark.createDataFrame([(n, v.tolist()) for n, v in zip(names, x)], "id string, v array<double>")
    assert all(r.i < r.j for r in D.pair_distances(df).collect()) and D.pair_distances(df).where("i >= j").count() == 0


def test_hot_names_and_whole_member_lists(spark, monkeypatch):
    monkeypatch.setattr(skew, "hot_threshold", lambda _: 50)
    rows = [(f"i{i:04d}", "hot", "s") for i in range(400)] + [(f"c{i}", f"k{i % 9}", None) for i in range(60)] + [("n", None, "s"), (None, "null_only", "s"), ("c1", "k1", None)]
    a = spark.createDataFrame(rows, "id string, cluster string, sample string").repartition(5)
    named = A.rename_clusters(a)
    assert named.count() == len(rows) and {r.cluster for r in named.where("name = 'OTU_1'").collect()} == {"hot"} and named.where("name IS NULL").count() == 1
    got = {}
    for r in A.cluster_summary(a, row_members=64).collect():
        got.setdefault(r.cluster, {"n": r.n, "parts": {}})["parts"][r.part] = r.members
    assert got["hot"]["n"] == 400 and sorted(got["hot"]["parts"]) == list(range(7)) and ";".join(got["hot"]["parts"][i] for i in range(7)) == ";".join(f"i{i:04d}" for i in range(400))
    assert got["k1"]["n"] == 8 and got["k1"]["parts"] == {0: "c1;c10;c19;c28;c37;c46;c55"} and got["null_only"]["parts"] == {0: None}
    assert A.cluster_summary(a.limit(0)).count() == 0
    assert {(r.label, r.n, r.n_expert, r.n_pseudo) for r in A.source_counts(spark.createDataFrame([("x", "expert"), ("x", "pseudo"), ("x", None), (None, "expert")], "label string, source string")).collect()} == {("x", 3, 1, 1), (None, 1, 1, 0)}


def test_fine_grid_keeps_within_the_coarse_one(spark):
    optima = lambda *x: spark.createDataFrame([(float(v),) for v in x], "cutoff double")
    grid = lambda *x, **k: [r.cutoff for r in Q.fine_cutoffs(optima(*x), **k).orderBy("cutoff").collect()]
    assert grid(0.3, 0.35)[0] == 0.15 and grid(0.3, 0.35)[-1] == 0.5 and len(grid(0.3, 0.35)) == 36
    assert grid(0.1)[0] == 0.05 and grid(0.95)[-1] == 1.0 and grid() == []


def test_positions_of_clades():
    z = np.array([[0, 1, 0.2, 2], [2, 3, 0.4, 2], [4, 5, 0.8, 4], [6, 7, 1.0, 5]], float)[:3]
    assert trees.clade_positions(z, list("abcd")) == [(4, 0.2, 0.5, 2), (5, 0.4, 2.5, 2)]
    assert trees.clade_positions(np.zeros((0, 4)), ["a"]) == []


def test_windows_of_late_rows(spark, tmp_path):
    rows = spark.sql("SELECT TIMESTAMP '2026-01-01 10:00:00' + make_interval(0, 0, 0, 0, n * 8) AS assigned_at, 'c' AS cluster FROM range(9) t(n)")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = windowed_counts(stream).writeStream.format("memory").queryName("windows").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("windows").agg(F.sum("n")).first()[0] == 9


def test_shared_paths_differ(spark):
    assert shared_path(spark, "x") != shared_path(spark, "x")
