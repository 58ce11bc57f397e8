import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from morphex.functions import scalars as S
from morphex.operators import annotate as A
from morphex.operators import distances as D
from morphex.operators import diversity as V
from morphex.operators import pseudo_labels as P
from morphex.operators import quality as Q
from morphex.operators import retrieval as R
from morphex.operators import training_data as TD


@pytest.fixture(scope="module")
def vectors(spark):
    x = np.random.default_rng(0).normal(size=(60, 8))
    x[7] = 0
    return x, spark.createDataFrame([(f"i{k:02d}", row.tolist(), f"L{k % 4}") for k, row in enumerate(x)], "id string, v array<double>, label string")


def cosine(x):
    u = x / np.maximum(np.linalg.norm(x, axis=1), 1e-12)[:, None]
    return np.clip(1 - u @ u.T, 0, 2)


def test_hand_distances(spark):
    df = spark.createDataFrame([("a", [0.1, 0.2, 0.3 - 0.1]), ("b", [0.9, 0.0, 0.2]), ("c", [-1.0, -0.1, -0.2]), ("d", [-0.9, 0.0, -0.2])], "id string, v array<double>")
    df = df.where("id <> 'a'").union(spark.createDataFrame([("a", [1.0, 0.1, 0.2])], df.schema))
    d = {(r.i, r.j): r.d for r in D.pair_distances(df).collect()}
    assert d["a", "c"] == pytest.approx(2) and d["b", "d"] == pytest.approx(2) and d["a", "b"] == pytest.approx(0.004998, abs=1e-6) and d["a", "d"] == pytest.approx(1.995002, abs=1e-6)


@pytest.mark.parametrize("block", [7, 512])
def test_pairs_match_brute_force(spark, vectors, monkeypatch, block):
    monkeypatch.setattr(D, "BLOCK_ROWS", block)
    x, df = vectors
    want = cosine(x)
    rows = D.pair_distances(df).collect()
    assert len(rows) == 60 * 59 // 2 and all(r.i < r.j for r in rows)
    assert all(abs(r.d - want[int(r.i[1:]), int(r.j[1:])]) < 1e-12 for r in rows)
    for r in D.pair_distances(df, "euclidean").limit(50).collect():
        a, b = int(r.i[1:]), int(r.j[1:])
        u = x / np.maximum(np.linalg.norm(x, axis=1), 1e-12)[:, None]
        assert r.d == pytest.approx(np.linalg.norm(u[a] - u[b]), abs=1e-7)


def test_pair_budget_and_small_cohorts(spark, vectors):
    _, df = vectors
    with pytest.raises(ValueError):
        D.pair_distances(df, budget=100)
    with pytest.raises(ValueError):
        D.pair_distances(df, "manhattan")
    assert D.pair_distances(df.limit(1)).count() == 0 == D.pair_distances(df.limit(0)).count()
    s = D.distance_summary(D.pair_distances(df.limit(0))).first()
    assert s.n_pairs == 0 and s.mean is None


def test_local_scaling(spark, vectors):
    x, df = vectors
    d = cosine(x)
    np.fill_diagonal(d, 0)
    s = np.sort(d, axis=1)[:, 5]
    for r in D.local_scaling(D.pair_distances(df), 5).limit(80).collect():
        a, b = int(r.i[1:]), int(r.j[1:])
        assert r.d == pytest.approx(d[a, b] / max(math.sqrt(s[a] * s[b]), 1e-10))


def test_whitening_gives_unit_variance(spark, vectors):
    _, df = vectors
    y = np.array([r.v for r in D.whitened(df, 8).collect()])
    assert np.allclose(np.cov(y.T), np.eye(y.shape[1]), atol=1e-9) and np.allclose(y.mean(axis=0), 0, atol=1e-9)


def test_scaled_components(spark, vectors):
    x, df = vectors
    y = np.array([r.v for r in D.scaled_components(df, 10).collect()])
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    assert np.allclose(sorted(np.var(y, axis=0)), sorted(np.linalg.eigvalsh(np.cov(z.T, bias=True))), atol=1e-9)
    assert len(D.scaled_components(df.limit(2), 10).first().v) == 8


def test_top_tokens(spark):
    df = spark.createDataFrame([([[9.0, 9.0], [1.0, 0.0], [3.0, 0.0], [0.0, 3.0]],), ([],), (None,)], "t array<array<double>>")
    assert [r[0] for r in df.select(S.top_tokens(F.col("t"), 2, 1)).collect()] == [[3.0, 0.0, 0.0, 3.0], [], None]


def test_histogram_counts_everything(spark, vectors):
    _, df = vectors
    p = D.pair_distances(df)
    assert sum(r.n for r in D.histogram(p, 60).collect()) == p.count()
    assert D.histogram(p.limit(0)).count() == 0


X9 = {"OTU_1": 10, "OTU_2": 5, "OTU_3": 3, "OTU_4": 2}


def test_alpha_diversity_by_hand(spark):
    rows = spark.createDataFrame([("s", c) for c, n in X9.items() for _ in range(n)] + [("s", None), (None, "OTU_9")], "sample string, cluster string")
    r = V.alpha_diversity(V.abundance(rows).where("sample = 's'"), ["sample"]).first()
    want = dict(Richness=4, Chao1=4, ACE=4, Shannon=1.207973687592, Simpson=0.655, InverseSimpson=2.898550724638, Pielou_J=0.871368824307, Heip_E=0.782232108316, Berger_Parker=0.5, Margalef=1.001424602086, Menhinick=0.894427191, Brillouin=0.997940274755, Hill_q0=4, Hill_q1=3.346696324947, Hill_q2=2.898550724638)
    for k, v in want.items():
        assert r[k] == pytest.approx(v, abs=1e-9), k
    assert r.Fisher_alpha == pytest.approx(1.503534, abs=2e-6)


def test_thresholds_leave_zero_rows(spark):
    counts = V.abundance(spark.createDataFrame([("s", "a")] * 3 + [("t", "b")], "sample string, cluster string"))
    t = {(r.min_abundance, r["sample"]): r.Richness for r in V.diversity_table(counts, [0, 2, 5]).collect()}
    assert t == {(0, None): 2, (2, None): 1, (5, None): 0, (0, "s"): 1, (2, "s"): 1, (5, "s"): 0, (0, "t"): 1, (2, "t"): 0, (5, "t"): 0}
    assert V.diversity_table(counts.limit(0), [0]).count() == 0


@settings(max_examples=8, deadline=None)
@given(st.lists(st.integers(1, 400), min_size=1, max_size=30))
def test_hill_numbers_fall(spark, counts):
    df = spark.createDataFrame([("s", f"c{i}", n) for i, n in enumerate(counts)], "sample string, cluster string, n long")
    r = V.alpha_diversity(df, ["sample"]).first()
    assert r.Hill_q0 + 1e-9 >= r.Hill_q1 >= r.Hill_q2 - 1e-9
    n = sum(counts)
    assert r.Brillouin == pytest.approx((math.lgamma(n + 1) - sum(math.lgamma(c + 1) for c in counts)) / n, abs=1e-9)


def test_otu_table_round_trip(spark):
    rows = spark.createDataFrame([("s1", "OTU_1"), ("s1", "OTU_1"), ("s1", "OTU_2"), ("s2", "OTU_2"), ("s2", "OTU_2"), ("s2", "OTU_2")], "sample string, cluster string")
    table = V.otu_table(rows)
    assert {(r["sample"], r.OTU_1, r.OTU_2) for r in table.collect()} == {("s1", 2, 1), ("s2", 0, 3)}
    back = {(r["sample"], r.cluster): r.n for r in V.counts_of_otu_table(table).collect()}
    assert back == {("s1", "OTU_1"): 2, ("s1", "OTU_2"): 1, ("s2", "OTU_2"): 3, (None, "OTU_1"): 2, (None, "OTU_2"): 4}


def test_perfect_and_single_partitions(spark):
    same = spark.createDataFrame([("0", "a"), ("0", "a"), ("1", "b"), ("1", "b")], "label string, cluster string")
    m = Q.external_metrics(Q.contingency(same)).first()
    assert all(m[k] == pytest.approx(1) for k in ("NMI", "ARI", "V_measure", "BCubed_F", "purity"))
    assert Q.adjusted_mutual_information(Q.contingency(same)) == pytest.approx(1)
    one = spark.createDataFrame([("0", "a"), ("0", "a")], same.schema)
    assert Q.external_metrics(Q.contingency(one)).first().NMI == 1
    assert Q.external_metrics(Q.contingency(one.limit(0))).first().ARI is None


def test_silhouette_matches_pairs(spark, vectors):
    x, df = vectors
    d, lab = cosine(x), np.arange(60) % 4
    s = []
    for i in range(60):
        own = (lab == lab[i]) & (np.arange(60) != i)
        a, b = d[i, own].mean(), min(d[i, lab == k].mean() for k in range(4) if k != lab[i])
        s.append((b - a) / max(a, b))
    assert Q.silhouette(df, "label").first().silhouette == pytest.approx(np.mean(s), abs=1e-9)
    assert Q.silhouette(df.where("label = 'L0'"), "label").first().silhouette == 0


def test_wss(spark, vectors):
    x, df = vectors
    want = sum(((x[k::4] - x[k::4].mean(axis=0)) ** 2).sum() for k in range(4))
    assert Q.within_sum_of_squares(df, "label").first().WSS == pytest.approx(want)


def test_recall_and_map(spark, vectors):
    x, df = vectors
    d, lab = cosine(x), np.arange(60) % 4
    ranked = R.ranked_neighbours(D.pair_distances(df), df)
    order = [sorted((j for j in range(60) if j != i), key=lambda j: (d[i, j], j)) for i in range(60)]
    got = {r.k: r.recall for r in R.recall_at(ranked, [1, 5, 60], 60).collect()}
    for k in (1, 5):
        assert got[k] == pytest.approx(np.mean([any(lab[j] == lab[i] for j in order[i][:k]) for i in range(60)]), abs=0.04)
    assert got[60] is None
    assert 0 < R.mean_average_precision(ranked).first().mAP < 1


def test_folds():
    assert R.stratified_folds(["a"] * 5) is None and R.stratified_folds(["a", "b", "b"]) is None
    f = R.stratified_folds(["a"] * 10 + ["b"] * 7)
    assert set(f) == set(range(5)) and sorted(np.bincount(f[:10])) == [2] * 5
    assert R.cohort_sample(list("abcd"), 2) == [list("abcd")[i] for i in np.sort(np.random.default_rng(42).choice(4, 2, replace=False))]
    assert R.cohort_sample(list("abcd"), 0) == list("abcd")


def _angle(t):
    return [math.cos(math.radians(t)), math.sin(math.radians(t))]


def test_pseudo_labels_by_geometry(spark):
    seeds = spark.createDataFrame([(f"a{i}", "A", _angle(t)) for i, t in enumerate((0, 0.2, 0.4))] + [(f"b{i}", "B", _angle(t)) for i, t in enumerate((90, 90.2, 90.4))], "ref string, label string, v array<double>")
    cand = spark.createDataFrame([(f"c{i:02d}", _angle(0)) for i in range(11)] + [("bad", [0.0, 0.0]), ("nul", None)], "ref string, v array<double>")
    out = {r.ref: r for r in P.decide(cand, seeds, P.Rules(neighbours=32)).collect()}
    assert [out[f"c{i:02d}"].accepted for i in range(11)] == [True] * 9 + [False] * 2
    assert out["c09"].reasons == out["c10"].reasons == ["class_cap"] and out["bad"].reasons == out["nul"].reasons == ["invalid_feature"]
    few = P.decide(cand, seeds.where("ref IN ('a0', 'b0')")).collect()
    assert {tuple(r.reasons) for r in few} == {("invalid_feature",), ("no_eligible_class",)}
    with pytest.raises(ValueError):
        P.decide(cand, seeds.union(spark.createDataFrame([("z", "A", [0.0, 0.0])], seeds.schema)))


def test_near_duplicates(spark):
    seeds = spark.createDataFrame([(f"a{i}", "A", _angle(i / 5), f"sha{i}") for i in range(4)], "ref string, label string, v array<double>, sha string")
    cand = spark.createDataFrame([("copy", _angle(0), "sha0"), ("other", _angle(0), "own")], "ref string, v array<double>, sha string")
    out = {r.ref: r for r in P.decide(cand, seeds).collect()}
    assert out["copy"].reasons == ["expert_content_duplicate"] and out["other"].reasons == ["no_runner_up"]


def test_corrections(spark):
    a = spark.createDataFrame([("img1", "OTU_1", "s"), ("img2", "OTU_1", "s"), ("img2", "OTU_1", "s"), ("img3", None, "s"), (None, "OTU_2", "s")], "id string, cluster string, sample string")
    raw = spark.createDataFrame([("img2", " OTU_3 "), ("img3", "OTU_4"), ("img1", ""), ("new", "OTU_1"), (None, "OTU_1")], "Image string, corrected_cluster string")
    c = A.canonical_corrections(raw)
    out = sorted((r.id or "", r.cluster or "") for r in A.apply_corrections(a, c, None).collect())
    assert out == [("", "OTU_2"), ("img1", "OTU_1"), ("img2", "OTU_3"), ("img2", "OTU_3"), ("img3", "OTU_4")]
    assert {r.id for r in A.unknown_corrections(c, a).collect()} == {"new"}
    assert {(r.id, r.reason) for r in A.invalid_corrections(c.union(c.selectExpr("id", "'x'"))).collect()} >= {("img2", "conflict"), ("img1", "blank_cluster"), (None, "missing_id")}
    assert A.changed_assignments(a, c, None).count() == 3
    s = {r.cluster: (r.n_before, r.n_after) for r in A.annotation_summary(a, c, None).collect()}
    assert s == {"OTU_1": (3, 1), "OTU_2": (1, 1), "OTU_3": (0, 2), "OTU_4": (0, 1)}
    assert A.apply_corrections(a.limit(0), c, None).count() == 0 and A.apply_corrections(a, c.limit(0), None).count() == 5


def test_names_and_summaries(spark):
    a = spark.createDataFrame([("b", "x"), ("a", "y"), ("c", "z"), ("d", "z")], "id string, cluster string")
    assert {(r.cluster, r.name) for r in A.rename_clusters(a).collect()} == {("z", "OTU_1"), ("y", "OTU_2"), ("x", "OTU_3")}
    assert {(r.cluster, r.n, r.members) for r in A.cluster_summary(a, row_members=1).collect()} == {("x", 1, "b"), ("y", 1, "a"), ("z", 2, "c"), ("z", 2, "d")}


def test_scalars(spark):
    df = spark.createDataFrame([(" a  b/c\\d ", "x/y/z.jpg", "YES"), ("q", "z.jpg", "maybe"), (None, None, None)], "name string, ref string, flag string")
    rows = df.select(S.sanitised_name("name").alias("n"), S.sample_of_reference("ref").alias("s"), S.boolean_literal("flag").alias("b"), S.canonical_reference(F.col("ref")).alias("c")).collect()
    assert [tuple(r) for r in rows] == [("a_b_c_d", "x", True, "x/y/z.jpg"), ("q", "", None, "z.jpg"), (None, "", None, None)]
    refs = spark.createDataFrame([("../x.jpg",), ("/root/img/a.jpg",), ("a/./b/../c.jpg",), ("/etc/x",)], "r string")
    assert [r[0] for r in refs.select(S.canonical_reference(F.col("r"), "/root/img")).collect()] == [None, "a.jpg", "a/c.jpg", None]
    assert [r.cutoff for r in S.cutoff_list(spark, 0.1, 0.3, 0.1).orderBy("cutoff").collect()] == [0.1, 0.2, 0.3]
    with pytest.raises(ValueError):
        S.cutoff_list(spark, 0, 1, 0.1, [float("nan")])
    S.register(spark)
    assert spark.sql("SELECT mx_dot(array(1D, 2D), array(3D, 4D)) AS d, mx_seed_bin(5) AS b").first() == (11.0, "4-5")
    m = spark.createDataFrame([("a", "1"), ("b", "2")], "id string, label string")
    assert S.manifest_hash(m, "id", "label").first() == S.manifest_hash(m.orderBy(F.desc("id")), "id", "label").first()


def test_class_weights(spark):
    df = spark.createDataFrame([("a",)] * 90 + [("b",)] * 10 + [(None,)], "label string")
    w = {r.label: r.weight for r in TD.class_weights(df).collect()}
    raw = {k: 0.01 / (1 - 0.99**n) for k, n in (("a", 90), ("b", 10))}
    mean = (90 * raw["a"] + 10 * raw["b"]) / 100
    assert w["a"] == pytest.approx(raw["a"] / mean) and w["b"] == pytest.approx(min(3, raw["b"] / mean))
    masks = TD.random_masks(spark.range(5), 20, 7).collect()
    assert all(len(set(r.masked)) == 7 for r in masks)
