import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from morphex.operators import trees as T
from morphex.operators.distances import pair_distances

X1 = np.array([[0, 0.1, 0.8, 0.9], [0.1, 0, 0.7, 0.8], [0.8, 0.7, 0, 0.1], [0.9, 0.8, 0.1, 0]])


def test_hand_linkage():
    z = T.average_linkage(X1)
    assert np.allclose(z[:, 2], [0.1, 0.1, 0.8]) and list(z[:, 3]) == [2, 2, 4]
    assert [len(set(T.cut(z, 4, t))) for t in (0.05, 0.3, 0.5, 0.81)] == [4, 2, 2, 1]
    assert set(T.clades(z, 4)) == {frozenset({0, 1}), frozenset({2, 3})}
    assert sorted(T.leaf_order(z, 4)) == [0, 1, 2, 3]


def naive_linkage(d):
    groups, heights = [[i] for i in range(len(d))], []
    while len(groups) > 1:
        best = min(((np.mean([d[a, b] for a in p for b in q]), i, j) for i, p in enumerate(groups) for j, q in enumerate(groups) if i < j))
        heights.append(best[0])
        groups[best[1]] += groups.pop(best[2])
    return heights


@settings(max_examples=25, deadline=None)
@given(st.integers(2, 12), st.integers(0, 10_000))
def test_linkage_properties(n, seed):
    d = np.random.default_rng(seed).random((n, n))
    d = (d + d.T) / 2
    np.fill_diagonal(d, 0)
    z = T.average_linkage(d)
    assert np.allclose(z[:, 2], naive_linkage(d)) and (np.diff(z[:, 2]) >= -1e-12).all() and z[-1, 3] == n
    cuts = [T.cut(z, n, t) for t in (0.2, 0.4, 0.6)]
    for fine, coarse in zip(cuts, cuts[1:]):
        assert all(coarse[i] == coarse[j] for i in range(n) for j in range(n) if fine[i] == fine[j])


def test_relational_scan_and_partitions(spark):
    x = np.random.default_rng(2).normal(size=(12, 4))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, v array<double>")
    merges = T.merge_table(pair_distances(df), list(range(12)))
    z = T.merges_array(merges)
    assert np.allclose(z[:, 2], T.average_linkage(T.cosine_matrix(x))[:, 2])
    cuts = spark.createDataFrame([(0.1,), (0.8,), (2.0,)], "cutoff double")
    scan = {r.cutoff: r.clusters for r in T.partition_scan(merges, cuts, 12).collect()}
    parts = T.partitions(spark, z, list(range(12)), [0.1, 0.8, 2.0])
    assert scan == {r.cutoff: r.n for r in parts.selectExpr("cutoff", "cluster").distinct().groupBy("cutoff").count().withColumnRenamed("count", "n").collect()}


def test_newick_round_trip():
    root = T.parse_newick("((a_1:1,'b c':2)90.0:0.5,(d:1,e:1,f:3)[note]:1,'it''s':2);")
    assert root.tips() == ["a_1", "b c", "d", "e", "f", "it's"]
    again = T.parse_newick(T.to_newick(root))
    assert again.tips() == root.tips() and [x.length for x, _ in again.walk()] == pytest.approx([x.length for x, _ in root.walk()])
    assert T.clade_supports(root, set(root.tips())) == {frozenset({"a_1", "b c"}): 90.0} and T.clade_supports(root, {"d"}) == {}
    for bad in ("((a,b);", "a,b;", "(a,b));", "('a,b);"):
        with pytest.raises(ValueError):
            T.parse_newick(bad)
    assert T.to_newick(T.from_merges(T.average_linkage(X1), list("ABCD")), {frozenset("AB"): 75.0}).count("75.0") == 1


def _path(root, a, b):
    up = {id(x): p for x, p in root.walk()}
    at = {x.name: x for x, _ in root.walk() if not x.children}

    def line(x):
        out = [x]
        while up[id(out[-1])] is not None:
            out.append(up[id(out[-1])])
        return out

    p, q = line(at[a]), line(at[b])
    common = {id(x) for x in p} & {id(x) for x in q}
    return sum(x.length for x in p + q if id(x) not in common)


def test_neighbour_joining_is_exact_on_tree_distances():
    root = T.parse_newick("((a:2,b:3):1,(c:4,d:1):2,(e:2,f:1):3);")
    names = root.tips()
    d = np.array([[0 if i == j else _path(root, i, j) for j in names] for i in names])
    nj = T.neighbour_joining(d, names)
    assert T.bipartitions(nj, names) == T.bipartitions(root, names)
    for i, a in enumerate(names):
        for j, b in enumerate(names[:i]):
            assert _path(nj, a, b) == pytest.approx(d[i, j])
    mid = T.midpoint_rooted(nj)
    depth = {}
    for x, p in mid.walk():
        depth[id(x)] = 0 if p is None else depth[id(p)] + x.length
    tips = sorted((depth[id(x)] for x, _ in mid.walk() if not x.children), reverse=True)
    assert tips[0] == pytest.approx(d.max() / 2) == pytest.approx(tips[1])
    for i, a in enumerate(names):
        for j, b in enumerate(names[:i]):
            assert _path(mid, a, b) == pytest.approx(d[i, j])


def test_shear_and_diversity(spark):
    root = T.parse_newick("((a:1,b:2):1,(c:3,d:4):2);")
    cut = T.sheared(root, {"a", "c", "d"})
    assert sorted(cut.tips()) == ["a", "c", "d"] and _path(cut, "a", "c") == _path(root, "a", "c")
    assert T.sheared(root, set()) is None
    counts = spark.createDataFrame([("s", "a", 3), ("s", "b", 1), ("t", "d", 2), ("t", "unknown", 9)], "sample string, tip string, n long")
    got = {r["sample"]: r for r in T.phylogenetic_diversity(*T.tree_tables(spark, root), counts).collect()}
    assert got["s"].faith_pd == pytest.approx(1 + 2 + 1) and got["s"].weighted_rooted == pytest.approx(0.75 * 1 + 0.25 * 2 + 1) and got["s"].weighted_unrooted == pytest.approx(0.5 * 1 + 0.5 * 2 + 0)
    assert got["t"].faith_pd == pytest.approx(6) and got["t"].richness == 1


def test_monophyly(spark):
    root = T.parse_newick("(((e0,e1),(e2,e3)),u);")
    _, closure = T.tree_tables(spark, root)
    labels = lambda *p: spark.createDataFrame(list(p), "tip string, label string")
    assert T.monophyly(closure, labels(("e0", "x"), ("e1", "x"), ("e2", "y"), ("e3", "y"))).first()[0] == 1
    assert T.monophyly(closure, labels(("e0", "x"), ("e1", "x"), ("e2", "y"), ("e3", "y"), ("u", "y"))).first()[0] == 0.5
    assert T.monophyly(closure, labels(("e0", None))).first()[0] is None


def test_support_is_a_percentage(spark):
    x = np.vstack([np.random.default_rng(1).normal(c, 0.05, (3, 16)) for c in (np.r_[[1] * 8, [0] * 8], np.r_[[0] * 8, [1] * 8])])
    rows = {tuple(r.clade): r.support for r in T.upgma_support(spark, x, 20).collect()}
    assert rows[0, 1, 2] == 100.0 and all(0 <= v <= 100 for v in rows.values())
    nj = T.neighbour_joining_support(spark, x, [f"t{i}" for i in range(6)], 20).collect()
    assert all(50 < r.support <= 100 for r in nj)
    with pytest.raises(ValueError):
        T.replicate_columns(1, 3, 0.5, 0, False)


def test_runs(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate("aabba")], "pos long, v string")
    assert sorted((r.v, r["first"], r["last"], r.n) for r in T.contiguous_runs(df, "pos", "v").collect()) == [("a", 0, 1, 2), ("a", 4, 4, 1), ("b", 2, 3, 2)]
