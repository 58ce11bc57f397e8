import numpy as np
import pyarrow as pa
import pytest

from morphex.llm import clusters as C
from morphex.llm import hnsw
from morphex.llm import neighbours as N
from morphex.llm.vectors import usable_vectors


def unit(x):
    return x / np.linalg.norm(x, axis=1)[:, None]


def clumps(seed=0, n=900, dims=16, groups=20):
    """Scattered vectors, tight groups of 3 to 8, a chain that is no group, and their own norms."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dims))
    for g in range(groups):
        c = rng.normal(size=dims)
        x = np.vstack([x, c + rng.normal(scale=0.05 * np.linalg.norm(c) / np.sqrt(dims), size=(3 + g % 6, dims))])
    a, b = np.eye(dims)[0], np.eye(dims)[1]
    x = np.vstack([x, [np.cos(t) * a + np.sin(t) * b for t in np.radians([0, 20, 40])]])
    return (x * rng.uniform(0.5, 40, len(x))[:, None]).astype(np.float32)


def frame(spark, x):
    return spark.createDataFrame([(f"s/{i:05d}.jpg", row.tolist()) for i, row in enumerate(x)], "id string, v array<float>").repartition(4)


def isolated(x, least=0.9):
    s = unit(x.astype(float)) @ unit(x.astype(float)).T >= least
    np.fill_diagonal(s, True)
    return {(f"s/{np.flatnonzero(s[i]).min():05d}.jpg", f"s/{i:05d}.jpg") for i in range(len(x)) if s[i].sum() >= 3 and all((s[j] == s[i]).all() for j in np.flatnonzero(s[i]))}


def test_usable_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [("a", 1.0, 2.0, 1), ("a", 3.0, 4.0, 2), ("b", 1.0, 1.0, 1), ("b", nan, 1.0, 2), ("c", 0.0, 0.0, 1), ("d", inf, 0.0, 1), ("e", None, 1.0, 1), (None, 1.0, 1.0, 1), (" \t", 1.0, 1.0, 1), ("f", 1.0, 0.0, None), ("f", 2.0, 0.0, 0)]
    df = spark.createDataFrame([(*r[:3], r[3], "x") for r in rows], "id string, dim_0 float, dim_1 float, extracted_at long, v string")
    assert {(r.id, tuple(r.v)) for r in usable_vectors(df).collect()} == {("a", (3.0, 4.0)), ("f", (2.0, 0.0))}
    assert usable_vectors(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        usable_vectors(df.select("id", "extracted_at"))


def test_lists_are_exact():
    x = unit(np.random.default_rng(1).normal(size=(700, 12))).astype(np.float32)
    i, s = hnsw.nearest_lists(x, 10)
    full = x @ x.T
    np.fill_diagonal(full, -3)
    assert np.allclose(s, -np.sort(-full, axis=1)[:, :10], atol=1e-6)
    assert hnsw.nearest_lists(x[:1], 4)[0].tolist() == [[-1] * 4] and sorted(hnsw.nearest_lists(x[:3], 4)[0][0].tolist()) == [-1, -1, 1, 2]


def test_graph_search_recall():
    x = unit(np.random.default_rng(2).normal(size=(6000, 16))).astype(np.float32)
    g, *_, order = hnsw.build(x[:5500])
    found = order[g.search(x[5500:], 64)[0]]
    true = np.argsort(-(x[5500:] @ x[:5500].T), axis=1)[:, :5]
    assert np.mean([len(set(a) & set(b)) / 5 for a, b in zip(true, found)]) > 0.9


def check_neighbours(spark, x, k=5, least=0.9):
    got = {}
    for r in N.nearest_neighbours(frame(spark, x), k).collect():
        got.setdefault(r.id, []).append((r.rank, r.neighbour, r.cosine))
    s = unit(x.astype(float)) @ unit(x.astype(float)).T
    np.fill_diagonal(s, -3)
    hit = 0
    for i in range(len(x)):
        mine = sorted(got.get(f"s/{i:05d}.jpg", []))
        assert [m[0] for m in mine] == list(range(1, min(k, len(x) - 1) + 1)) and len({m[1] for m in mine}) == len(mine)
        kth = np.sort(s[i])[-min(k, len(x) - 1)]
        for _, other, cosine in mine:
            j = int(other[2:7])
            assert abs(cosine - s[i, j]) < 1e-9
            hit += s[i, j] >= kth - 1e-9
    assert hit / (len(x) * min(k, len(x) - 1)) >= least


def test_probes_grow_until_the_recall_is_met():
    x = unit(np.random.default_rng(9).normal(size=(4000, 64))).astype(np.float32)
    centroids = N.fit_centroids(x, 120)
    probes = N.fit_probes(x, centroids, 5)
    own = (x @ centroids.T).argmax(axis=1)
    s = x @ x.T
    np.fill_diagonal(s, -3)
    near = np.argsort(-s, axis=1)[:, :5]
    ranks = np.argsort(np.argsort(-(x @ centroids.T), axis=1), axis=1)
    meet = np.minimum(ranks[np.arange(len(x))[:, None], own[near]], ranks[near, own[:, None]]) < probes
    assert probes > 24 and meet.mean() >= N.ROUTE_RECALL - 0.01


@pytest.mark.parametrize("cell, shard", [(32_768, 49_152), (200, 150)])
def test_neighbours_recall(spark, monkeypatch, cell, shard):
    monkeypatch.setattr(N, "CELL_ROWS", cell)
    monkeypatch.setattr(N, "SHARD_ROWS", shard)
    monkeypatch.setattr(N, "QUERY_ROWS", shard)
    monkeypatch.setattr(N, "SEARCH_ROWS", 100)
    x = np.vstack([clumps(), np.random.default_rng(5).normal(size=(3300, 16)).astype(np.float32)])
    check_neighbours(spark, x)


def test_recall_with_many_cells_is_measured(spark, monkeypatch):
    monkeypatch.setattr(N, "CELL_ROWS", 60)
    x = np.vstack([clumps(), np.random.default_rng(5).normal(size=(3300, 16)).astype(np.float32)])
    assert -(-len(x) // N.CELL_ROWS) >= 64
    df = frame(spark, x)
    near = N.nearest_neighbours(df, 5).cache()
    r = N.measured_recall(df, near, 5, 400).first()
    s = unit(x.astype(float)) @ unit(x.astype(float)).T
    np.fill_diagonal(s, -3)
    kth = np.sort(s, axis=1)[:, -5]
    all_ = np.mean([q.cosine >= kth[int(q.id[2:7])] - 1e-9 for q in near.collect()])
    assert 200 <= r.n_queries <= 1600 and r.recall == r.n_found / r.n_wanted and r.recall >= 0.9 and all_ >= 0.9 and abs(r.recall - all_) < 0.04
    assert N.measured_recall(df.limit(0), near).first().recall is None


def test_hanging_lists_find_most_of_the_nearest():
    x = unit(np.random.default_rng(3).normal(size=(6000, 12))).astype(np.float32)
    _, near, sim, order = hnsw.build(x)
    y = x[order]
    full = y @ y.T
    np.fill_diagonal(full, -3)
    assert np.allclose(np.take_along_axis(full, near.astype(int), axis=1), sim, atol=1e-6) and all(len(set(r)) == len(r) for r in near.tolist())
    assert (np.diff(sim, axis=1) <= 0).all() and (sim[:, :5] >= np.sort(full, axis=1)[:, -5][:, None] - 1e-6).mean() > 0.95


def test_neighbours_of_copies_and_few_rows(spark):
    x = clumps(3, 60, 8, 3)
    x = np.vstack([x, np.repeat(x[:1], 100, axis=0), x[5:8] * 2])
    rows = N.nearest_neighbours(frame(spark, x), 5).collect()
    copies = [f"s/{i:05d}.jpg" for i in (0, *range(len(x) - 103, len(x) - 3))]
    for c in copies:
        mine = [r.neighbour for r in sorted((r for r in rows if r.id == c), key=lambda r: r.rank)]
        assert mine == [o for o in sorted(copies) if o != c][:5]
    assert len(rows) == 5 * len(x)
    check_neighbours(spark, x[:3])
    assert N.nearest_neighbours(frame(spark, x[:1])).count() == 0
    assert N.nearest_neighbours(spark.createDataFrame([], "id string, v array<float>")).count() == 0


@pytest.mark.parametrize("rows", [6_144, 60])
def test_isolated_groups(spark, monkeypatch, rows):
    monkeypatch.setattr(C, "CLUSTER_ROWS", rows)
    monkeypatch.setattr(C, "TASK_ROWS", 50)
    x = clumps(4)
    want = isolated(x)
    assert len({g for g, _ in want}) >= 15
    assert {(r.group_id, r.id) for r in C.isolated_groups(frame(spark, x)).collect()} == want


@pytest.mark.parametrize("area, guests", [(98_304, 262_144), (8, 7)])
def test_no_pair_is_missed_at_borders(spark, monkeypatch, area, guests):
    monkeypatch.setattr(C, "AREA_ROWS", area, raising=False)
    monkeypatch.setattr(C, "GUEST_ROWS", guests, raising=False)
    # rows farther than a quarter of the similar distance from the border, whose difference points at it
    turn = np.radians([33, 34, 57])
    x = np.stack([np.cos(turn), np.sin(turn), [0, 0.02, 0]], axis=1).astype(np.float32)
    monkeypatch.setattr(C, "fit_clusters", lambda *_: np.eye(3, dtype=np.float32)[:2])
    assert len(isolated(x)) == 3 and {(r.group_id, r.id) for r in C.isolated_groups(frame(spark, x)).collect()} == isolated(x)
    # rows with 20 clusters in reach
    x = np.hstack([np.ones((20, 1)), 0.2 * np.eye(20)]).astype(np.float32)
    monkeypatch.setattr(C, "fit_clusters", lambda *_: unit(x).astype(np.float32))
    assert len(isolated(x)) == 20 and {(r.group_id, r.id) for r in C.isolated_groups(frame(spark, x)).collect()} == isolated(x)


def test_groups_of_copies(spark):
    x = clumps(6, 40, 8, 3)
    x = np.vstack([x, np.repeat(x[:1], 90, axis=0), x[1:2], x[1:2]])
    assert {(r.group_id, r.id) for r in C.isolated_groups(frame(spark, x)).collect()} == isolated(x)
    assert C.isolated_groups(spark.createDataFrame([], "id string, v array<float>")).count() == 0
    assert C.isolated_groups(frame(spark, x[:2])).count() == 0


def test_features_keep_sums_and_ward_matches_brute_force():
    x = np.random.default_rng(7).normal(size=(3000, 6))
    tree = C.FeatureTree(100, 6)
    tree.add(np.ones(len(x)), (x**2).sum(axis=1), x)
    assert len(tree.n) <= 100 and tree.n.sum() == 3000 and np.allclose(tree.sum.sum(axis=0), x.sum(axis=0)) and np.isclose(tree.square.sum(), (x**2).sum())
    # greedy Ward on a few leaves
    n, s = tree.n[:12], tree.sum[:12]
    groups = [[i] for i in range(12)]
    while len(groups) > 4:
        def cost(a, b):
            na, nb = n[a].sum(), n[b].sum()
            d = s[a].sum(axis=0) / na - s[b].sum(axis=0) / nb
            return na * nb / (na + nb) * (d @ d)

        _, i, j = min((cost(a, b), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j)
        groups[i] = groups[i] + groups.pop(j)
    label = C.ward(n, s, 4)
    assert {frozenset(g) for g in groups} == {frozenset(np.flatnonzero(label == k)) for k in set(label)}


def test_clusters_cover_all_rows(spark):
    x = clumps(8)
    a = C.assign_clusters(frame(spark, x), 6).cache()
    assert a.count() == len(x) == a.select("id").distinct().count()
    d = C.describe_clusters(a).collect()
    assert sum(r.size for r in d) == len(x) and all(1 <= len(r.members) <= 3 for r in d)
    for r in d:
        best = sorted(((-q.closeness, q.id) for q in a.where(a.cluster == r.cluster).collect()))[:3]
        assert r.members == [i for _, i in best]
    assert C.assign_clusters(spark.createDataFrame([], "id string, v array<float>")).count() == 0


def test_pairs_of_a_least_cosine_are_routed_by_their_own_reach(spark, monkeypatch):
    monkeypatch.setattr(N, "CELL_ROWS", 200)
    x = np.vstack([clumps(groups=150), np.random.default_rng(5).normal(size=(3300, 16)).astype(np.float32)])
    u = unit(x).astype(np.float32)
    rows = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "row_id long, v array<float>").repartition(4)
    centroids = N.fit_centroids(u, 24)
    all_, similar = (N.fit_reach(rows, u, np.arange(len(u)), centroids, 5, least) for least in (None, 0.9))
    s = u @ u.T
    np.fill_diagonal(s, -3)
    near = np.argsort(-s, axis=1)[:, :5]
    c = u @ centroids.T
    own = c.argmax(axis=1)
    i, j = np.repeat(np.arange(len(u)), 5), near.ravel()
    apart = np.maximum(np.linalg.norm(centroids[own[i]] - centroids[own[j]], axis=1), 1e-6)
    gap = np.minimum(c[i, own[i]] - c[i, own[j]], c[j, own[j]] - c[j, own[i]]) / apart
    assert (gap <= all_ + 1e-5).mean() >= N.ROUTE_RECALL - 0.005 and (gap[s[i, j] >= 0.9] <= similar + 1e-5).all() and similar < all_
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(len(x))), pa.array(list(x), pa.list_(pa.float32()))], names=["row_id", "v"])
    asked = [sum(len(t) for b in N._placer(centroids, reach, np.ones(24, int))([batch]) for t in b.column("targets").to_pylist()) for reach in (similar, all_)]
    assert asked[0] < 0.7 * asked[1]
    # the pairs are those of the exact lists
    got = {(r.id, r.neighbour) for r in N.nearest_neighbours(frame(spark, x), 5, least_cosine=0.9).collect()}
    want = {(f"s/{a:05d}.jpg", f"s/{b:05d}.jpg") for a, b in zip(i, j) if s[a, b] >= 0.9}
    assert len(want) > 1000 and got <= want and len(got) >= 0.99 * len(want)


def test_rows_are_compared_in_turns(spark, monkeypatch):
    for name, value in (("AREA_ROWS", 90), ("GUEST_ROWS", 70), ("CLUSTER_ROWS", 60), ("COPIES_AT_ONCE", 1)):
        monkeypatch.setattr(C, name, value)
    x = clumps(4)
    u = unit(x).astype(np.float32)
    centroids = N.fit_centroids(u, 16)
    places = C._Places(centroids, 0.5 * np.sqrt(0.2), C.ward(np.ones(16), centroids, 5))
    n = np.ones(len(x), np.int64)
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(len(x))), pa.array(list(x), pa.list_(pa.float32())), pa.array(n), pa.array(n), pa.array(n)], names=["row_id", "v", "weight", "h1", "h2"])
    counts = next(places.count([batch])).to_pydict()
    turns = places.plan(np.array(counts["homes"]), np.array(counts["guests"]), C.COPIES_AT_ONCE * len(x))
    sent = [[r for b in places.send(t)([batch]) for r in b.select(["task", "row_id", "cells", "home", "mine", "guest"]).to_pylist()] for t in range(turns)]
    assert turns > 2 and sum(counts["homes"]) == len(x) and max(map(len, sent)) < 1.6 * len(x) < sum(map(len, sent)) / 2
    # every row of a cluster meets every row compared there once
    met = {}
    for r in (r for rows in sent for r in rows):
        met.setdefault(r["task"], []).append(r)
    pairs = [(m["row_id"], g["row_id"]) for rows in met.values() for m in rows if m["mine"] for g in rows if g["guest"] and m["home"] in g["cells"]]
    row, cell, home = places.meetings(batch)
    assert len(pairs) == len(set(pairs)) == np.bincount(home, minlength=16)[cell].sum()
    got = []
    plan = C._Places.plan
    monkeypatch.setattr(C._Places, "plan", lambda *a: got.append(plan(*a)) or got[-1])
    assert {(r.group_id, r.id) for r in C.isolated_groups(frame(spark, x)).collect()} == isolated(x) and got[0] > 2


def test_short_rows_bound_the_cosines():
    for dims in (3, 16, 64):
        x = unit(np.random.default_rng(dims).normal(size=(500, dims)) * np.linspace(1, 3, dims)).astype(np.float32)
        x[250:] = unit(x[:250] + np.random.default_rng(1).normal(scale=0.3 / np.sqrt(dims), size=(250, dims)))
        y = C._short(x)
        assert y.shape[1] < dims + 1 and (y @ y.T >= x @ x.T - 2e-6).all() and (dims < 64 or (y @ y.T >= 0.9).mean() < 0.02)


def planted(n=12_000, dims=48):
    """(rows, queries): scattered unit rows, every fifth with a partner in the rows and another among the queries."""
    rng = np.random.default_rng(17)
    x = unit(rng.normal(size=(n, dims)))
    near = lambda: unit(x[::5] + rng.normal(scale=0.38 / np.sqrt(dims), size=(len(x[::5]), dims)))
    return np.vstack([x, near()]).astype(np.float32), near().astype(np.float32)


def test_similar_rows_are_found_below_few_vectors_of_the_next_layer():
    x, q = planted()
    g, near, sim, order = hnsw.build(x, least=0.9)
    m = len(g.below[0])
    home = (x[order] @ x[order][g.below[0]].T).argmax(axis=1)
    both, one = hnsw.fit_visits(x[order], x[order][g.below[0]], home, 0.9)
    assert max(both, one, g.visits) < 0.8 * hnsw.usual_visits(m)
    s = x @ x.T
    np.fill_diagonal(s, -3)
    listed = {(order[a], order[b]) for a in range(len(order)) for b in near[a, :9] if b >= 0}
    want = set(zip(*np.nonzero(s >= 0.9)))
    assert len(want) > 3000 and len(listed & want) >= 0.998 * len(want)
    # a search finds the rows similar to a query, of which following links from a few places loses very many
    found, value = g.search_similar(q, 48, np.full(len(q), 0.9))
    s = q @ x[order].T
    want = set(zip(*np.nonzero(s >= 0.9)))
    met = lambda f: len({(i, j) for i, row in enumerate(f) for j in row if j >= 0} & want)
    assert len(want) > 2000 and met(found) >= 0.998 * len(want) > 1.05 * met(g.search(q, 48, np.full(len(q), 0.9))[0])
    r, c = np.nonzero(found >= 0)
    assert np.allclose(value[r, c], s[r, found[r, c]], atol=1e-5)
    assert all(len(set(row[row >= 0])) == (row >= 0).sum() for row in found)


def test_searches_among_very_many_similar_rows_hold_few(monkeypatch):
    monkeypatch.setattr(hnsw, "HELD_PAIRS", 2000)
    x = unit(1 + np.random.default_rng(3).normal(scale=0.2, size=(5000, 24))).astype(np.float32)  # every pair is similar
    q, x = x[:60], x[60:]
    g, *_, order = hnsw.build(x, least=0.9)
    g.visits = len(g.below[0])
    asked, keep = [], hnsw._keep_best
    monkeypatch.setattr(hnsw, "_keep_best", lambda *p: asked.append(len(p[2])) or keep(*p))
    found, value = g.search_similar(q, 16, np.full(len(q), 0.9))
    best = -np.sort(-(q @ x.T), axis=1)[:, :16]
    assert np.allclose(value, best, atol=1e-5) and max(asked) < 2000 + 60 * np.diff(g.starts).max()

def test_pairs_of_a_least_cosine_meet_across_shards(spark, monkeypatch):
    monkeypatch.setattr(N, "CELL_ROWS", 8000)
    monkeypatch.setattr(N, "SHARD_ROWS", 12_000)
    x = np.vstack(planted(7000))
    s = x @ x.T
    np.fill_diagonal(s, -3)
    want = {(f"s/{i:05d}.jpg", f"s/{j:05d}.jpg") for i in range(len(x)) for j in np.argsort(-s[i])[:5] if s[i, j] >= 0.9}
    got = {(r.id, r.neighbour) for r in N.nearest_neighbours(frame(spark, x), 5, least_cosine=0.9).collect()}
    assert len(want) > 5000 and got <= want and len(got) >= 0.995 * len(want)
