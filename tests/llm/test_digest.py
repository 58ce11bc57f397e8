import numpy as np

from morphex.llm import digest as G


def test_cut_bounds_and_sums():
    x = np.random.default_rng(0).normal(size=50_000)
    g, m, w, lo, hi = G.cut(np.zeros(len(x), int), x, np.ones(len(x)), x, x, 200)
    assert len(m) <= 102 and w.sum() == len(x) and np.isclose((m * w).sum(), x.sum()) and (np.diff(m) > 0).all() and lo.min() == x.min() and hi.max() == x.max()
    probs = np.array([0.01, 0.25, 0.5, 0.75, 0.99])
    e = G.estimate(m, w, x.min(), x.max(), probs)
    rank = np.searchsorted(np.sort(x), e) / len(x)
    assert (np.abs(rank - probs) <= np.pi / 200 * np.sqrt(probs * (1 - probs)) + 1 / len(x)).all()


def test_per_key_against_counting(spark, monkeypatch):
    monkeypatch.setattr(G, "BUFFER_ROWS", 500)
    rng = np.random.default_rng(1)
    rows = [("hot", float(v)) for v in rng.normal(size=6000)] + [(f"k{i % 40}", float(i)) for i in range(800)] + [("same", 2.0)] * 50
    rows += [("none", None), ("nan", float("nan")), ("inf", float("inf")), (None, 1.0), (None, 3.0)]
    df = spark.createDataFrame([(k, v, "x") for k, v in rows], "key string, value double, part string").repartition(5)
    probs = [0.05, 0.5, 0.95]
    found = G.digest_percentiles(G.digests(df, ["key"], "value"), ["key"], probs)
    out = {}
    for r in G.certify(df, ["key"], "value", found).collect():
        out.setdefault(r.key, {})[r.prob] = r
    assert set(out) == {k for k, v in rows if v is not None and np.isfinite(v)}
    for k, by in out.items():
        x = np.sort([v for q, v in rows if q == k and v is not None and np.isfinite(v)])
        for p, r in by.items():
            below, upto = np.searchsorted(x, r.estimate) / len(x), np.searchsorted(x, r.estimate, "right") / len(x)
            assert r.n == len(x) and abs(r.rank_error - max(0, below - p, p - upto)) < 1e-9
            assert r.rank_error <= np.pi / G.DELTA * np.sqrt(p * (1 - p)) + 1 / len(x)
    assert out["same"][0.5].estimate == 2.0


def test_merging_days_equals_whole_within_bound(spark):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([("a", f"d{i % 9}", float(v)) for i, v in enumerate(rng.gamma(2, size=9000))], "key string, day string, value double")
    daily = G.digests(df, ["key", "day"], "value")
    merged = G.digest_percentiles(G.merge_digests(daily.drop("day"), ["key"]), ["key"], [0.5, 0.9])
    assert all(r.rank_error <= 2 * np.pi / G.DELTA * 0.5 + 1e-3 for r in G.certify(df, ["key"], "value", merged).collect())
    assert G.digest_percentiles(G.digests(df.limit(0), ["key"], "value"), ["key"], [0.5]).count() == 0


def test_rows_of_hot_keys_stay_where_they_are(spark, monkeypatch):
    monkeypatch.setattr(G, "hot_threshold", lambda _: 100)
    rows = [("hot", float(i)) for i in range(900)] + [(f"k{i % 20}", float(i)) for i in range(400)] + [(None, float(i)) for i in range(300)]
    df = spark.createDataFrame(rows, "key string, value double").repartition(4)
    found = G.digest_percentiles(G.digests(df, ["key"], "value"), ["key"], [0.5])
    auto = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = G.certify(df, ["key"], "value", found)
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "LeftAnti" in plan and out.count() == 22 and all(r.rank_error < 0.02 + 1 / r.n for r in out.collect())
        sent = [p for p in out._jdf.queryExecution().executedPlan().toString().split("\n") if "hashpartitioning(key" in p]
        assert sent
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", auto)
