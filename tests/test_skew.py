import math
import random

import pytest

from morphex.operators import skew


def brute(rows, probs):
    keys = {}
    for k, v in rows:
        if k is not None:
            keys.setdefault(k, []).append(v)
    out = {}
    for k, vs in keys.items():
        x = sorted(v for v in vs if v is not None)
        out[k] = (len(vs), len(x), [x[min(len(x), max(1, math.ceil(p * len(x)))) - 1] for p in probs] if x else None)
    return out


@pytest.mark.parametrize("hot", [10, 10**9])
def test_against_sorting(spark, monkeypatch, hot):
    monkeypatch.setattr(skew, "MIN_HOT", hot)
    monkeypatch.setattr(skew, "FEW", 4)
    monkeypatch.setattr(skew, "BINS", 8)
    rng = random.Random(1)
    rows = [("hot", rng.choice([rng.randrange(-(10**15), 10**15), 7, None])) for _ in range(900)] + [(f"k{rng.randrange(30)}", rng.randrange(-50, 50)) for _ in range(300)]
    rows += [("same", 5)] * 40 + [(None, 1)] * 20 + [("empty", None)] * 15 + [("wide", x) for x in (-(2**63), 2**63 - 1, 0)] * 8
    probs = [0.0, 0.1, 0.5, 0.9, 1.0]
    df = spark.createDataFrame([(k, v, "x") for k, v in rows], "key string, value long, n_rows string")
    got = {r.key: (r.n_rows, r.n_values, r.quantiles) for r in skew.key_quantiles(df, ["key"], "value", probs).collect()}
    assert got == brute(rows, probs)


def test_dominant_and_empty(spark):
    df = spark.createDataFrame([("a", 1)] * 96 + [("b", 2)] * 4, "key string, value long")
    assert {r.key for r in skew.dominant(skew.key_quantiles(df, ["key"], "value", [0.5]), 0.04).collect()} == {"a", "b"}
    assert {r.key for r in skew.dominant(skew.key_quantiles(df, ["key"], "value", [0.5]), 0.05).collect()} == {"a"}
    assert skew.key_quantiles(df.limit(0), ["key"], "value", [0.5]).count() == 0
