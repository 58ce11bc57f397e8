import numpy as np
import pytest

from morphex.operators import features as X
from morphex.operators import training_data as TD


@pytest.mark.parametrize("strategy", ["blockwise", "hybrid"])
def test_block_masks_are_exact_and_repeatable(spark, strategy):
    ids = spark.range(40).selectExpr("id")
    one, two = ({r.id: tuple(r.masked) for r in TD.block_masks(ids.repartition(n), 12, 9, 0.37, strategy, 5).collect()} for n in (1, 4))
    assert one == two and len(set(one.values())) > 30 and all(len(set(m)) == len(m) == TD.masked_count(0.37, 108) and 0 <= min(m) and max(m) < 108 for m in one.values())
    assert TD.block_masks(ids.limit(0), 12, 9, 0.37, strategy).count() == 0


def test_mask_bounds():
    assert [TD.masked_count(r, 10) for r in (0.0, 0.25, 0.35, 1.0)] == [1, 2, 4, 9]
    for h, w in ((1, 9), (2, 2), (3, 3)):
        assert len(TD.block_shapes(h, w)) == 0
    with pytest.raises(ValueError):
        TD.block_masks(None, 3, 3, 0.3)


def test_plans_of_prolonged_runs(spark):
    assert TD.resume_plan(10, 4, 10, 7, 7) == "same" and TD.resume_plan(10, 10, 15, 8, 7) == "extended"
    for bad in ((10, 10, 10, 7, 7), (10, 4, 9, 7, 7), (10, 4, 10, 8, 7)):
        with pytest.raises(ValueError):
            TD.resume_plan(*bad)
    v = [r.value for r in TD.extended_schedule(spark, 3, 8, 1.0, 0.0).orderBy("step").collect()]
    assert v[:4] == [1.0] * 4 and np.allclose(v[3:], [0.5 * (1 + np.cos(np.pi * i / 5)) for i in range(5)])
    with pytest.raises(ValueError):
        TD.extended_schedule(spark, 8, 8, 1.0, 0.0)
    ramp = [r.value for r in TD.linear_ramp(spark, 5, 1.0, 3.0, 3).orderBy("step").collect()]
    assert ramp == [1.0, 2.0, 3.0, 3.0, 3.0] and [r.value for r in TD.linear_ramp(spark, 2, 1.0, 3.0, 0).collect()] == [3.0, 3.0]
    warm = [r.value for r in TD.cosine_schedule(spark, 6, 1.0, 0.0, 3, 0.5).orderBy("step").collect()]
    assert np.allclose(warm, [0.5, 0.75, 1.0, 1.0, 0.75, 0.25])


def unit(x):
    return x / np.linalg.norm(x, axis=-1, keepdims=True)


def test_relational_loss_by_hand(spark):
    rng = np.random.default_rng(0)
    s, t = unit(rng.normal(size=(2, 6, 4))), unit(rng.normal(size=(2, 6, 4)))
    df = spark.createDataFrame([(i, v, s[v, i].tolist(), t[v, i].tolist()) for v in (0, 1) for i in range(6)], "id long, view int, student array<double>, teacher array<double>").repartition(3)

    def one(a, b):
        z, q = t[b] @ t[b].T / 0.05, s[a] @ t[b].T / 0.1
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        return -(p * (q - np.log(np.exp(q).sum(axis=1, keepdims=True)))).sum(axis=1).mean()

    for pairing, views in TD.VIEW_PAIRS.items():
        assert abs(TD.relational_loss(df, 0.1, 0.05, pairing).first().loss - np.mean([one(a, b) for a, b in views])) < 1e-9
    with pytest.raises(ValueError):
        TD.relational_loss(df, 0.1, 0.05, "other")
    assert TD.relational_loss(df.limit(0), 0.1, 0.05).first().loss is None


def test_margin_by_hand(spark):
    rows = spark.createDataFrame([(1, "a", [1.0, 0.1]), (2, "b", [-1.0, -0.2]), (3, "lost", [1.0, 0.0])], "id long, label string, v array<double>")
    centres = spark.createDataFrame([("a", 0, [1.0, 0.0]), ("a", 1, [0.0, 1.0]), ("b", 0, [1.0, -1.0])], "label string, sub_centre int, w array<double>")
    got = {r.id: r for r in TD.margin_logits(rows, centres, 8.0, 0.5).collect()}
    assert set(got) == {1, 2} and got[1].hit and got[1].local_centre == 0 and got[1].global_label == "a" and not got[2].hit and got[2].global_label == "a" and got[2].global_centre == 1
    x = unit(np.array([1.0, 0.1]))
    own, other = np.cos(np.arccos(x[0]) + 0.5) * 8, x @ unit(np.array([1.0, -1.0])) * 8
    assert abs(got[1].loss - (np.log(np.exp(own) + np.exp(other)) - own)) < 1e-9
    y = unit(np.array([-1.0, -0.2]))
    cos = y @ unit(np.array([1.0, -1.0]))
    assert cos > np.cos(np.pi - 0.5) and abs(got[2].loss - (np.log(np.exp(np.cos(np.arccos(cos) + 0.5) * 8) + np.exp(max(-1 / np.hypot(1, 0.2), y[1]) * 8)) - np.cos(np.arccos(cos) + 0.5) * 8)) < 1e-9
    one = TD.margin_logits(rows, centres.where("label = 'a'")).collect()
    assert [r.hit for r in one] == [None]
    p = TD.compact_penalty(centres, 0.5, 2.0).first()
    assert p.active == 1.0 and abs(p.penalty - 1.0) < 1e-12 and TD.compact_penalty(centres.where("label = 'b'")).first().penalty is None
    drift = {(r.label, r.sub_centre): r.cosine for r in TD.centre_drift(centres, centres.where("label = 'a'")).collect()}
    assert set(drift) == {("a", 0), ("a", 1)} and all(abs(c - 1) < 1e-12 for c in drift.values())


def test_weighted_cross_entropy(spark):
    assert TD.weighted_cross_entropy(spark.createDataFrame([(1.0, 2.0), (3.0, 4.0)], "weight double, loss double")).first().loss == 3.5


# ---- features of images ----------------------------------------------------------------------------------------


def field(number, kind, payload):
    """One field of the wire format of a stored network."""
    def varint(n):
        out = b""
        while True:
            out += bytes([n & 127 | (128 if n > 127 else 0)])
            n >>= 7
            if not n:
                return out

    return varint(number << 3 | kind) + (varint(payload) if kind == 0 else varint(len(payload)) + payload)


def network(nodes, outputs, side):
    """A stored network with input x of (batch, 3, side, side); ``nodes``: (operation, inputs, output)."""
    dims = lambda ds: b"".join(field(1, 2, field(2, 2, d.encode()) if isinstance(d, str) else field(1, 0, d)) for d in ds)
    value = lambda name, ds: field(1, 2, name.encode()) + field(2, 2, field(1, 2, field(1, 0, 1) + field(2, 2, dims(ds))))
    graph = b"".join(field(1, 2, b"".join(field(1, 2, i.encode()) for i in ins) + field(2, 2, out.encode()) + field(4, 2, op.encode())) for op, ins, out in nodes)
    graph += field(2, 2, b"g") + field(11, 2, value("x", ["n", 3, side, side])) + field(12, 2, value(*outputs))
    return field(1, 0, 8) + field(7, 2, graph) + field(8, 2, field(1, 2, b"") + field(2, 0, 13))


def image(seed, h, w):
    return np.random.default_rng(seed).integers(0, 256, (h, w, 3)).astype(np.uint8)


def test_transforms():
    x = image(1, 20, 30)
    assert X.resized(x, 20, 30) is x and np.allclose(X.cubic_weights(7, 3).sum(axis=1), 1) and (X.resized(np.full((9, 5, 3), 77, np.uint8), 4, 11) == 77).all()
    assert np.array_equal(X.centre_cropped(x, 20), x[:, 5:25]) and X.centre_cropped(x, 8).shape == (8, 8, 3) and X.centre_cropped(x, 40).shape == (40, 40, 3)
    s = X.squared(x)
    assert s.shape == (30, 30, 3) and np.array_equal(s[5:25], x) and tuple(s[0, 0]) == X.background(x) and X.background(x[:1]) == X.FALLBACK_FILL
    p = X.prepared(np.full((4, 6, 3), 255, np.uint8), 4)
    assert p.shape == (3, 4, 4) and np.allclose(p[:, 0, 0], (1 - np.array(X.CHANNEL_MEAN)) / X.CHANNEL_STD)
    with pytest.raises(ValueError):
        X.prepared(x, 4, "other")


def test_extraction(spark, tmp_path):
    path = str(tmp_path / "mean.onnx")
    (tmp_path / "mean.onnx").write_bytes(network([("GlobalAveragePool", ["x"], "p"), ("Flatten", ["p"], "y")], ("y", ["n", 3]), 6))
    rows = [(f"i{i}", 8 + i % 3, 7, image(i, 8 + i % 3, 7).tobytes()) for i in range(70)] + [("none", 4, 4, None), ("short", 4, 4, b"abc")]
    df = spark.createDataFrame(rows, "ref string, height int, width int, pixels binary").repartition(3)
    for transform in X.TRANSFORMS:
        got = {r.ref: r for r in X.extract_embeddings(df, path, 224, transform, "projector").collect()}
        assert len(got) == 72 and got["none"].reason == got["short"].reason == "missing_pixels" and got["none"].v is None
        for i in (0, 33, 69):
            assert np.allclose(got[f"i{i}"].v, X.prepared(image(i, 8 + i % 3, 7), 6, transform).mean(axis=(1, 2)), atol=1e-5)
    assert X.extract_embeddings(df.limit(0), path).count() == 0
    with pytest.raises(ValueError):
        X.extract_embeddings(df, path, token="other")


def test_tokens_of_an_output():
    out = np.random.default_rng(2).normal(size=(3, 6, 4))
    assert np.array_equal(X._vectors(out, "cls", 2, 1), out[:, 0])
    got = X._vectors(out, "patch-topk", 2, 1)
    best = np.argsort(-np.linalg.norm(out[:, 1:], axis=2), axis=1)[:, :2] + 1
    assert np.allclose(got, np.stack([np.concatenate([out[i, b] for b in best[i]]) for i in range(3)]))


def test_patch_features_chain(spark):
    rng = np.random.default_rng(3)
    t = rng.normal(size=(8, 5, 3))
    df = spark.createDataFrame([(i, t[i].tolist()) for i in range(8)] + [(99, [])], "id long, tokens array<array<double>>")
    got = {r.id: np.array(r.v) for r in X.patch_features(df, 2).collect()}
    x = X._vectors(t, "patch-topk", 2, 1)
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    full = np.stack([got[i] for i in range(8)])
    assert set(got) == set(range(8)) and np.allclose(full @ full.T, z @ z.T, atol=1e-8)
