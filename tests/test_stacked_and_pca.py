"""Models that share their passes, and principal components without a covariance matrix."""

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tabweave.operators import learn as L
from tabweave.operators import pca
from tabweave.operators.cuts import bits_double, double_bits, keys_at
from tabweave.operators.features import pca as pca_columns
from tabweave.operators.stacked import logistic_stack, ridge_path, stack_metrics


def made(spark, n=300, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, 2)) * [3.0, 0.5] + [10.0, -1.0]
    z = x @ np.array([[0.6, -0.2, 0.0], [0.0, 1.5, -1.0]]) + rng.gumbel(size=(n, 3))
    rows = [(i, float(a), float(b), "xyz"[c], ["train", "train", "train", "val", "test"][i % 5]) for i, ((a, b), c) in enumerate(zip(x, z.argmax(1)))]
    return spark.createDataFrame(rows, "id bigint, a double, b double, y string, split string"), rows


def fitted(x, y, weight, penalty, k):
    """Newton's method on standardised features, a plain version."""
    z = np.column_stack([(x - x.mean(0)) / x.std(0), np.ones(len(x))])
    d = z.shape[1]
    w = np.zeros((d, k))
    keep = np.zeros((d, k))
    keep[:-1] = penalty
    for _ in range(60):
        p = np.exp(z @ w - (z @ w).max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        g = z.T @ ((p - np.eye(k)[y]) * weight[:, None]) / weight.sum() + keep * w
        h = np.zeros((d * k, d * k))
        for i in range(len(z)):
            h += weight[i] * np.kron(np.outer(z[i], z[i]), np.diag(p[i]) - np.outer(p[i], p[i]))
        h = h / weight.sum() + np.diag(keep.ravel()) + 1e-12 * np.eye(d * k)
        w = w - np.linalg.solve(h, g.ravel()).reshape(d, k)
    return p


def test_logistic_models_share_their_passes(spark):
    df, rows = made(spark)
    df = df.withColumn("split", F.lit("train")).withColumn("w", F.array(F.lit(1.0), F.lit(1.0), (F.col("id") % 2).cast("double")))
    stack = logistic_stack(df.repartition(3), ["a", "b"], "y", [0.01, 1.0, 0.1], row_weights="w", most_passes=200)
    assert max(stack.gradient) < 1e-6 and stack.classes == ["x", "y", "z"] and stack.passes < 200
    x, y = np.array([r[1:3] for r in rows]), np.array(["xyz".index(r[3]) for r in rows])
    got = {r["id"]: np.array(r["probabilities"]) for r in stack.probabilities(df).collect()}
    for m, (penalty, weight) in enumerate([(0.01, np.ones(300)), (1.0, np.ones(300)), (0.1, np.arange(300) % 2.0)]):
        want = fitted(x, y, weight, penalty, 3)
        assert np.allclose([got[i][m] for i in range(300)], want, atol=1e-5)


def test_logistic_models_stop_on_validation(spark):
    df, _ = made(spark, 200, seed=3)
    stack = logistic_stack(df, ["a", "b"], "y", [0.0, 0.1], patience=3)
    met = {(r["model"], r["split"]): r for r in stack_metrics(stack, df, "y").collect()}
    for m in (0, 1):
        assert abs(met[m, "val"]["log_loss"] - stack.val_loss[m]) < 1e-9 and met[m, "train"]["n"] == 120
        assert met[m, "val"]["log_loss"] < np.log(3)
    with pytest.raises(ValueError):
        logistic_stack(df.filter("split <> 'train'"), ["a"], "y", [0.0])


def test_ridge_path(spark):
    df, rows = made(spark, 150, seed=1)
    df = df.withColumn("t", 2 * F.col("a") - F.col("b") + F.sin(F.col("id")))
    got = ridge_path(df, ["a", "b"], "t", [0.0, 1.0, 100.0]).collect()
    x = np.array([r[1:3] for r in rows])
    t = 2 * x[:, 0] - x[:, 1] + np.sin(np.arange(150))
    side = np.array([r[4] for r in rows])
    tr = side == "train"
    for r in got:
        z = x[tr] - x[tr].mean(0)
        coef = np.linalg.solve(z.T @ z / tr.sum() + r["penalty"] * np.eye(2), z.T @ (t[tr] - t[tr].mean()) / tr.sum())
        off = t - (t[tr].mean() + (x - x[tr].mean(0)) @ coef)
        assert np.allclose(r["coefficients"], coef) and np.isclose(r["val_rmse"], np.sqrt((off[side == "val"] ** 2).mean()))
    assert [r["chosen"] for r in got] == [r["val_rmse"] == min(q["val_rmse"] for q in got) for r in got]


def test_choice_on_validation(spark):
    df, _ = made(spark)
    metrics, _, chosen = L.fit_choose(df, ["a", "b"], "y", "rf", [{"numTrees": 1, "maxDepth": 1}, {"numTrees": 10, "maxDepth": 4}], seed=1)
    each = [L.fit_eval(df, ["a", "b"], "y", "rf", p, seed=1)[0].filter("split = 'val'").first() for p in ({"numTrees": 1, "maxDepth": 1}, {"numTrees": 10, "maxDepth": 4})]
    best = max(range(2), key=lambda i: (each[i]["accuracy"], each[i]["macro_f1"], -i))
    assert chosen == [{"numTrees": 1, "maxDepth": 1}, {"numTrees": 10, "maxDepth": 4}][best]
    assert metrics.filter("split = 'val'").first()["accuracy"] == each[best]["accuracy"]


@pytest.mark.parametrize("kind, params", [("lr", {"maxIter": 30, "regParam": 0.01}), ("rf", {"numTrees": 3, "maxDepth": 3})])
def test_bagging(spark, kind, params):
    df, rows = made(spark, 120)
    got = L.bagging(df, ["id"], ["a", "b"], "y", kind, params, n_models=3, fraction=0.5)
    out = {r["id"]: (r["y"], r["pred"]) for r in got.collect()}
    classes = sorted({r[3] for r in rows if r[4] == "train"})
    assert len(out) == 120 and all(out[i][0] == (classes.index(rows[i][3]) if rows[i][3] in classes else len(classes)) for i in out)
    assert np.mean([y == p for y, p in out.values()]) > 0.5


def test_keys_and_bits(spark):
    df = spark.range(500).select((F.col("id") % 3).alias("g"), (F.xxhash64("id").bitwiseAND(F.lit((1 << 60) - 1))).alias("k"))
    rows = df.collect()
    for edge in (1, 10_000):
        got = {r["g"]: r["keys"] for r in keys_at(df, ["g"], "k", lambda m: [F.lit(0), F.lit(1), F.floor(m / 2), m], edge_rows=edge).collect()}
        for g in range(3):
            mine = sorted(r["k"] for r in rows if r["g"] == g)
            assert got[g] == [None, mine[0], mine[len(mine) // 2 - 1], mine[-1]]
    values = [0.0, 1.5, -2.25, 5e-324, -1e-310, float("inf"), float("-inf"), 1e308, 2.2250738585072014e-308]
    back = spark.createDataFrame([(v,) for v in values], "v double").select("v", bits_double(double_bits(F.col("v"))).alias("b")).collect()
    assert all(r["v"] == r["b"] for r in back)


# ------------------------------------------------------------------ principal components
def test_components_are_those_of_the_covariance(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((400, 30)) @ np.diag(0.8 ** np.arange(30)) @ rng.standard_normal((30, 30)) + 5
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id bigint, v array<double>").repartition(4)
    found = pca.components(df, "v", k=5)
    values, axes = np.linalg.eigh(np.cov(x.T, bias=True))
    values, axes = values[::-1][:5], axes[:, ::-1][:, :5]
    axes = axes * np.sign(axes[np.abs(axes).argmax(0), np.arange(5)])
    assert np.allclose(found.variances, values, rtol=1e-6) and np.allclose(found.axes, axes, atol=1e-3)
    assert np.isclose(found.total, np.trace(np.cov(x.T, bias=True)))
    got = {r["id"]: r["p"] for r in pca.project(df, "v", found, "p").select("id", vector_to_array("p").alias("p")).collect()}
    assert np.allclose([got[i] for i in range(400)], (x - x.mean(0)) @ found.axes)


def test_fewest_components_for_a_share(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((200, 40)) * np.r_[np.full(20, 3.0), np.full(20, 0.01)]
    df = spark.createDataFrame([([float(v) for v in r],) for r in x], "v array<double>")
    share = np.cumsum(np.sort(np.linalg.eigvalsh(np.cov(x.T, bias=True)))[::-1]) / np.trace(np.cov(x.T, bias=True))
    want = int(np.flatnonzero(share >= 0.95)[0]) + 1
    assert want > pca.FIRST and len(pca.components(df, "v", variance=0.95, rounds=30).variances) == want
    assert len(pca.components(df, "v", variance=0.999999, most=6).variances) == 6
    with pytest.raises(ValueError):
        pca_columns(df, "v")


def test_wide_vectors(spark):
    """20,000 columns: no matrix of their products."""
    rng = np.random.default_rng(2)
    axis = rng.standard_normal(20_000)
    rows = [([float(v) for v in (i % 7 - 3) * axis + 0.01 * rng.standard_normal(20_000)],) for i in range(21)]
    found = pca.components(spark.createDataFrame(rows, "v array<double>"), "v", k=1, rounds=2)
    cosine = abs(found.axes[:, 0] @ axis) / np.linalg.norm(axis)
    assert cosine > 0.999 and found.variances[0] > 0.99 * found.total
