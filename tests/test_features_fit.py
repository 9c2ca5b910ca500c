"""Fitted transforms: power by maximum likelihood, target encoding with derived weights, the graph's hook."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabweave.operators import features as J
from tabweave.operators import graph as G
from tabweave.operators.encoder import HashingEncoder


def yeo_johnson(x, lam):
    out = np.empty_like(x)
    up = x >= 0
    out[up] = np.log1p(x[up]) if lam == 0 else np.expm1(lam * np.log1p(x[up])) / lam
    out[~up] = -np.log1p(-x[~up]) if lam == 2 else -np.expm1((2 - lam) * np.log1p(-x[~up])) / (2 - lam)
    return out


def likelihood(x, lam):
    y = yeo_johnson(x, lam)
    return -len(x) / 2 * math.log(y.var()) + (lam - 1) * (np.sign(x) * np.log1p(np.abs(x))).sum()


def test_power_maximises_the_likelihood_wherever_it_lies(spark):
    rng = np.random.default_rng(0)
    z = rng.standard_normal(600)
    columns = {"plain": z, "skew": np.exp(2 * z), "left": -np.exp(z), "steep": 0.2 + 0.01 * np.exp(z), "low": 1.5 - 0.1 * np.exp(z), "wide": 1e6 * z}
    df = spark.createDataFrame([tuple(float(v) for v in r) for r in zip(*columns.values())], ", ".join(f"{c} double" for c in columns))
    got = J.power_fit(df, list(columns))
    assert abs(got["steep"]) > 4.25 or abs(got["low"]) > 4.25  # beyond any fixed grid
    for c, x in columns.items():
        best = likelihood(x, got[c])
        for step in (1e-3, 0.05, 1.0):
            assert best >= likelihood(x, got[c] + step) - 1e-7 and best >= likelihood(x, got[c] - step) - 1e-7, c
    made = J.PowerTransformer().fit(df, ["skew"]).transform(df).toPandas()["skew"].to_numpy()
    want = yeo_johnson(columns["skew"], got["skew"])
    assert np.allclose(made, (want - want.mean()) / want.std(), atol=1e-7)


def test_power_of_constant_null_and_nan(spark):
    df = spark.createDataFrame([(3.0, None, 1.0), (3.0, None, float("nan")), (3.0, None, 2.0), (3.0, None, None)], "c double, n double, x double")
    got = J.power_fit(df, ["c", "n", "x"])
    assert got["c"] == 1.0 and got["n"] == 1.0 and math.isfinite(got["x"])
    out = J.PowerTransformer().fit(df, ["c"]).transform(df)
    assert {r["c"] for r in out.collect()} == {0.0}


def derived(train, value):
    y = np.array([t for _, t in train], float)
    mine = np.array([t for c, t in train if c == value], float)
    if not len(mine):
        return y.mean()
    weight = len(mine) * y.var() / (len(mine) * y.var() + mine.var()) if y.var() else 0.0
    return weight * mine.mean() + (1 - weight) * y.mean()


@pytest.mark.parametrize("scale", [1.0, 1e6])
def test_target_encoding_derives_its_weights(spark, scale):
    rng = np.random.default_rng(1)
    rows = [(i, [None, "a", "b", "c", f"r{i}"][i % 5], float(scale + rng.standard_normal() + i % 5), int(i % 3), i % 4 > 0) for i in range(200)]
    df = spark.createDataFrame(rows, "id int, cat string, y double, fold int, train boolean")
    got = {r["id"]: r["cat_te"] for r in J.target_encode(df, "cat", "y", "fold", F.col("train")).collect()}
    assert len(got) == 200
    for i, c, _, f, t in rows:
        seen = [(c2, y2) for _, c2, y2, f2, t2 in rows if t2 and not (t and f2 == f)]
        assert abs(got[i] - derived(seen, c)) < 1e-6
    flat = J.target_encode(df.withColumn("y", F.lit(2.0)), "cat", "y", "fold", F.col("train")).collect()
    assert {r["cat_te"] for r in flat} == {2.0}


def test_graph_takes_a_transformer(spark):
    df = spark.createDataFrame([(i, "t", float(i * i)) for i in range(30)] + [(30, None, None)], "id bigint, s string, n double")
    train = df.filter("id < 20")
    fitted = J.PowerTransformer().fit(train, ["n"]).transform(df).select("id", "n").collect()
    got = G.star_edges(df, "id", ["s"], ["n"], HashingEncoder(4), digits=9, num_transformer=J.PowerTransformer(), fit_on=train)
    plain = G.star_edges(df, "id", [], ["n"], HashingEncoder(4), digits=9)
    unit = plain.filter("row_id = 1 and kind = 'num'").first()["edge"]
    x = {r["row_id"]: r["x"] for r in got.filter("kind = 'num'").collect()}
    assert len(x) == 30
    for r in fitted[:30]:
        assert np.allclose(x[r["id"]], [v * r["n"] for v in unit], atol=1e-6)


def test_target_encode_query_computes_its_rows_once(spark, tmp_path):
    """The split and the folds are pinned: the encoding reads neither the orders nor the cuts again."""
    from tabweave.registry.features import j4_target_encode, j4_target_encode_fixed

    rows = [(i, f"p{i % 3}", "F" if i % 2 else "O") for i in range(60)]
    spark.createDataFrame(rows, "o_orderkey bigint, o_orderpriority string, o_orderstatus string").write.parquet(str(tmp_path / "orders.parquet"))
    for query in (j4_target_encode, j4_target_encode_fixed):
        got = query(spark, str(tmp_path))
        assert "parquet" not in got._jdf.queryExecution().optimizedPlan().toString().lower()
        assert got.count() == 60
