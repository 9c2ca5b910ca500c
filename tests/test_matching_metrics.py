"""Matching, metrics, preparation and I/O edge cases."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabweave.operators import match as M
from tabweave.operators import metrics as Q
from tabweave.operators import prepare as P
from tabweave.functions import text as T


def _vecs(spark, rows):
    return spark.createDataFrame(rows, "id bigint, vec array<float>")


def test_vector_knn_ties_zero_and_small_t2(spark):
    a = _vecs(spark, [(1, [1.0, 0.0]), (2, [0.0, 0.0])])
    b = _vecs(spark, [(10, [1.0, 0.0]), (11, [1.0, 0.0]), (12, [0.0, 1.0])])
    r = {(x["t1_id"], x["rank"]): (x["t2_id"], x["sim"]) for x in
         M.vector_knn(a, "id", "vec", b, "id", "vec", k=5).collect()}
    assert r[(1, 1)] == (10, pytest.approx(1.0)) and r[(1, 2)][0] == 11  # tie -> smaller id first
    assert (1, 4) not in r  # T2 smaller than k: only 3 ranks
    assert r[(2, 1)] == (10, 0.0)  # zero vector: similarity 0, smallest id


def test_vector_knn_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    m1, m2 = rng.standard_normal((60, 8)), rng.standard_normal((70, 8))
    a = _vecs(spark, [(i, m1[i].tolist()) for i in range(60)])
    b = _vecs(spark, [(100 + j, m2[j].tolist()) for j in range(70)])
    got = {(x["t1_id"], x["rank"]): x["t2_id"] for x in
           M.vector_knn(a, "id", "vec", b, "id", "vec", k=3, block_rows=16).collect()}
    n1 = m1.astype(np.float32).astype(np.float64)
    n2 = m2.astype(np.float32).astype(np.float64)
    s = (n1 / np.linalg.norm(n1, axis=1, keepdims=True)) @ (n2 / np.linalg.norm(n2, axis=1, keepdims=True)).T
    for i in range(60):
        order = np.argsort(-s[i], kind="stable")[:3]
        assert [got[(i, r)] for r in (1, 2, 3)] == [100 + j for j in order]


def test_lsh_recall_reasonable(spark):
    rng = np.random.default_rng(5)
    centers = rng.standard_normal((20, 16))
    pts = np.repeat(centers, 10, axis=0) + 0.05 * rng.standard_normal((200, 16))
    df = _vecs(spark, [(i, pts[i].tolist()) for i in range(200)])
    exact = M.vector_knn(df, "id", "vec", df, "id", "vec", k=1, exclude_same_id=True)
    approx = M.lsh_knn(df, "id", "vec", df, "id", "vec", dim=16, exclude_same_id=True)
    j = exact.alias("e").join(approx.alias("a"), "t1_id", "left")
    recall = j.select(F.avg((F.col("e.t2_id") == F.col("a.t2_id")).cast("double"))).first()[0]
    assert recall >= 0.9


def test_text_knn_threshold_and_bounds(spark):
    t1 = spark.createDataFrame([(1, "red apple pie"), (2, "zzz"), (3, "")], "id bigint, text string")
    t2 = spark.createDataFrame([(7, "apple pie recipe"), (8, "red car")], "id bigint, text string")
    m = M.text_knn(t1, "id", "text", t2, "id", "text")
    got = {r["t1_id"]: (r["t2_id"], r["sim"]) for r in m.collect()}
    assert got[1][0] == 7 and 0 < got[1][1] <= 1
    assert got[2] == (7, 0.0) and got[3] == (7, 0.0)  # no shared token: smallest id, similarity 0
    thr = {r["t1_id"]: r["t2_id"] for r in M.apply_threshold(m, got[1][1]).collect()}
    assert thr[1] == 7 and thr[2] is None  # exactly at the threshold is kept


def test_enrich_prefix_and_row_count(spark):
    t1 = spark.createDataFrame([(1, "a"), (2, "b")], "id bigint, text string")
    t2 = spark.createDataFrame([(5, "a")], "id bigint, text string")
    m = spark.createDataFrame([(1, 5, 1.0)], "t1_id bigint, t2_id bigint, sim double")
    e = M.enrich(t1, "id", t2, "id", m, check_rows=True)
    assert e.columns == ["id", "text", "t2_id", "t2_text"] and e.count() == 2
    with pytest.raises(ValueError):
        M.enriched_names(["id", "t2_id"], ["id"])


def test_random_match_with_replacement(spark):
    t1 = spark.range(50).withColumnRenamed("id", "a")
    t2 = spark.range(3).withColumnRenamed("id", "b")
    r = M.random_match(t1, "a", t2, "b", seed=1)
    assert r.count() == 50 and set(x["t2_id"] for x in r.collect()) <= {0, 1, 2}


def test_auc_edge_cases(spark):
    tied = spark.createDataFrame([(1, 0.5), (0, 0.5), (1, 0.5), (0, 0.5)], "y int, score double")
    assert Q.roc_auc(tied).first()["auc"] == pytest.approx(0.5)
    single = spark.createDataFrame([(1, 0.2), (1, 0.9)], "y int, score double")
    assert Q.roc_auc(single).first()["auc"] is None
    perfect = spark.createDataFrame([(0, 0.1), (0, 0.2), (1, 0.8), (1, 0.9)], "y int, score double")
    assert Q.roc_auc(perfect).first()["auc"] == pytest.approx(1.0)
    assert Q.average_precision(perfect).first()["average_precision"] == pytest.approx(1.0)


def test_macro_f1_label_only_in_predictions(spark):
    df = spark.createDataFrame([(0, 0), (0, 2), (1, 1)], "y int, pred int")
    f1 = Q.macro_f1(df).first()["macro_f1"]
    # classes 0 (P=1, R=.5), 1 (1, 1), 2 (0, 0)
    assert f1 == pytest.approx((2 / 3 + 1 + 0) / 3)
    w = Q.weighted_prf(df).first()
    acc = Q.accuracy(df).first()["accuracy"]
    assert w["weighted_recall"] == pytest.approx(acc)  # accuracy == support-weighted recall


def test_minmax_equal_scores_and_rank_ties(spark):
    from tabweave.operators.runs import minmax_normalise, model_ranking, rank_min
    df = spark.createDataFrame([("d", "m1", 0.7), ("d", "m2", 0.7), ("e", "m1", 0.2), ("e", "m2", 0.6)],
                               "data_name string, model string, score double")
    n = {(r["data_name"], r["model"]): r["normalized_score"] for r in minmax_normalise(df).collect()}
    assert n[("d", "m1")] is None and n[("e", "m2")] == 1.0
    rk = rank_min(df, ["data_name"], "score", ["model"]).filter("data_name = 'd'").collect()
    assert {r["rank"] for r in rk} == {1}
    mr = model_ranking(spark.createDataFrame([("a", 1.0), ("b", 1.0), ("c", 0.0)], "model string, normalized_score double"))
    assert {r["model"]: r["avg_rank"] for r in mr.collect()} == {"a": 1.5, "b": 1.5, "c": 3.0}


def test_drop_high_null_boundaries(spark):
    rows = [(i, None, i if i < 2 else None, i if i < 3 else None, "k" if i == 0 else None, "c") for i in range(4)]
    df = spark.createDataFrame(rows, "id int, all_null string, half int, half_plus int, one string, const string")
    assert P.high_null_columns(df, 0.5) == ["all_null", "one"] or set(P.high_null_columns(df, 0.5)) == {"all_null", "one"}
    # 4 rows: cut = 2; 'half' has 2 nulls (kept); 'half_plus' has 1 null
    df2 = spark.createDataFrame([(i, i if i < 1 else None) for i in range(4)], "id int, x int")
    assert P.high_null_columns(df2, 0.5) == ["x"]  # 3 nulls > 2
    assert set(P.single_unique_columns(df)) == {"one", "const"}  # all-null column stays


def test_numeric_coercion_tokens(spark):
    vals = ["1d", " 12 ", "1,234", "inf", "", "nan", "N/A", "-3.5e2", ".5"]
    df = spark.createDataFrame([(v,) for v in vals], "s string")
    got = [r["x"] for r in df.select(T.to_number("s").alias("x")).collect()]
    assert got[0] is None and got[1] == 12.0 and got[2] is None and math.isinf(got[3])
    assert got[4] is None and got[5] is None and got[6] is None and got[7] == -350.0 and got[8] == 0.5


def test_csv_bom_latin1_newlines_quotes(spark, tmp_path):
    from tabweave.sources import files as S
    p = tmp_path / "bom.csv"
    p.write_bytes("﻿id,text\n1,\"a \"\"quoted\"\"\nline\"\n".encode("utf-8"))
    df = S.read_csv(spark, str(p), text_col="text")
    assert df.columns == ["id", "text"]
    assert df.first()["text"] == 'a "quoted"\nline'
    q = tmp_path / "latin.csv"
    q.write_bytes("id,text\n1,caf\xe9\n".encode("latin-1"))
    df2, enc = S.read_csv_auto(spark, str(q), text_col="text")
    assert enc == "ISO-8859-1" and df2.first()["text"] == "café"
    with pytest.raises(ValueError):
        S.read_csv(spark, str(p), text_col="missing")


def test_text_functions(spark):
    df = spark.createDataFrame([("1 hr 30 min", "100.0", "[{'name': 'a'}, {'name': 'b'}]", "[]")],
                               "d string, n string, l string, e string")
    r = df.select(T.duration_minutes("d").alias("m"), T.trim_chars("n", ".0").alias("t"),
                  T.names_from_literal_list("l").alias("x"), T.names_from_literal_list("e").alias("y")).first()
    assert r["m"] == 90.0 and r["t"] == "1" and r["x"] == "a, b" and r["y"] is None


def test_bootstrap_ci_bounds(spark):
    df = spark.createDataFrame([(i, i % 2, (i // 3) % 2) for i in range(60)], "id int, y int, pred int")
    ci = Q.bootstrap_accuracy_ci(df, ["id"]).first()
    assert 0.0 <= ci["lower"] <= ci["mid"] <= ci["upper"] <= 1.0


def test_every_row_gets_a_match_and_buckets_are_scored_apart(spark):
    rng = np.random.default_rng(1)
    t1 = _vecs(spark, [(i, rng.standard_normal(8).tolist()) for i in range(40)])
    t2 = _vecs(spark, [(i, rng.standard_normal(8).tolist()) for i in range(5)])  # most buckets are empty
    got = M.lsh_knn(t1, "id", "vec", t2, "id", "vec", dim=8, bits=8, tables=2, probes=0)
    assert got.select("t1_id").distinct().count() == got.count() == 40
    exact = {r["t1_id"]: r["sim"] for r in M.vector_knn(t1, "id", "vec", t2, "id", "vec").collect()}
    assert all(r["sim"] <= exact[r["t1_id"]] + 1e-9 for r in got.collect())


def test_regression_keeps_its_target(spark):
    from tabweave.operators import learn as L

    df = spark.range(300).select(F.col("id").cast("double").alias("x"), (F.col("id") * 3.0 + 1).alias("y"),
                                 F.when(F.col("id") % 3 == 0, "test").otherwise("train").alias("split"))
    m = {r["split"]: r for r in L.fit_eval(df, ["x"], "y", "ridge", {"regParam": 0.0})[0].collect()}
    assert m["test"]["r2"] > 0.999 and m["train"]["rmse"] < 0.1


def test_bagging_with_composite_ids(spark):
    from tabweave.operators import learn as L

    df = spark.range(60).select((F.col("id") % 6).alias("a"), F.floor(F.col("id") / 6).alias("b"), F.col("id").cast("double").alias("x"),
                                F.when(F.col("id") < 30, "lo").otherwise("hi").alias("y"),
                                F.when(F.col("id") % 4 == 0, "test").otherwise("train").alias("split"))
    got = L.bagging(df, ["a", "b"], ["x"], "y", "lr", {"maxIter": 20}, n_models=3)
    assert got.count() == got.select("a", "b").distinct().count() == 60
    assert got.filter("y = pred").count() >= 57


def test_grid_search_resumes(spark, tmp_path, monkeypatch):
    from tabweave.operators import learn as L
    from tabweave.operators.runs import param_grid

    df = spark.range(90).select(F.col("id").cast("double").alias("x"), (F.col("id") % 2).cast("string").alias("y"),
                                F.element_at(F.array(F.lit("train"), F.lit("val"), F.lit("test")), (F.col("id") % 3 + 1).cast("int")).alias("split"))
    grid = param_grid(spark, {"regParam": [0.0, 0.1, 0.2]})
    path, runs, fit = str(tmp_path / "log"), [], L.fit_eval

    def cut_off(*a, **k):
        if len(runs) == 2:
            raise RuntimeError("lost")
        runs.append(a)
        return fit(*a, **k)

    monkeypatch.setattr(L, "fit_eval", cut_off)
    with pytest.raises(RuntimeError):
        L.grid_search(df, ["x"], "y", "lr", grid, log_path=path)
    runs.clear()
    log = L.grid_search(df, ["x"], "y", "lr", grid, log_path=path)
    assert len(runs) == 1 and sorted(r["config_idx"] for r in log.collect()) == [0, 1, 2]


def test_bootstrap_metrics(spark):
    df = spark.createDataFrame([(i, i % 2, (i % 2) * 0.8 + 0.1) for i in range(40)], "id int, y int, pred double")
    assert Q.bootstrap_ci(df, ["id"], "auc").first()["lower"] == 1.0
    assert abs(Q.bootstrap_ci(df, ["id"], "mse").first()["mid"] - 0.01) < 1e-9
    with pytest.raises(ValueError):
        Q.bootstrap_ci(df, ["id"], "f1")
