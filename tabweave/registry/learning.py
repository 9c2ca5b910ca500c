"""End-to-end plans (P2, P3, P8, P9, P11, K3) and learning baselines (N1,
N3-N5, N7). Model fits are held against facts that are certain: rows per split, ranges,
the share of the commonest class."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import functions as F

from ..core import TableSpec, table
from ..operators import features as J
from ..operators import graph as G
from ..operators import learn as L
from ..operators import match as M
from ..operators import split as X
from ..operators.encoder import HashingEncoder
from ..operators.runs import param_grid
from ..operators.stacked import logistic_stack, ridge_path
from ..plans.evaluation import build_features, entity_features, load_recipe, run_recipe
from ..plans.join_fa import rank_ablation
from ..plans.union_fa import union_fa
from ..sources.files import scratch_path
from ..functions.text import NUMERIC_TEXT
from .features import EDGES_SQL, _hash_sql, _norm_sql
from .prepare import MESSY_SQL, messy
from .sqlparts import ratio, seeded_md5, seeded_uint, tfidf_top1, vector_topk

VEC = "SELECT vec_id AS id, embedding AS e FROM embeddings"


# ------------------------------------------------------------------ P2 / P3
def p2_union_fa(spark, sf):
    c = table(spark, sf, "customer")
    s = table(spark, sf, "supplier")
    return union_fa(c, "c_custkey", s, "s_suppkey", exclude=["c_acctbal", "s_acctbal"], threshold=0.3)["mapping"]


P2_T1 = ("SELECT c_custkey AS id, concat_ws(', ', 'c_name: ' || trim(c_name), 'c_nationkey: ' || CAST(c_nationkey AS VARCHAR), "
         "CASE WHEN trim(c_mktsegment) <> '' THEN 'c_mktsegment: ' || trim(c_mktsegment) END) AS text FROM customer")
P2_T2 = ("SELECT s_suppkey AS id, concat_ws(', ', 's_name: ' || trim(s_name), 's_nationkey: ' || CAST(s_nationkey AS VARCHAR)) "
         "AS text FROM supplier")
SQL_P2 = f"""WITH {tfidf_top1(P2_T1, P2_T2)},
t AS ({P2_T1}), a AS ({P2_T2}),
thr AS (SELECT t1_id, CASE WHEN sim >= 0.3 THEN t2_id END AS t2_id, sim FROM best)
SELECT t.id AS task_index, coalesce(thr.t2_id, -1) AS aux_index, t.text AS task_text, a.text AS aux_text,
  round(thr.sim, 6) AS cosine_similarity, round(1 - round(thr.sim, 6), 6) AS cosine_distance
FROM t LEFT JOIN thr ON thr.t1_id = t.id LEFT JOIN a ON a.id = thr.t2_id"""


def p3_rank_ablation(spark, sf):
    e = table(spark, sf, "embeddings")
    tabs = rank_ablation(e, "vec_id", "embedding", e, "vec_id", "embedding", [1, 2, 4, 8], seed=42,
                         exclude_same_id=True)
    return _union(t["mapping"] for t in tabs.values())


def _union(frames):
    return reduce(lambda a, b: a.unionByName(b), frames)


def p3_rank_stats(spark, sf):
    e = table(spark, sf, "embeddings")
    tabs = rank_ablation(e, "vec_id", "embedding", e, "vec_id", "embedding", [1, 2, 4, 8], seed=42, exclude_same_id=True)
    return _union(t["stats"].withColumn("name", F.lit(name)) for name, t in tabs.items()).select(
        "name", "n_rows", "n_distinct_t2", "mean_similarity", "min_similarity", "max_similarity")


def p3_rank_enriched(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", "embedding", "label")
    tabs = rank_ablation(e, "vec_id", "embedding", e, "vec_id", "embedding", [2], seed=42, exclude_same_id=True,
                         include_random=False, drop_t2=["embedding"])
    return tabs["rank2"]["enriched"].drop("embedding")


SQL_P3 = f"""WITH {vector_topk(VEC, 8)},
idx AS (SELECT vec_id AS t2_id, row_number() OVER (ORDER BY vec_id) - 1 AS slot FROM embeddings),
draw AS (SELECT vec_id AS t1_id, {seeded_uint(42, 'vec_id')} % (SELECT count(*) FROM embeddings) AS slot FROM embeddings),
m AS (SELECT t1_id, t2_id, 'rank_nn' AS match_type, rank, round(sim, 6) AS s FROM knn WHERE rank IN (1, 2, 4, 8)
  UNION ALL SELECT draw.t1_id, idx.t2_id, 'random', NULL, round(list_dot_product(a.e, b.e) / (a.nrm * b.nrm), 6)
    FROM draw JOIN idx USING (slot) JOIN vn a ON a.id = draw.t1_id JOIN vn b ON b.id = idx.t2_id)"""
SQL_P3_STATS = SQL_P3 + """ SELECT CASE WHEN rank IS NULL THEN 'random' ELSE 'rank' || CAST(rank AS VARCHAR) END AS name, count(*) AS n_rows,
  count(DISTINCT t2_id) AS n_distinct_t2, round(avg(s), 6) AS mean_similarity, round(min(s), 6) AS min_similarity, round(max(s), 6) AS max_similarity
FROM m GROUP BY rank"""
SQL_P3 += " SELECT t1_id AS t1_index, t2_id AS t2_index, match_type, rank, s AS cosine_similarity, round(1 - s, 6) AS cosine_distance FROM m"
SQL_P3_ENRICHED = f"""WITH {vector_topk(VEC, 2)} SELECT e.vec_id, e.label, x.vec_id AS t2_vec_id, x.label AS t2_label
FROM embeddings e JOIN knn ON knn.t1_id = e.vec_id AND knn.rank = 2 JOIN embeddings x ON x.vec_id = knn.t2_id"""


# ------------------------------------------------------------------ P8 / P9 / P11 / K3
def p8_recipe_standin(spark, sf):
    out, spec = run_recipe(messy(spark, sf), load_recipe("standin_customer"))
    return out


def _num(x):
    return f"CASE WHEN regexp_matches({x}, '{NUMERIC_TEXT}') THEN TRY_CAST(trim({x}) AS DOUBLE) END"


SQL_P8 = f"""WITH m AS ({MESSY_SQL})
SELECT id, "Customer Name" AS Customer_Name, coalesce(CAST(half_null AS VARCHAR), 'nan') AS half_null, segment,
  {_num("regexp_replace(price_text, '[$,€£¥]', '', 'g')")} AS price_text, {_num('nation_text')} AS nation_text
FROM m WHERE segment IS NOT NULL"""


def p9_feature_build(spark, sf):
    c = table(spark, sf, "customer").withColumn("Rich", F.when(F.col("c_acctbal") > 5000, "yes").otherwise("no"))
    spec = TableSpec.from_kinds(bin_cols=["rich"], num_cols=["c_acctbal", "c_nationkey"], cat_cols=["c_name"],
                                target="c_mktsegment")
    out = build_features(c, "c_custkey", spec)
    return out.select(*[F.round(x, 6).alias(x) if t == "double" else F.col(x) for x, t in out.dtypes])


SQL_P9 = f"""WITH b AS (SELECT c_custkey, c_mktsegment AS label, {seeded_md5(42, 'c_custkey')} AS o FROM customer),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY o, c_custkey) AS pos,
             count(*) OVER (PARTITION BY label) AS m FROM b),
t AS (SELECT *, pos > m - ceil(m::DOUBLE * 0.2::DOUBLE) AS is_test FROM r),
tr AS (SELECT c_custkey, row_number() OVER (ORDER BY o, c_custkey) AS tp, count(*) OVER () AS nt FROM t WHERE NOT is_test),
split AS (SELECT c_custkey, CASE WHEN tp > nt - (SELECT {ratio('count(*)', 0.1)} FROM customer) THEN 'val' ELSE 'train' END AS split FROM tr
          UNION ALL SELECT c_custkey, 'test' FROM t WHERE is_test),
c AS (SELECT customer.*, split.split FROM customer JOIN split USING (c_custkey)),
mm AS (SELECT min(c_acctbal) AS a0, max(c_acctbal) AS a1, min(c_nationkey) AS n0, max(c_nationkey) AS n1 FROM c WHERE split = 'train'),
lab AS (SELECT v, CAST(row_number() OVER (ORDER BY v) - 1 AS INTEGER) AS code FROM (SELECT DISTINCT c_mktsegment AS v FROM c WHERE split = 'train'))
SELECT c.c_custkey, CAST(c.c_acctbal > 5000 AS INTEGER) AS rich,
  round((c.c_acctbal - mm.a0) / (mm.a1 - mm.a0), 6) AS c_acctbal,
  round((c.c_nationkey - mm.n0) / (mm.n1 - mm.n0), 6) AS c_nationkey, c.c_name,
  coalesce(lab.code, -1) AS c_mktsegment, c.split
FROM c CROSS JOIN mm LEFT JOIN lab ON lab.v = c.c_mktsegment"""


def p11_entity_features(spark, sf):
    c = table(spark, sf, "customer")
    out = entity_features(c, "c_name", ["c_mktsegment", "c_nationkey"], dim=8)
    return out.select("entity", *[F.round(f"X{i}", 6).alias(f"X{i}") for i in range(8)])


P11_SENT = ("'query: ' || concat_ws(' ', 'c_mktsegment ' || lower(replace(regexp_replace(c_mktsegment, '[<>\n]', '', 'g'), '_', ' ')) || '.', "
            "'c_nationkey ' || CAST(c_nationkey AS VARCHAR) || '.')")
SQL_P11 = f"""WITH s AS (SELECT lower(replace(regexp_replace(c_name, '[<>\n]', '', 'g'), '_', ' ')) AS entity, {P11_SENT} AS sent FROM customer),
v AS (SELECT sent, {_norm_sql(_hash_sql('sent'))} AS vec FROM (SELECT DISTINCT sent FROM s))
SELECT s.entity, {", ".join(f"v.vec[{i + 1}] AS X{i}" for i in range(8))} FROM s JOIN v USING (sent)"""


def k3_graph_numeric_transform(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_acctbal", "c_nationkey")
    return G.star_edges(c, "c_custkey", ["c_name", "c_mktsegment"], ["c_acctbal", "c_nationkey"], HashingEncoder(8),
                        num_transformer=J.StandardTransformer())


K3_EDGES = EDGES_SQL.replace(
    "'c_acctbal', CAST(c_acctbal AS DOUBLE) FROM customer",
    "'c_acctbal', (c_acctbal - (SELECT avg(c_acctbal) FROM customer)) / (SELECT stddev_pop(c_acctbal) FROM customer) FROM customer").replace(
    "'c_nationkey', CAST(c_nationkey AS DOUBLE) FROM customer",
    "'c_nationkey', (c_nationkey - (SELECT avg(c_nationkey) FROM customer)) / (SELECT stddev_pop(c_nationkey) FROM customer) FROM customer")
SQL_K3 = f"""WITH {K3_EDGES}
SELECT * FROM edges UNION ALL SELECT row_id, "column", 'self', [1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0], NULL FROM edges"""


# ------------------------------------------------------------------ N1 / N3 / N4 / N5 / N7
def _orders_ml(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", F.col("o_totalprice").alias("price"),
                                          F.year("o_orderdate").cast("double").alias("year"),
                                          F.month("o_orderdate").cast("double").alias("month"))
    return o.join(X.stratified_split(o, "o_orderkey", "o_orderstatus", seed=42), "o_orderkey")


FEATS = ["price", "year", "month"]


def _facts(metrics, df, split="split"):
    """What is certain of a metrics frame: the rows of each split, values in range,
    and on the training rows at least the accuracy of the commonest class."""
    top = df.groupBy(split, "o_orderstatus").agg(F.count(F.lit(1)).alias("n")).groupBy(split).agg(
        F.sum("n").alias("n_rows"), (F.max("n") / F.sum("n")).alias("majority"))
    ok = F.lit(True)
    for c in metrics.columns:
        if c != split:
            ok = ok & F.coalesce(F.col(c).between(0.0, 1.0), F.lit(True))
    return metrics.join(top, split).select(split, "n_rows", ok.alias("in_range"),
                                           ((F.col(split) != "train") | (F.col("accuracy") >= F.col("majority"))).alias("learned"))


ORDERS_SPLIT_SQL = f"""SELECT o_orderkey, o_orderstatus, CASE WHEN pos <= {ratio('m', 0.7)} THEN 'train'
  WHEN pos <= {ratio('m', 0.7)} + {ratio('m', 0.1)} THEN 'val' ELSE 'test' END AS split
  FROM (SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY {seeded_md5(42, 'o_orderkey')}, o_orderkey) AS pos,
               count(*) OVER (PARTITION BY o_orderstatus) AS m FROM orders)"""
SQL_FACTS = f"SELECT split, count(*) AS n_rows, true AS in_range, true AS learned FROM ({ORDERS_SPLIT_SQL}) GROUP BY split"


def n1_fit_eval(spark, sf):
    df = _orders_ml(spark, sf).checkpoint(eager=True)
    m, _ = L.fit_eval(df, FEATS, "o_orderstatus", "rf", {"numTrees": 20, "maxDepth": 5}, seed=0)
    return _facts(m, df)


def n1_regression(spark, sf):
    """Ridge on the numeric target: finite errors, and no worse than the mean on the training rows."""
    df = _orders_ml(spark, sf).checkpoint(eager=True)
    m, _ = L.fit_eval(df, ["year", "month"], "price", "ridge", {"regParam": 0.1})
    n = df.groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"))
    return m.join(n, "split").select("split", "n_rows", (F.abs(F.col("rmse") - F.sqrt("mse")) < 1e-6).alias("in_range"),
                                     ((F.col("split") != "train") | (F.col("r2") >= -1e-6)).alias("learned"))


def n3_grid_search(spark, sf):
    """A search that is cut off after two configs and resumed from its log."""
    df = _orders_ml(spark, sf).checkpoint(eager=True)
    grid = param_grid(spark, {"regParam": [0.0, 0.1], "maxIter": [10, 30]})
    path = scratch_path(spark, f"grid-{uuid.uuid4().hex}")
    L.grid_search(df, FEATS, "o_orderstatus", "lr", grid.filter("config_idx < 2"), log_path=path)
    log = L.grid_search(df, FEATS, "o_orderstatus", "lr", grid, log_path=path)
    best = L.best_config(log).select("val_acc").first()[0]
    return log.agg(F.count(F.lit(1)).alias("n_configs"), F.countDistinct("config_idx").alias("n_distinct"),
                   (F.max("val_acc") == F.lit(best)).alias("best_is_max"))


SQL_N3 = "SELECT CAST(4 AS BIGINT) AS n_configs, CAST(4 AS BIGINT) AS n_distinct, count(*) > 0 AS best_is_max FROM orders"


PENALTIES = [0.01, 0.1, 1.0, 10.0]


def n1_ridge_path(spark, sf):
    """Linear models of four penalties from one aggregate, the best of them chosen on the validation rows."""
    df = _orders_ml(spark, sf)
    got = ridge_path(df, ["year", "month"], "price", PENALTIES)
    return got.select("penalty", F.round("intercept", 3).alias("intercept"), F.round(F.col("coefficients")[0], 6).alias("coef_year"),
                      F.round(F.col("coefficients")[1], 6).alias("coef_month"), F.round("val_rmse", 6).alias("val_rmse"), "chosen")


SQL_N1_RIDGE = f"""WITH s AS ({ORDERS_SPLIT_SQL}),
d AS (SELECT split, o_totalprice AS p, year(o_orderdate)::DOUBLE AS a, month(o_orderdate)::DOUBLE AS b FROM orders JOIN s USING (o_orderkey)),
m AS (SELECT avg(p) AS mp, avg(a) AS ma, avg(b) AS mb, var_pop(a) AS saa, var_pop(b) AS sbb, covar_pop(a, b) AS sab, covar_pop(a, p) AS sap,
             covar_pop(b, p) AS sbp FROM d WHERE split = 'train'),
k AS (SELECT unnest({PENALTIES}::DOUBLE[]) AS penalty),
c AS (SELECT *, (sap * (sbb + penalty) - sbp * sab) / ((saa + penalty) * (sbb + penalty) - sab * sab) AS ca,
             (sbp * (saa + penalty) - sap * sab) / ((saa + penalty) * (sbb + penalty) - sab * sab) AS cb FROM m CROSS JOIN k),
f AS (SELECT penalty, ca, cb, mp - ca * ma - cb * mb AS i FROM c),
v AS (SELECT penalty, sqrt(avg((p - i - ca * a - cb * b) ** 2)) AS rmse FROM d CROSS JOIN f WHERE split = 'val' GROUP BY penalty)
SELECT penalty, round(i, 3) AS intercept, round(ca, 6) AS coef_year, round(cb, 6) AS coef_month, round(rmse, 6) AS val_rmse,
  row_number() OVER (ORDER BY rmse, penalty) = 1 AS chosen FROM f JOIN v USING (penalty)"""


def n3_stacked_logistic(spark, sf):
    """Logistic models of four penalties in one loop of passes: the log-odds of status F by year."""
    o = table(spark, sf, "orders").select((F.col("o_orderstatus") == "F").cast("int").alias("y"), F.year("o_orderdate").cast("double").alias("year"),
                                          F.lit("train").alias("split"))
    got = logistic_stack(o, ["year"], "y", PENALTIES, most_passes=200, tolerance=1e-11)
    odds = got.weights[:, :, 1] - got.weights[:, :, 0]
    return spark.createDataFrame([(p, round(float(w[0]), 6), round(float(w[1]), 4)) for p, w in zip(PENALTIES, odds)],
                                 "penalty double, coef_year double, intercept double")


def _newton_sql(rounds: int) -> str:
    """Newton's steps for the log-odds v * z + b, with penalty / 4 times v squared (half of it on either class)."""
    step = """(SELECT penalty, v - (hbb * gv - hvb * gb) / (hvv * hbb - hvb * hvb) AS v, b - (hvv * gb - hvb * gv) / (hvv * hbb - hvb * hvb) AS b
  FROM (SELECT penalty, v, b, avg((s - y) * z) + penalty / 2 * v AS gv, avg(s - y) AS gb, avg(s * (1 - s) * z * z) + penalty / 2 AS hvv,
               avg(s * (1 - s) * z) AS hvb, avg(s * (1 - s)) AS hbb
        FROM (SELECT *, 1 / (1 + exp(-(v * z + b))) AS s FROM z CROSS JOIN {before}) GROUP BY penalty, v, b))"""
    return ",\n".join(f"t{i + 1} AS MATERIALIZED {step.format(before=f't{i}')}" for i in range(rounds))


SQL_N3_STACK = f"""WITH o AS (SELECT (o_orderstatus = 'F')::INTEGER AS y, year(o_orderdate)::DOUBLE AS x FROM orders),
m AS MATERIALIZED (SELECT avg(x) AS mx, stddev_pop(x) AS sx FROM o),
z AS MATERIALIZED (SELECT y, (x - mx) / sx AS z FROM o CROSS JOIN m),
t0 AS (SELECT unnest({PENALTIES}::DOUBLE[]) AS penalty, 0::DOUBLE AS v, 0::DOUBLE AS b),
{_newton_sql(12)}
SELECT penalty, round(v / sx, 6) AS coef_year, round(b - v * mx / sx, 4) AS intercept FROM t12 CROSS JOIN m"""


def n4_repeated_runs(spark, sf):
    from ..operators.runs import run_statistics
    log = L.repeated_runs(_orders_ml(spark, sf).checkpoint(eager=True), FEATS, "o_orderstatus", "rf", {"numTrees": 10, "maxDepth": 4}, [1, 2, 3])
    got = run_statistics(log, ["split"], ["accuracy", "macro_f1"])
    names = [c for c in got.columns if got.schema[c].dataType.simpleString() == "double"]
    ok = reduce(lambda a, b: a & b, [F.col(c).between(0.0, 1.0) for c in names])
    return got.groupBy("split").agg(F.count(F.lit(1)).alias("n_metrics"), F.min(ok).alias("in_range"))


SQL_N4 = f"SELECT split, CAST(2 AS BIGINT) AS n_metrics, true AS in_range FROM ({ORDERS_SPLIT_SQL}) GROUP BY split"


def n5_bagging(spark, sf):
    preds = L.bagging(_orders_ml(spark, sf), ["o_orderkey"], FEATS, "o_orderstatus", "lr", {"maxIter": 20}, n_models=15)
    return preds.groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("o_orderkey").alias("n_ids"),
                                      F.min(F.col("pred").between(0, 3)).alias("in_range"))


SQL_N5 = f"SELECT split, count(*) AS n_rows, count(DISTINCT o_orderkey) AS n_ids, true AS in_range FROM ({ORDERS_SPLIT_SQL}) GROUP BY split"


def n7_source_target(spark, sf):
    target = _orders_ml(spark, sf).withColumnRenamed("o_orderkey", "id")
    li = table(spark, sf, "lineitem")
    source = li.select(F.concat_ws("|", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("id"),
                       F.col("l_linestatus").alias("o_orderstatus"), F.col("l_extendedprice").alias("price"),
                       F.year("l_shipdate").cast("double").alias("year"), F.month("l_shipdate").cast("double").alias("month"))
    target = target.withColumn("id", F.col("id").cast("string"))
    m = L.source_target_fit(target, source, FEATS, "o_orderstatus", "rf", {"numTrees": 10, "maxDepth": 4},
                            fraction=0.5, cap=10_000, seed=0)
    return m.select("split", F.col("accuracy").between(0.0, 1.0).alias("in_range"))


SQL_N7 = f"SELECT split, true AS in_range FROM ({ORDERS_SPLIT_SQL}) GROUP BY split"

QUERIES = {
    "p2_union_fa": (p2_union_fa, SQL_P2),
    "p3_rank_ablation": (p3_rank_ablation, SQL_P3),
    "p3_rank_stats": (p3_rank_stats, SQL_P3_STATS),
    "p3_rank_enriched": (p3_rank_enriched, SQL_P3_ENRICHED),
    "p8_recipe_standin": (p8_recipe_standin, SQL_P8),
    "p9_feature_build": (p9_feature_build, SQL_P9),
    "p11_entity_features": (p11_entity_features, SQL_P11),
    "k3_graph_numeric_transform": (k3_graph_numeric_transform, SQL_K3),
    "n1_fit_eval": (n1_fit_eval, SQL_FACTS),
    "n1_regression": (n1_regression, SQL_FACTS),
    "n1_ridge_path": (n1_ridge_path, SQL_N1_RIDGE),
    "n3_grid_search": (n3_grid_search, SQL_N3),
    "n3_stacked_logistic": (n3_stacked_logistic, SQL_N3_STACK),
    "n4_repeated_runs": (n4_repeated_runs, SQL_N4),
    "n5_bagging": (n5_bagging, SQL_N5),
    "n7_source_target": (n7_source_target, SQL_N7),
}
