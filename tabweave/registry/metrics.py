"""Metric queries (D6-D14, D17, D20-D22, E13) over predictions derived from the tables.

Predictions come from deterministic rules or neighbours on the driver tables:
* binary: labelled documents, y = quality, score = n_chars / (n_chars + 2000);
* multi-class: embeddings, y = label, class scores = votes of the 8 nearest
  other vectors (exact kNN), prediction = nearest other vector's label;
* regression: orders, y = o_totalprice, prediction = mean price of the status.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..core import table
from ..operators import match as M
from ..operators import metrics as Q
from ..operators import split as X
from ..session import ensure_checkpoint_dir
from .sqlparts import ratio, seeded_md5, vector_topk

VEC = "SELECT vec_id AS id, embedding AS e FROM embeddings"


def _binary(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "n_chars", "source")
    lab = table(spark, sf, "labels").select("doc_id", F.col("quality").alias("y"))
    j = d.join(lab, "doc_id")
    return j.withColumn("score", F.round(F.col("n_chars") / (F.col("n_chars") + 2000.0), 6)) \
        .withColumn("pred", (F.col("score") > 0.5).cast("int"))


BIN_SQL = """SELECT d.doc_id, d.n_chars, d.source, l.quality AS y, round(d.n_chars / (d.n_chars + 2000.0), 6) AS score,
  CAST(round(d.n_chars / (d.n_chars + 2000.0), 6) > 0.5 AS INTEGER) AS pred FROM documents d JOIN labels l USING (doc_id)"""


def _neighbours(spark, sf, k=8):
    e = table(spark, sf, "embeddings")
    return M.vector_knn(e, "vec_id", "embedding", e, "vec_id", "embedding", k=k, exclude_same_id=True)


def _votes(spark, sf, k=8, knn=None):
    """Shares of the labels among the ``k`` nearest; ``knn`` may be a deeper list."""
    lab = table(spark, sf, "embeddings").select(F.col("vec_id").alias("t2_id"), F.col("label").alias("class"))
    near = (knn if knn is not None else _neighbours(spark, sf, k)).filter(F.col("rank") <= k)
    return (near.join(lab, "t2_id").groupBy(F.col("t1_id").alias("row"), "class")
            .agg((F.count(F.lit(1)) / float(k)).alias("score")))


def VOTES_SQL(k=8):
    return f"""WITH {vector_topk(VEC, k)},
votes AS (SELECT knn.t1_id AS row, e.label AS class, count(*) / {float(k)} AS score
          FROM knn JOIN embeddings e ON e.vec_id = knn.t2_id GROUP BY knn.t1_id, e.label)"""


def _multiclass(spark, sf):
    e = table(spark, sf, "embeddings")
    knn = M.vector_knn(e, "vec_id", "embedding", e, "vec_id", "embedding", k=1, exclude_same_id=True)
    lab = e.select(F.col("vec_id").alias("t2_id"), F.col("label").alias("pred"))
    return (e.select(F.col("vec_id").alias("row"), F.col("label").alias("y"))
            .join(knn.select(F.col("t1_id").alias("row"), "t2_id").join(lab, "t2_id"), "row").drop("t2_id"))


MC_SQL = f"""WITH {vector_topk(VEC, 1)},
mc AS (SELECT e.vec_id AS row, e.label AS y, p.label AS pred FROM embeddings e JOIN knn ON knn.t1_id = e.vec_id
       JOIN embeddings p ON p.vec_id = knn.t2_id)"""


def _r6(df):
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# ------------------------------------------------------------------ D6 - D9
def d6_accuracy(spark, sf):
    return _r6(Q.accuracy(_multiclass(spark, sf)))


SQL_D6 = MC_SQL + " SELECT round(avg(CAST(y = pred AS DOUBLE)), 6) AS accuracy FROM mc"

PER_CLASS_SQL = """
c AS (SELECT y, pred, count(*) AS n FROM mc GROUP BY y, pred),
t AS (SELECT y AS label, sum(n) AS support, sum(CASE WHEN y = pred THEN n ELSE 0 END) AS tp FROM c GROUP BY y),
p AS (SELECT pred AS label, sum(n) AS predicted FROM c GROUP BY pred),
pc AS (SELECT coalesce(t.label, p.label) AS label, coalesce(support, 0) AS support, coalesce(tp, 0) AS tp,
              coalesce(predicted, 0) AS predicted FROM t FULL JOIN p ON t.label = p.label),
pcm AS (SELECT *, CASE WHEN predicted = 0 THEN 0.0 ELSE tp::DOUBLE / predicted END AS precision,
               CASE WHEN support = 0 THEN 0.0 ELSE tp::DOUBLE / support END AS recall,
               CASE WHEN support + predicted = 0 THEN 0.0 ELSE 2.0 * tp / (support + predicted) END AS f1 FROM pc)"""


def d7_macro_f1(spark, sf):
    return _r6(Q.macro_f1(_multiclass(spark, sf)))


SQL_D7 = MC_SQL + "," + PER_CLASS_SQL + " SELECT round(avg(f1), 6) AS macro_f1 FROM pcm"


def d8_weighted_prf(spark, sf):
    return _r6(Q.weighted_prf(_multiclass(spark, sf)))


SQL_D8 = MC_SQL + "," + PER_CLASS_SQL + """ SELECT round(sum(precision * support) / sum(support), 6) AS weighted_precision,
  round(sum(recall * support) / sum(support), 6) AS weighted_recall, round(sum(f1 * support) / sum(support), 6) AS weighted_f1 FROM pcm"""


def d9_classification_report(spark, sf):
    return _r6(Q.classification_report(_multiclass(spark, sf)))


SQL_D9 = MC_SQL + "," + PER_CLASS_SQL + """
SELECT CAST(label AS VARCHAR) AS label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1,
       CAST(support AS BIGINT) AS support FROM pcm
UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), CAST(sum(support) AS BIGINT) FROM pcm
UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6),
  round(sum(f1 * support) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM pcm"""


# ------------------------------------------------------------------ D10 - D13
def d10_binary_auc(spark, sf):
    return _r6(Q.roc_auc(_binary(spark, sf)))


SQL_D10 = f"""WITH b AS ({BIN_SQL}),
st AS (SELECT score AS s, sum(y) AS pos, sum(1 - y) AS neg FROM b GROUP BY score),
cs AS (SELECT *, sum(neg) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_neg FROM st)
SELECT round(sum(pos * (cum_neg - neg + 0.5 * neg)) / (sum(pos) * sum(neg)), 6) AS auc FROM cs"""


def d10_auc_by_source(spark, sf):
    return _r6(Q.roc_auc(_binary(spark, sf), by=["source"]))


SQL_D10B = f"""WITH b AS ({BIN_SQL}),
st AS (SELECT source, score AS s, sum(y) AS pos, sum(1 - y) AS neg FROM b GROUP BY source, score),
cs AS (SELECT *, sum(neg) OVER (PARTITION BY source ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_neg FROM st)
SELECT source, round(CASE WHEN sum(pos) * sum(neg) = 0 THEN NULL ELSE sum(pos * (cum_neg - neg + 0.5 * neg)) / (sum(pos) * sum(neg)) END, 6) AS auc
FROM cs GROUP BY source"""


def d11_ovr_auc(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("row"), F.col("label").alias("y"))
    votes = _votes(spark, sf)
    ensure_checkpoint_dir(spark)
    return _r6(Q.ovr_auc(votes.checkpoint(eager=True), e))  # read for the classes, the scores and what they leave at zero


SQL_D11 = VOTES_SQL() + """,
classes AS (SELECT DISTINCT label AS class FROM embeddings),
grid AS (SELECT e.vec_id AS row, e.label AS y, c.class, coalesce(v.score, 0.0) AS score
         FROM embeddings e CROSS JOIN classes c LEFT JOIN votes v ON v.row = e.vec_id AND v.class = c.class),
st AS (SELECT class, score AS s, sum(CAST(y = class AS INTEGER)) AS pos, sum(CAST(y <> class AS INTEGER)) AS neg FROM grid GROUP BY class, score),
cs AS (SELECT *, sum(neg) OVER (PARTITION BY class ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_neg FROM st),
per AS (SELECT class, CASE WHEN sum(pos) * sum(neg) = 0 THEN NULL ELSE sum(pos * (cum_neg - neg + 0.5 * neg)) / (sum(pos) * sum(neg)) END AS auc
        FROM cs GROUP BY class)
SELECT round(avg(auc), 6) AS macro_auc, count(auc) AS n_classes FROM per"""


def d12_average_precision(spark, sf):
    return _r6(Q.average_precision(_binary(spark, sf)))


SQL_D12 = f"""WITH b AS ({BIN_SQL}),
st AS (SELECT score AS s, sum(y) AS pos, sum(1 - y) AS neg FROM b GROUP BY score),
cs AS (SELECT *, sum(pos) OVER (ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_pos,
              sum(neg) OVER (ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_neg FROM st)
SELECT round(sum(pos * cum_pos / (cum_pos + cum_neg)) / sum(pos), 6) AS average_precision FROM cs"""


def _regression(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", F.col("o_totalprice").alias("y"))
    means = o.groupBy("o_orderstatus").agg(F.avg("y").alias("pred"))
    return o.join(means, "o_orderstatus")


REG_SQL = """SELECT o_orderkey, o_orderstatus, o_totalprice AS y, avg(o_totalprice) OVER (PARTITION BY o_orderstatus) AS pred FROM orders"""


def d13_regression_metrics(spark, sf):
    return _r6(Q.regression_metrics(_regression(spark, sf)))


SQL_D13 = f"""WITH r AS ({REG_SQL})
SELECT round(avg((y - pred) * (y - pred)), 6) AS mse, round(sqrt(avg((y - pred) * (y - pred))), 6) AS rmse,
       round(1 - sum((y - pred) * (y - pred)) / (sum(y * y) - sum(y) * sum(y) / count(*)), 6) AS r2 FROM r"""


# ------------------------------------------------------------------ D14 / D17
def _binary_split(spark, sf):
    b = _binary(spark, sf)
    s = X.stratified_split(b, "doc_id", "y", seed=42)
    return b.join(s, "doc_id")


BIN_SPLIT_SQL = f"""WITH b AS ({BIN_SQL}),
s AS (SELECT doc_id, CASE WHEN pos <= {ratio('m', 0.7)} THEN 'train' WHEN pos <= {ratio('m', 0.7)} + {ratio('m', 0.1)} THEN 'val'
             ELSE 'test' END AS split
      FROM (SELECT doc_id, row_number() OVER (PARTITION BY y ORDER BY {seeded_md5(42, 'doc_id')}, doc_id) AS pos,
                   count(*) OVER (PARTITION BY y) AS m FROM b)),
bs AS (SELECT b.*, s.split FROM b JOIN s USING (doc_id))"""


def d14_generalisation_gap(spark, sf):
    return _r6(Q.generalisation_gap(_binary_split(spark, sf)))


SQL_D14 = BIN_SPLIT_SQL + """
SELECT round(avg(CASE WHEN split = 'train' THEN CAST(y = pred AS DOUBLE) END), 6) AS train_acc,
       round(avg(CASE WHEN split = 'test' THEN CAST(y = pred AS DOUBLE) END), 6) AS test_acc,
       round(avg(CASE WHEN split = 'train' THEN CAST(y = pred AS DOUBLE) END) - avg(CASE WHEN split = 'test' THEN CAST(y = pred AS DOUBLE) END), 6) AS gap
FROM bs"""


def d17_bootstrap_ci(spark, sf):
    return _r6(Q.bootstrap_accuracy_ci(_binary(spark, sf), ["doc_id"], n_boot=10, seed=123))


SQL_D17 = f"""WITH b AS ({BIN_SQL}),
p AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS slot, CAST(y = pred AS DOUBLE) AS ok FROM b),
n AS (SELECT count(*) AS n FROM b),
d AS (SELECT t.b, ('0x' || substr(md5(concat_ws('|', '123', CAST(t.b AS VARCHAR), CAST(p.slot AS VARCHAR))), 1, 15))::BIGINT
               % (SELECT n FROM n) AS slot FROM p CROSS JOIN range(1, 11) t(b)),
per AS (SELECT d.b, avg(p.ok) AS acc FROM d JOIN p USING (slot) GROUP BY d.b),
ci AS (SELECT greatest(0.0, quantile_cont(acc, 0.025)) AS lower, least(1.0, quantile_cont(acc, 0.975)) AS upper FROM per)
SELECT round(lower, 6) AS lower, round(upper, 6) AS upper, round((upper + lower) / 2, 6) AS mid,
       round((upper - lower) / 2, 6) AS half_width FROM ci"""


def d17_bootstrap_auc_ci(spark, sf):
    return _r6(Q.bootstrap_ci(_binary(spark, sf), ["doc_id"], "auc", "y", "score", n_boot=10, seed=123))


def d17_bootstrap_mse_ci(spark, sf):
    return _r6(Q.bootstrap_ci(_binary(spark, sf), ["doc_id"], "mse", "y", "score", n_boot=10, seed=123))


def _d17_sql(per: str) -> str:
    return f"""WITH b AS ({BIN_SQL}),
p AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS slot, y, score FROM b),
d AS (SELECT t.b, ('0x' || substr(md5(concat_ws('|', '123', CAST(t.b AS VARCHAR), CAST(p.slot AS VARCHAR))), 1, 15))::BIGINT
               % (SELECT count(*) FROM b) AS slot FROM p CROSS JOIN range(1, 11) t(b)),
r AS (SELECT d.b, p.y, p.score FROM d JOIN p USING (slot)),
per AS ({per}),
ci AS (SELECT greatest(0.0, quantile_cont(v, 0.025)) AS lower, least(1.0, quantile_cont(v, 0.975)) AS upper FROM per)
SELECT round(lower, 6) AS lower, round(upper, 6) AS upper, round((upper + lower) / 2, 6) AS mid, round((upper - lower) / 2, 6) AS half_width FROM ci"""


SQL_D17_AUC = _d17_sql("""SELECT b, sum(CASE WHEN y = 1 THEN avg_rank END) / sum(y) / (count(*) - sum(y)) - (sum(y) + 1) / 2.0 / (count(*) - sum(y)) AS v
  FROM (SELECT b, y, rank() OVER (PARTITION BY b ORDER BY score) + (count(*) OVER (PARTITION BY b, score) - 1) / 2.0 AS avg_rank FROM r) GROUP BY b""")
SQL_D17_MSE = _d17_sql("SELECT b, avg((y - score) * (y - score)) AS v FROM r GROUP BY b")


# ------------------------------------------------------------------ D20 - D22, E13
def d20_ensemble(spark, sf):
    knn = _neighbours(spark, sf, 8).checkpoint(eager=True)  # the list of eight holds the list of two
    v8 = _votes(spark, sf, 8, knn).withColumn("model", F.lit("knn8")).withColumn("w", F.lit(0.7))
    v2 = _votes(spark, sf, 2, knn).withColumn("model", F.lit("knn2")).withColumn("w", F.lit(0.3))
    return _r6(Q.ensemble(v8.unionByName(v2)))


SQL_D20 = f"""WITH v8 AS ({VOTES_SQL(8)} SELECT row, class, score, 0.7 AS w FROM votes),
v2 AS ({VOTES_SQL(2)} SELECT row, class, score, 0.3 AS w FROM votes),
a AS (SELECT * FROM v8 UNION ALL SELECT * FROM v2),
m AS (SELECT row, class, sum(w * score) / sum(w) AS m FROM a GROUP BY row, class),
e AS (SELECT *, exp(m - max(m) OVER (PARTITION BY row)) AS ex FROM m)
SELECT row, class, round(m, 6) AS m, round(ex / sum(ex) OVER (PARTITION BY row), 6) AS prob FROM e"""


def d21_domain_weights(spark, sf):
    b = _binary(spark, sf).withColumn("loss", F.abs(F.col("y") - F.col("score")))
    return _r6(Q.domain_weights(b, "source", "loss"))


SQL_D21 = f"""WITH b AS (SELECT *, abs(y - score) AS loss FROM ({BIN_SQL})),
sd AS (SELECT stddev_pop(loss) AS sd FROM b),
g AS (SELECT source, avg(loss) AS mean_loss, -avg(loss) / (SELECT CASE WHEN sd > 0 THEN sd ELSE 1.0 END FROM sd) AS x FROM b GROUP BY source),
e AS (SELECT *, exp(x - (SELECT max(x) FROM g)) AS ex FROM g)
SELECT source, round(mean_loss, 6) AS mean_loss, round(ex / (SELECT sum(ex) FROM e), 6) AS weight FROM e"""


def d22_fill_predictions(spark, sf):
    r = _regression(spark, sf)
    r = r.withColumn("pred", F.when(F.col("o_orderkey") % 7 == 0, F.lit(None)).when(
        F.col("o_orderkey") % 11 == 0, F.lit(float("nan"))).otherwise(F.col("pred")))
    o = table(spark, sf, "orders")
    split = X.stratified_split(o, "o_orderkey", "o_orderpriority", seed=42)
    train = r.join(split.filter("split = 'train'"), "o_orderkey")
    return _r6(Q.fill_predictions(r, train).select("o_orderkey", "pred"))


SQL_D22 = f"""WITH r AS ({REG_SQL}),
s AS (SELECT o_orderkey, CASE WHEN pos <= {ratio('m', 0.7)} THEN 'train' WHEN pos <= {ratio('m', 0.7)} + {ratio('m', 0.1)} THEN 'val' ELSE 'test' END AS split
      FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY {seeded_md5(42, 'o_orderkey')}, o_orderkey) AS pos,
                   count(*) OVER (PARTITION BY o_orderpriority) AS m FROM orders)),
mu AS (SELECT avg(y) AS mu FROM r JOIN s USING (o_orderkey) WHERE split = 'train')
SELECT o_orderkey, round(CASE WHEN o_orderkey % 7 = 0 OR o_orderkey % 11 = 0 THEN (SELECT mu FROM mu) ELSE pred END, 6) AS pred FROM r"""


def e13_argmax_label(spark, sf):
    return _r6(Q.argmax_label(_votes(spark, sf)))


SQL_E13 = VOTES_SQL() + """
SELECT row, pred, round(score, 6) AS score FROM (
  SELECT row, class AS pred, score, row_number() OVER (PARTITION BY row ORDER BY score DESC, class) AS rn FROM votes) WHERE rn = 1"""


QUERIES = {
    "d6_accuracy": (d6_accuracy, SQL_D6),
    "d7_macro_f1": (d7_macro_f1, SQL_D7),
    "d8_weighted_prf": (d8_weighted_prf, SQL_D8),
    "d9_classification_report": (d9_classification_report, SQL_D9),
    "d10_binary_auc": (d10_binary_auc, SQL_D10),
    "d10_auc_by_source": (d10_auc_by_source, SQL_D10B),
    "d11_ovr_auc": (d11_ovr_auc, SQL_D11),
    "d12_average_precision": (d12_average_precision, SQL_D12),
    "d13_regression_metrics": (d13_regression_metrics, SQL_D13),
    "d14_generalisation_gap": (d14_generalisation_gap, SQL_D14),
    "d17_bootstrap_ci": (d17_bootstrap_ci, SQL_D17),
    "d17_bootstrap_auc_ci": (d17_bootstrap_auc_ci, SQL_D17_AUC),
    "d17_bootstrap_mse_ci": (d17_bootstrap_mse_ci, SQL_D17_MSE),
    "d20_ensemble": (d20_ensemble, SQL_D20),
    "d21_domain_weights": (d21_domain_weights, SQL_D21),
    "d22_fill_predictions": (d22_fill_predictions, SQL_D22),
    "e13_argmax_label": (e13_argmax_label, SQL_E13),
}
