"""Run-log queries.

The run log is derived from the tables: every labelled document is one
evaluation of a rule ``n_chars > 2000 -> quality 1``; runs are keyed by
dataset (``lang``), method (``'m' || n_chars % 4``), train size and seed, and
carry train/val/test accuracies (by ``doc_id % 10`` slices) and a val loss.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..core import positions, table
from ..operators import runs as R

METRICS = ["train_acc", "val_acc", "test_acc", "val_loss"]


def runs_frame(spark, sf, labelled_only: bool = True):
    d = table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    lab = table(spark, sf, "labels").select("doc_id", "quality")
    j = d.join(lab, "doc_id", "inner" if labelled_only else "left")
    c = (F.col("quality") == (F.col("n_chars") > 2000).cast("int")).cast("double")
    part = F.col("doc_id") % 10
    loss = F.abs(F.col("quality") - F.col("n_chars") / (F.col("n_chars") + 2000.0))
    return j.groupBy(F.col("lang").alias("data_name"),
                     F.concat(F.lit("m"), (F.col("n_chars") % 4).cast("string")).alias("method"),
                     (32 * (1 + F.col("doc_id") % 2)).alias("num_train"),
                     (F.col("doc_id") % 3).alias("random_state")).agg(
        F.avg(F.when(part < 6, c)).alias("train_acc"), F.avg(F.when(part.isin(6, 7), c)).alias("val_acc"),
        F.avg(F.when(part >= 8, c)).alias("test_acc"), F.avg(F.when(part.isin(6, 7), loss)).alias("val_loss"),
        F.avg(c).alias("score"), F.lit("classification").alias("task"))


RUNS_SQL = """SELECT lang AS data_name, 'm' || CAST(n_chars % 4 AS VARCHAR) AS method, 32 * (1 + doc_id % 2) AS num_train,
  doc_id % 3 AS random_state,
  avg(CASE WHEN doc_id % 10 < 6 THEN c END) AS train_acc, avg(CASE WHEN doc_id % 10 IN (6, 7) THEN c END) AS val_acc,
  avg(CASE WHEN doc_id % 10 >= 8 THEN c END) AS test_acc,
  avg(CASE WHEN doc_id % 10 IN (6, 7) THEN abs(quality - n_chars / (n_chars + 2000.0)) END) AS val_loss,
  avg(c) AS score, 'classification' AS task
FROM (SELECT d.doc_id, d.lang, d.n_chars, l.quality, CAST(l.quality = CAST(d.n_chars > 2000 AS INTEGER) AS DOUBLE) AS c
      FROM documents d JOIN labels l USING (doc_id))
GROUP BY 1, 2, 3, 4"""


def _r6(df):
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _unpivot_sql(keys: str) -> str:
    sel = " UNION ALL ".join(f"SELECT {keys}{', ' if keys else ''}'{m}' AS metric, {m} AS value FROM runs" for m in METRICS)
    return f"long AS ({sel})"


# ------------------------------------------------------------------ D15 / D16
def d15_run_statistics(spark, sf):
    return _r6(R.run_statistics(runs_frame(spark, sf), ["data_name", "method"], METRICS))


SQL_D15 = f"""WITH runs AS ({RUNS_SQL}), {_unpivot_sql('data_name, method')}
SELECT data_name, method, metric, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std,
  round(min(value), 6) AS min, round(max(value), 6) AS max, count(*) AS n
FROM long WHERE value IS NOT NULL GROUP BY data_name, method, metric"""


def d16_dynamic_summary(spark, sf):
    return _r6(R.dynamic_summary(runs_frame(spark, sf), METRICS))


SQL_D16 = f"""WITH runs AS ({RUNS_SQL}), {_unpivot_sql('')}
SELECT metric, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, round(min(value), 6) AS min,
  round(max(value), 6) AS max, count(*) AS n FROM long WHERE value IS NOT NULL GROUP BY metric"""


# ------------------------------------------------------------------ D18 / D19 / P10 / E12
def d19_floor_scores(spark, sf):
    return _r6(R.floor_scores(runs_frame(spark, sf)).select("data_name", "method", "num_train", "random_state", "score"))


SQL_D19 = f"""WITH runs AS ({RUNS_SQL})
SELECT data_name, method, num_train, random_state, round(CASE WHEN score < 0.5 THEN 0.5 ELSE score END, 6) AS score FROM runs"""


def d18_minmax_normalise(spark, sf):
    r = runs_frame(spark, sf).select("data_name", "method", "num_train", "random_state", "score")
    return _r6(R.minmax_normalise(r))


NORM_SQL = """SELECT *, CASE WHEN max(score) OVER (PARTITION BY data_name) = min(score) OVER (PARTITION BY data_name) THEN NULL
  ELSE (score - min(score) OVER (PARTITION BY data_name)) / (max(score) OVER (PARTITION BY data_name) - min(score) OVER (PARTITION BY data_name))
  END AS normalized_score FROM {src}"""
SQL_D18 = f"""WITH runs AS ({RUNS_SQL}), n AS ({NORM_SQL.format(src='runs')})
SELECT data_name, method, num_train, random_state, round(score, 6) AS score, round(normalized_score, 6) AS normalized_score FROM n"""


def _compiled(spark, sf):
    return R.minmax_normalise(R.floor_scores(runs_frame(spark, sf)))


def p10_results_compile(spark, sf):
    return _r6(R.model_ranking(_compiled(spark, sf), model="method"))


def e12_model_ranking_at_64(spark, sf):
    return _r6(R.model_ranking(_compiled(spark, sf).filter("num_train = 64"), model="method"))


def _ranking_sql(where: str) -> str:
    return f"""WITH runs AS ({RUNS_SQL}),
fl AS (SELECT * REPLACE (CASE WHEN score < 0.5 THEN 0.5 ELSE score END AS score) FROM runs),
n AS ({NORM_SQL.format(src='fl')}),
g AS (SELECT method, avg(normalized_score) AS mean_score FROM n {where} GROUP BY method)
SELECT method, round(mean_score, 6) AS mean_score,
  round(rank() OVER (ORDER BY mean_score DESC) + (count(*) OVER (PARTITION BY mean_score) - 1) / 2.0, 6) AS avg_rank FROM g"""


SQL_P10 = _ranking_sql("")
SQL_E12 = _ranking_sql("WHERE num_train = 64")


# ------------------------------------------------------------------ E9 / E10 / E11 / E14
def e9_grid_shards(spark, sf):
    cfg = runs_frame(spark, sf).select("method", "num_train").distinct()
    cfg = positions(cfg, [], ["method", "num_train"], out="config_idx")
    return R.grid_shards(cfg, "config_idx", 3)


SQL_E9 = f"""WITH runs AS ({RUNS_SQL}),
c AS (SELECT method, num_train, row_number() OVER (ORDER BY method, num_train) AS config_idx FROM (SELECT DISTINCT method, num_train FROM runs))
SELECT method, num_train, config_idx, CAST(ntile(3) OVER (ORDER BY config_idx) - 1 AS INTEGER) AS shard FROM c"""


def e10_best_config(spark, sf):
    r = runs_frame(spark, sf).filter("val_acc IS NOT NULL AND val_loss IS NOT NULL") \
        .select("data_name", "method", "num_train", "random_state", "val_acc", "val_loss")
    return _r6(R.best_by(r, ["data_name"], desc=["val_acc"], asc=["val_loss", "num_train", "random_state"]))


SQL_E10 = f"""WITH runs AS ({RUNS_SQL})
SELECT data_name, method, num_train, random_state, round(val_acc, 6) AS val_acc, round(val_loss, 6) AS val_loss FROM (
  SELECT *, row_number() OVER (PARTITION BY data_name ORDER BY val_acc DESC, val_loss, num_train, random_state, method DESC) AS rn
  FROM runs WHERE val_acc IS NOT NULL AND val_loss IS NOT NULL) WHERE rn = 1"""


def e11_rank_min(spark, sf):
    r = runs_frame(spark, sf).filter("val_loss IS NOT NULL").select("data_name", "method", "num_train", "random_state",
                                                                   "val_loss")
    return _r6(R.rank_min(r, ["data_name"], "val_loss", ["method", "num_train", "random_state"]))


SQL_E11 = f"""WITH runs AS ({RUNS_SQL})
SELECT data_name, method, num_train, random_state, round(val_loss, 6) AS val_loss,
  rank() OVER (PARTITION BY data_name ORDER BY val_loss) AS rank FROM runs WHERE val_loss IS NOT NULL"""


def e14_best_run(spark, sf):
    r = runs_frame(spark, sf).filter("test_acc IS NOT NULL").select("data_name", "method", "num_train", "random_state",
                                                                   "test_acc")
    return _r6(R.best_by(r, ["data_name", "method"], desc=["test_acc"], asc=["random_state", "num_train"]))


SQL_E14 = f"""WITH runs AS ({RUNS_SQL})
SELECT data_name, method, num_train, random_state, round(test_acc, 6) AS test_acc FROM (
  SELECT *, row_number() OVER (PARTITION BY data_name, method ORDER BY test_acc DESC, random_state, num_train) AS rn
  FROM runs WHERE test_acc IS NOT NULL) WHERE rn = 1"""


# ------------------------------------------------------------------ I21 / I22 / N6
def i21_case_ids(spark, sf):
    r = R.with_case_id(runs_frame(spark, sf), "data_name", "num_train", "random_state")
    return r.filter(F.col("num_train").cast("string").contains("64")).select("case", "method")


SQL_I21 = f"""WITH runs AS ({RUNS_SQL})
SELECT concat_ws('_', data_name, CAST(num_train AS VARCHAR), CAST(random_state AS VARCHAR)) AS "case", method
FROM runs WHERE contains(CAST(num_train AS VARCHAR), '64')"""

DISPLAY = [("m0", "Baseline"), ("m1", "Tree"), ("m", "Model ")]


def i22_display_names(spark, sf):
    return R.display_names(runs_frame(spark, sf).select("data_name", "method", "num_train", "random_state"),
                           "method", DISPLAY)


SQL_I22 = f"""WITH runs AS ({RUNS_SQL})
SELECT data_name, replace(replace(replace(method, 'm0', 'Baseline'), 'm1', 'Tree'), 'm', 'Model ') AS method,
  num_train, random_state FROM runs"""

METHODS = [("m0", None, None), ("m1", "regression", None), ("m2", None, 32), ("m3", "classification", 64)]


def n6_eligible_methods(spark, sf):
    methods = spark.createDataFrame(METHODS, "method string, only_task string, max_train bigint")
    r = runs_frame(spark, sf).select("data_name", "method", "num_train", "random_state", "task")
    return R.eligible(r, methods).select("data_name", "method", "num_train", "random_state")


SQL_N6 = f"""WITH runs AS ({RUNS_SQL}),
m AS (SELECT * FROM (VALUES ('m0', NULL, NULL), ('m1', 'regression', NULL), ('m2', NULL, 32), ('m3', 'classification', 64))
      t(method, only_task, max_train))
SELECT data_name, method, num_train, random_state FROM runs JOIN m USING (method)
WHERE (only_task IS NULL OR only_task = task) AND (max_train IS NULL OR num_train <= max_train)"""


# ------------------------------------------------------------------ A9 / C17 / C18
def a9_catalog_tags(spark, sf):
    e = table(spark, sf, "events")
    ds = (F.when(F.col("event_type") == "click", "mstraffic").when(F.col("event_type") == "view", "ncbuilding")
          .when(F.col("event_type") == "purchase", "dsmusic").when(F.col("event_type") == "signup", "agbooks")
          .otherwise("nnstocks"))
    k = e.select("event_id", ds.alias("dataset"), (F.col("user_id") % 5).cast("int").alias("table_idx"))
    return R.dataset_tags(k, "dataset", "table_idx")


_TAG_ROWS = """('mstraffic', 0, 'mstraffic_maryland'), ('mstraffic', 1, 'mstraffic_seattle'), ('mstraffic', 2, 'mstraffic_da'), ('mstraffic', 3, 'mstraffic_fa'),
  ('ncbuilding', 0, 'ncbuilding_newyork'), ('ncbuilding', 1, 'ncbuilding_chicago'), ('ncbuilding', 2, 'ncbuilding_da'), ('ncbuilding', 3, 'ncbuilding_fa'),
  ('dsmusic', 0, 'dsmusic_discogs'), ('dsmusic', 1, 'dsmusic_spotify'), ('dsmusic', 2, 'dsmusic_da'), ('dsmusic', 3, 'dsmusic_fa'),
  ('agbooks', 0, 'agbooks_amazon'), ('agbooks', 1, 'agbooks_goodreads'), ('agbooks', 2, 'agbooks_da'), ('agbooks', 3, 'agbooks_fa'),
  ('nnstocks', 0, 'nnstocks_nnlist'), ('nnstocks', 1, 'nnstocks_nnwiki'), ('nnstocks', 2, 'nnstocks_da'), ('nnstocks', 3, 'nnstocks_fa')"""
SQL_A9 = f"""WITH k AS (SELECT event_id, CASE event_type WHEN 'click' THEN 'mstraffic' WHEN 'view' THEN 'ncbuilding'
  WHEN 'purchase' THEN 'dsmusic' WHEN 'signup' THEN 'agbooks' ELSE 'nnstocks' END AS dataset,
  CAST(user_id % 5 AS INTEGER) AS table_idx FROM events),
cat AS (SELECT * FROM (VALUES {_TAG_ROWS}) t(dataset, table_idx, tag))
SELECT k.event_id, k.dataset, k.table_idx, coalesce(cat.tag, k.dataset || '_table' || CAST(k.table_idx AS VARCHAR)) AS tag
FROM k LEFT JOIN cat ON cat.dataset = k.dataset AND cat.table_idx = k.table_idx"""


def c17_skip_completed(spark, sf):
    keys = ["data_name", "method", "num_train", "random_state"]
    d = table(spark, sf, "documents")
    todo = d.select(F.col("lang").alias("data_name"), F.concat(F.lit("m"), (F.col("n_chars") % 4).cast("string")).alias("method"),
                    (32 * (1 + F.col("doc_id") % 2)).alias("num_train"), (F.col("doc_id") % 3).alias("random_state")).distinct()
    from ..operators.augment import skip_completed
    return skip_completed(todo, runs_frame(spark, sf), keys)


SQL_C17 = f"""WITH runs AS ({RUNS_SQL}),
todo AS (SELECT DISTINCT lang AS data_name, 'm' || CAST(n_chars % 4 AS VARCHAR) AS method, 32 * (1 + doc_id % 2) AS num_train,
                doc_id % 3 AS random_state FROM documents)
SELECT * FROM todo t WHERE NOT EXISTS (SELECT 1 FROM runs r WHERE r.data_name = t.data_name AND r.method = t.method
  AND r.num_train = t.num_train AND r.random_state = t.random_state)"""


def c18_best_params(spark, sf):
    r = runs_frame(spark, sf)
    params = r.filter("val_acc IS NOT NULL").select(
        "data_name", "method", "num_train", "random_state",
        F.concat(F.lit("depth="), (F.col("random_state") + 2).cast("string"), F.lit(";val="),
                 F.round("val_acc", 3).cast("string")).alias("params"))
    from ..operators.augment import best_params
    return best_params(params, r.select("data_name", "method", "num_train", "random_state"))


SQL_C18 = f"""WITH runs AS ({RUNS_SQL})
SELECT r.data_name, r.method, r.num_train, r.random_state,
  CASE WHEN r.val_acc IS NOT NULL THEN 'depth=' || CAST(r.random_state + 2 AS VARCHAR) || ';val=' || CAST(round(r.val_acc, 3) AS VARCHAR) END AS params
FROM runs r"""


QUERIES = {
    "d15_run_statistics": (d15_run_statistics, SQL_D15),
    "d16_dynamic_summary": (d16_dynamic_summary, SQL_D16),
    "d19_floor_scores": (d19_floor_scores, SQL_D19),
    "d18_minmax_normalise": (d18_minmax_normalise, SQL_D18),
    "p10_results_compile": (p10_results_compile, SQL_P10),
    "e12_model_ranking_at_64": (e12_model_ranking_at_64, SQL_E12),
    "e9_grid_shards": (e9_grid_shards, SQL_E9),
    "e10_best_config": (e10_best_config, SQL_E10),
    "e11_rank_min": (e11_rank_min, SQL_E11),
    "e14_best_run": (e14_best_run, SQL_E14),
    "i21_case_ids": (i21_case_ids, SQL_I21),
    "i22_display_names": (i22_display_names, SQL_I22),
    "n6_eligible_methods": (n6_eligible_methods, SQL_N6),
    "a9_catalog_tags": (a9_catalog_tags, SQL_A9),
    "c17_skip_completed": (c17_skip_completed, SQL_C17),
    "c18_best_params": (c18_best_params, SQL_C18),
}
