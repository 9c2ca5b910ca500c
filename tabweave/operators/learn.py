"""Learning baselines on Spark ML.

Each fit is data-parallel; the grid and repeat loops
run on the driver over a handful of configurations (the loop handles
parameters, never rows). The run log is a table appended per config. Linear and logistic models that
differ in a penalty or in their rows share every pass over the data (``stacked``).
"""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import (GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier,
                                       OneVsRest, RandomForestClassifier)
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..core import spread
from . import metrics as Q
from .cuts import keys_at
from .runs import best_by
from .stacked import logistic_stack


def make_estimator(kind: str, params: dict, seed: int):
    if kind == "rf":
        return RandomForestClassifier(seed=seed, **params)
    if kind == "lr":
        return LogisticRegression(**params)
    if kind == "gbt":
        return OneVsRest(classifier=GBTClassifier(seed=seed, **params))
    if kind == "mlp":
        return MultilayerPerceptronClassifier(seed=seed, **params)
    if kind == "ridge":
        return LinearRegression(elasticNetParam=0.0, **params)
    raise ValueError(f"unknown estimator {kind!r}")


REGRESSORS = ("ridge",)


def predictions(df: DataFrame, features: list[str], label: str, kind: str, params: dict | None = None, seed: int = 0,
                split: str = "split", task: str | None = None) -> tuple[DataFrame, object]:
    """Fit on ``split == 'train'`` and predict every row: ``split, y, pred`` and, of
    classifiers that give one, ``probability`` (array). Regression keeps the numeric target."""
    task = task or ("regression" if kind in REGRESSORS else "classification")
    df = spread(df)
    stages = [VectorAssembler(inputCols=features, outputCol="_x", handleInvalid="keep")]
    if task == "regression":
        df = df.withColumn("_y", F.col(label).cast("double"))
    else:
        stages.insert(0, StringIndexer(inputCol=label, outputCol="_y", handleInvalid="keep", stringOrderType="alphabetAsc"))
    est = make_estimator(kind, params or {}, seed).setFeaturesCol("_x").setLabelCol("_y")
    model = Pipeline(stages=[*stages, est]).fit(df.filter(F.col(split) == "train"))
    made = model.transform(df)
    extra = [vector_to_array("probability").alias("probability")] if "probability" in made.columns else []
    return made.select(F.col(split).alias("split"), F.col("_y").alias("y"), F.col("prediction").alias("pred"), *extra), model


def evaluate(pred: DataFrame, task: str) -> DataFrame:
    """Metrics per split. Regression: D13. Classification: accuracy, macro F1,
    weighted precision / recall / F1, and one-vs-rest AUC (NULL without probabilities)."""
    if task == "regression":
        return Q.regression_metrics(pred, by=["split"])
    out = Q.accuracy(pred, by=["split"]).join(Q.macro_f1(pred, by=["split"]), "split").join(
        Q.weighted_prf(pred, by=["split"]), "split")
    if "probability" not in pred.columns:
        return out.withColumn("auc", F.lit(None).cast("double"))
    one = pred.select("split", "y", F.posexplode("probability").alias("class", "score"))
    per = Q.roc_auc(one.withColumn("y", (F.col("y") == F.col("class")).cast("int")), by=["split", "class"])
    return out.join(per.groupBy("split").agg(F.avg("auc").alias("auc")), "split", "left")


def fit_eval(df: DataFrame, features: list[str], label: str, kind: str = "rf", params: dict | None = None,
             seed: int = 0, split: str = "split", task: str | None = None) -> tuple[DataFrame, object]:
    """Fit on the training rows and evaluate every split by task. Returns a metrics
    frame with one row per split, and the fitted model."""
    task = task or ("regression" if kind in REGRESSORS else "classification")
    pred, model = predictions(df, features, label, kind, params, seed, split, task)
    pred = pred.checkpoint(eager=True)  # each metric reads it
    return evaluate(pred, task), model


def fit_choose(df: DataFrame, features: list[str], label: str, kind: str, candidates: list[dict], seed: int = 0,
               split: str = "split", task: str | None = None) -> tuple[DataFrame, object, dict]:
    """N1 with its choice on validation: every candidate is fitted on the training rows, the one that does best on the validation
    rows (accuracy, then macro F1; regression: RMSE; ties: the first) is returned with its metrics on all splits, its model
    and its parameters."""
    task = task or ("regression" if kind in REGRESSORS else "classification")
    best = None
    for nth, params in enumerate(candidates):
        m, model = fit_eval(df, features, label, kind, params, seed, split, task)
        rows = {r["split"]: r for r in m.collect()}  # one row a split
        val = rows.get("val") or rows["train"]
        rank = (-val["rmse"], 0.0) if task == "regression" else (val["accuracy"], val["macro_f1"])
        if best is None or rank > best[0]:
            best = rank, m, model, params
    return best[1], best[2], best[3]


def grid_search(df: DataFrame, features: list[str], label: str, kind: str, grid: DataFrame,
                log: DataFrame | None = None, seed: int = 0, log_path: str | None = None) -> DataFrame:
    """One N1 fit per config of ``grid`` (``config_idx`` + parameter columns),
    skipping configs already logged (C17); returns the full log with one row per
    config: ``config_idx, <params>, val_acc, val_f1, test_acc, test_f1``.

    With ``log_path`` (a shared folder) each finished config is appended there as
    Parquet at once, and what is there already is not run again: a search that was
    cut off goes on where it stopped."""
    spark = df.sparkSession
    pcols = [c for c in grid.columns if c != "config_idx"]
    types = dict(grid.dtypes)
    schema = ", ".join(["config_idx bigint"] + [f"`{c}` {types[c]}" for c in pcols] +
                       ["val_acc double", "test_acc double", "val_f1 double", "test_f1 double"])
    if log_path:
        spark.createDataFrame([], schema).write.mode("append").parquet(log_path)  # so that there is one to read
        done = spark.read.schema(schema).parquet(log_path)
        log = done if log is None else log.unionByName(done).dropDuplicates(["config_idx"])
    todo = grid if log is None else grid.join(log.select("config_idx"), "config_idx", "left_anti")
    rows = []
    for r in todo.orderBy("config_idx").collect():  # configs are few; rows never leave Spark
        m, _ = fit_eval(df, features, label, kind, {c: r[c] for c in pcols}, seed)
        got = {x["split"]: x for x in m.collect()}
        rows.append((r["config_idx"], *[r[c] for c in pcols],
                     *[float(got[s]["accuracy"]) if s in got else None for s in ("val", "test")],
                     *[float(got[s]["macro_f1"]) if s in got else None for s in ("val", "test")]))
        if log_path:
            spark.createDataFrame(rows[-1:], schema).write.mode("append").parquet(log_path)
    if log_path:
        return spark.read.schema(schema).parquet(log_path)
    new = spark.createDataFrame(rows, schema)
    return new if log is None else log.unionByName(new)


def best_config(log: DataFrame) -> DataFrame:
    """E10 on a grid log: max (val_acc, val_f1), first config wins ties."""
    return best_by(log.withColumn("_all", F.lit(1)), ["_all"], desc=["val_acc", "val_f1"], asc=["config_idx"]).drop("_all")


def repeated_runs(df: DataFrame, features: list[str], label: str, kind: str, params: dict,
                  seeds: list[int]) -> DataFrame:
    """One fit per seed; returns the run log ``seed, split, accuracy, macro_f1``."""
    out = None
    for s in seeds:
        m, _ = fit_eval(df, features, label, kind, params, seed=s)
        m = m.withColumn("seed", F.lit(s))
        out = m if out is None else out.unionByName(m)
    return out


def bagging(df: DataFrame, ids: list[str], features: list[str], label: str, kind: str = "lr",
            params: dict | None = None, n_models: int = 15, fraction: float = 0.8, seed: int = 0) -> DataFrame:
    """``n_models`` fits, each on an exact seeded ``fraction`` of the training
    rows; class probabilities averaged per row (D20 with equal weights; ties go to
    the smaller class). Returns ``ids..., split, y, pred``.

    A draw is the rows up to the key at its cut (``cuts.keys_at``): the keys are counted, not sorted, and each row tells by
    its own keys which draws it is in. Logistic models share every pass (``stacked.logistic_stack``; ``regParam`` is
    their penalty, ``maxIter`` their passes). Others are fitted one by one on 0/1 weight columns of one training frame
    (a zero weight takes a row out of the loss) and chained on one frame: each row is read once and its probabilities are
    averaged in place."""
    params = params or {}
    train = df.filter(F.col("split") == "train")
    keep = int(train.count() * fraction)
    digest = lambda b: F.md5(F.concat_ws("|", (b + F.lit(seed)).cast("string"), *[F.col(i).cast("string") for i in ids]))
    order = lambda b: F.conv(F.substring(digest(b), 1, 15), 16, 10).cast("bigint")
    drawn = train.select(*ids).withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(n_models - 1))))
    ends = {r["_b"]: r["keys"][0] for r in keys_at(drawn.withColumn("_o", order(F.col("_b"))), ["_b"], "_o", lambda m: [F.lit(keep)]).collect()}
    inside = [(order(F.lit(b)) <= F.lit(ends.get(b) if ends.get(b) is not None else -1)).cast("double") for b in range(n_models)]
    if kind == "lr":
        stack = logistic_stack(df.withColumn("_bags", F.array(*inside)), features, label, [params.get("regParam", 0.0)] * n_models,
                               row_weights="_bags", most_passes=params.get("maxIter", 100))
        classes = F.array(*[F.lit(c) for c in stack.classes])
        scored = stack.probabilities(df.select(*ids, "split", label, *[c for c in features if c not in (*ids, "split", label)]), mean_over_models=True)
        at = F.array_position(classes, F.col(label)) - 1
        return scored.select(*ids, "split", F.when(at >= 0, at).otherwise(len(stack.classes)).cast("double").alias("y"),
                             (F.array_position("probabilities", F.array_max("probabilities")) - 1).cast("double").alias("pred"))
    idx = StringIndexer(inputCol=label, outputCol="_y", handleInvalid="keep", stringOrderType="alphabetAsc").fit(train)
    vec = VectorAssembler(inputCols=features, outputCol="_x", handleInvalid="keep")
    base = spread(vec.transform(idx.transform(df))).checkpoint(eager=True)
    fit_rows = base.filter(F.col("split") == "train").withColumns({f"_w{b}": c for b, c in enumerate(inside)}).checkpoint(eager=True)
    scored = base
    for b in range(n_models):
        est = make_estimator(kind, params, seed + b).setFeaturesCol("_x").setLabelCol("_y")
        est = est.setPredictionCol(f"_pred{b}").setProbabilityCol(f"_prob{b}").setRawPredictionCol(f"_raw{b}")
        if est.hasParam("weightCol"):
            model = est.setWeightCol(f"_w{b}").fit(fit_rows)
        else:
            model = est.fit(fit_rows.filter(F.col(f"_w{b}") > 0))
        scored = model.transform(scored).drop(f"_pred{b}", f"_raw{b}")
    each = scored.select(*ids, "split", F.col("_y").alias("y"),
                         *[vector_to_array(f"_prob{b}").alias(f"_p{b}") for b in range(n_models)])
    total = F.col("_p0")
    for b in range(1, n_models):
        total = F.zip_with(total, f"_p{b}", lambda x, y: x + y)
    each = each.withColumn("_sum", total)
    best = (F.array_position("_sum", F.array_max("_sum")) - 1).cast("double")
    return each.select(*ids, "split", "y", best.alias("pred"))


def source_target_fit(target: DataFrame, source: DataFrame, features: list[str], label: str, kind: str = "rf",
                      params: dict | None = None, fraction: float = 1.0, cap: int = 10_000, seed: int = 0,
                      ids: tuple[str, str] = ("id", "id")) -> DataFrame:
    """Train on target-train ∪ a capped stratified source sample (E8,
    strata = domain + label); validate and test on the target only."""
    from .split import capped_stratified_sample
    src = source.withColumn("domain", F.lit(1))
    picked = capped_stratified_sample(src, ids[1], ["domain", label], fraction, cap, seed)
    src = src.join(picked.select(ids[1]), ids[1]).withColumn("split", F.lit("train"))
    both = target.withColumn("domain", F.lit(0)).unionByName(src, allowMissingColumns=True)
    m, _ = fit_eval(both, features, label, kind, params, seed)
    return m
