"""Classification / regression metrics as aggregates.

Inputs are long prediction frames: ``y, pred`` for labels, ``y, score`` for
binary scores, ``row, class, score`` for per-class scores. Every metric is a
grouped aggregate (map-side partial), and score-ordered metrics (AUC, AP)
use one row per distinct score plus skew-safe running sums — never a
single-task global window over all predictions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..core import positions, running_sums, seeded_uint


def accuracy(df: DataFrame, y: str = "y", pred: str = "pred", by: list[str] = ()) -> DataFrame:
    """D6."""
    return df.groupBy(*by).agg(F.avg((F.col(y) == F.col(pred)).cast("double")).alias("accuracy"))


def confusion(df: DataFrame, y: str = "y", pred: str = "pred", by: list[str] = ()) -> DataFrame:
    return df.groupBy(*by, F.col(y).alias("y"), F.col(pred).alias("pred")).agg(F.count(F.lit(1)).alias("n"))


def per_class(df: DataFrame, y: str = "y", pred: str = "pred", by: list[str] = ()) -> DataFrame:
    """tp, fp, fn, support, precision, recall, f1 for every label seen in y or pred
    (zero division -> 0)."""
    c = confusion(df, y, pred, by)
    t = c.groupBy(*by, F.col("y").alias("label")).agg(
        F.sum("n").alias("support"), F.sum(F.when(F.col("y") == F.col("pred"), F.col("n")).otherwise(0)).alias("tp"))
    p = c.groupBy(*by, F.col("pred").alias("label")).agg(F.sum("n").alias("predicted"))
    j = t.join(p, [*by, "label"], "full").na.fill(0, ["support", "tp", "predicted"])
    j = j.withColumns({
        "precision": F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("predicted")), F.lit(0.0)),
        "recall": F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("support")), F.lit(0.0)),
    })
    return j.withColumn("f1", F.coalesce(F.try_divide(2.0 * F.col("tp"), F.col("support") + F.col("predicted")),
                                         F.lit(0.0)))


def macro_f1(df: DataFrame, y: str = "y", pred: str = "pred", by: list[str] = ()) -> DataFrame:
    """Mean F1 over the union of true and predicted labels."""
    return per_class(df, y, pred, by).groupBy(*by).agg(F.avg("f1").alias("macro_f1"))


def weighted_prf(df: DataFrame, y: str = "y", pred: str = "pred", by: list[str] = ()) -> DataFrame:
    """Support-weighted precision, recall, F1."""
    pc = per_class(df, y, pred, by)
    tot = F.sum("support")
    return pc.groupBy(*by).agg(*[(F.sum(F.col(m) * F.col("support")) / tot).alias(f"weighted_{m}")
                                 for m in ("precision", "recall", "f1")])


def classification_report(df: DataFrame, y: str = "y", pred: str = "pred") -> DataFrame:
    """Per-class rows plus ``macro avg`` and ``weighted avg`` rows."""
    pc = per_class(df, y, pred).select(F.col("label").cast("string").alias("label"), "precision", "recall", "f1",
                                       "support")
    macro = pc.agg(F.lit("macro avg").alias("label"), *[F.avg(m).alias(m) for m in ("precision", "recall", "f1")],
                   F.sum("support").alias("support"))
    weighted = pc.agg(F.lit("weighted avg").alias("label"),
                      *[(F.sum(F.col(m) * F.col("support")) / F.sum("support")).alias(m)
                        for m in ("precision", "recall", "f1")], F.sum("support").alias("support"))
    return pc.unionByName(macro).unionByName(weighted)


def _score_table(df: DataFrame, y: str, score: str, by: list[str]) -> DataFrame:
    return df.groupBy(*by, F.col(score).alias("s")).agg(
        F.sum(F.col(y).cast("long")).alias("pos"), F.sum(1 - F.col(y).cast("long")).alias("neg"))


def roc_auc(df: DataFrame, y: str = "y", score: str = "score", by: list[str] = ()) -> DataFrame:
    """Binary ROC-AUC with tied scores counted half (mid-rank formula).
    A group with only one class gives NULL."""
    return _auc_from_table(_score_table(df, y, score, by), list(by))


def ovr_auc(scores: DataFrame, labels: DataFrame, row: str = "row", cls: str = "class", score: str = "score",
            y: str = "y") -> DataFrame:
    """One-vs-rest AUC per class, then the macro mean.

    ``scores`` may be sparse: a (row, class) pair without a score counts as
    score 0. The zero-score rows are counted per class from label totals, so
    no rows x classes grid is ever built. A class that is all-positive or
    all-negative has a NULL AUC and is skipped by the mean."""
    lab = labels.select(row, F.col(y).alias("_y"))
    n = lab.count()
    s = scores.join(lab, row).withColumn("_is", (F.col(cls) == F.col("_y")).cast("long"))
    present = s.groupBy(cls, F.col(score).alias("s")).agg(
        F.sum("_is").alias("pos"), F.sum(1 - F.col("_is")).alias("neg"))
    seen = present.groupBy(cls).agg(F.sum("pos").alias("_pp"), F.sum("neg").alias("_pn"))
    classes = scores.select(cls).union(lab.select(F.col("_y").alias(cls))).distinct()
    totals = lab.groupBy(F.col("_y").alias(cls)).agg(F.count(F.lit(1)).alias("_P"))
    zero = (classes.join(totals, cls, "left").join(seen, cls, "left").na.fill(0, ["_P", "_pp", "_pn"])
            .select(cls, F.lit(0.0).alias("s"), (F.col("_P") - F.col("_pp")).alias("pos"),
                    (F.lit(n) - F.col("_P") - F.col("_pn")).alias("neg")))
    table = present.unionByName(zero).groupBy(cls, "s").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    per = _auc_from_table(table, [cls])
    return per.agg(F.avg("auc").alias("macro_auc"), F.count("auc").alias("n_classes"))


def _auc_from_table(st: DataFrame, by: list[str]) -> DataFrame:
    st = running_sums(st, list(by), ["s"], ["neg"])
    part = st.withColumn("_c", F.col("pos") * (F.col("cum_neg") - F.col("neg") + 0.5 * F.col("neg")))
    agg = part.groupBy(*by).agg(F.sum("_c").alias("_c"), F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    return agg.select(*by, F.try_divide(F.col("_c"), F.col("_p") * F.col("_n")).alias("auc"))


def average_precision(df: DataFrame, y: str = "y", score: str = "score", by: list[str] = ()) -> DataFrame:
    """Sum over distinct thresholds (descending) of delta-recall x precision."""
    st = _score_table(df, y, score, by).withColumn("_ns", -F.col("s"))
    st = running_sums(st, list(by), ["_ns"], ["pos", "neg"])
    part = st.withColumn("_c", F.col("pos") * F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg")))
    agg = part.groupBy(*by).agg(F.sum("_c").alias("_c"), F.sum("pos").alias("_p"))
    return agg.select(*by, F.try_divide(F.col("_c"), F.col("_p")).alias("average_precision"))


def regression_metrics(df: DataFrame, y: str = "y", pred: str = "pred", by: list[str] = ()) -> DataFrame:
    """MSE, RMSE, R^2 = 1 - SSE/SST (one pass; SST from the population variance,
    which Spark merges without cancellation)."""
    e = F.col(y) - F.col(pred)
    g = df.groupBy(*by).agg(F.avg(e * e).alias("mse"), F.sum(e * e).alias("_sse"), (F.var_pop(y) * F.count(y)).alias("_sst"))
    sst = F.col("_sst")
    return g.select(*by, "mse", F.sqrt("mse").alias("rmse"), (1 - F.try_divide(F.col("_sse"), sst)).alias("r2"))


def generalisation_gap(df: DataFrame, y: str = "y", pred: str = "pred", split: str = "split") -> DataFrame:
    """Train accuracy - test accuracy."""
    ok = (F.col(y) == F.col(pred)).cast("double")
    g = df.agg(F.avg(F.when(F.col(split) == "train", ok)).alias("train_acc"),
               F.avg(F.when(F.col(split) == "test", ok)).alias("test_acc"))
    return g.withColumn("gap", F.col("train_acc") - F.col("test_acc"))


def bootstrap_ci(df: DataFrame, ids: list[str], metric: str = "acc", y: str = "y", pred: str = "pred", n_boot: int = 10,
                 seed: int = 123, alpha: float = 0.95) -> DataFrame:
    """``n_boot`` resamples of n rows with replacement (slot of draw j in
    resample b = md5 of ``seed|b|j`` mod n), the metric of each resample, percentiles
    (1-alpha)/2 and 1-(1-alpha)/2 clamped to [0, 1]; midpoint and half width.
    ``metric``: ``acc`` (pred is a label), ``auc`` (pred is a score), ``mse``."""
    n = df.count()
    rows = positions(df.select(*ids, F.col(y).alias("y"), F.col(pred).alias("pred")), [], ids, out="_slot")
    rows = rows.withColumn("_slot", F.col("_slot") - 1)
    draws = rows.select(F.col("_slot").alias("_j")).withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(n_boot))))
    draws = draws.withColumn("_slot", F.pmod(seeded_uint(seed, F.col("b"), F.col("_j")), F.lit(n)))
    drawn = draws.join(rows.select("_slot", "y", "pred"), "_slot")
    if metric == "acc":
        per = accuracy(drawn, by=["b"]).withColumnRenamed("accuracy", "value")
    elif metric == "auc":
        per = roc_auc(drawn, "y", "pred", ["b"]).withColumnRenamed("auc", "value")
    elif metric == "mse":
        per = regression_metrics(drawn, by=["b"]).withColumnRenamed("mse", "value")
    else:
        raise ValueError(f"metric is acc, auc or mse, not {metric!r}")
    low, high = (1 - alpha) / 2, alpha + (1 - alpha) / 2
    ci = per.agg(F.greatest(F.lit(0.0), F.percentile("value", low)).alias("lower"),
                 F.least(F.lit(1.0), F.percentile("value", high)).alias("upper"))
    return ci.select("lower", "upper", ((F.col("upper") + F.col("lower")) / 2).alias("mid"),
                     ((F.col("upper") - F.col("lower")) / 2).alias("half_width"))


def bootstrap_accuracy_ci(df: DataFrame, ids: list[str], y: str = "y", pred: str = "pred", n_boot: int = 10,
                          seed: int = 123, alpha: float = 0.95) -> DataFrame:
    """D17 for accuracy."""
    return bootstrap_ci(df, ids, "acc", y, pred, n_boot, seed, alpha)


def argmax_label(scores: DataFrame, row: str = "row", cls: str = "class", score: str = "score") -> DataFrame:
    """Class with the highest score per row; ties -> smaller class."""
    best = scores.groupBy(row).agg(F.max(F.struct(F.col(score), (-F.col(cls)).alias("_neg"))).alias("_b"))
    return best.select(row, (-F.col("_b._neg")).alias("pred"), F.col(f"_b.{score}").alias("score"))


def threshold_label(df: DataFrame, score: str = "score", t: float = 0.5) -> DataFrame:
    """E13 binary: score > t -> 1."""
    return df.withColumn("pred", (F.col(score) > t).cast("int"))


def ensemble(scores: DataFrame, row: str = "row", cls: str = "class", model: str = "model", score: str = "score",
             weight: str = "w", link: str = "softmax") -> DataFrame:
    """Weighted mean of per-model scores per (row, class), then softmax over
    classes (max-shifted) or sigmoid."""
    m = scores.groupBy(row, cls).agg((F.sum(F.col(weight) * F.col(score)) / F.sum(weight)).alias("m"))
    if link == "sigmoid":
        return m.withColumn("prob", 1 / (1 + F.exp(-F.col("m"))))
    mx = m.groupBy(row).agg(F.max("m").alias("_mx"))
    e = m.join(mx, row).withColumn("_e", F.exp(F.col("m") - F.col("_mx")))
    z = e.groupBy(row).agg(F.sum("_e").alias("_z"))
    return e.join(z, row).select(row, cls, "m", (F.col("_e") / F.col("_z")).alias("prob"))


def domain_weights(losses: DataFrame, source: str = "source", loss: str = "loss") -> DataFrame:
    """Softmax over sources of -(mean loss of the source) / population std
    of all losses (per-source mean; the std of zero is replaced by 1)."""
    g = losses.groupBy(source).agg(F.avg(loss).alias("mean_loss"))
    sd = losses.agg(F.stddev_pop(loss).alias("sd")).first()["sd"] or 1.0
    g = g.withColumn("_x", -F.col("mean_loss") / F.lit(sd if sd > 0 else 1.0))
    mx = g.agg(F.max("_x")).first()[0]
    g = g.withColumn("_e", F.exp(F.col("_x") - F.lit(mx)))
    z = g.agg(F.sum("_e")).first()[0]
    return g.select(source, "mean_loss", (F.col("_e") / F.lit(z)).alias("weight"))


def fill_predictions(preds: DataFrame, train: DataFrame, pred: str = "pred", y: str = "y") -> DataFrame:
    """NULL or NaN predictions replaced by the training-target mean (a scalar)."""
    mean = train.agg(F.avg(y)).first()[0]
    p = F.col(pred)
    return preds.withColumn(pred, F.when(p.isNull() | F.isnan(p), F.lit(mean)).otherwise(p))
