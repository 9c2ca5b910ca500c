"""Many models in one pass over the data.

Models that differ in a penalty or in the weights of their rows (bags) read the same rows. Here all of them share each pass: a task
multiplies its rows once with the weights of all models side by side and returns the sums of their losses and
gradients, which are added up in two steps. The driver sees numbers per model, never rows.

* ``ridge_path``: linear models of every penalty from one aggregate of moments, closed form;
* ``logistic_stack``: multinomial logistic models by L-BFGS; the step lengths of a line search are further models
  of the same pass. After each pass the weights with the least loss on the validation rows are kept, and a model stops when
  that has not improved for ``patience`` passes, or when its gradient vanishes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..core import spread
from ..session import ensure_checkpoint_dir

STEPS = (1.0, 0.5, 0.25, 0.06, 0.004)  # lengths of a step that one pass tries
MEMORY = 10  # pairs of changes that L-BFGS keeps


# ------------------------------------------------------------------ linear models
def ridge_path(df: DataFrame, features: list[str], target: str, penalties: list[float], split: str = "split") -> DataFrame:
    """N1 for regression: ``penalty, intercept, coefficients, train_rmse, val_rmse, test_rmse, chosen`` of linear models that minimise
    half the mean squared error plus ``penalty`` / 2 times the squared coefficients, fitted on the training rows.
    ``chosen`` marks the least error on the validation rows (ties: the smaller penalty). Rows with a null take no part.

    One aggregate gives the moments of every split; the errors follow from them, so no row is read again."""
    cols = [*features, target]
    full = df.select(split, *[F.col(f"`{c}`").cast("double").alias(f"_{i}") for i, c in enumerate(cols)]).dropna()
    names = [f"_{i}" for i in range(len(cols))]
    centre = full.filter(F.col(split) == "train").agg(*[F.avg(c).alias(c) for c in names]).first()
    if centre[0] is None:
        raise ValueError("no training rows")
    mean = np.array([centre[c] for c in names])
    z = {c: F.col(c) - F.lit(float(m)) for c, m in zip(names, mean)}  # sums about the means lose no digits
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    rows = full.groupBy(split).agg(F.count(F.lit(1)).alias("n"), *[F.sum(z[c]).alias(f"s{c}") for c in names],
                                   *[F.sum(z[a] * z[b]).alias(f"q{a}{b}") for a, b in pairs]).collect()  # one row a split
    d = len(features)
    moments = {}
    for r in rows:
        second = np.zeros((d + 1, d + 1))
        for a, b in pairs:
            i, j = names.index(a), names.index(b)
            second[i, j] = second[j, i] = r[f"q{a}{b}"]
        moments[r[split]] = (r["n"], np.array([r[f"s{c}"] for c in names]), second)
    n, first, second = moments["train"]
    cov = second / n - np.outer(first / n, first / n)
    out = []
    for penalty in penalties:
        coef = np.linalg.lstsq(cov[:d, :d] + penalty * np.eye(d), cov[:d, d], rcond=None)[0]
        direction = np.append(-coef, 1.0)  # residual = direction . z, about the training means
        errors = []
        for s in ("train", "val", "test"):
            m, _, sq = moments.get(s, (0, None, None))
            errors.append(float(np.sqrt(max(direction @ sq @ direction / m, 0.0))) if m else None)
        out.append([float(penalty), float(mean[d] - coef @ mean[:d]), [float(c) for c in coef], *errors, False])
    judged = [r for r in out if r[4] is not None] or out
    min(judged, key=lambda r: (r[4] if r[4] is not None else 0.0, r[0]))[6] = True
    return df.sparkSession.createDataFrame([tuple(r) for r in out], "penalty double, intercept double, coefficients array<double>, "
                                           "train_rmse double, val_rmse double, test_rmse double, chosen boolean")


# ------------------------------------------------------------------ logistic models
@dataclass
class Stack:
    """Fitted models: ``weights`` is (models, features + 1, classes), the last row of each the intercepts, on the features' own scale."""

    features: list[str]
    classes: list
    weights: np.ndarray
    val_loss: list
    passes: int
    gradient: list = field(default_factory=list)  # largest entry at the end, on standardised features

    def probabilities(self, df: DataFrame, mean_over_models: bool = False, models: list[int] | None = None) -> DataFrame:
        """``df`` with ``probabilities``: per model a list of class probabilities, or their mean over the models."""
        picked = self.weights if models is None else self.weights[models]
        sent = df.sparkSession.sparkContext.broadcast(picked)
        whole = df.withColumn("_x", F.array(*[F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)) for c in self.features]))
        kind = "array<double>" if mean_over_models else "array<array<double>>"

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = _matrix(batch.column(batch.num_columns - 1))
                p = _softmax(x, sent.value)
                p = p.mean(1) if mean_over_models else p
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(p.tolist())], names=[*batch.schema.names[:-1], "probabilities"])

        columns = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.schema.fields)
        return whole.mapInArrow(run, f"{columns}probabilities {kind}")


def _matrix(column: pa.Array) -> np.ndarray:
    """A list column of equal lengths, with a last column of ones."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    x = flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))
    return np.concatenate([x, np.ones((len(x), 1))], axis=1)


def _softmax(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """(rows, models, classes)"""
    m, d, k = weights.shape
    z = (x @ weights.transpose(1, 0, 2).reshape(d, m * k)).reshape(len(x), m, k)
    z -= z.max(axis=2, keepdims=True)
    np.exp(z, out=z)
    return z / z.sum(axis=2, keepdims=True)


def logistic_stack(df: DataFrame, features: list[str], label: str, penalties: list[float], split: str = "split",
                   row_weights: str | None = None, most_passes: int = 100, patience: int = 20, tolerance: float = 1e-9) -> Stack:
    """One multinomial logistic model for each penalty, all in the same passes.

    Model i minimises the mean log-loss of its training rows plus ``penalties[i]`` / 2 times the squared weights of the
    standardised features (intercepts are free). ``row_weights`` names an array column with the weight of a row in each model
    (bags); without it every training row weighs 1. Where there are validation rows each model ends with the weights that lose least
    on them (equal ones: the later), else with the last."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    x = [F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)) for c in features]
    train = F.col(split) == "train"
    stats = df.filter(train).agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(x)], *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(x)],
                                 F.collect_set(label).alias("classes")).first()
    classes = sorted(stats["classes"] or [])
    if not classes:
        raise ValueError("no training rows")
    mean = np.array([stats[f"m{i}"] for i in range(len(x))])
    scale = np.array([stats[f"s{i}"] or 1.0 for i in range(len(x))])
    models, d, k = len(penalties), len(x), len(classes)
    code = F.coalesce(F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(label)) - 1, F.lit(-1)).cast("int")
    part = F.when(train, 0).when(F.col(split) == "val", 1)
    scaled = F.array(*[(c - F.lit(float(m))) / F.lit(float(s)) for c, m, s in zip(x, mean, scale)])
    weights = F.col(row_weights).cast("array<double>") if row_weights else F.array_repeat(F.lit(1.0), models)
    rows = spread(df.select(scaled.alias("x"), code.alias("y"), part.alias("part"), weights.alias("w"))
                  .filter("part is not null and y >= 0")).checkpoint(eager=True)

    def sums(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Loss, gradient and validation loss of weights (lengths, models, d + 1, k)."""
        sent = spark.sparkContext.broadcast(points)
        size = points[..., 0, 0].size

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at = sent.value.reshape(-1, d + 1, k)
            lengths = len(at) // models
            total = np.zeros((size, 4 + (d + 1) * k))  # loss, weight, validation loss, validation rows, gradient
            for batch in batches:
                for lo in range(0, batch.num_rows, 4096):
                    some = batch.slice(lo, 4096)
                    z, y, side = _matrix(some.column(0)), some.column(1).to_numpy(), some.column(2).to_numpy()
                    w = np.tile(_matrix(some.column(3))[:, :-1], lengths)
                    p = _softmax(z, at)
                    loss = -np.log(np.maximum(p[np.arange(len(y)), :, y], 1e-300))
                    w = np.where((side == 0)[:, None], w, 0.0)
                    total[:, 0] += (loss * w).sum(0)
                    total[:, 1] += w.sum(0)
                    total[:, 2] += loss[side == 1].sum(0)
                    total[:, 3] += (side == 1).sum()
                    p[np.arange(len(y)), :, y] -= 1
                    p *= w[:, :, None]
                    total[:, 4:] += np.einsum("rd,rmk->mdk", z, p).reshape(size, -1)
            yield pa.RecordBatch.from_arrays([pa.array([total.ravel()], pa.list_(pa.float64()))], names=["s"])

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            parts = [b.column(0).flatten().to_numpy().reshape(b.num_rows, -1).sum(0) for b in batches if b.num_rows]
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array([np.sum(parts, axis=0)], pa.list_(pa.float64()))], names=["s"])

        each = rows.mapInArrow(run, "s array<double>")
        few = max(1, int(rows.rdd.getNumPartitions() ** 0.5))
        got = each.repartition(few).mapInArrow(add, "s array<double>").collect()
        total = np.sum([np.array(r["s"]) for r in got], axis=0).reshape(*points.shape[:2], -1)
        n = np.maximum(total[..., 1], 1e-300)
        penalty = np.array(penalties)
        inner = points[..., :d, :]
        loss = total[..., 0] / n + penalty / 2 * (inner ** 2).sum((-1, -2))
        gradient = total[..., 4:].reshape(points.shape) / n[..., None, None]
        gradient[..., :d, :] += penalty[:, None, None] * inner
        val = np.where(total[..., 3] > 0, total[..., 2] / np.maximum(total[..., 3], 1), np.nan)
        return loss, gradient, val

    at = np.zeros((models, d + 1, k))
    loss, gradient, val = (s[0] for s in sums(at[None]))
    best, best_val, waited = at.copy(), val.copy(), np.zeros(models, int)
    memory: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(models)]
    live = np.ones(models, bool)
    passes = 1
    while passes < most_passes and live.any():
        direction = np.stack([_downhill(g, m) if on else np.zeros_like(g) for g, m, on in zip(gradient, memory, live)])
        tried = at + np.array(STEPS)[:, None, None, None] * direction
        losses, gradients, vals = sums(tried)
        passes += 1
        for i in np.flatnonzero(live):
            slope = float((gradient[i] * direction[i]).sum())
            ok = [s for s in range(len(STEPS)) if losses[s, i] <= loss[i] + 1e-4 * STEPS[s] * slope]
            if not ok:
                if not memory[i]:
                    live[i] = False  # no step goes down any more
                memory[i] = []  # once more along the gradient
                continue
            s = min(ok, key=lambda s: losses[s, i])
            change, bend = tried[s, i] - at[i], gradients[s, i] - gradient[i]
            if (change * bend).sum() > 1e-12:
                memory[i] = [*memory[i], (change, bend)][-MEMORY:]
            at[i], loss[i], gradient[i], val[i] = tried[s, i], losses[s, i], gradients[s, i], vals[s, i]
            if np.isnan(val[i]) or val[i] <= best_val[i] or np.isnan(best_val[i]):
                best[i], best_val[i], waited[i] = at[i], val[i], 0
            else:
                waited[i] += 1
            live[i] = np.abs(gradient[i]).max() > tolerance and waited[i] < patience
    plain = best.copy()
    plain[:, :d, :] = best[:, :d, :] / scale[None, :, None]
    plain[:, d, :] = best[:, d, :] - np.einsum("d,mdk->mk", mean, plain[:, :d, :])
    return Stack(features, classes, plain, [None if np.isnan(v) else float(v) for v in best_val], passes,
                 [float(np.abs(g).max()) for g in gradient])


def _downhill(gradient: np.ndarray, memory: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The L-BFGS direction."""
    g, shares = gradient.copy(), []
    for change, bend in reversed(memory):
        rho = 1 / (change * bend).sum()
        a = rho * (change * g).sum()
        g -= a * bend
        shares.append((a, rho))
    if memory:
        change, bend = memory[-1]
        g *= (change * bend).sum() / (bend * bend).sum()
    for (change, bend), (a, rho) in zip(memory, reversed(shares)):
        g += change * (a - rho * (bend * g).sum())
    return -g


def stack_metrics(stack: Stack, df: DataFrame, label: str, split: str = "split") -> DataFrame:
    """``model, split, n, accuracy, log_loss``: all models judged in one pass."""
    classes = F.array(*[F.lit(c) for c in stack.classes])
    scored = stack.probabilities(df.select(label, split, *[c for c in stack.features if c not in (label, split)]))
    each = scored.select(F.col(label).alias("_y"), F.col(split).alias("split"), F.posexplode("probabilities").alias("model", "p"))
    top = F.array_position("p", F.array_max("p"))
    mine = F.get("p", (F.array_position(classes, F.col("_y")) - 1).cast("int"))
    right = (F.get(classes, (top - 1).cast("int")) == F.col("_y")).cast("double")
    return each.groupBy("model", "split").agg(F.count(F.lit(1)).alias("n"), F.avg(F.coalesce(right, F.lit(0.0))).alias("accuracy"),
                                              F.avg(-F.log(F.greatest(mine, F.lit(1e-300)))).alias("log_loss"))
