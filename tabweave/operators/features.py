"""Fit / transform feature operators.

``fit`` returns a small parameter DataFrame (or a one-row aggregate read on
the driver); ``apply`` joins or maps it back. Fit scope is explicit: pass
the training rows (``fit_on='train'`` is the default in the plans).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..core import positions


def q(c: str) -> Column:
    return F.col(f"`{c}`")


# ------------------------------------------------------------------ J1 / J2
def label_encode_fit(df: DataFrame, col: str) -> DataFrame:
    """Sorted distinct non-null values -> 0..n-1 (string order for strings,
    numeric order for numbers). Output ``value, code``."""
    vals = df.select(q(col).alias("value")).filter(F.col("value").isNotNull()).distinct()
    return positions(vals, [], ["value"], out="_p").select("value", (F.col("_p") - 1).cast("int").alias("code"))


def label_encode_apply(df: DataFrame, col: str, params: DataFrame, out: str | None = None,
                       unknown: int | None = None) -> DataFrame:
    """Replace ``col`` by its code (``out`` keeps both); unseen -> ``unknown`` (J2: -1)."""
    p = params.select(F.col("value").alias("_v"), F.col("code").alias("_code"))
    j = df.join(p, q(col) == F.col("_v"), "left").drop("_v")
    code = F.col("_code") if unknown is None else F.coalesce(F.col("_code"), F.lit(unknown))
    return j.withColumn(out or col, code).drop("_code")


def ordinal_encode(train: DataFrame, df: DataFrame, cols: list[str]) -> DataFrame:
    """Per column codes fitted on ``train``; unknown values (and NULL) -> -1."""
    for c in cols:
        df = label_encode_apply(df, c, label_encode_fit(train, c), unknown=-1)
    return df


# ------------------------------------------------------------------ J3
def one_hot_fit(train: DataFrame, col: str) -> list[str]:
    """J3 categories (NULL -> ``'missing'``), sorted. Each becomes a column of
    ``one_hot_apply``; for a column with too many to be columns use ``one_hot_vector``."""
    cats = train.select(F.coalesce(q(col).cast("string"), F.lit("missing")).alias("v")).distinct()
    return sorted(r["v"] for r in cats.collect())


def one_hot_vector(train: DataFrame, df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    """J3 for any number of categories: one sparse vector per row, from the J1 codes
    (which stay a DataFrame); unseen values are all zeros."""
    from pyspark.ml.feature import OneHotEncoder

    named = lambda d: d.withColumn("_cat", F.coalesce(q(col).cast("string"), F.lit("missing")))
    codes = label_encode_fit(named(train), "_cat")
    n = codes.count()
    coded = label_encode_apply(named(df), "_cat", codes, out="_slot", unknown=n).withColumn("_slot", F.col("_slot").cast("double"))
    sizes = df.sparkSession.range(n).select(F.col("id").cast("double").alias("_slot"))
    model = OneHotEncoder(inputCol="_slot", outputCol=out or f"{col}_vec", dropLast=True, handleInvalid="keep").fit(sizes)
    return model.transform(coded).drop("_cat", "_slot")


def one_hot_apply(df: DataFrame, col: str, categories: list[str]) -> DataFrame:
    """One 0/1 column per fitted category; unseen values are all zeros."""
    v = F.coalesce(q(col).cast("string"), F.lit("missing"))
    return df.withColumns({f"{col}_{c}": (v == F.lit(c)).cast("int") for c in categories}).drop(col)


# ------------------------------------------------------------------ J4
def target_encode(df: DataFrame, col: str, target: str, fold: str, is_train: Column, smoothing: float | str = "auto",
                  out: str | None = None) -> DataFrame:
    """Category means of the target, drawn towards the mean of all rows.

    ``smoothing="auto"`` derives the weight of a category's own mean from the data (empirical Bayes): with ``n`` rows,
    variance ``s2`` within it and variance ``t2`` of all rows it is ``n * t2 / (n * t2 + s2)``. A number ``m`` gives ``n / (n + m)``.

    Training rows are cross-fitted: a row of fold f is encoded with statistics
    of the *other* training folds. Other rows use all training rows. Unseen categories get the mean of all rows; a null
    category is one of its own; where the target does not vary the result is its mean."""
    out = out or f"{col}_te"
    tr = df.filter(is_train)
    y = F.col(target).cast("double")
    centre = tr.agg(F.avg(y)).first()[0] or 0.0  # sums about the mean lose no digits
    d = y - F.lit(centre)

    def sums(*by: str, mark: str) -> DataFrame:
        return tr.groupBy(*[q(c).alias(f"_{mark}{i}") for i, c in enumerate(by)]).agg(
            F.count(d).alias(f"_{mark}n"), F.sum(d).alias(f"_{mark}s"), F.sum(d * d).alias(f"_{mark}q"))

    # (Spark names are case-insensitive: keep every helper name distinct)
    cat, part, whole = sums(col, mark="c"), sums(fold, col, mark="k"), sums(fold, mark="f")
    total = tr.agg(F.count(d).alias("n"), F.sum(d).alias("s"), F.sum(d * d).alias("q")).first()
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))

    def encoded(n: Column, s: Column, sq: Column, gn: Column, gs: Column, gq: Column) -> Column:
        prior = F.try_divide(gs, gn)
        mean = F.try_divide(s, n)
        if smoothing == "auto":
            t2 = F.greatest(F.try_divide(gq, gn) - prior * prior, F.lit(0.0))
            s2 = F.greatest(F.try_divide(sq, n) - mean * mean, F.lit(0.0))
            weight = F.coalesce(F.try_divide(n * t2, n * t2 + s2), F.lit(0.0))
        else:
            weight = n / (n + F.lit(float(smoothing)))
        return F.lit(centre) + F.coalesce(weight * mean + (1 - weight) * prior, prior, F.lit(0.0))

    t = (tr.join(cat, q(col).eqNullSafe(F.col("_c0")), "left")
         .join(part, q(fold).eqNullSafe(F.col("_k0")) & q(col).eqNullSafe(F.col("_k1")), "left")
         .join(whole, q(fold).eqNullSafe(F.col("_f0")), "left"))
    t = t.withColumn(out, encoded(*[zero(f"_c{v}") - zero(f"_k{v}") for v in "nsq"],
                                  *[F.lit(total[v] or 0) - zero(f"_f{v}") for v in "nsq"])).select(*df.columns, out)
    o = df.filter(~F.coalesce(is_train, F.lit(False))).join(cat, q(col).eqNullSafe(F.col("_c0")), "left")
    o = o.withColumn(out, encoded(*[zero(f"_c{v}") for v in "nsq"], *[F.lit(total[v] or 0) for v in "nsq"])).select(*df.columns, out)
    return t.unionByName(o)


# ------------------------------------------------------------------ J5 - J7
def impute_fit(train: DataFrame, mean_cols=(), mode_cols=(), empty_mode=None) -> dict:
    """One aggregate for all means and one for all modes (by count, ties -> smallest value).
    A column with no values gets ``empty_mode`` (0 for numbers, 'Unknown' for text)."""
    out: dict = {}
    if mean_cols:
        row = train.agg(*[F.avg(q(c)).alias(c) for c in mean_cols]).first()
        out.update({c: row[c] for c in mean_cols})
    if mode_cols:
        # a cell becomes a struct with its value in the field of its column, so that values keep their types and order
        cells = F.array(*[F.struct(F.lit(i).alias("nth"), *[(q(c) if j == i else F.lit(None).cast(train.schema[c].dataType)).alias(f"v{j}")
                                                            for j, c in enumerate(mode_cols)]) for i in range(len(mode_cols))])
        flat = train.select(F.explode(cells).alias("c")).select("c.*")
        values = [f"v{j}" for j in range(len(mode_cols))]
        best = (flat.filter(F.coalesce(*[F.when(F.col(v).isNotNull(), F.lit(1)) for v in values]).isNotNull())
                .groupBy("nth", *values).agg(F.count(F.lit(1)).alias("n"))
                .groupBy("nth").agg(F.min(F.struct((-F.col("n")).alias("less"), *values)).alias("b")).collect())  # one row a column
        found = {mode_cols[r["nth"]]: r["b"][f"v{r['nth']}"] for r in best}
        for c in mode_cols:
            is_num = dict(train.dtypes)[c] != "string"
            out[c] = found.get(c, empty_mode if empty_mode is not None else (0 if is_num else "Unknown"))
    return out


def impute_apply(df: DataFrame, values: dict) -> DataFrame:
    return df.withColumns({c: F.coalesce(q(c), F.lit(v)) for c, v in values.items() if v is not None})


def minmax_fit(train: DataFrame, cols: list[str]) -> dict:
    row = train.agg(*[F.min(q(c)).alias(f"mn{i}") for i, c in enumerate(cols)],
                    *[F.max(q(c)).alias(f"mx{i}") for i, c in enumerate(cols)]).first()
    return {c: (row[f"mn{i}"], row[f"mx{i}"]) for i, c in enumerate(cols)}


def minmax_apply(df: DataFrame, params: dict) -> DataFrame:
    """(x - min) / (max - min); a constant column -> 0."""
    ex = {}
    for c, (mn, mx) in params.items():
        ex[c] = F.lit(0.0) if mn is None or mx == mn else (q(c) - F.lit(mn)) / F.lit(mx - mn)
    return df.withColumns(ex)


def standard_fit(train: DataFrame, cols: list[str]) -> dict:
    row = train.agg(*[F.avg(q(c)).alias(f"m{i}") for i, c in enumerate(cols)],
                    *[F.stddev_pop(q(c)).alias(f"s{i}") for i, c in enumerate(cols)]).first()
    return {c: (row[f"m{i}"], row[f"s{i}"]) for i, c in enumerate(cols)}


def standard_apply(df: DataFrame, params: dict) -> DataFrame:
    """(x - mean) / population std; std 0 -> divide by 1."""
    return df.withColumns({c: (q(c) - F.lit(m)) / F.lit(s if s else 1.0) for c, (m, s) in params.items()})


# ------------------------------------------------------------------ J8 Yeo-Johnson
def _power_parts(x: Column, lam: float) -> tuple[Column, Column]:
    """Yeo-Johnson of ``x`` and its derivative by ``lam``, both stable where the power tends to 0."""
    up = x >= 0
    log = F.log1p(F.abs(x))
    t = F.when(up, F.lit(float(lam))).otherwise(F.lit(2.0 - float(lam)))
    z = t * log
    size = F.when(t == 0, log).otherwise(F.expm1(z) / t)
    # d/dt of (exp(t * log) - 1) / t, by its series where the terms would cancel
    slope = F.when(F.abs(z) < 1e-3, log * log * (F.lit(0.5) + z / 3 + z * z / 8)).otherwise((F.exp(z) * (z - 1) + 1) / (t * t))
    return F.when(up, size).otherwise(-size), slope


def power_fit(train: DataFrame, cols: list[str], width: float = 1e-9, most_passes: int = 60) -> dict[str, float]:
    """Per column the lambda that maximises the Yeo-Johnson likelihood, without a bound on it.

    The likelihood's slope falls from positive to negative at its maximum. All columns share each pass (one aggregate): it evaluates the
    slope at a few lambdas a column, first until they enclose the zero, then at the secant's zero and close beside
    it. Null and NaN are left out; a constant (or empty) column gets 1, which changes nothing;
    where doubles overflow before the slope turns, the last power with finite numbers is taken."""
    value = {c: F.when(~F.isnan(q(c).cast("double")), q(c).cast("double")) for c in cols}

    def slopes(at: dict[str, list[float]]) -> dict[str, list[float | None]]:
        aggs = []
        for i, c in enumerate(at):
            x = value[c]
            aggs += [F.count(x).alias(f"n{i}"), F.sum(F.signum(x) * F.log1p(F.abs(x))).alias(f"l{i}")]
            for j, lam in enumerate(at[c]):
                y, dy = _power_parts(x, lam)
                aggs += [F.var_pop(y).alias(f"v{i}_{j}"), F.covar_pop(y, dy).alias(f"w{i}_{j}")]
        row = train.agg(*aggs).first()
        out = {}
        for i, c in enumerate(at):
            each = []
            for j in range(len(at[c])):
                v, w = row[f"v{i}_{j}"], row[f"w{i}_{j}"]
                ok = v is not None and v > 0 and math.isfinite(v) and math.isfinite(w)
                each.append((row[f"l{i}"] or 0.0) - row[f"n{i}"] * w / v if ok else None)
            out[c] = each
        return out

    done: dict[str, float] = {}
    box: dict[str, list] = {}  # column -> [low, its slope, high, its slope]
    walls: dict[str, float] = {}  # column -> the nearest power whose numbers overflow
    grid = {c: [-2.0, 0.0, 1.0, 2.0, 4.0] for c in cols}
    for _ in range(most_passes):
        if not grid:
            break
        got = slopes(grid)
        for c in list(grid):
            seen = sorted((lam, g) for lam, g in zip(grid[c], got[c]) if g is not None)
            seen += [(box[c][0], box[c][1]), (box[c][2], box[c][3])] if c in box else []
            seen = sorted(p for p in seen if p[1] is not None)
            if not seen or (len(seen) < 2 and c not in box):
                done[c] = 1.0
                del grid[c]
                continue
            up, down = [p for p in seen if p[1] > 0], [p for p in seen if p[1] <= 0]
            if not up or not down:  # outwards, twice as far each time, but not to where numbers end
                edge = seen[0] if not up else seen[-1]
                beyond = [lam for lam, g in zip(grid[c], got[c]) if g is None and (lam < edge[0] if not up else lam > edge[0])]
                if beyond:
                    walls[c] = max(beyond) if not up else min(beyond)
                wall = walls.get(c)
                box[c] = [*edge, *edge]
                far = abs(wall - edge[0]) if wall is not None else 1 + abs(edge[0])
                if far <= 1e-6 * max(1.0, abs(edge[0])) or far > 1e9:
                    done[c] = edge[0]
                    del grid[c]
                    continue
                shares = (0.25, 0.5, 0.75) if wall is not None else (0.5, 1.0, 2.0)
                grid[c] = [edge[0] + (far if not down else -far) * f for f in shares]
                continue
            low, high = max(up), min(down)
            box[c] = [*low, *high]
            if high[1] == 0 or high[0] - low[0] <= width * max(1.0, abs(low[0])):
                done[c] = high[0] if high[1] == 0 else (low[0] + high[0]) / 2
                del grid[c]
                continue
            span = high[0] - low[0]
            root = low[0] + span * low[1] / (low[1] - high[1])
            near = span * 0.02
            points = {min(max(p, low[0] + span * 1e-3), high[0] - span * 1e-3) for p in (root - near, root, root + near, (low[0] + high[0]) / 2)}
            grid[c] = sorted(points)
    for c in grid:
        done[c] = (box[c][0] + box[c][2]) / 2
    return {c: done[c] for c in cols}


class StandardTransformer:
    """J7 as a transformer that is fitted once: zero mean, unit (population) variance."""

    def fit(self, df: DataFrame, cols: list[str]) -> "StandardTransformer":
        self.params = standard_fit(df, cols) if cols else {}
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        return standard_apply(df, self.params)


class PowerTransformer:
    """J8 as a transformer that is fitted once: Yeo-Johnson by maximum likelihood, then J7. Null and NaN stay as they are."""

    def fit(self, df: DataFrame, cols: list[str]) -> "PowerTransformer":
        self.lambdas = power_fit(df, cols) if cols else {}
        self.scale = StandardTransformer().fit(self._powered(df), cols)
        return self

    def _powered(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: _power_parts(q(c).cast("double"), lam)[0] for c, lam in self.lambdas.items()})

    def transform(self, df: DataFrame) -> DataFrame:
        return self.scale.transform(self._powered(df))


# ------------------------------------------------------------------ J9 / J10
def assemble(df: DataFrame, spec_cols: dict[str, list[str]], out: str = "features") -> DataFrame:
    """Column groups in sorted kind order, concatenated into one vector."""
    from pyspark.ml.feature import VectorAssembler
    cols = [c for k in sorted(spec_cols) for c in spec_cols[k]]
    return VectorAssembler(inputCols=cols, outputCol=out, handleInvalid="keep").transform(df)


def pca(df: DataFrame, col: str = "features", k: int | None = None, variance: float | None = None,
        out: str = "pca", most: int | None = None) -> DataFrame:
    """Coordinates along the first ``k`` principal components, or the fewest that reach the share
    ``variance`` (``most`` at most), found without a width x width matrix (``pca.components``). (The benchmark's own
    choices: k = 100 for wider inputs, else the width; variance with k = 301 at most.)"""
    from .pca import components, project

    return project(df, col, components(df, col, k, variance, most), out)
