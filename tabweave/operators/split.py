"""Train/val/test splits, nested subsets and folds.

Every split is a ``(row_id..., split)`` table computed from a seeded order
(the first 60 bits of ``md5(seed|row_id)``, a bigint, then the id) or a time order, with counts truncated as
``int(m * ratio)``. No class is sorted: ``cuts.sliced`` counts the rows by the leading bits of their key
and ranks only those around a cut, so a class holding a third of all rows is no hot key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..core import positions, ratio_count, seeded_uint
from .cuts import double_bits, sliced

SPLITS = ("train", "val", "test")


def _ids(ids: list[str] | str) -> list[str]:
    return [ids] if isinstance(ids, str) else list(ids)


def _named(slice_: Column, names: tuple[str, ...]) -> Column:
    out = F.when(slice_ == 0, names[0])
    for i, n in enumerate(names[1:], 1):
        out = out.when(slice_ == i, n)
    return out


def _bounds(*ratios: float):
    """Cuts after ``int(m * r)`` rows for each ratio, one after the other."""

    def cuts(m: Column) -> list[Column]:
        out, at = [], F.lit(0)
        for r in ratios:
            at = at + ratio_count(m, r)
            out.append(at)
        return out

    return cuts


def stratified_split(df: DataFrame, ids: list[str] | str, label: str, seed: int = 42,
                     train_ratio: float = 0.7, val_ratio: float = 0.1,
                     time_col: str | None = None) -> DataFrame:
    """Per class, first ``int(m*train)`` rows -> train, next ``int(m*val)``
    -> val, rest -> test. Order = seeded shuffle, or ``time_col`` ascending
    (E2; ties by id) when given and present — absent falls back to E1.
    Rows with a NULL label get a NULL split."""
    ids = _ids(ids)
    temporal = time_col is not None and time_col in df.columns
    base = df.select(*ids, F.col(label).alias("_label"),
                     (F.col(time_col) if temporal else seeded_uint(seed, *ids)).alias("_o"))
    labelled = base.filter(F.col("_label").isNotNull())
    key, bits = _key_of(base.schema["_o"].dataType.simpleString()) if temporal else (F.col("_o"), 60)
    if key is None:  # no bits in the order of the column, so it is sorted
        ranked = positions(labelled, ["_label"], ["_o", *ids], out="_pos", size_col="_m")
        behind = sum(((F.col("_pos") > c).cast("int") for c in _bounds(train_ratio, val_ratio)(F.col("_m"))), F.lit(0))
        cut = ranked.withColumn("_slice", behind)
    else:
        keyed = labelled.withColumn("_key", key)
        if temporal:  # nulls come last
            keyed = keyed.withColumn("_key", F.coalesce("_key", F.lit(2 ** 63 - 1)))
        cut = sliced(keyed, ["_label"], "_key", ids, _bounds(train_ratio, val_ratio), "_slice", bits)
    out = cut.select(*ids, _named(F.col("_slice"), SPLITS).alias("split"))
    unlabelled = base.filter(F.col("_label").isNull()).select(*ids, F.lit(None).cast("string").alias("split"))
    return out.unionByName(unlabelled)


def _key_of(kind: str) -> tuple[Column | None, int]:
    """A bigint in the order of ``_o`` and its number of bits; None for kinds without one."""
    c = F.col("_o")
    if kind in ("tinyint", "smallint", "int", "bigint"):
        return c.cast("bigint"), 64
    if kind == "date":
        return F.unix_date(c).cast("bigint"), 64
    if kind in ("timestamp", "timestamp_ntz"):
        return F.unix_micros(c.cast("timestamp")), 64
    if kind in ("float", "double"):
        return double_bits(c), 64
    return None, 0


def random_split(df: DataFrame, ids: list[str] | str, seed: int = 42, train_ratio: float = 0.8,
                 val_end_ratio: float = 0.9) -> DataFrame:
    """Unstratified; train = first ``int(n*0.8)``, val up to ``int(n*0.9)``."""
    ids = _ids(ids)
    cuts = lambda m: [ratio_count(m, train_ratio), ratio_count(m, val_end_ratio)]
    cut = sliced(df.select(*ids, seeded_uint(seed, *ids).alias("_o")), [], "_o", ids, cuts, "_slice")
    return cut.select(*ids, _named(F.col("_slice"), SPLITS).alias("split"))


def stratified_holdout_then_val(df: DataFrame, ids: list[str] | str, label: str, seed: int = 42,
                                test_ratio: float = 0.2, val_ratio: float = 0.1) -> DataFrame:
    """Per class the last ``ceil(m*test)`` rows of the seeded order -> test;
    of the remaining (train) rows, the last ``int(n*val)`` in the seeded order
    (n = all rows) -> val."""
    ids = _ids(ids)
    n_val = int(df.count() * val_ratio)
    base = df.select(*ids, F.col(label).alias("_label"), seeded_uint(seed, *ids).alias("_o"))
    cut = sliced(base, ["_label"], "_o", ids, lambda m: [m - F.ceil(m.cast("double") * F.lit(float(test_ratio)))], "_test")
    train = cut.filter("_test = 0").select(*ids, "_o").checkpoint(eager=True)  # cut once more
    tr = sliced(train, [], "_o", ids, lambda m: [m - F.lit(n_val)], "_val")
    te = cut.filter("_test = 1").select(*ids, F.lit("test").alias("split"))
    return tr.select(*ids, _named(F.col("_val"), ("train", "val")).alias("split")).unionByName(te)


def group_split(df: DataFrame, ids: list[str] | str, group: str | None, num_train: int,
                seed: int = 42) -> DataFrame:
    """E5: ``num_train`` groups (seeded order over distinct groups) -> train,
    the other groups -> test. ``group=None`` makes every row its own group."""
    ids = _ids(ids)
    if group is None:
        g = df.select(*ids, F.concat_ws("|", *[F.col(i).cast("string") for i in ids]).alias("_g"))
    else:
        g = df.select(*ids, F.col(group).cast("string").alias("_g"))
    groups = g.select("_g").distinct().withColumn("_o", seeded_uint(seed, F.col("_g")))
    cut = sliced(groups, [], "_o", ["_g"], lambda m: [F.lit(num_train)], "_slice")
    chosen = cut.select("_g", _named(F.col("_slice"), ("train", "test")).alias("split"))
    return g.join(chosen, "_g").select(*ids, "split")


def _ntile(pos: Column, m: Column, k: int) -> Column:
    """``ntile(k)`` computed from a 1-based position and the group size."""
    q = (m / k).cast("long")
    r = m % k
    big = r * (q + 1)
    return F.when(pos <= big, ((pos - 1) / (q + 1)).cast("long") + 1) \
        .otherwise(r + ((pos - big - 1) / q).cast("long") + 1).cast("int")


def _repeated(df: DataFrame, ids: list[str], repeats: int, seed: int, label: str | None) -> tuple[DataFrame, list[str]]:
    """The rows once a repeat, with their order key under the seed ``seed + repeat``."""
    rep = df.select(*ids, *([F.col(label).alias("_label")] if label else []))
    rep = rep.withColumn("repeat", F.explode(F.sequence(F.lit(1), F.lit(repeats))))
    digest = F.md5(F.concat_ws("|", (F.col("repeat") + F.lit(seed)).cast("string"), *[F.col(i).cast("string") for i in ids]))
    rep = rep.withColumn("_o", F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint"))
    return rep, ["repeat"] + (["_label"] if label else [])


def repeated_kfold(df: DataFrame, ids: list[str] | str, k: int, repeats: int, seed: int = 42,
                   label: str | None = None) -> DataFrame:
    """For each repeat r (seed ``seed + r``), fold = ntile(k) over the seeded
    order, within the class when ``label`` is given (stratified)."""
    ids = _ids(ids)
    rep, by = _repeated(df, ids, repeats, seed, label)
    # the first m % k folds have one row more
    ends = lambda m: [F.floor(m / k) * f + F.least(F.lit(f), m % k) for f in range(1, k)]
    cut = sliced(rep, by, "_o", ids, ends, "_slice")
    return cut.select("repeat", *ids, (F.col("_slice") + 1).cast("int").alias("fold"))


def repeated_shuffle_split(df: DataFrame, ids: list[str] | str, repeats: int, test_ratio: float, seed: int = 42,
                           label: str | None = None) -> DataFrame:
    """For each repeat r (seed ``seed + r``) the first ``ceil(m * test_ratio)`` rows of
    the seeded order are the test part, within the class when ``label`` is given.
    Output ``repeat, ids..., part`` (``test`` or ``train``)."""
    ids = _ids(ids)
    rep, by = _repeated(df, ids, repeats, seed, label)
    cut = sliced(rep, by, "_o", ids, lambda m: [F.ceil(m.cast("double") * F.lit(float(test_ratio)))], "_slice")
    return cut.select("repeat", *ids, _named(F.col("_slice"), ("test", "train")).alias("part"))


def nested_subsets(df: DataFrame, ids: list[str] | str, label: str, fractions=(0.25, 0.5, 0.75),
                   seed: int = 42, check: bool = False) -> DataFrame:
    """Class-balanced nested subsets: prefixes of one per-class seeded
    shuffle, ``int(m*f)`` rows per class. NULL labels raise. Output
    ``row ids, pct``; with ``check`` nesting and class counts are verified."""
    ids = _ids(ids)
    if df.filter(F.col(label).isNull()).limit(1).count():
        raise ValueError(f"nested subsets need a label in every row; {label!r} has NULLs")
    base = df.select(*ids, F.col(label).alias("_label"), seeded_uint(seed, *ids).alias("_o"))
    order = sorted(fractions)
    cut = sliced(base, ["_label"], "_o", ids, lambda m: [ratio_count(m, f) for f in order], "_slice")
    # a row is in every subset whose cut it lies before
    pcts = F.array(*[F.lit(int(round(f * 100))) for f in order])
    out = cut.select(*ids, F.explode(F.slice(pcts, F.col("_slice") + 1, len(order))).alias("pct"))
    if check:
        fr = sorted(fractions)
        for a, b in zip(fr, fr[1:]):
            pa = out.filter(F.col("pct") == int(round(a * 100))).select(*ids)
            pb = out.filter(F.col("pct") == int(round(b * 100))).select(*ids)
            if pa.join(pb, ids, "left_anti").limit(1).count():
                raise RuntimeError(f"rows of the {a:.0%} subset are missing from the {b:.0%} subset")
    return out


def capped_stratified_sample(df: DataFrame, ids: list[str] | str, strata: list[str], fraction: float,
                             cap: int = 10_000, seed: int = 42) -> DataFrame:
    """Keep ``int(m_s * size)`` rows per stratum, size = ``cap/n*fraction``
    when n > cap, else ``fraction`` (seeded order within each stratum). ``cap`` is the
    documented bound on the rows that a model is fitted on (N7); it has no other use."""
    ids = _ids(ids)
    n = df.count()
    size = (cap / n * fraction) if n > cap else fraction
    key = F.concat_ws("_", *[F.col(s).cast("string") for s in strata])
    base = df.select(*ids, key.alias("_s"), seeded_uint(seed, *ids).alias("_o"))
    cut = sliced(base, ["_s"], "_o", ids, lambda m: [ratio_count(m, size)], "_slice")
    return cut.filter("_slice = 0").select(*ids, F.col("_s").alias("stratum"))


# ------------------------------------------------------------------ summaries and checks
def split_summary(df: DataFrame, ids: list[str] | str, label: str, splits: DataFrame) -> DataFrame:
    """Per class total/train/val/test, plus an ``__all__`` row; shares of the total."""
    ids = _ids(ids)
    j = df.select(*ids, F.col(label).cast("string").alias("label")).join(splits, ids, "left")
    aggs = [F.count(F.lit(1)).alias("total")] + [F.count_if(F.col("split") == s).alias(s) for s in SPLITS]
    per = j.groupBy("label").agg(*aggs)
    tot = j.agg(*aggs).select(F.lit("__all__").alias("label"), *[F.col(c) for c in ("total", *SPLITS)])
    both = per.unionByName(tot)
    return both.select("label", "total", *SPLITS,
                       *[F.round(F.col(s) / F.col("total"), 6).alias(f"{s}_share") for s in SPLITS])


def split_violations(df: DataFrame, ids: list[str] | str, splits: DataFrame) -> DataFrame:
    """H7: one row of violation counts: rows without a split, rows with more than
    one split, split rows with no table row, and an empty-test flag."""
    ids = _ids(ids)
    per_row = splits.groupBy(*ids).agg(F.count(F.lit(1)).alias("_n"), F.count("split").alias("_k"),
                                       F.max((F.col("split") == "test").cast("int")).alias("_t"))
    j = df.select(*ids, F.lit(1).alias("_in")).join(per_row, ids, "full")
    return j.agg(
        F.count_if(F.col("_in").isNotNull() & F.coalesce(F.col("_k"), F.lit(0)).__eq__(0)).alias("missing"),
        F.count_if(F.col("_n") > 1).alias("overlapping"),
        F.count_if(F.col("_in").isNull()).alias("unknown_rows"),
        (F.coalesce(F.sum("_t"), F.lit(0)) == 0).cast("int").alias("empty_test"),
    )


def assert_valid_split(df: DataFrame, ids, splits: DataFrame) -> None:
    v = split_violations(df, ids, splits).first()
    if any(v):
        raise ValueError(f"invalid split: {v.asDict()}")


def fit_set(df: DataFrame, ids: list[str] | str, splits: DataFrame) -> dict[str, DataFrame]:
    """H6: train ∪ val as the fit set, test apart."""
    ids = _ids(ids)
    j = df.join(splits, ids)
    return {"fit": j.filter(F.col("split").isin("train", "val")), "test": j.filter(F.col("split") == "test")}


def explicit_split(df: DataFrame, ids: list[str] | str, train_ids: DataFrame, test_ids: DataFrame,
                   val_ids: DataFrame | None = None) -> DataFrame:
    """H8: splits from explicit id lists; train and test must come together.
    Rows in no list get a NULL split."""
    ids = _ids(ids)
    if (train_ids is None) != (test_ids is None):
        raise ValueError("train and test id lists must be given together")
    lists = train_ids.select(*ids).withColumn("split", F.lit("train")).unionByName(
        test_ids.select(*ids).withColumn("split", F.lit("test")))
    if val_ids is not None:
        lists = lists.unionByName(val_ids.select(*ids).withColumn("split", F.lit("val")))
    return df.select(*ids).join(lists, ids, "left")
