"""Run-log analytics.

A run log is a long table: one row per (dataset, method, num_train, seed)
with metric columns. Summaries are grouped aggregates; "best" picks are
``max`` over a struct (partial aggregation, deterministic tie rule); ranks
inside a dataset use the skew-safe ``positions`` primitive.
"""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..core import positions
from ..functions.text import case_id, replace_chain
from .split import _ntile

# The benchmark's dataset -> table index -> tag catalogue.
TABLE_TAGS = {
    "mstraffic": ["mstraffic_maryland", "mstraffic_seattle", "mstraffic_da", "mstraffic_fa"],
    "ncbuilding": ["ncbuilding_newyork", "ncbuilding_chicago", "ncbuilding_da", "ncbuilding_fa"],
    "nctaxi": ["nctaxi_newyork_taxi", "nctaxi_chicago_taxi", "nctaxi_da", "nctaxi_fa"],
    "dsmusic": ["dsmusic_discogs", "dsmusic_spotify", "dsmusic_da", "dsmusic_fa"],
    "agbooks": ["agbooks_amazon", "agbooks_goodreads", "agbooks_da", "agbooks_fa"],
    "nnstocks": ["nnstocks_nnlist", "nnstocks_nnwiki", "nnstocks_da", "nnstocks_fa"],
}


def catalog_frame(spark: SparkSession) -> DataFrame:
    rows = [(d, i, t) for d, tags in TABLE_TAGS.items() for i, t in enumerate(tags)]
    return spark.createDataFrame(rows, "dataset string, table_idx int, tag string")


def dataset_tags(df: DataFrame, dataset: str, idx: str, strict: bool = False) -> DataFrame:
    """Tag of (dataset, table index); unknown -> ``<dataset>_table<i>``.
    ``strict`` raises when a known dataset is asked for an index it lacks."""
    cat = F.broadcast(catalog_frame(df.sparkSession))  # fixed 24-row table
    j = df.join(cat, (df[dataset] == cat["dataset"]) & (df[idx] == cat["table_idx"]), "left")
    if strict:
        known = list(TABLE_TAGS)
        bad = j.filter(cat["tag"].isNull() & df[dataset].isin(known)).limit(1).count()
        if bad:
            raise IndexError("table index out of range for a catalogued dataset")
    return j.select(df["*"], F.coalesce(cat["tag"], F.concat(df[dataset], F.lit("_table"),
                                                              df[idx].cast("string"))).alias("tag"))


def param_grid(spark: SparkSession, space: dict[str, list]) -> DataFrame:
    """Cartesian product of small value lists with a stable ``config_idx``
    (product order of the lists, last key fastest)."""
    keys = list(space)
    rows = [(i, *vals) for i, vals in enumerate(itertools.product(*[space[k] for k in keys]))]
    types = {bool: "boolean", int: "bigint", float: "double", str: "string"}
    schema = ", ".join(["config_idx bigint"] + [f"`{k}` {types[type(space[k][0])]}" for k in keys])
    return spark.createDataFrame(rows, schema)


def run_statistics(runs: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Mean, population std, min, max of each metric per key (long form)."""
    long = runs.unpivot(keys, metrics, "metric", "value").filter(F.col("value").isNotNull())
    return long.groupBy(*keys, "metric").agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"), F.count(F.lit(1)).alias("n"))


def dynamic_summary(runs: DataFrame, metrics: list[str]) -> DataFrame:
    """The same summary over whatever metrics are present (NULLs skipped)."""
    return run_statistics(runs, [], metrics)


def floor_scores(df: DataFrame, score: str = "score", task: str = "task") -> DataFrame:
    """Classification < 0.5 -> 0.5; regression < 0 -> 0."""
    s = F.col(score)
    floor = F.when(F.col(task) == "classification", F.lit(0.5)).otherwise(F.lit(0.0))
    return df.withColumn(score, F.when(s < floor, floor).otherwise(s))


def minmax_normalise(df: DataFrame, by: str = "data_name", score: str = "score",
                     out: str = "normalized_score") -> DataFrame:
    """(score - min) / (max - min) per dataset; equal min/max -> NULL.
    Min and max come from a grouped aggregate joined back (a hot dataset is
    pre-reduced map-side instead of sorted into one window task)."""
    mm = df.groupBy(by).agg(F.min(score).alias("_mn"), F.max(score).alias("_mx"))
    return df.join(mm, by).withColumn(out, F.try_divide(F.col(score) - F.col("_mn"), F.col("_mx") - F.col("_mn"))) \
        .drop("_mn", "_mx")


def grid_shards(configs: DataFrame, idx: str, num_tasks: int) -> DataFrame:
    """Contiguous balanced chunks over ``idx`` order; the first
    ``total % num_tasks`` shards get one extra config (0-based ``shard``)."""
    total = configs.count()
    p = positions(configs, [], [idx], out="_pos")
    return p.withColumn("shard", _ntile(F.col("_pos"), F.lit(total), num_tasks) - 1).drop("_pos")


def best_by(df: DataFrame, by: list[str], desc: list[str], asc: list[str]) -> DataFrame:
    """The row maximising ``desc`` (then minimising ``asc``) per group,
    via ``max`` over a struct — a partial aggregate, no sort of the group."""
    cols = [c for c in df.columns if c not in by]
    key = F.struct(*[F.col(c) for c in desc], *[(-F.col(c)).alias(f"_neg_{c}") for c in asc],
                   F.struct(*[F.col(c) for c in cols]).alias("_row"))
    best = df.groupBy(*by).agg(F.max(key).alias("_b"))
    return best.select(*by, *[F.col(f"_b._row.{c}").alias(c) for c in cols])


def rank_min(df: DataFrame, by: list[str], value: str, tiebreak: list[str], out: str = "rank") -> DataFrame:
    """``rank(method='min')`` ascending — equal values share the smallest position."""
    p = positions(df, by, [value, *tiebreak], out="_pos")
    first = p.groupBy(*by, value).agg(F.min("_pos").alias(out))
    return p.join(first, [*by, value]).drop("_pos")


def model_ranking(df: DataFrame, model: str = "model", score: str = "normalized_score") -> DataFrame:
    """Mean normalised score per model, ranked descending with average
    ranks on ties. Runs the window over the per-model table (one row per model)."""
    g = df.groupBy(model).agg(F.avg(score).alias("mean_score"))
    w = Window.orderBy(F.col("mean_score").desc())
    cnt = Window.partitionBy("mean_score")
    return g.withColumn("avg_rank", F.rank().over(w) + (F.count(F.lit(1)).over(cnt) - 1) / 2.0)


def with_case_id(df: DataFrame, *cols: str, out: str = "case") -> DataFrame:
    """I21."""
    return df.withColumn(out, case_id(*cols))


def display_names(df: DataFrame, col: str, pairs: list[tuple[str, str]]) -> DataFrame:
    """Ordered substring replacements."""
    return df.withColumn(col, replace_chain(col, pairs))


def eligible(runs: DataFrame, methods: DataFrame, task: str = "task", num_train: str = "num_train") -> DataFrame:
    """Keep (run, method) pairs whose method suits the task and size:
    ``methods`` has ``method, only_task`` (NULL = any) and ``max_train`` (NULL = any)."""
    ok = (F.col("only_task").isNull() | (F.col("only_task") == F.col(task))) & \
         (F.col("max_train").isNull() | (F.col(num_train) <= F.col("max_train")))
    return runs.join(methods, "method").filter(ok)
