"""Profiles and match summaries (D1-D5): one fused ``agg`` each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cuts import exact_quantiles


def column_profile(df: DataFrame) -> DataFrame:
    """Null count and distinct count for every column.

    Two aggregates: one row of counts, and the distinct (column, 128-bit digest of the value) pairs, so that long texts and wide
    rows are not carried once per column. Equal values have equal digests, -0.0 that of 0.0.

    Output (long form): ``column, n_rows, n_null, n_distinct``.
    """
    names = df.columns
    nulls = df.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(f"`{c}`").isNull()).alias(f"z{i}") for i, c in enumerate(names)])
    nulls = nulls.select("n", F.explode(F.arrays_zip(F.array(*[F.lit(c) for c in names]).alias("column"),
                                                     F.array(*[F.col(f"z{i}") for i in range(len(names))]).alias("n_null"))).alias("r"))

    def digest(c: str, kind: str):
        value = F.col(f"`{c}`")
        if kind in ("float", "double"):
            value = value + F.lit(0.0).cast(kind)  # one zero
        return F.when(F.col(f"`{c}`").isNotNull(), F.md5(F.to_json(F.struct(value.alias("v"))).cast("binary")))

    cells = F.array(*[digest(c, k) for c, k in df.dtypes])
    kinds = (df.select(F.posexplode(cells).alias("nth", "d")).filter("d is not null").distinct()
             .groupBy("nth").agg(F.count(F.lit(1)).alias("n_distinct")))
    order = F.array_position(F.array(*[F.lit(c) for c in names]), F.col("column")) - 1
    flat = nulls.select(F.col("r.column").alias("column"), F.col("n").alias("n_rows"), F.col("r.n_null").alias("n_null"))
    return (flat.withColumn("nth", order).join(kinds, "nth", "left")
            .select("column", "n_rows", "n_null", F.coalesce("n_distinct", F.lit(0)).alias("n_distinct")))


def match_statistics(mapping: DataFrame, sim: str = "cosine_similarity") -> DataFrame:
    """Rows, matched rows, distinct aux rows used, mean/median/min/max similarity. The median is exact and
    keeps no buffer of values (``cuts.exact_quantiles``)."""
    s = F.col(sim)
    out = mapping.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count("t2_index").alias("n_matched"),
        F.count_distinct("t2_index").alias("n_distinct_t2"),
        F.round(F.avg(s), 6).alias("mean_similarity"),
        F.round(F.min(s), 6).alias("min_similarity"),
        F.round(F.max(s), 6).alias("max_similarity"),
    )
    half = exact_quantiles(mapping, [], sim, [0.5]).agg(F.round(F.max(F.col("quantiles")[0]), 6)).first()[0]
    return out.withColumn("median_similarity", F.lit(half).cast("double")).select(
        "n_rows", "n_matched", "n_distinct_t2", "mean_similarity", "median_similarity", "min_similarity", "max_similarity")


def similarity_buckets(mapping: DataFrame, sim: str = "cosine_similarity") -> DataFrame:
    """D3: matched rows with similarity > 0.8, in [0.5, 0.8], < 0.5."""
    s = F.col(sim)
    m = mapping.filter(F.col("t2_index").isNotNull())
    return m.agg(
        F.count_if(s > 0.8).alias("n_above_08"),
        F.count_if((s >= 0.5) & (s <= 0.8)).alias("n_05_to_08"),
        F.count_if(s < 0.5).alias("n_below_05"),
    )
