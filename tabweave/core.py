"""Shared building blocks: table specs, row identity, seeded order, skew-safe ranks.

Determinism rules used everywhere:
* a row is identified by a natural key (``row_id``), never by position;
* a seeded random order is ``md5(seed || '|' || row_id)`` then ``row_id``;
  the same hex comes out of Spark and DuckDB, so samples and splits have an
  exact SQL oracle;
* ratio counts truncate a double product: ``cast(m * r as bigint)``.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field, asdict

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .session import ensure_checkpoint_dir

# --------------------------------------------------------------------------- spec
@dataclass(frozen=True)
class TableSpec:
    """Typed view over a DataFrame: target, entity, task and column kinds."""

    target: str | None = None
    entity: str | None = None
    task: str = "classification"  # or "regression"
    kinds: dict = field(default_factory=dict)  # column -> "num" | "cat" | "bin"
    repeated: bool = False

    def columns_of(self, kind: str) -> list[str]:
        return [c for c, k in self.kinds.items() if k == kind and c != self.target]

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @staticmethod
    def from_json(text: str) -> "TableSpec":
        return TableSpec(**json.loads(text))

    @staticmethod
    def from_kinds(bin_cols=(), num_cols=(), cat_cols=(), target=None, **kw) -> "TableSpec":
        kinds = {c.lower(): "bin" for c in bin_cols}
        kinds.update({c.lower(): "num" for c in num_cols})
        kinds.update({c.lower(): "cat" for c in cat_cols})
        return TableSpec(target=target, kinds=kinds, **kw)


# ------------------------------------------------------------------ table access
TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# ------------------------------------------------------------------ seeded order
def seeded_hash(seed: int, *ids: str | Column) -> Column:
    """md5 hex of ``seed|id[|id2...]`` — identical in Spark and DuckDB."""
    parts = [F.lit(str(seed))] + [F.col(i).cast("string") if isinstance(i, str) else i.cast("string") for i in ids]
    return F.md5(F.concat_ws("|", *parts))


def seeded_uint(seed: int, *ids: str | Column) -> Column:
    """Uniform integer in [0, 2^60) from the first 15 hex digits of the seeded md5."""
    return F.conv(F.substring(seeded_hash(seed, *ids), 1, 15), 16, 10).cast("bigint")


def ratio_count(m: Column | str, ratio: float) -> Column:
    """``int(m * ratio)`` with the double product truncated (m=90, 0.7 -> 62)."""
    m = F.col(m) if isinstance(m, str) else m
    return (m.cast("double") * F.lit(float(ratio))).cast("bigint")


def round6(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, 6)


# ------------------------------------------------------------------ parallelism of small inputs
def spread(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Round-robin repartition only when the input has fewer partitions than
    the cluster has cores (a small file read as one split would otherwise run
    CPU-heavy work on one core). Large inputs already have many splits and
    pass through without a shuffle."""
    want = min_partitions or df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(want) if df.rdd.getNumPartitions() < want else df


def measured(df: DataFrame) -> DataFrame:
    """A small frame written below the checkpoint folder and read again: its size is then known to the planner, which
    broadcasts it in a join if it is small and shuffles if not."""
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/tabweave-io/measured-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# ------------------------------------------------------------ skew-safe ranking
def positions(df: DataFrame, by: list[str], order: list[str], out: str = "pos",
              size_col: str | None = None, num_partitions: int | None = None) -> DataFrame:
    """1-based ``row_number()`` within ``by`` ordered by ``order`` (a total order),
    without putting a whole group into one task.

    A ``Window.partitionBy(by)`` sends each group to a single task, so a label
    holding a third of the rows would hold a third of the data in one task.
    Instead the rows are range-partitioned on ``by + order`` (sampled bounds
    split a hot group over many tasks) and sorted within partitions; the local
    position comes from ``monotonically_increasing_id``. The frame is then
    checkpointed (reliable storage, cuts the lineage and pins the partition
    ids), per-(partition, group) counts give each slice its offset, and the
    offset table (at most partitions + groups rows) is joined back.
    ``size_col`` optionally adds the group size.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [*by, *order]
    ordered = (
        df.repartitionByRange(n, *[F.col(k).asc_nulls_last() for k in keys])
        .sortWithinPartitions(*[F.col(k).asc_nulls_last() for k in keys])
        .withColumn("_pid", F.spark_partition_id())
        .withColumn("_mid", F.monotonically_increasing_id())
        .checkpoint(eager=True)
    )
    slices = ordered.groupBy("_pid", *by).agg(
        F.min("_mid").alias("_m0"), F.count(F.lit(1)).alias("_cnt"))
    w = Window.partitionBy(*by).orderBy("_pid")
    slices = slices.withColumn(
        "_off", F.coalesce(F.sum("_cnt").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    if size_col:
        slices = slices.withColumn(size_col, F.sum("_cnt").over(Window.partitionBy(*by)))
    cond = [ordered["_pid"] == slices["_pid"]] + [ordered[b].eqNullSafe(slices[b]) for b in by]
    extra = [slices[size_col]] if size_col else []
    return (
        ordered.join(slices, cond, "inner")
        .select(ordered["*"], (ordered["_mid"] - slices["_m0"] + slices["_off"] + 1).alias(out), *extra)
        .drop("_pid", "_mid")
    )


def group_sizes(df: DataFrame, by: list[str], out: str = "m") -> DataFrame:
    """Per-group row counts (partial aggregation: a hot group is pre-counted map-side)."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias(out))


def running_sums(df: DataFrame, by: list[str], order: list[str], values: list[str],
                 prefix: str = "cum_", num_partitions: int | None = None) -> DataFrame:
    """Inclusive running sums of ``values`` within ``by`` along ``order`` (a total
    order), skew-safe like ``positions``: range partitions are summed locally
    (a window over one bounded slice), and each slice adds the totals of the
    slices before it in the same group."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [*by, *order]
    ordered = (
        df.repartitionByRange(n, *[F.col(k).asc_nulls_last() for k in keys])
        .sortWithinPartitions(*[F.col(k).asc_nulls_last() for k in keys])
        .withColumn("_pid", F.spark_partition_id())
        .withColumn("_mid", F.monotonically_increasing_id())
        .checkpoint(eager=True)
    )
    local_w = Window.partitionBy("_pid", *by).orderBy("_mid").rowsBetween(Window.unboundedPreceding, 0)
    local = ordered.withColumns({f"_l{i}": F.sum(v).over(local_w) for i, v in enumerate(values)})
    slices = ordered.groupBy("_pid", *by).agg(*[F.sum(v).alias(f"_t{i}") for i, v in enumerate(values)])
    w = Window.partitionBy(*by).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.select("_pid", *by, *[F.coalesce(F.sum(f"_t{i}").over(w), F.lit(0)).alias(f"_o{i}")
                                          for i in range(len(values))])
    cond = [local["_pid"] == slices["_pid"]] + [local[b].eqNullSafe(slices[b]) for b in by]
    return (local.join(slices, cond, "inner")
            .select(local["*"], *[(local[f"_l{i}"] + slices[f"_o{i}"]).alias(f"{prefix}{v}") for i, v in enumerate(values)])
            .drop("_pid", "_mid", *[f"_l{i}" for i in range(len(values))]))
