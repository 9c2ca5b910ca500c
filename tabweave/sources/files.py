"""Scans and sinks.

CSV is read with every column as a string (no ``inferSchema`` pass); typing
happens afterwards through a ``TableSpec`` / recipe. Scratch output goes to
a folder under the session's checkpoint directory (shared storage on a
cluster), never to a machine-local temp folder.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..core import TableSpec
from ..functions.text import NA_TOKENS, null_tokens
from ..session import ensure_checkpoint_dir
from .csv_records import parsed, records, splittable

SPLIT_NAMES = ("train", "val", "test")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the checkpoint directory."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/tabweave-io/{name}-{uuid.uuid4().hex}"


# ------------------------------------------------------------------ A1 / A2 / A4 / A5
def read_csv(spark: SparkSession, path: str, text_col: str | None = None, encoding: str = "UTF-8",
             sep: str = ",", required: list[str] = (), na_tokens: list[str] | None = None,
             multi_line: bool = True) -> DataFrame:
    """A1/A4: header CSV with quoted multi-line cells; all columns strings.
    A file with line breaks inside cells is read by many tasks (``csv_records``); ``multi_line=False`` leaves files
    without them to Spark's own splitting reader. An encoding that does not write line breaks as ASCII does
    (UTF-16) needs one task a file.
    A missing ``text_col``/``required`` column raises with the column list;
    ``text_col`` NULL becomes ``''``. ``na_tokens`` (A5) turn listed cell
    texts into NULL (Spark's own ``nullValue`` accepts a single token)."""
    df = (spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"')
          .option("encoding", encoding).option("sep", sep).option("inferSchema", False).csv(path))
    if multi_line and splittable(encoding) and df.columns:
        df = parsed(records(spark, path, sep, encoding), df.columns, sep, encoding)
    first = df.columns[0] if df.columns else None
    if first is not None and first.startswith("﻿"):
        df = df.withColumnRenamed(first, first[1:])  # byte-order mark glued to the first header
    need = list(required) + ([text_col] if text_col else [])
    missing = [c for c in need if c not in df.columns]
    if missing:
        raise ValueError(f"Column(s) {missing} not found in {path}. Columns: {df.columns}")
    if na_tokens is not None:
        df = df.withColumns({c: null_tokens(F.col(f"`{c}`"), na_tokens or NA_TOKENS) for c in df.columns})
    if text_col:
        df = df.withColumn(text_col, F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")))
    return df


def detect_encoding(spark: SparkSession, path: str) -> str:
    """A2: UTF-8 when every line is valid UTF-8, else ISO-8859-1
    (latin-1 decodes any byte, so later fall-backs could never trigger)."""
    bad = spark.read.text(path).filter(~F.is_valid_utf8(F.col("value").cast("binary")))
    return "UTF-8" if bad.isEmpty() else "ISO-8859-1"


def read_csv_auto(spark: SparkSession, path: str, **kw) -> tuple[DataFrame, str]:
    enc = detect_encoding(spark, path)
    return read_csv(spark, path, encoding=enc, **kw), enc


def write_csv(df: DataFrame, path: str, sep: str = ",", encoding: str = "UTF-8") -> None:
    """Header CSV, quotes doubled (no BOM)."""
    (df.write.mode("overwrite").option("header", True).option("escape", '"').option("sep", sep)
     .option("encoding", encoding).csv(path))


# ------------------------------------------------------------------ A3
TS_MICROS = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def write_jsonl(df: DataFrame, path: str) -> None:
    """JSON lines with microsecond timestamps (the default format keeps milliseconds)."""
    df.write.mode("overwrite").option("timestampNTZFormat", TS_MICROS).option("timestampFormat", TS_MICROS).json(path)


def read_jsonl(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """A3: JSON lines with a declared schema (no inference pass)."""
    return (spark.read.schema(schema).option("timestampNTZFormat", TS_MICROS)
            .option("timestampFormat", TS_MICROS).json(path))


# ------------------------------------------------------------------ A6 / A13
def write_table(df: DataFrame, path: str, spec: TableSpec) -> None:
    """Parquet data plus a one-row JSON sidecar with the table spec."""
    df.write.mode("overwrite").parquet(f"{path}/data")
    df.sparkSession.createDataFrame([(spec.to_json(),)], "spec string").coalesce(1) \
        .write.mode("overwrite").json(f"{path}/spec")


def read_table(spark: SparkSession, path: str) -> tuple[DataFrame, TableSpec]:
    spec = TableSpec.from_json(spark.read.json(f"{path}/spec").first()["spec"])
    return spark.read.parquet(f"{path}/data"), spec


def read_vectors(spark: SparkSession, path: str, key: str) -> DataFrame:
    """Precomputed vectors keyed by entity."""
    return spark.read.parquet(path).select(key, *[c for c in spark.read.parquet(path).columns if c != key])


# ------------------------------------------------------------------ A8
def read_split(spark: SparkSession, path: str, ids: list[str]) -> tuple[DataFrame, dict]:
    """``(ids..., split)`` table; checks the split names and reports the
    share of each split (one tiny aggregate)."""
    df = spark.read.parquet(path)
    for c in [*ids, "split"]:
        if c not in df.columns:
            raise ValueError(f"split table must contain {c!r}")
    counts = {r["split"]: r["n"] for r in df.groupBy("split").agg(F.count(F.lit(1)).alias("n")).collect()}
    unknown = [s for s in counts if s is not None and s not in SPLIT_NAMES]
    absent = [s for s in SPLIT_NAMES if s not in counts]
    if unknown or absent:
        raise ValueError(f"split names: unknown {unknown}, absent {absent}")
    total = sum(counts.values())
    return df, {s: (counts.get(s, 0), counts.get(s, 0) / total if total else 0.0) for s in SPLIT_NAMES}


# ------------------------------------------------------------------ A10 / A11 / H5
RUN_FIELDS = ["train_acc", "val_acc", "test_acc", "val_loss"]


def write_results(runs: DataFrame, path: str, keys: list[str], run_key: str, metrics: list[str]) -> None:
    """One JSON document per key: its run list (ordered by ``run_key``),
    statistics (mean / population std / min / max) and the key as config."""
    per = runs.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct(F.col(run_key), *[F.col(m) for m in metrics]))).alias("individual_runs"),
        F.struct(*[F.avg(m).alias(f"{m}_mean") for m in metrics], *[F.stddev_pop(m).alias(f"{m}_std") for m in metrics],
                 *[F.min(m).alias(f"{m}_min") for m in metrics], *[F.max(m).alias(f"{m}_max") for m in metrics],
                 F.count(F.lit(1)).alias("n_runs")).alias("statistics"),
        F.struct(*[F.col(k) for k in keys]).alias("config"))
    per.write.mode("overwrite").json(path)


def read_results(spark: SparkSession, paths: list[str] | str, first_only: bool = False) -> DataFrame:
    """A10/H5: nested result JSON (one or many paths, e.g. shards) -> flat run
    log; ``first_only`` keeps each file's first run (``individual_runs[0]``). Files
    with a ``total_runtime`` in their summary lend it to runs without a runtime."""
    raw = spark.read.json(paths if isinstance(paths, list) else [paths])
    cfg = [F.col(f"config.{c}").alias(c) for c in raw.select("config.*").columns]
    fields = raw.select(F.explode("individual_runs").alias("r")).select("r.*").columns
    if "runtime" in fields and "total_runtime" in raw.columns:
        given = F.col("total_runtime").cast("double")
        raw = raw.withColumn("individual_runs", F.transform(
            "individual_runs", lambda r: r.withField("runtime", F.coalesce(r["runtime"], given))))
    if first_only:
        return raw.select(*cfg, F.col("individual_runs")[0].alias("r")).select("*", "r.*").drop("r")
    return raw.select(*cfg, F.posexplode("individual_runs").alias("run_idx", "r")).select("*", "r.*").drop("r")


def compile_results(spark: SparkSession, root: str, task_col_score: dict[str, str]) -> DataFrame:
    """CSV result files laid out as ``.../data_name=<d>/method=<m>/num_train=<n>/random_state=<s>/*.csv``
    (any depth); the key fields are parsed from each row's file path and the
    score column is picked by task (``{'classification': 'test_acc', ...}``)."""
    df = spark.read.option("header", True).option("recursiveFileLookup", True).csv(root) \
        .withColumn("_path", F.col("_metadata.file_path"))
    out = df
    for k in ("data_name", "method", "num_train", "random_state"):
        out = out.withColumn(k, F.regexp_extract("_path", f"/{k}=([^/]+)/", 1))
    score = None
    for task, col in task_col_score.items():
        expr = F.when(F.col("task") == task, F.col(col).cast("double"))
        score = expr if score is None else score.when(F.col("task") == task, F.col(col).cast("double"))
    return out.select("data_name", "method", F.col("num_train").cast("bigint").alias("num_train"),
                      F.col("random_state").cast("bigint").alias("random_state"), "task", score.alias("score"))
