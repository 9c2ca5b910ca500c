"""Source / sink round trips (A1-A8, A10-A13, H5) over the driver tables.

Each query writes a table to a fresh folder under the checkpoint directory
with one of our sinks and reads it back with the matching scan, so the
oracle is the original table.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..core import TableSpec, table
from ..operators import runs as R
from ..operators import split as X
from ..sources import files as S
from .runs import RUNS_SQL, runs_frame
from .sqlparts import ratio, seeded_md5


def a1_a7_csv_roundtrip(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text", "lang")
    path = S.scratch_path(spark, "docs-csv")
    S.write_csv(d, path)
    back = S.read_csv(spark, path, text_col="text", required=["doc_id"])
    return back.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", "lang")


SQL_A1 = "SELECT doc_id, coalesce(text, '') AS text, lang FROM documents"


def a2_encoding_detect(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    path = S.scratch_path(spark, "docs-latin1")
    S.write_csv(d, path, encoding="ISO-8859-1")
    back, enc = S.read_csv_auto(spark, path, text_col="text")
    return back.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.lit(enc).alias("encoding"))


SQL_A2 = "SELECT doc_id, text, 'ISO-8859-1' AS encoding FROM documents"


def a4_custom_separator(spark, sf):
    c = table(spark, sf, "customer")
    path = S.scratch_path(spark, "cust-semicolon")
    S.write_csv(c, path, sep=";")
    back = S.read_csv(spark, path, sep=";")
    return back.select(F.col("c_custkey").cast("bigint").alias("c_custkey"), "c_name",
                       F.col("c_acctbal").cast("double").alias("c_acctbal"), "c_mktsegment")


SQL_A4 = "SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer"


def a5_null_token_scan(spark, sf):
    c = table(spark, sf, "customer")
    k = F.col("c_custkey")
    seg = (F.when(k % 7 == 0, "Unknown").when(k % 11 == 0, "?").when(k % 13 == 0, " N/A ")
           .otherwise(F.col("c_mktsegment")))
    path = S.scratch_path(spark, "cust-na")
    S.write_csv(c.select("c_custkey", seg.alias("segment")), path)
    plain = S.read_csv(spark, path, na_tokens=[]).select(F.col("c_custkey").cast("bigint").alias("c_custkey"), "segment")
    own = S.read_csv(spark, path, na_tokens=["N/A", "Unknown", "?"]).select(
        F.col("c_custkey").cast("bigint").alias("c_custkey"), F.col("segment").alias("own"))
    return plain.join(own, "c_custkey")  # the default tokens, and those of a table


SQL_A5 = """SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 'Unknown' WHEN c_custkey % 11 = 0 THEN '?' WHEN c_custkey % 13 = 0 THEN NULL
  ELSE c_mktsegment END AS segment, CASE WHEN c_custkey % 7 = 0 OR c_custkey % 11 = 0 OR c_custkey % 13 = 0 THEN NULL
  ELSE c_mktsegment END AS own FROM customer"""


def a3_jsonl_roundtrip(spark, sf):
    e = table(spark, sf, "events")
    path = S.scratch_path(spark, "events-json")
    S.write_jsonl(e, path)
    schema = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
    return S.read_jsonl(spark, path, schema)


SQL_A3 = "SELECT event_id, ts, user_id, event_type, value, props FROM events"


def a6_typed_table_roundtrip(spark, sf):
    o = table(spark, sf, "orders")
    spec = TableSpec(target="o_orderstatus", entity="o_orderkey",
                     kinds={"o_totalprice": "num", "o_orderpriority": "cat"})
    path = S.scratch_path(spark, "orders-table")
    S.write_table(o, path, spec)
    back, spec2 = S.read_table(spark, path)
    if spec2 != spec:
        raise RuntimeError("table spec did not survive the round trip")
    return back.withColumn("target", F.lit(spec2.target))


SQL_A6 = "SELECT *, 'o_orderstatus' AS target FROM orders"


def a8_split_scan(spark, sf):
    o = table(spark, sf, "orders")
    path = S.scratch_path(spark, "orders-split")
    X.stratified_split(o, "o_orderkey", "o_orderpriority", seed=42).write.mode("overwrite").parquet(path)
    df, shares = S.read_split(spark, path, ["o_orderkey"])
    return df.groupBy("split").agg(F.count(F.lit(1)).alias("n"))


SQL_A8 = f"""WITH r AS (SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY {seeded_md5(42, 'o_orderkey')}, o_orderkey) AS pos,
  count(*) OVER (PARTITION BY o_orderpriority) AS m FROM orders)
SELECT CASE WHEN pos <= {ratio('m', 0.7)} THEN 'train' WHEN pos <= {ratio('m', 0.7)} + {ratio('m', 0.1)} THEN 'val' ELSE 'test' END AS split,
  count(*) AS n FROM r GROUP BY 1"""

METRICS = ["train_acc", "val_acc", "test_acc", "val_loss"]
KEYS = ["data_name", "method", "num_train"]


def a10_a11_result_roundtrip(spark, sf):
    runs = runs_frame(spark, sf)
    path = S.scratch_path(spark, "results")
    S.write_results(runs, path, KEYS, "random_state", METRICS)
    flat = S.read_results(spark, path)
    return flat.select(*KEYS, "random_state", *[F.round(m, 6).alias(m) for m in METRICS])


SQL_A10 = f"""WITH runs AS ({RUNS_SQL})
SELECT data_name, method, num_train, random_state, {", ".join(f"round({m}, 6) AS {m}" for m in METRICS)} FROM runs"""


def a10_first_run(spark, sf):
    runs = runs_frame(spark, sf)
    path = S.scratch_path(spark, "results-first")
    S.write_results(runs, path, KEYS, "random_state", METRICS)
    return S.read_results(spark, path, first_only=True).select(*KEYS, "random_state")


SQL_A10B = f"""WITH runs AS ({RUNS_SQL})
SELECT data_name, method, num_train, min(random_state) AS random_state FROM runs GROUP BY 1, 2, 3"""


def a12_result_compile(spark, sf):
    runs = runs_frame(spark, sf)
    root = S.scratch_path(spark, "compiled")
    (runs.write.mode("overwrite").option("header", True)
     .partitionBy("data_name", "method", "num_train", "random_state").csv(root))
    out = S.compile_results(spark, root, {"classification": "test_acc", "regression": "score"})
    return out.select("data_name", "method", "num_train", "random_state", F.round("score", 6).alias("score"))


SQL_A12 = f"""WITH runs AS ({RUNS_SQL})
SELECT data_name, method, num_train, random_state, round(test_acc, 6) AS score FROM runs"""


def a13_vector_scan(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("entity"), "embedding")
    path = S.scratch_path(spark, "vectors")
    e.write.mode("overwrite").parquet(path)
    return S.read_vectors(spark, path, "entity")


SQL_A13 = "SELECT CAST(vec_id AS VARCHAR) AS entity, embedding FROM embeddings"


def h5_merge_shards(spark, sf):
    """Configs spread over 3 shards (E9), each shard's results written apart,
    merged by a multi-path scan and reduced to the best config per dataset."""
    runs = runs_frame(spark, sf).filter("val_acc IS NOT NULL AND val_loss IS NOT NULL")
    cfg = runs.select("method", "num_train").distinct()
    from ..core import positions
    cfg = R.grid_shards(positions(cfg, [], ["method", "num_train"], out="config_idx"), "config_idx", 3)
    tagged = runs.join(cfg, ["method", "num_train"])
    paths = []
    for s in range(3):
        p = S.scratch_path(spark, f"shard{s}")
        S.write_results(tagged.filter(F.col("shard") == s), p, KEYS, "random_state", ["val_acc", "val_loss"])
        paths.append(p)
    merged = S.read_results(spark, paths)
    best = R.best_by(merged.select("data_name", "method", "num_train", "random_state", "val_acc", "val_loss"),
                     ["data_name"], desc=["val_acc"], asc=["val_loss", "num_train", "random_state"])
    return best.select(*[F.round(c, 6).alias(c) if c in ("val_acc", "val_loss") else F.col(c) for c in best.columns])


SQL_H5 = f"""WITH runs AS ({RUNS_SQL})
SELECT data_name, method, num_train, random_state, round(val_acc, 6) AS val_acc, round(val_loss, 6) AS val_loss FROM (
  SELECT *, row_number() OVER (PARTITION BY data_name ORDER BY val_acc DESC, val_loss, num_train, random_state, method DESC) AS rn
  FROM runs WHERE val_acc IS NOT NULL AND val_loss IS NOT NULL) WHERE rn = 1"""


QUERIES = {
    "a1_a7_csv_roundtrip": (a1_a7_csv_roundtrip, SQL_A1),
    "a2_encoding_detect": (a2_encoding_detect, SQL_A2),
    "a4_custom_separator": (a4_custom_separator, SQL_A4),
    "a5_null_token_scan": (a5_null_token_scan, SQL_A5),
    "a3_jsonl_roundtrip": (a3_jsonl_roundtrip, SQL_A3),
    "a6_typed_table_roundtrip": (a6_typed_table_roundtrip, SQL_A6),
    "a8_split_scan": (a8_split_scan, SQL_A8),
    "a10_a11_result_roundtrip": (a10_a11_result_roundtrip, SQL_A10),
    "a10_first_run": (a10_first_run, SQL_A10B),
    "a12_result_compile": (a12_result_compile, SQL_A12),
    "a13_vector_scan": (a13_vector_scan, SQL_A13),
    "h5_merge_shards": (h5_merge_shards, SQL_H5),
}
