"""Core primitives, splits, samples and set operations on hand-made edge cases."""

from pyspark.sql import functions as F

from tabweave.core import positions, running_sums
from tabweave.operators import augment as A
from tabweave.operators import sample as S
from tabweave.operators import split as X


def _labels(spark, sizes):
    rows, i = [], 0
    for label, n in sizes.items():
        for _ in range(n):
            rows.append((i, label, i % 7))
            i += 1
    return spark.createDataFrame(rows, "id bigint, label string, t int")


def test_positions_hot_group_is_exact_and_spread(spark):
    # one label holds 90% of the rows: ranks must still be 1..m per label
    df = _labels(spark, {"hot": 9000, "a": 600, "b": 400}).withColumn("o", F.md5(F.col("id").cast("string")))
    p = positions(df, ["label"], ["o", "id"], out="pos", size_col="m", num_partitions=16)
    got = {r["label"]: (r["mn"], r["mx"], r["n"], r["m"]) for r in
           p.groupBy("label").agg(F.min("pos").alias("mn"), F.max("pos").alias("mx"),
                                  F.countDistinct("pos").alias("n"), F.first("m").alias("m")).collect()}
    assert got["hot"] == (1, 9000, 9000, 9000)
    assert got["a"] == (1, 600, 600, 600)
    # the hot label was range-partitioned over several partitions
    parts = (df.repartitionByRange(16, "label", "o", "id").filter("label = 'hot'")
             .select(F.spark_partition_id().alias("p")).distinct().count())
    assert parts > 4


def test_positions_match_window(spark):
    df = _labels(spark, {"x": 50, "y": 30}).withColumn("o", F.md5(F.col("id").cast("string")))
    from pyspark.sql import Window
    ref = df.withColumn("ref", F.row_number().over(Window.partitionBy("label").orderBy("o", "id")))
    p = positions(ref, ["label"], ["o", "id"], out="pos")
    assert p.filter("pos != ref").count() == 0


def test_running_sums(spark):
    df = spark.createDataFrame([(g, i, 1) for g in ("a", "b") for i in range(100)], "g string, i int, v int")
    r = running_sums(df, ["g"], ["i"], ["v"], num_partitions=7)
    assert r.filter("cum_v != i + 1").count() == 0


def test_stratified_split_truncation_and_null_label(spark):
    df = _labels(spark, {"c1": 1, "c3": 3, "c9": 9, "c10": 10, "c90": 90})
    df = df.unionByName(spark.createDataFrame([(1000, None, 0)], "id bigint, label string, t int"))
    s = X.stratified_split(df, "id", "label", seed=42).join(df, "id")
    counts = {(r["label"], r["split"]): r["n"] for r in s.groupBy("label", "split").count()
              .withColumnRenamed("count", "n").collect()}
    assert counts[("c90", "train")] == 62  # int(90 * 0.7) truncates the double product
    assert counts[("c90", "val")] == 9
    assert counts[("c10", "train")] == 7 and counts[("c10", "val")] == 1
    assert counts[("c1", "test")] == 1
    assert counts[(None, None)] == 1
    assert s.count() == df.count()


def test_temporal_split_order_and_fallback(spark):
    df = spark.createDataFrame([(i, "a", i // 2) for i in range(10)], "id bigint, label string, ts int")
    s = {r["id"]: r["split"] for r in X.stratified_split(df, "id", "label", time_col="ts").collect()}
    assert [s[i] for i in range(10)] == ["train"] * 7 + ["val"] + ["test"] * 2
    # absent time column: seeded fallback, still 7/1/2
    s2 = X.stratified_split(df, "id", "label", time_col="missing").groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in s2} == {"train": 7, "val": 1, "test": 2}


def test_nested_subsets_nest_and_balance(spark):
    df = _labels(spark, {"a": 40, "b": 20})
    out = X.nested_subsets(df, "id", "label", seed=1, check=True)
    c = {(r["pct"]): r["count"] for r in out.groupBy("pct").count().collect()}
    assert c == {25: 15, 50: 30, 75: 45}


def test_grid_shards_7_in_3(spark):
    from tabweave.operators.runs import grid_shards
    cfg = spark.createDataFrame([(i,) for i in range(7)], "config_idx bigint")
    sizes = sorted(r["count"] for r in grid_shards(cfg, "config_idx", 3).groupBy("shard").count().collect())
    assert sizes == [2, 2, 3]
    first = grid_shards(cfg, "config_idx", 3).filter("shard = 0").count()
    assert first == 3


def test_sample_exact_and_zero(spark):
    df = _labels(spark, {"a": 100})
    assert S.sample_exact(df, "id", 37).count() == 37
    z = S.sample_exact(df, "id", 0)
    assert z.count() == 0 and z.columns == df.columns


def test_drop_duplicate_groups_and_keep_first(spark):
    df = spark.createDataFrame([(1, "x", None), (2, "x", None), (3, "y", 1), (4, "z", 2), (5, "z", 2)],
                               "id int, a string, b int")
    keep = sorted(r["id"] for r in A.distinct_keep_first(df, ["a", "b"], "id").collect())
    assert keep == [1, 3, 4]  # NULLs compare equal inside a duplicate group
    single = sorted(r["id"] for r in A.drop_duplicate_groups(df, ["a", "b"]).collect())
    assert single == [3]


def test_append_unified_and_mask(spark):
    task = spark.createDataFrame([(1, "a", 1.0)], "id int, name string, v double")
    aux = spark.createDataFrame([(9, "b", "2", "x")], "aid int, Name string, v string, extra string")
    cmap = A.align_columns(task.columns, aux.columns)
    assert cmap == {"Name": "name", "v": "v"}
    out, aux_only = A.append_unified(task, aux, cmap)
    assert out.columns == ["id", "name", "v", "aid", "extra"] and aux_only == ["aid", "extra"]
    assert dict(out.dtypes)["v"] == "string"  # int/str clash reconciled to string
    assert out.count() == 2


def test_align_columns_clash_raises(spark):
    import pytest
    with pytest.raises(ValueError):
        A.align_columns(["A b", "a_b"], ["ab"])
    with pytest.raises(ValueError):
        A.align_columns(["ab"], ["A/B", "a-b"])


def test_empty_append_budget():
    assert S.append_budget(10, 0.05, 100) == 0
    assert S.append_budget(1000, 0.3, 100) == 100


def test_holdout_then_val_counts(spark):
    df = _labels(spark, {"a": 50, "b": 30})
    s = {r["split"]: r["count"] for r in X.stratified_holdout_then_val(df, "id", "label", seed=3)
         .groupBy("split").count().collect()}
    # test: ceil(50*.2)=10 + ceil(30*.2)=6; val: int(80*.1)=8 from the remaining train rows
    assert s == {"test": 16, "val": 8, "train": 56}


def test_repeated_kfold_sizes(spark):
    df = _labels(spark, {"a": 11, "b": 7})
    f = X.repeated_kfold(df, "id", k=3, repeats=2, seed=1, label="label").join(df, "id")
    sizes = {(r["repeat"], r["label"], r["fold"]): r["count"] for r in f.groupBy("repeat", "label", "fold").count().collect()}
    assert [sizes[(1, "a", i)] for i in (1, 2, 3)] == [4, 4, 3]  # ntile: remainder to the first folds
    assert [sizes[(2, "b", i)] for i in (1, 2, 3)] == [3, 2, 2]
    assert f.count() == 36


def test_group_split_keeps_groups_together(spark):
    df = spark.createDataFrame([(i, i % 10) for i in range(100)], "id int, g int")
    s = X.group_split(df, "id", "g", num_train=4, seed=2).join(df, "id")
    per_group = s.groupBy("g").agg(F.countDistinct("split").alias("n"), F.first("split").alias("s")).collect()
    assert all(r["n"] == 1 for r in per_group)
    assert sum(1 for r in per_group if r["s"] == "train") == 4


def test_capped_sample_quota(spark):
    df = _labels(spark, {"a": 300, "b": 100})
    out = X.capped_stratified_sample(df, "id", ["label"], fraction=0.5, cap=200, seed=1)
    c = {r["stratum"]: r["count"] for r in out.groupBy("stratum").count().collect()}
    # n=400 > cap: size = 200/400*0.5 = 0.25 per stratum
    assert c == {"a": 75, "b": 25}
