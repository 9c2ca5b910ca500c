"""Cuts and quantiles of an order against a plain sort."""

import math
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabweave.operators import cuts
from tabweave.operators import split as X
from tabweave.operators.aggregate import match_statistics


def made(spark, n=900, keys=1 << 60, seed=0):
    rng = random.Random(seed)
    rows = [(i, rng.choice(["a", "a", "a", "b", None, f"c{rng.randrange(9)}"]), rng.randrange(keys)) for i in range(n)]
    return spark.createDataFrame(rows, "id bigint, g string, k bigint"), rows


def plain(rows, limits):
    groups = {}
    for i, g, k in rows:
        groups.setdefault(g, []).append((k, i))
    out = {}
    for g, members in groups.items():
        for pos, (_, i) in enumerate(sorted(members), 1):
            out[i] = sum(pos > c for c in limits(len(members)))
    return out


@pytest.mark.parametrize("keys, edge_rows", [(1 << 60, 200_000), (1 << 60, 1), (5, 200_000), (5, 3), (1 << 20, 2)])
@pytest.mark.parametrize("by", [["g"], []])
def test_sliced(spark, keys, edge_rows, by):
    df, rows = made(spark, keys=keys)
    got = cuts.sliced(df, by, "k", ["id"], lambda m: [F.lit(0), F.floor(m * 0.3), F.floor(m * 0.3), m - 1, m, m + 5], "s", edge_rows=edge_rows)
    want = plain([(i, g if by else None, k) for i, g, k in rows], lambda m: [0, int(m * 0.3), int(m * 0.3), m - 1, m, m + 5])
    assert {r["id"]: r["s"] for r in got.collect()} == want


def test_sliced_signed_keys_and_sizes(spark):
    rows = [(i, None, v) for i, v in enumerate([-(1 << 63), -5, -1, 0, 3, (1 << 63) - 1])]
    df = spark.createDataFrame(rows, "id bigint, g string, k bigint")
    got = cuts.sliced(df, ["g"], "k", ["id"], lambda m: [F.lit(2), F.lit(4)], "s", key_bits=64, edge_rows=1, size_col="m")
    assert sorted(tuple(r) for r in got.select("id", "s", "m").collect()) == [(0, 0, 6), (1, 0, 6), (2, 1, 6), (3, 1, 6), (4, 2, 6), (5, 2, 6)]
    assert cuts.sliced(df.limit(0), [], "k", ["id"], lambda m: [F.lit(2)], "s").count() == 0
    assert cuts.sliced(df.limit(0), ["g"], "k", ["id"], lambda m: [F.lit(2)], "s").count() == 0


def test_no_sort_of_all_rows(spark):
    """Only the rows around a cut are ranked."""
    df = spark.range(20_000).select("id", (F.xxhash64("id").bitwiseAND(F.lit((1 << 60) - 1))).alias("k"))
    found, shift, big = cuts.intervals(df, [], "k", lambda m: [F.floor(m / 2)], 60, cuts.EDGE_ROWS)
    row = found.first()
    assert row["_n"] < 40 and row["_before"] < 10_000 <= row["_before"] + row["_n"] and not big


def test_double_bits(spark):
    rng = random.Random(2)
    values = [0.0, -0.0, 5e-324, -5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.0, math.nextafter(1, 2), math.nextafter(1, 0), -1.0,
              1.7976931348623157e308, float("inf"), float("-inf"), 2.0 ** 52, 2.0 ** 53 + 2, 1e-310]
    values += [struct.unpack("<d", struct.pack("<Q", rng.randrange(0x7FEFFFFFFFFFFFFF)))[0] * rng.choice([1, -1]) for _ in range(500)]
    values += [2.0 ** e * f for e in range(-1022, 1023, 7) for f in (1.0, math.nextafter(1, 0), 1.5)]
    got = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").select("v", cuts.double_bits(F.col("v")).alias("b")).collect()
    for r in got:
        bits = struct.unpack("<q", struct.pack("<d", abs(r["v"])))[0]
        assert r["b"] == (-bits if r["v"] < 0 else bits), r["v"]


@pytest.mark.parametrize("edge_rows", [200_000, 4, 1])
def test_exact_quantiles(spark, edge_rows):
    rng = np.random.default_rng(4)
    values = np.concatenate([rng.standard_normal(401), np.full(300, 0.25), 10.0 ** rng.integers(-300, 300, 100), [-1e-320]])
    rows = [(int(i % 3), float(v)) for i, v in enumerate(values)] + [(0, None), (9, 1.5), (8, None)]
    df = spark.createDataFrame(rows, "g int, v double")
    shares = [0.0, 0.025, 0.5, 0.77, 1.0]
    got = {r["g"]: r["quantiles"] for r in cuts.exact_quantiles(df, ["g"], "v", shares, edge_rows).collect()}
    assert set(got) == {0, 1, 2, 9}
    for g in (0, 1, 2, 9):
        mine = np.array([v for h, v in rows if h == g and v is not None])
        assert np.allclose(got[g], np.quantile(mine, shares), rtol=1e-12, atol=0)
    assert cuts.exact_quantiles(df.limit(0), ["g"], "v", [0.5]).count() == 0
    assert cuts.exact_quantiles(df.limit(0), [], "v", [0.5]).first()["m"] is None  # one row, as an aggregate without groups


def test_match_statistics_median(spark):
    df = spark.createDataFrame([(1, 0.1), (2, 0.2), (2, 0.4), (None, 0.9)], "t2_index bigint, cosine_similarity double")
    assert tuple(match_statistics(df).first()) == (4, 3, 2, 0.4, 0.3, 0.1, 0.9)
    assert match_statistics(df.limit(0)).first()["median_similarity"] is None


def test_temporal_split_of_each_kind(spark):
    df = spark.range(200).select("id", (F.col("id") % 2).alias("y"), ((F.col("id") * 37) % 50).alias("day")).select(
        "id", "y", F.date_add(F.lit("2024-01-01").cast("date"), F.col("day").cast("int")).alias("d"),
        (F.col("day") / 7 - 3).alias("f"), F.lpad(F.col("day").cast("string"), 3, "0").alias("s"), "day",
        F.when(F.col("day") > 3, F.timestamp_micros(F.col("day") * 1_000_000 - 20_000_000)).alias("t"))
    rows = df.collect()
    for col in ("d", "f", "s", "day", "t"):
        got = {r["id"]: r["split"] for r in X.stratified_split(df, "id", "y", time_col=col).collect()}
        for y in (0, 1):
            order = sorted((r for r in rows if r["y"] == y), key=lambda r: (r[col] is None, r[col] if r[col] is not None else 0, r["id"]))
            assert [got[r["id"]] for r in order] == ["train"] * 70 + ["val"] * 10 + ["test"] * 20


def test_sliced_has_no_lambda_over_the_key(spark):
    """Spark may push a lambda over the rows' key below the join with the cuts, where there is no key."""
    df, _ = made(spark)
    got = cuts.sliced(df, ["g"], "k", ["id"], lambda m: [F.lit(2), m], "s").filter("s = 0").select("id")
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan and "!Filter" not in plan
