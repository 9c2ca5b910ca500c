"""The inverted file with many cells: small slices and folded matches give the same exact result."""

import numpy as np

from tabweave.operators import ivf


def test_slices_shrink_with_the_cells():
    assert ivf._slice_rows(10) == ivf.SLICE
    for cells in (5_000, 40_000, ivf.MAX_CELLS):
        assert ivf._slice_rows(cells) * cells <= ivf.SLICE_CELLS


def test_folded_matches_are_the_best(spark, monkeypatch):
    """A block's matches are folded while its lists are read; pairs are counted without a row a cell."""
    monkeypatch.setattr(ivf, "FOLD", 40)
    monkeypatch.setattr(ivf, "SLICE_CELLS", 100)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 6)).round(1)
    left = ivf.pd.DataFrame({"id": range(200), "vec": list(x), "cells": [list(range(20))] * 200})
    right = ivf.pd.DataFrame({"id": range(200), "vec": list(x), "cell": np.arange(200) % 20})
    got = ivf._score_lists(left, right, 3, True)
    unit = x / np.sqrt((x * x).sum(1, keepdims=True))
    sims = unit @ unit.T
    np.fill_diagonal(sims, -np.inf)
    assert got.groupby("t1_id").size().eq(3).all()
    best = np.sort(sims, axis=1)[:, ::-1][:, :3]
    assert np.allclose(got.sort_values(["t1_id", "sim"], ascending=[True, False])["sim"].to_numpy().reshape(200, 3), best)

    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, vec array<double>")
    index = ivf.VectorIndex(df, "id", "vec", cells=10)
    routed = ivf.ivf_routes(index, df, "id", "vec", 10)
    assert index.pairs(routed) == 200 * 200


def test_block_pair_in_slices(spark, monkeypatch):
    """A block pair's similarities are computed some rows at a time."""
    from tabweave.operators import blocked

    seen = []

    def kernel(lp, rp):
        seen.append(len(lp) * len(rp))
        assert len(lp) * len(rp) <= 60
        return blocked.dense_cosine_kernel(lp, rp)

    monkeypatch.setattr(blocked, "MATRIX", 60)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(30, 4))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, vec array<double>")
    real = {}  # the block function runs on the driver, where the limit is set

    from pyspark.sql.pandas.group_ops import PandasCogroupedOps
    apply = PandasCogroupedOps.applyInPandas
    monkeypatch.setattr(PandasCogroupedOps, "applyInPandas", lambda self, f, schema: (real.update(run=f), apply(self, f, schema))[1])
    blocked.blocked_pairs_topk(df, df, [], 2, kernel, "vec array<double>", exclude_same_id=True)
    rows = blocked.pd.DataFrame({"id": range(30), "vec": list(x)})
    got = real["run"](rows, rows)
    unit = x / np.sqrt((x * x).sum(1, keepdims=True))
    sims = unit @ unit.T
    np.fill_diagonal(sims, -np.inf)
    assert len(seen) == 15 and np.allclose(got["sim"].to_numpy().reshape(30, 2), np.sort(sims, axis=1)[:, ::-1][:, :2])
