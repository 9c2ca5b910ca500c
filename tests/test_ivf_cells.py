"""An inverted file of very many cells: nothing that grows with rows x cells is sorted, sent as lists or trained in one task."""

import numpy as np
import pytest

from tabweave.operators import ivf


def lloyd(x, cells, rounds=10, seed=42):
    centres = x[np.random.default_rng(seed).choice(len(x), cells, replace=False)]
    for _ in range(rounds):
        own = (x @ centres.T).argmax(1)
        total = np.zeros_like(centres)
        np.add.at(total, own, x)
        n = np.linalg.norm(total, axis=1, keepdims=True)
        centres = np.where(n > 0, total / np.where(n > 0, n, 1), centres)
    return centres


def frame(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id bigint, vec array<double>")


def test_sample_stays_in_the_tasks(spark, monkeypatch):
    """Rounds over rows dealt to the tasks end at the centres of plain Lloyd, as those of one task do."""
    x = np.random.default_rng(5).standard_normal((300, 6))
    x[17] = 0
    unit = ivf._l2(x)
    df = frame(spark, x)
    one = ivf.train_centres(df, "id", "vec", 80)
    monkeypatch.setattr(ivf, "TRAIN_PAIRS", 0)
    spread = ivf.train_centres(df, "id", "vec", 80)
    order = [r["id"] for r in df.filter("id != 17").orderBy(ivf.seeded_uint(42, "id"), "id").collect()]
    assert np.allclose(one, lloyd(unit[order], 80)) and np.allclose(spread, one)


def test_without_block_rows_few_groups(spark, monkeypatch):
    monkeypatch.setattr(ivf, "DEFAULT_BLOCK_ROWS", 10)
    x = np.random.default_rng(0).standard_normal((400, 5))
    index = ivf.VectorIndex(frame(spark, x), "id", "vec", 100)
    assert 1 <= len(index.cells.groups[0]) <= ivf.INDEX_GROUPS


@pytest.mark.parametrize("nprobe, least", [(1, 1), (7, 2), (2, 9), (30, 3), (100, 1)])
def test_probes_are_the_nearest(nprobe, least):
    """Ties and empty cells too: as a sort of every row's cells says."""
    rng = np.random.default_rng(nprobe)
    size = rng.integers(0, 4, 40)
    cells = ivf.Cells(np.zeros((39, 2)), size, np.zeros(40), rng.integers(0, 5, 40))
    sims = rng.standard_normal((50, len(cells.held))).round(1)
    got = cells.probes(sims.astype(np.float32), nprobe, least)
    for row, mask in zip(sims.astype(np.float32), got):
        order = np.argsort(-row, kind="stable")
        before = np.cumsum(size[cells.held[order]]) - size[cells.held[order]]
        assert set(np.flatnonzero(mask)) == set(order[(np.arange(len(order)) < nprobe) | (before < least)])


def test_a_bit_a_cell(spark):
    """A routed row has a bit for each cell of the group, not a number, and names the same cells."""
    x = np.random.default_rng(1).standard_normal((300, 6))
    x[:3] = 0  # a cell of their own; as searching rows they are left out
    df = frame(spark, x)
    index = ivf.VectorIndex(df, "id", "vec", cells=90, block_rows=100)
    packed, plain = (ivf.ivf_routes(index, df, "id", "vec", 40, 1, True, packed=p) for p in (True, False))
    group, first = index.cells.groups
    named = {}
    for r in packed.collect():
        g = list(group).index(r["grp"])
        held = index.cells.held[first[g]:first[g + 1]]
        assert len(r["bits"]) == -(-len(held) // 8)
        named[r["id"], r["grp"]] = held[ivf._unpacked([r["bits"]])[0, :len(held)]].tolist()
    assert named == {(r["id"], r["grp"]): list(r["cells"]) for r in plain.collect()}
    assert {i for i, _ in named} == set(range(3, 300))
    assert index.pairs(packed) == index.pairs(plain) == sum(int(index.cells.size[c]) for v in named.values() for c in v)


def test_no_cell_with_a_better_row_is_ruled_out():
    rng = np.random.default_rng(3)
    x = ivf._l2(np.repeat(rng.standard_normal((12, 6)), 20, axis=0) + 0.1 * rng.standard_normal((240, 6)))
    centres = ivf.kmeans(x, 20)
    own = (x @ centres.T).argmax(1)
    least = np.array([min([1.0, *(x[own == c] @ centres[c])]) for c in range(20)] + [1.0])
    cells = ivf.Cells(centres, np.append(np.bincount(own, minlength=20), 2), np.arccos(np.clip(least, -1, 1)), rng.integers(0, 4, 21))
    q = ivf._l2(np.concatenate([x[::5], rng.standard_normal((50, 6))]))
    sims = q @ x.T
    for kth in (np.sort(sims, axis=1)[:, -1], np.sort(sims, axis=1)[:, -9], np.full(len(q), -2.0), np.full(len(q), -1.0)):
        may = cells.may_hold(cells.near_held(q), kth)
        for at, c in enumerate(cells.held):
            best = np.zeros(len(q)) if c == 20 else sims[:, own == c].max(1)
            assert may[best >= kth, at].all()
    assert cells.may_hold(cells.near_held(q), np.sort(sims, axis=1)[:, -1]).mean() < 0.5  # and most are


@pytest.mark.parametrize("k, share", [(1, 32), (3, 32), (3, 10**9)])
def test_wanted_pairs_one_by_one(monkeypatch, k, share):
    """Rows that ask for a few cells among many get the same matches with and without a product of all."""
    monkeypatch.setattr(ivf, "SPARSE", share)
    rng = np.random.default_rng(k)
    x = rng.standard_normal((400, 5)).round(1)
    cell = rng.integers(0, 200, 400)
    asked = [sorted(rng.choice(200, 2, replace=False).tolist()) for _ in range(400)]
    left = ivf.pd.DataFrame({"id": range(400), "vec": list(x), "cells": asked})
    got = ivf._score_lists(left, ivf.pd.DataFrame({"id": range(400), "vec": list(x), "cell": cell}), k, True)
    unit = ivf._l2(x)
    for i in range(400):
        of = [j for j in range(400) if cell[j] in asked[i] and i != j]
        want = sorted((-round(float(unit[i] @ unit[j]), 9), j) for j in of)[:k]
        rows = got[got["t1_id"] == i]
        assert sorted((-round(s, 9), j) for s, j in zip(rows["sim"], rows["t2_id"])) == want
