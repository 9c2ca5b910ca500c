"""Vector lists in tiles: few groups at any size, copies and repeated ids, the same matches as a plain product."""

import numpy as np
import pytest

from tabweave.operators import ivf
from tabweave.operators import match as M


def test_groups_do_not_grow_with_the_table(spark, monkeypatch):
    """Every row goes to most groups: their number must not follow the table."""
    made = []

    class Index(ivf.VectorIndex):
        def __init__(self, *args, **kw):
            super().__init__(*args, **kw)
            made.append(len(set(self.cells.group.tolist()) - {int(self.cells.group[-1])}))

    monkeypatch.setattr(M, "VectorIndex", Index)
    x = np.random.default_rng(0).normal(size=(400, 5))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, e array<double>")
    M.vector_knn(df, "id", "e", df, "id", "e", k=2, exclude_same_id=True, block_rows=10)
    assert 1 <= made[0] <= 8


def frames(x, ids, cells, open_cells, kth):
    left = ivf.pd.DataFrame({"id": ids, "vec": list(x), "kth": kth, "cells": open_cells})
    return left, ivf.pd.DataFrame({"id": ids, "vec": list(x), "cell": cells})


@pytest.mark.parametrize("k, known", [(1, False), (4, False), (4, True)])
def test_tiles_copies_and_repeated_ids(monkeypatch, k, known):
    monkeypatch.setattr(ivf, "TILE_ROWS", 16)
    monkeypatch.setattr(ivf, "TILE", 24)
    monkeypatch.setattr(ivf, "SMALL", 3)
    monkeypatch.setattr(ivf, "FOLD", 50)
    rng = np.random.default_rng(k)
    x = rng.normal(size=(120, 5)).round(1)
    x[30:70] = x[3]  # many copies
    ids = np.arange(120)
    ids[31:33] = 30  # an id that comes three times
    cells = np.array([int(abs(v[0]) * 3) for v in x])
    opened = [sorted(rng.choice(np.arange(9), rng.integers(1, 9), replace=False).tolist()) for _ in x]
    unit = x / np.sqrt((x * x).sum(1, keepdims=True))
    sims = unit @ unit.T
    for i in range(120):
        sims[i, [c not in opened[i] for c in cells]] = -np.inf
        sims[i, ids == ids[i]] = -np.inf
    best = np.sort(sims, axis=1)[:, ::-1][:, :k]
    kth = np.where(np.isfinite(best[:, -1]), best[:, -1], -2.0) if known else np.full(120, -2.0)
    left, right = frames(x, ids, cells, opened, kth)
    got = ivf._score_lists(left.drop_duplicates("id"), right, k, True)
    for i in np.unique(ids, return_index=True)[1]:
        rows = got[got["t1_id"] == ids[i]]
        want = best[i][np.isfinite(best[i])]
        assert np.allclose(np.sort(rows["sim"].to_numpy())[::-1], want)
        ties = [(round(-s, 9), t) for s, t in zip(rows["sim"], rows["t2_id"])]
        full = sorted((round(-s, 9), t) for s, t in zip(sims[i], ids) if np.isfinite(s))
        assert sorted(ties) == full[:len(ties)]
