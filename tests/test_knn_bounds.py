"""Inverted file, pivots and text bounds against brute force, with the pairs they score counted."""

import numpy as np
import pytest

from tabweave.operators import ivf
from tabweave.operators import match as M


def vectors(spark, x, first=0):
    return spark.createDataFrame([(first + i, [float(v) for v in r]) for i, r in enumerate(x)], "id bigint, vec array<double>")


def exact(a, b, k, same):
    unit = lambda m: m / np.where((n := np.linalg.norm(m, axis=1, keepdims=True)) > 0, n, 1)
    sims = unit(a) @ unit(b).T
    out = {}
    for i, row in enumerate(sims):
        order = [j for j in np.lexsort((np.arange(len(b)), -row.round(12))) if not (same and i == j)][:k]
        out.update({(i, r + 1): (j, round(float(row[j]), 9) + 0.0) for r, j in enumerate(order)})
    return out


def found(df):
    return {(r["t1_id"], r["rank"]): (r["t2_id"], round(r["sim"], 9) + 0.0) for r in df.collect()}


def clustered(n, dim=8, clusters=12, spread=0.02, seed=0):
    rng = np.random.default_rng(seed)
    return rng.standard_normal((clusters, dim))[rng.integers(0, clusters, n)] + spread * rng.standard_normal((n, dim))


@pytest.mark.parametrize("block_rows, k", [(4096, 1), (16, 3)])
def test_pivots_are_exact_and_prune(spark, block_rows, k):
    x = clustered(400)
    df = vectors(spark, x)
    index = ivf.VectorIndex(df, "id", "vec", cells=20, block_rows=block_rows)
    counted = []
    got = ivf.pivot_knn(df, "id", "vec", index, nprobe=1, k=k, exclude_same_id=True, counted=counted)
    assert found(got) == exact(x, x, k, True)
    assert sum(counted) < 0.2 * 400 * 400  # most cells are ruled out
    assert counted[1] < counted[0]


def test_pivots_without_clusters_zero_null_and_repeated_vectors(spark):
    rng = np.random.default_rng(1)
    a, b = rng.standard_normal((60, 5)), rng.standard_normal((90, 5))
    a[7] = 0
    b[[3, 30, 60]] = 0
    b[40:50] = b[0]
    got = found(M.vector_knn(vectors(spark, a), "id", "vec", vectors(spark, b), "id", "vec", k=4, block_rows=10))
    assert got == exact(a, b, 4, False)
    null = spark.createDataFrame([(1, None)], "id bigint, vec array<double>")
    assert M.vector_knn(null, "id", "vec", vectors(spark, b), "id", "vec").count() == 0
    assert M.vector_knn(vectors(spark, a), "id", "vec", null, "id", "vec").count() == 0


def test_every_row_has_its_matches_and_scores_are_exact(spark):
    x = clustered(300, seed=2)
    x[:150] = x[0]  # a hot cell
    df = vectors(spark, x)
    index = ivf.VectorIndex(df, "id", "vec", cells=30, block_rows=40)
    got = found(ivf.ivf_knn(df, "id", "vec", index, nprobe=1, k=3, exclude_same_id=True))
    want = exact(x, x, 300, True)
    sims = {(i, j): s for (i, _), (j, s) in want.items()}
    assert {i for i, _ in got} == set(range(300)) and len(got) == 900
    assert all(abs(sims[i, j] - s) < 1e-8 for (i, _), (j, s) in got.items())
    recall = np.mean([got[i, 1][1] >= want[i, 1][1] - 1e-8 for i in range(300)])
    assert recall >= 0.9
    pairs = index.pairs(ivf.ivf_routes(index, df, "id", "vec", 1, 3, True))
    assert pairs == sum(int(index.cells.size[c]) for r in ivf.ivf_routes(index, df, "id", "vec", 1, 3, True).collect() for c in r["cells"])


def test_bounds_are_upper_bounds():
    rng = np.random.default_rng(3)
    x = ivf._l2(rng.standard_normal((200, 6)))
    centres = ivf.kmeans(x, 9)
    own = (x @ centres.T).argmax(1)
    least = np.array([min([1.0, *(x[own == c] @ centres[c])]) for c in range(9)] + [1.0])
    cells = ivf.Cells(centres, np.append(np.bincount(own, minlength=9), 0), np.arccos(np.clip(least, -1, 1)), np.zeros(10, int))
    q = ivf._l2(rng.standard_normal((50, 6)))
    bound = cells.bound(cells.near(q))
    for c in range(9):
        if (own == c).any():
            assert ((q @ x[own == c].T).max(1) <= bound[:, c]).all()
    assert (bound[:, 9] == -np.inf).all()


def test_too_many_cells(spark):
    with pytest.raises(ValueError):
        ivf.train_centres(vectors(spark, np.ones((2, 2))), "id", "vec", ivf.MAX_CELLS + 1)


@pytest.mark.parametrize("k", [1, 3])
def test_text_bounds_are_exact(spark, k):
    rng = np.random.default_rng(k)
    words = [[f"{g}{i}" for i in range(30)] for g in "abcd"]
    text = lambda g: " ".join(rng.choice(words[g], rng.integers(0, 9)))
    t1 = spark.createDataFrame([(i, text(i % 4)) for i in range(120)] + [(500, ""), (501, None), (502, "nothing known")], "id bigint, text string")
    t2 = spark.createDataFrame([(i, text(i // 40)) for i in range(160)], "id bigint, text string")
    one = M.text_knn(t1, "id", "text", t2, "id", "text", k=k)
    counted = []
    many = M.text_knn(t1, "id", "text", t2, "id", "text", k=k, block_rows=16, tile_rows=4, counted=counted)
    assert found(many) == found(one)
    assert counted[0] < 0.5 * counted[1]  # rows go to few of the blocks
