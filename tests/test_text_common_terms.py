"""Text match over several blocks: rare terms joined, common ones once a combination."""

import numpy as np
import pytest

from tabweave.operators import match as M
from tabweave.operators import textbounds


def found(got):
    return {(r["t1_id"], r["rank"]): (r["t2_id"], round(r["sim"], 9)) for r in got.collect()}


@pytest.mark.parametrize("k, room", [(1, 16), (3, 1), (2, 0)])
def test_pairs_do_not_grow_with_the_square(spark, monkeypatch, k, room):
    """Rows that share only common terms, as ``name`` and one of a few numbers, are not all scored with each other."""
    monkeypatch.setattr(textbounds, "PAIRS_A_ROW", room)
    rng = np.random.default_rng(k)
    t1 = [(i, f"name x{i} nation n{i % 7} kind k{i % 3}") for i in range(300)] + [(900, ""), (901, None), (902, "zz"), (3, "name x3 nation n3 kind k0")]
    t2 = [(i, f"name x{rng.integers(0, 400)} y{i % 5} nation n{i % 6}") for i in range(200)] + [(500 + i, "name nation n2") for i in range(9)] + [(7000, None)]
    t1, t2 = spark.createDataFrame(t1, "id bigint, text string"), spark.createDataFrame(t2, "id bigint, text string")
    one = found(M.text_knn(t1, "id", "text", t2, "id", "text", k=k + 12))
    counted = []
    many = found(M.text_knn(t1, "id", "text", t2, "id", "text", k=k, block_rows=16, counted=counted))
    assert {i for i, _ in many} == {i for i, _ in one} and len(many) == 303 * k
    for (i, r), (j, sim) in many.items():
        row = sorted({(-s, t) for (t1_id, _), (t, s) in one.items() if t1_id == i})  # in one block a row that comes twice is matched twice
        assert sim == -row[r - 1][0]  # as near
        if row[-1][0] > -sim:  # all ties were listed: the smaller id
            assert (-sim, j) == row[r - 1]
    if room:
        assert counted[1] == 304 * 210 and counted[0] < counted[1] / 4
