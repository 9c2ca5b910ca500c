"""Text match: terms are counted where the text is read, a single block of searched rows goes to the tasks."""

import math
from collections import Counter

import pytest

from tabweave.operators import ivf
from tabweave.operators import match as M

LEFT = [(1, "a b b c"), (2, "c d"), (3, None), (4, ""), (5, "zz yy xx"), (6, "a a a")]
RIGHT = [(11, "a b"), (12, "c c d"), (13, None), (14, "b a")]


def frames(spark, left=LEFT, right=RIGHT):
    return (spark.createDataFrame(left, "l bigint, t string"), spark.createDataFrame(right, "r bigint, t string"))


def plain(left, right):
    texts = {("l", i): Counter((t or "").split()) for i, t in left} | {("r", i): Counter((t or "").split()) for i, t in right}
    df = Counter(w for c in texts.values() for w in c)
    vec = {k: {w: n * (math.log((1 + len(texts)) / (1 + df[w])) + 1) for w, n in c.items()} for k, c in texts.items()}
    unit = {k: {w: x / math.sqrt(sum(y * y for y in v.values())) for w, x in v.items()} for k, v in vec.items()}
    sim = lambda i, j: sum(x * unit["r", j].get(w, 0) for w, x in unit["l", i].items())
    return {i: max((round(sim(i, j), 9), -j) for j, _ in right) for i, _ in left}


def found(got):
    return {r["t1_id"]: (round(r["sim"], 9), -r["t2_id"]) for r in got.collect()}


@pytest.mark.parametrize("sent", [1 << 20, 0])
def test_terms_sent_or_joined(spark, monkeypatch, sent):
    a, b = frames(spark)
    monkeypatch.setattr(M, "SENT_TERMS", sent)
    monkeypatch.setattr(M.weighted, "__defaults__", (sent,))
    assert found(M.text_knn(a, "l", "t", b, "r", "t")) == plain(LEFT, RIGHT)


def test_no_row_a_term_and_no_shuffled_vector(spark):
    a, b = frames(spark)
    plan = M.text_knn(a, "l", "t", b, "r", "t")._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "CoGroup" not in plan


def test_rows_with_one_id_are_one_text(spark):
    a, b = frames(spark, LEFT + LEFT[:2], RIGHT)
    got = M.text_knn(a, "l", "t", b, "r", "t")
    assert got.count() == len(LEFT)
    texts, df = M.term_rows(a.selectExpr("1 side", "l id", "t text"))
    assert texts.count() == len(LEFT) + 2
    assert {tuple(r["tf"]) for r in texts.filter("id = 2").collect()} == {(2, 2)}
    assert df.agg({"df": "sum"}).first()[0] == 3 + 2 + 3 + 1


def test_known_bound_prunes_but_loses_nothing(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 5)).round(1)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id bigint, e array<float>")
    index = ivf.VectorIndex(df, "id", "e", cells=12, block_rows=64)
    assert dict(index.rows.dtypes)["vec"] == "array<float>"
    got = {}
    for r in ivf.pivot_knn(df, "id", "e", index, 1, 4, True).collect():
        got.setdefault(r["t1_id"], []).append((r["rank"], round(r["sim"], 9)))
    y = x.astype(np.float32).astype(np.float64)
    y = y / np.sqrt((y * y).sum(1, keepdims=True))
    sims = y @ y.T
    np.fill_diagonal(sims, -np.inf)
    for i in range(300):
        assert [s for _, s in sorted(got[i])] == pytest.approx(np.sort(sims[i])[::-1][:4].tolist(), abs=1e-8)
