"""Terms beyond those that go to every task: one number where only one text has them, else joined."""

import math

import pytest

from tabweave.operators import match as M

TEXTS = [(1, "a b b c u1"), (2, "c d u2 u3"), (3, None), (4, ""), (5, "a b c d e u4"), (6, "a a e"), (7, "a")]


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("sent, joined", [(100, False), (5, False), (3, True), (0, True)])
def test_only_rare_terms_are_joined(spark, sent, joined):
    corpus = spark.createDataFrame(TEXTS, "id bigint, text string").selectExpr("1 side", "id", "text")
    texts, idf = M._texts_and_idf(corpus, "word")
    got = M.weighted(texts, idf, sent)
    assert ("Join" in plan(got)) == joined
    words = {i: (t or "").split() for i, t in TEXTS}
    df = {w: sum(w in x for x in words.values()) for x in words.values() for w in x}
    rows = {r["id"]: r for r in got.collect()}
    assert set(rows) == set(words)
    for i, x in words.items():
        want = sorted(x.count(w) * (math.log((1 + len(TEXTS)) / (1 + df[w])) + 1) for w in set(x))
        assert sorted(rows[i]["w"]) == pytest.approx(want)
        assert rows[i]["tok"] == sorted(rows[i]["tok"])
        assert rows[i]["nrm"] == pytest.approx(math.sqrt(sum(v * v for v in want)))
