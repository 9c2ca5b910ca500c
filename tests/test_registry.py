"""Registered queries: every entry runs on the smallest data set, and a sample
with an oracle agrees with DuckDB there (the full check runs at sf0.01 via
scripts/compare.py)."""

import math

import pytest

import __spark_entry__ as entry

from .conftest import SF_SMALL

ORACLE_SAMPLE = ["c5_tfidf_top1", "c1_knn_exact_top8", "e1_stratified_split_lineitem", "p4_union_da",
                 "d10_binary_auc", "d15_run_statistics", "j4_target_encode", "m2_centre_vectors"]


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def _canon(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=lambda t: tuple(str(x) for x in t))


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert "t2_text" in df.columns


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ORACLE_SAMPLE)
def test_oracle_agreement(spark, duck, name):
    sdf = entry.queries()[name](spark, SF_SMALL)
    res = duck.execute(entry.oracle_sql()[name])
    dcols = [d[0] for d in res.description]
    assert sorted(sdf.columns) == sorted(dcols)
    assert _canon([tuple(r) for r in sdf.collect()], sdf.columns) == _canon(res.fetchall(), dcols)
