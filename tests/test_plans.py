"""Physical-plan properties of registered queries (sf0.001)."""

import __spark_entry__ as entry

from .conftest import SF_SMALL

PAIRWISE = ["c5_tfidf_top1", "c1_knn_exact_top8", "c3_rank2_match", "c4_random_match", "c2_lsh_recall",
            "c14_label_alignment", "p1_join_fa_enriched", "p3_rank_ablation", "d11_ovr_auc", "d20_ensemble",
            "m1_star_edges", "p4_union_da"]


def _plan(spark, name):
    return entry.queries()[name](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()


def test_no_row_cross_products(spark):
    """Pairwise work happens inside blocked kernels, never as joined row pairs:
    no cartesian product or nested-loop join in the similarity queries."""
    bad = [(n, p) for n in PAIRWISE for p in ("CartesianProduct", "BroadcastNestedLoopJoin") if p in _plan(spark, n)]
    assert bad == []


def test_scan_reads_only_needed_columns(spark):
    plan = _plan(spark, "e1_stratified_split_lineitem")
    schemas = [line for line in plan.split("\n") if "ReadSchema" in line]
    assert schemas and all("l_extendedprice" not in s and "l_shipdate" not in s for s in schemas)
