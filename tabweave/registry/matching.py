"""Matching queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..core import table
from ..functions.vectors import cosine
from ..operators import match as M
from ..operators.cuts import exact_quantiles
from ..operators.encoder import HashingEncoder
from ..operators.ivf import MAX_CELLS, VectorIndex, ivf_knn, ivf_routes, pivot_knn
from ..plans.join_fa import encoded_pair, join_fa_text
from .sqlparts import seeded_uint, tfidf_top1, vector_topk

TEXT_T1 = "SELECT doc_id AS id, text FROM documents"
TEXT_T2 = "SELECT item_id AS id, text FROM benchmark"
VEC = "SELECT vec_id AS id, embedding AS e FROM embeddings"


def _emb(spark, sf):
    return table(spark, sf, "embeddings")


# ---------------------------------------------------------------- C5 / P1
def c5_tfidf_top1(spark, sf):
    t1, t2 = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    m = M.text_knn(t1, "doc_id", "text", t2, "item_id", "text", k=1)
    return m.select("t1_id", "t2_id", F.round("sim", 6).alias("cosine_similarity"))


SQL_C5 = f"WITH {tfidf_top1(TEXT_T1, TEXT_T2)} SELECT t1_id, t2_id, round(sim, 6) AS cosine_similarity FROM best"

MAPPING_SQL = f"""WITH {tfidf_top1(TEXT_T1, TEXT_T2)},
mapping AS (
  SELECT d.doc_id AS t1_index, b.item_id AS t2_index, d.text AS t1_text, b.text AS t2_text,
         round(best.sim, 6) AS cosine_similarity, round(1 - round(best.sim, 6), 6) AS cosine_distance
  FROM documents d LEFT JOIN best ON best.t1_id = d.doc_id LEFT JOIN benchmark b ON b.item_id = best.t2_id)"""


def p1_join_fa_mapping(spark, sf):
    return join_fa_text(spark, sf)["mapping"]


def p1_join_fa_enriched(spark, sf):
    return join_fa_text(spark, sf)["enriched"]


def c9_matched_aux(spark, sf):
    return join_fa_text(spark, sf)["matched"]


def d2_match_stats(spark, sf):
    return join_fa_text(spark, sf)["stats"]


def d3_similarity_buckets(spark, sf):
    return join_fa_text(spark, sf)["buckets"]


def c6_threshold_mapping(spark, sf):
    return join_fa_text(spark, sf, threshold=0.3)["mapping"]


SQL_P1_MAPPING = MAPPING_SQL + " SELECT * FROM mapping"
SQL_P1_ENRICHED = f"""WITH {tfidf_top1(TEXT_T1, TEXT_T2)}
SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, b.item_id, b.text AS t2_text
FROM documents d LEFT JOIN best ON best.t1_id = d.doc_id LEFT JOIN benchmark b ON b.item_id = best.t2_id"""
SQL_C9 = f"""WITH {tfidf_top1(TEXT_T1, TEXT_T2)}
SELECT d.doc_id AS t1_index, b.item_id, b.text
FROM documents d LEFT JOIN best ON best.t1_id = d.doc_id LEFT JOIN benchmark b ON b.item_id = best.t2_id"""
SQL_D2 = MAPPING_SQL + """
SELECT count(*) AS n_rows, count(t2_index) AS n_matched, count(DISTINCT t2_index) AS n_distinct_t2,
       round(avg(cosine_similarity), 6) AS mean_similarity, round(median(cosine_similarity), 6) AS median_similarity,
       round(min(cosine_similarity), 6) AS min_similarity, round(max(cosine_similarity), 6) AS max_similarity
FROM mapping"""
SQL_D3 = MAPPING_SQL + """
SELECT CAST(count_if(cosine_similarity > 0.8) AS BIGINT) AS n_above_08,
       CAST(count_if(cosine_similarity >= 0.5 AND cosine_similarity <= 0.8) AS BIGINT) AS n_05_to_08,
       CAST(count_if(cosine_similarity < 0.5) AS BIGINT) AS n_below_05
FROM mapping WHERE t2_index IS NOT NULL"""
SQL_C6 = f"""WITH {tfidf_top1(TEXT_T1, TEXT_T2)},
thr AS (SELECT t1_id, CASE WHEN sim >= 0.3 THEN t2_id END AS t2_id, sim FROM best)
SELECT d.doc_id AS t1_index, b.item_id AS t2_index, d.text AS t1_text, b.text AS t2_text,
       round(thr.sim, 6) AS cosine_similarity, round(1 - round(thr.sim, 6), 6) AS cosine_distance
FROM documents d LEFT JOIN thr ON thr.t1_id = d.doc_id LEFT JOIN benchmark b ON b.item_id = thr.t2_id"""


# ---------------------------------------------------------------- C1 / C3 / C4 / C8 / C10 / P3
def c1_knn_exact_top8(spark, sf):
    e = _emb(spark, sf)
    m = M.vector_knn(e, "vec_id", "embedding", e, "vec_id", "embedding", k=8, exclude_same_id=True)
    return m.select("t1_id", "t2_id", "rank", F.round("sim", 6).alias("cosine_similarity"))


SQL_C1 = f"WITH {vector_topk(VEC, 8)} SELECT t1_id, t2_id, rank, round(sim, 6) AS cosine_similarity FROM knn"


def c3_rank2_match(spark, sf):
    e = _emb(spark, sf)
    knn = M.vector_knn(e, "vec_id", "embedding", e, "vec_id", "embedding", k=2, exclude_same_id=True)
    return M.rank_match(knn, 2).select("t1_id", "t2_id", "rank", F.round("sim", 6).alias("cosine_similarity"))


SQL_C3 = f"WITH {vector_topk(VEC, 2)} SELECT t1_id, t2_id, rank, round(sim, 6) AS cosine_similarity FROM knn WHERE rank = 2"


def c4_random_match(spark, sf):
    e = _emb(spark, sf)
    m = M.random_match(e, "vec_id", e, "vec_id", seed=42)
    a = e.select(F.col("vec_id").alias("t1_id"), F.col("embedding").alias("a"))
    b = e.select(F.col("vec_id").alias("t2_id"), F.col("embedding").alias("b"))
    return (m.join(a, "t1_id").join(b, "t2_id")
            .select("t1_id", "t2_id", F.round(cosine("a", "b"), 6).alias("cosine_similarity")))


SQL_C4 = f"""WITH n AS (SELECT count(*) AS n FROM embeddings),
idx AS (SELECT vec_id AS t2_id, row_number() OVER (ORDER BY vec_id) - 1 AS slot FROM embeddings),
draw AS (SELECT vec_id AS t1_id, {seeded_uint(42, 'vec_id')} % (SELECT n FROM n) AS slot FROM embeddings),
v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS nrm FROM embeddings)
SELECT draw.t1_id, idx.t2_id,
       round(CASE WHEN a.nrm = 0 OR b.nrm = 0 THEN 0.0 ELSE list_dot_product(a.e, b.e) / (a.nrm * b.nrm) END, 6) AS cosine_similarity
FROM draw JOIN idx USING (slot) JOIN v a ON a.vec_id = draw.t1_id JOIN v b ON b.vec_id = idx.t2_id"""


def c8_enrich_rank1_drop(spark, sf):
    """P3 rank-1 table: each vector widened with its nearest other vector's
    columns; the aux ``embedding`` column is dropped first (C10)."""
    e = _emb(spark, sf)
    knn = M.vector_knn(e, "vec_id", "embedding", e, "vec_id", "embedding", k=1, exclude_same_id=True)
    t1 = e.select("vec_id", "label")
    return M.enrich(t1, "vec_id", e, "vec_id", knn, prefix="t2_", drop_t2=["embedding", "absent_col"])


SQL_C8 = f"""WITH {vector_topk(VEC, 1)}
SELECT e.vec_id, e.label, b.vec_id AS t2_vec_id, b.label AS t2_label
FROM embeddings e LEFT JOIN knn ON knn.t1_id = e.vec_id LEFT JOIN embeddings b ON b.vec_id = knn.t2_id"""


def c2_lsh_recall(spark, sf):
    """C2 approximate 1-NN against the exact one: every vector has a match, no match
    is better than the exact one, and at least nine in ten are it."""
    e = _emb(spark, sf)
    dim = len(e.select("embedding").first()[0])
    approx = M.lsh_knn(e, "vec_id", "embedding", e, "vec_id", "embedding", dim=dim, exclude_same_id=True)
    exact = M.vector_knn(e, "vec_id", "embedding", e, "vec_id", "embedding", k=1, exclude_same_id=True)
    both = exact.select("t1_id", F.col("t2_id").alias("exact_t2"), F.col("sim").alias("exact_sim")).join(
        approx.select("t1_id", F.col("t2_id").alias("lsh_t2"), F.col("sim").alias("lsh_sim")), "t1_id", "left")
    hit = F.avg((F.col("lsh_t2") == F.col("exact_t2")).cast("double"))
    return both.agg(F.count(F.lit(1)).alias("n_rows"), F.count("lsh_t2").alias("n_matched"),
                    F.count_if(F.col("lsh_sim") > F.col("exact_sim") + 1e-9).alias("n_better"), (hit >= 0.9).alias("recall_ok"))


SQL_C2 = "SELECT count(*) AS n_rows, count(*) AS n_matched, CAST(0 AS BIGINT) AS n_better, true AS recall_ok FROM embeddings"


IVF_CELL_ROWS, IVF_SHARE = 3, 0.18  # rows a cell and share of the cells probed: these vectors have hardly any clusters


def c2_ivf_recall(spark, sf):
    """C2 by an inverted file, against the exact match of every vector: how many rows are matched, that no score is
    better than the exact one or differs from the cosine of its pair, a recall of 0.9, and less than a fifth of all pairs scored."""
    e = _emb(spark, sf)
    n = e.count()
    cells = min(MAX_CELLS, max(1, -(-n // IVF_CELL_ROWS)))
    index = VectorIndex(e, "vec_id", "embedding", cells)
    nprobe = int(cells * IVF_SHARE)
    approx = ivf_knn(e, "vec_id", "embedding", index, nprobe, exclude_same_id=True)
    pairs = index.pairs(ivf_routes(index, e, "vec_id", "embedding", nprobe, exclude_same_id=True, packed=True))
    exact = pivot_knn(e, "vec_id", "embedding", index, exclude_same_id=True)
    a = e.select(F.col("vec_id").alias("t1_id"), F.col("embedding").alias("a"))
    b = e.select(F.col("vec_id").alias("ivf_t2"), F.col("embedding").alias("b"))
    both = exact.select("t1_id", F.col("t2_id").alias("exact_t2"), F.col("sim").alias("exact_sim")).join(
        approx.select("t1_id", F.col("t2_id").alias("ivf_t2"), F.col("sim").alias("ivf_sim")), "t1_id", "left").join(a, "t1_id").join(b, "ivf_t2", "left")
    hit = F.avg((F.col("ivf_t2") == F.col("exact_t2")).cast("double"))
    return both.agg(F.count(F.lit(1)).alias("n_rows"), F.count("ivf_t2").alias("n_matched"),
                    F.count_if(F.col("ivf_sim") > F.col("exact_sim") + 1e-9).alias("n_better"),
                    F.count_if(F.abs(F.col("ivf_sim") - cosine("a", "b")) > 1e-6).alias("n_wrong"),
                    F.round(F.sum("exact_sim"), 3).alias("exact_total"), (hit >= 0.9).alias("recall_ok"),
                    F.lit(pairs * 5 < n * n).alias("pairs_ok"))


SQL_C2_IVF = f"""WITH {vector_topk(VEC, 1)}
SELECT count(*) AS n_rows, count(*) AS n_matched, CAST(0 AS BIGINT) AS n_better, CAST(0 AS BIGINT) AS n_wrong,
       round(sum(sim), 3) AS exact_total, true AS recall_ok, true AS pairs_ok FROM knn"""


SHARES = [0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0]


def d2_similarity_quantiles(spark, sf):
    """Exact quantiles of the similarities as computed, per label of the vector that is matched."""
    e = _emb(spark, sf)
    knn = M.vector_knn(e, "vec_id", "embedding", e, "vec_id", "embedding", k=8, exclude_same_id=True)
    sims = knn.join(e.select(F.col("vec_id").alias("t1_id"), "label"), "t1_id").checkpoint(eager=True)
    return exact_quantiles(sims, ["label"], "sim", SHARES).select("label", "m", *[F.round(F.col("quantiles")[i], 6).alias(f"q{int(p * 100)}") for i, p in enumerate(SHARES)])


SQL_D2_Q = f"""WITH {vector_topk(VEC, 8)}
SELECT label, count(*) AS m, """ + ", ".join(f"round(quantile_cont(sim, {p}), 6) AS q{int(p * 100)}" for p in SHARES) + """
FROM knn JOIN embeddings ON vec_id = t1_id GROUP BY label"""


def p1_join_fa_encoded(spark, sf):
    """Join-FA over encoded texts: the nearest item of each document, and whether the match through the lists of an inverted
    file is as near (recall at 0.9 over all documents)."""
    t1, t2 = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    left, right = encoded_pair(t1, "doc_id", "text", t2, "item_id", "text", HashingEncoder(16))
    index = VectorIndex(right, "item_id", "_vec")
    exact = pivot_knn(left, "doc_id", "_vec", index).checkpoint(eager=True)
    near = ivf_knn(left, "doc_id", "_vec", index, nprobe=8).select("t1_id", F.col("sim").alias("near_sim"))
    both = exact.join(near, "t1_id", "left").withColumn("as_near", F.coalesce(F.col("near_sim") >= F.col("sim") - 1e-9, F.lit(False)))
    both = both.checkpoint(eager=True)
    recall = both.agg(F.avg(F.col("as_near").cast("double"))).first()[0]
    return both.select(F.col("t1_id").alias("t1_index"), F.col("t2_id").alias("t2_index"), F.round("sim", 6).alias("cosine_similarity"),
                       F.col("near_sim").isNotNull().alias("matched"), F.lit(bool(recall is None or recall >= 0.9)).alias("recall_ok"))


SQL_P1_ENCODED = f"""WITH rows AS (SELECT 1 AS side, doc_id AS id, text FROM documents UNION ALL SELECT 2, item_id, text FROM benchmark),
c AS (SELECT side, id, string_split(' ' || lower(coalesce(text, '')) || ' ', '') AS c FROM rows),
g AS (SELECT side, id, unnest(list_transform(range(1, len(c) - 1), lambda i: c[i] || c[i + 1] || c[i + 2])) AS g FROM c),
n AS (SELECT side, id, g, count(*) AS n FROM g GROUP BY side, id, g),
h AS (SELECT g, ('0x' || substr(md5(g), 1, 8))::BIGINT % 16 AS b,
             CASE WHEN ('0x' || substr(md5(g), 9, 1))::INTEGER < 8 THEN 1.0 ELSE -1.0 END AS w FROM (SELECT DISTINCT g FROM n)),
v AS (SELECT side, id, b, sum(n * w)::DOUBLE AS w FROM n JOIN h USING (g) GROUP BY side, id, b),
u AS (SELECT side, id, b, w / sqrt(sum(w * w) OVER (PARTITION BY side, id)) AS w FROM v QUALIFY sum(w * w) OVER (PARTITION BY side, id) > 0),
pairs AS (SELECT x.id AS t1, y.id AS t2, sum(x.w * y.w) AS sim FROM u x JOIN u y ON x.b = y.b AND x.side = 1 AND y.side = 2 GROUP BY ALL),
every AS (SELECT doc_id AS t1, item_id AS t2, coalesce(sim, 0) AS sim FROM documents CROSS JOIN benchmark LEFT JOIN pairs ON t1 = doc_id AND t2 = item_id),
best AS (SELECT * FROM every QUALIFY row_number() OVER (PARTITION BY t1 ORDER BY sim DESC, t2) = 1)
SELECT t1 AS t1_index, t2 AS t2_index, round(sim, 6) AS cosine_similarity, true AS matched, true AS recall_ok FROM best"""


QUERIES = {
    "c5_tfidf_top1": (c5_tfidf_top1, SQL_C5),
    "p1_join_fa_mapping": (p1_join_fa_mapping, SQL_P1_MAPPING),
    "p1_join_fa_enriched": (p1_join_fa_enriched, SQL_P1_ENRICHED),
    "c9_matched_aux": (c9_matched_aux, SQL_C9),
    "d2_match_stats": (d2_match_stats, SQL_D2),
    "d2_similarity_quantiles": (d2_similarity_quantiles, SQL_D2_Q),
    "d3_similarity_buckets": (d3_similarity_buckets, SQL_D3),
    "c6_threshold_mapping": (c6_threshold_mapping, SQL_C6),
    "c1_knn_exact_top8": (c1_knn_exact_top8, SQL_C1),
    "c3_rank2_match": (c3_rank2_match, SQL_C3),
    "c4_random_match": (c4_random_match, SQL_C4),
    "c8_enrich_rank1_drop": (c8_enrich_rank1_drop, SQL_C8),
    "c2_lsh_recall": (c2_lsh_recall, SQL_C2),
    "c2_ivf_recall": (c2_ivf_recall, SQL_C2_IVF),
    "p1_join_fa_encoded": (p1_join_fa_encoded, SQL_P1_ENCODED),
}
