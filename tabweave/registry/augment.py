"""Alignment / augmentation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..core import table
from ..operators import augment as A
from ..operators import match as M
from ..operators import split as X
from ..plans.join_fa import join_fa, join_fa_text
from ..plans.union_da import join_da, union_da
from .sqlparts import ratio, seeded_md5, tfidf_top1


def _task_aux(spark, sf):
    """Union stand-ins: customer (task, label ``mktsegment``) and supplier
    (aux, label = its nation name); ``c_``/``s_`` prefixes stripped."""
    task = table(spark, sf, "customer")
    task = task.withColumnsRenamed({c: c[2:] for c in task.columns})
    s = table(spark, sf, "supplier")
    n = table(spark, sf, "nation")
    aux = s.join(n, s["s_nationkey"] == n["n_nationkey"]).select(
        F.col("s_suppkey").alias("suppkey"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nationkey"),
        F.col("s_acctbal").alias("acctbal"), F.col("n_name").alias("nation"))
    return task, aux


TASK_SQL = ("SELECT c_custkey AS custkey, c_name AS name, c_nationkey AS nationkey, c_acctbal AS acctbal, "
            "c_mktsegment AS mktsegment FROM customer")
AUX_SQL = ("SELECT s_suppkey AS suppkey, s_name AS name, s_nationkey AS nationkey, s_acctbal AS acctbal, "
           "n.n_name AS nation FROM supplier s JOIN nation n ON n.n_nationkey = s.s_nationkey")
CUST_SPLIT_SQL = f"""SELECT custkey, CASE WHEN pos <= {ratio('m', 0.7)} THEN 'train'
  WHEN pos <= {ratio('m', 0.7)} + {ratio('m', 0.1)} THEN 'val' ELSE 'test' END AS split
  FROM (SELECT custkey, row_number() OVER (PARTITION BY mktsegment ORDER BY {seeded_md5(42, 'custkey')}, custkey) AS pos,
               count(*) OVER (PARTITION BY mktsegment) AS m FROM task WHERE mktsegment IS NOT NULL)"""
LABEL_MAP_SQL = f"""
tl AS (SELECT label, row_number() OVER (ORDER BY label) AS id FROM (
         SELECT DISTINCT trim(mktsegment) AS label FROM task WHERE mktsegment IS NOT NULL AND trim(mktsegment) <> '')),
al AS (SELECT label, row_number() OVER (ORDER BY label) AS id FROM (
         SELECT DISTINCT trim(nation) AS label FROM aux WHERE nation IS NOT NULL AND trim(nation) <> '')),
{tfidf_top1('SELECT id, label AS text FROM al', 'SELECT id, label AS text FROM tl', 'char3')},
lmap AS (SELECT al.label AS aux_label, tl.label AS task_label, best.sim
         FROM best JOIN al ON al.id = best.t1_id JOIN tl ON tl.id = best.t2_id)"""


# ------------------------------------------------------------------ D5 / C14
def d5_label_set_customer(spark, sf):
    return A.label_set(table(spark, sf, "customer"), "c_mktsegment")


SQL_D5 = ("SELECT DISTINCT trim(c_mktsegment) AS label FROM customer "
          "WHERE c_mktsegment IS NOT NULL AND trim(c_mktsegment) <> ''")


def c14_label_alignment(spark, sf):
    task, aux = _task_aux(spark, sf)
    return A.align_labels(A.label_set(task, "mktsegment"), A.label_set(aux, "nation"))


SQL_C14 = f"""WITH task AS ({TASK_SQL}), aux AS ({AUX_SQL}), {LABEL_MAP_SQL}
SELECT aux_label, task_label, round(sim, 6) AS cosine_similarity, round(1 - round(sim, 6), 6) AS cosine_distance FROM lmap"""


# ------------------------------------------------------------------ P4 / H1 / H2
def _p4(spark, sf):
    task, aux = _task_aux(spark, sf)
    split = X.stratified_split(task, "custkey", "mktsegment", seed=42)
    return union_da(task, "custkey", "mktsegment", split, aux, "suppkey", "nation", ratio=0.05, seed=42)


def p4_union_da(spark, sf):
    return _p4(spark, sf)["combined"]


SQL_P4 = f"""WITH task AS ({TASK_SQL}), aux AS ({AUX_SQL}), split AS ({CUST_SPLIT_SQL}), {LABEL_MAP_SQL},
rel AS (SELECT suppkey, name, nationkey, acctbal, lmap.task_label AS mktsegment FROM aux JOIN lmap ON lmap.aux_label = trim(aux.nation)),
budget AS (SELECT least({ratio("(SELECT count(*) FROM split WHERE split = 'train')", 0.05)},
                        (SELECT count(*) FROM aux), (SELECT count(*) FROM rel)) AS n),
picked AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY {seeded_md5(42, 'suppkey')}, suppkey) AS pos FROM rel)
           WHERE pos <= (SELECT n FROM budget))
SELECT t.custkey, t.name, t.nationkey, t.acctbal, t.mktsegment, CAST(NULL AS BIGINT) AS suppkey, s.split
FROM task t LEFT JOIN split s USING (custkey)
UNION ALL SELECT NULL, name, nationkey, acctbal, mktsegment, suppkey, 'train' FROM picked"""


def h1_append_unified(spark, sf):
    """All supplier rows appended to all customer rows on the aligned schema."""
    task, aux = _task_aux(spark, sf)
    cmap = A.align_columns(task.columns, aux.columns, "mktsegment", "nation")
    out, _ = A.append_unified(task, aux, cmap)
    return out


SQL_H1 = f"""WITH task AS ({TASK_SQL}), aux AS ({AUX_SQL})
SELECT custkey, name, nationkey, acctbal, mktsegment, CAST(NULL AS BIGINT) AS suppkey, CAST(NULL AS VARCHAR) AS nation FROM task
UNION ALL SELECT NULL, name, nationkey, acctbal, NULL, suppkey, nation FROM aux"""


def h2_mask_extension(spark, sf):
    return _p4(spark, sf)["combined"].select("custkey", "suppkey", "split")


SQL_H2 = f"SELECT custkey, suppkey, split FROM ({SQL_P4})"


# ------------------------------------------------------------------ H3 / H4
def h3_distinct_keep_first(spark, sf):
    d = table(spark, sf, "documents")
    return A.distinct_keep_first(d.select("doc_id", "text"), ["text"], "doc_id").select("doc_id")


SQL_H3A = "SELECT min(doc_id) AS doc_id FROM documents GROUP BY text"


def h3_drop_duplicate_groups(spark, sf):
    d = table(spark, sf, "documents")
    return A.drop_duplicate_groups(d.select("doc_id", "text"), ["text"]).select("doc_id")


SQL_H3B = "SELECT doc_id FROM documents WHERE text IN (SELECT text FROM documents GROUP BY text HAVING count(*) = 1)"


def h4_multi_source_union(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), F.col("c_nationkey").alias("nationkey"),
                                            F.col("c_acctbal").alias("acctbal"))
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_nationkey").alias("nationkey"),
                                            F.col("s_acctbal").alias("acctbal"))
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("key"), F.col("p_size").alias("nationkey"))
    return A.multi_source_union(c, "acctbal", [(s, "acctbal"), (p, None)])


SQL_H4 = """SELECT c_custkey AS key, c_nationkey AS nationkey, c_acctbal AS acctbal, c_acctbal AS y, 0 AS domain FROM customer
UNION ALL SELECT s_suppkey, s_nationkey, s_acctbal, s_acctbal, 1 FROM supplier WHERE s_acctbal IS NOT NULL
UNION ALL SELECT p_partkey, p_size, NULL, -1.0, 2 FROM part"""


# ------------------------------------------------------------------ C12 / C13 / C16
def c12_entity_attach(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    feats = table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    return A.attach_entity_features(o, "o_custkey", feats, "c_custkey")


SQL_C12 = """SELECT o.o_orderkey, o.o_custkey, f.c_nationkey, f.c_mktsegment FROM orders o LEFT JOIN (
  SELECT c_custkey, min({'c_nationkey': c_nationkey, 'c_mktsegment': c_mktsegment}) AS s FROM customer GROUP BY c_custkey) g
  ON g.c_custkey = o.o_custkey, LATERAL (SELECT g.s.c_nationkey AS c_nationkey, g.s.c_mktsegment AS c_mktsegment) f"""


def c13_dictionary_lookup(spark, sf):
    p = table(spark, sf, "part")
    vectors = p.groupBy(F.lower("p_name").alias("name")).agg(
        F.array(F.round(F.avg("p_retailprice"), 6), F.avg("p_size").cast("double")).alias("vector"))
    return A.dictionary_lookup(p, "p_name", vectors, "name")


SQL_C13 = """WITH v AS (SELECT lower(p_name) AS name, [round(avg(p_retailprice), 6), avg(p_size)::DOUBLE] AS vector
                  FROM part GROUP BY lower(p_name))
SELECT DISTINCT v.name, v.vector FROM part JOIN v ON v.name = lower(part.p_name)"""


def c16_zip_join(spark, sf):
    m = join_fa_text(spark, sf)["matched"].withColumnRenamed("t1_index", "doc_id")
    d = table(spark, sf, "documents").select("doc_id", "lang")
    return A.zip_join(d, m.select("doc_id", "item_id"), "doc_id")


SQL_C16 = f"""WITH {tfidf_top1('SELECT doc_id AS id, text FROM documents', 'SELECT item_id AS id, text FROM benchmark')}
SELECT d.doc_id, d.lang, best.t2_id AS item_id FROM documents d JOIN best ON best.t1_id = d.doc_id"""


# ------------------------------------------------------------------ P5
def _p5_task(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text", "lang")
    task = d.join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")
    return task, X.stratified_split(task, "doc_id", "quality", seed=42)


def p5_join_da(spark, sf):
    """Matched benchmark rows get the quality label of their document and are
    appended to the labelled document table (documents ⟕ labels)."""
    task, split = _p5_task(spark, sf)
    return join_da(task, "doc_id", "quality", split, "item_id", matched=join_fa_text(spark, sf)["matched"], seed=42)["combined"]


def p5_join_da_enriched(spark, sf):
    """The same from the enriched table: its task columns go, its label stays."""
    task, split = _p5_task(spark, sf)
    items = table(spark, sf, "benchmark")
    fa = join_fa(task, "doc_id", "text", items, "item_id", "text", M.text_knn(task, "doc_id", "text", items, "item_id", "text"))
    return join_da(task, "doc_id", "quality", split, "item_id", enriched=fa["enriched"], seed=42)["combined"]


P5_SQL = f"""WITH {tfidf_top1('SELECT doc_id AS id, text FROM documents', 'SELECT item_id AS id, text FROM benchmark')},
task AS (SELECT d.doc_id, d.text, d.lang, l.quality FROM documents d LEFT JOIN labels l USING (doc_id)),
split AS (SELECT doc_id, CASE WHEN pos <= {ratio('m', 0.7)} THEN 'train'
            WHEN pos <= {ratio('m', 0.7)} + {ratio('m', 0.1)} THEN 'val' ELSE 'test' END AS split
          FROM (SELECT doc_id, row_number() OVER (PARTITION BY quality ORDER BY {seeded_md5(42, 'doc_id')}, doc_id) AS pos,
                       count(*) OVER (PARTITION BY quality) AS m FROM task WHERE quality IS NOT NULL)),
rows1 AS (SELECT DISTINCT b.item_id, b.text, t.quality FROM best JOIN benchmark b ON b.item_id = best.t2_id
          JOIN task t ON t.doc_id = best.t1_id WHERE t.quality IS NOT NULL),
budget AS (SELECT least({ratio("(SELECT count(*) FROM split WHERE split = 'train')", 0.3)}, (SELECT count(*) FROM rows1)) AS n),
picked AS (SELECT * FROM (SELECT *, row_number() OVER (
             ORDER BY md5(concat_ws('|', '42', CAST(item_id AS VARCHAR), CAST(quality AS VARCHAR))), item_id, quality) AS pos
           FROM rows1) WHERE pos <= (SELECT n FROM budget))
"""
SQL_P5 = P5_SQL + """SELECT t.doc_id, t.text, t.lang, t.quality, CAST(NULL AS BIGINT) AS item_id, s.split FROM task t LEFT JOIN split s USING (doc_id)
UNION ALL SELECT NULL, text, NULL, quality, item_id, 'train' FROM picked"""
SQL_P5_ENRICHED = P5_SQL + """SELECT t.doc_id, t.text, t.lang, t.quality, CAST(NULL AS BIGINT) AS item_id, CAST(NULL AS VARCHAR) AS t2_text, s.split
FROM task t LEFT JOIN split s USING (doc_id) UNION ALL SELECT NULL, NULL, NULL, quality, item_id, text, 'train' FROM picked"""


QUERIES = {
    "d5_label_set_customer": (d5_label_set_customer, SQL_D5),
    "c14_label_alignment": (c14_label_alignment, SQL_C14),
    "p4_union_da": (p4_union_da, SQL_P4),
    "h1_append_unified": (h1_append_unified, SQL_H1),
    "h2_mask_extension": (h2_mask_extension, SQL_H2),
    "h3_distinct_keep_first": (h3_distinct_keep_first, SQL_H3A),
    "h3_drop_duplicate_groups": (h3_drop_duplicate_groups, SQL_H3B),
    "h4_multi_source_union": (h4_multi_source_union, SQL_H4),
    "c12_entity_attach": (c12_entity_attach, SQL_C12),
    "c13_dictionary_lookup": (c13_dictionary_lookup, SQL_C13),
    "c16_zip_join": (c16_zip_join, SQL_C16),
    "p5_join_da": (p5_join_da, SQL_P5),
    "p5_join_da_enriched": (p5_join_da_enriched, SQL_P5_ENRICHED),
}
