"""Split, subset and sampling queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..core import table
from ..functions.text import reformat_date
from ..operators import sample as S
from ..operators import split as X
from .sqlparts import ratio, seeded_md5

LI_IDS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
LI_H = "md5(concat_ws('|', '42', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR), " \
       "CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR)))"


def _three_way_sql(src: str, ids: str, label: str, order: str) -> str:
    return f"""WITH b AS (SELECT {ids}, {label} AS label, {order} AS o FROM {src}),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY o, {ids}) AS pos,
             count(*) OVER (PARTITION BY label) AS m FROM b WHERE label IS NOT NULL)
SELECT {ids}, CASE WHEN pos <= {ratio('m', 0.7)} THEN 'train'
                   WHEN pos <= {ratio('m', 0.7)} + {ratio('m', 0.1)} THEN 'val' ELSE 'test' END AS split FROM r
UNION ALL SELECT {ids}, CAST(NULL AS VARCHAR) FROM b WHERE label IS NULL"""


# ------------------------------------------------------------------ E1 / P6
def e1_stratified_split_lineitem(spark, sf):
    return X.stratified_split(table(spark, sf, "lineitem"), LI_IDS, "l_returnflag", seed=42)


SQL_E1 = _three_way_sql("lineitem", ", ".join(LI_IDS), "l_returnflag", LI_H)


def p6_mask_customer(spark, sf):
    return X.stratified_split(table(spark, sf, "customer"), "c_custkey", "c_mktsegment", seed=42)


SQL_P6 = _three_way_sql("customer", "c_custkey", "c_mktsegment", seeded_md5(42, "c_custkey"))


def e2_temporal_split_orders(spark, sf):
    """Time column arrives as text (``MM/dd/yyyy hh:mm:ss a``) and is parsed strictly."""
    o = table(spark, sf, "orders")
    o = o.withColumn("o_time", F.to_timestamp(
        reformat_date(F.date_format("o_orderdate", "MM/dd/yyyy hh:mm:ss a"), ["MM/dd/yyyy hh:mm:ss a"], strict=True)))
    return X.stratified_split(o, "o_orderkey", "o_orderpriority", time_col="o_time")


SQL_E2 = _three_way_sql("orders", "o_orderkey", "o_orderpriority", "o_orderdate")


def e3_random_split_orders(spark, sf):
    return X.random_split(table(spark, sf, "orders"), "o_orderkey", seed=42)


SQL_E3 = f"""WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY {seeded_md5(42, 'o_orderkey')}, o_orderkey) AS pos,
                             count(*) OVER () AS n FROM orders)
SELECT o_orderkey, CASE WHEN pos <= {ratio('n', 0.8)} THEN 'train' WHEN pos <= {ratio('n', 0.9)} THEN 'val'
                        ELSE 'test' END AS split FROM r"""


def e4_holdout_then_val_orders(spark, sf):
    return X.stratified_holdout_then_val(table(spark, sf, "orders"), "o_orderkey", "o_orderstatus", seed=42)


SQL_E4 = f"""WITH b AS (SELECT o_orderkey, o_orderstatus AS label, {seeded_md5(42, 'o_orderkey')} AS o FROM orders),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY o, o_orderkey) AS pos,
             count(*) OVER (PARTITION BY label) AS m FROM b),
t AS (SELECT *, pos > m - ceil(m::DOUBLE * 0.2::DOUBLE) AS is_test FROM r),
tr AS (SELECT o_orderkey, row_number() OVER (ORDER BY o, o_orderkey) AS tp, count(*) OVER () AS nt FROM t WHERE NOT is_test)
SELECT o_orderkey, CASE WHEN tp > nt - (SELECT {ratio('count(*)', 0.1)} FROM orders) THEN 'val' ELSE 'train' END AS split FROM tr
UNION ALL SELECT o_orderkey, 'test' FROM t WHERE is_test"""


def e5_group_split_events(spark, sf):
    return X.group_split(table(spark, sf, "events"), "event_id", "user_id", num_train=100, seed=42)


SQL_E5 = f"""WITH g AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS g FROM events),
r AS (SELECT g, row_number() OVER (ORDER BY {seeded_md5(42, 'g')}, g) AS gp FROM g)
SELECT e.event_id, CASE WHEN r.gp <= 100 THEN 'train' ELSE 'test' END AS split
FROM events e JOIN r ON r.g = CAST(e.user_id AS VARCHAR)"""


def e6_repeated_kfold_orders(spark, sf):
    return X.repeated_kfold(table(spark, sf, "orders"), "o_orderkey", k=5, repeats=2, seed=42,
                            label="o_orderpriority")


SQL_E6 = """WITH b AS (SELECT CAST(t.repeat AS INTEGER) AS repeat, o_orderkey, o_orderpriority AS label,
                  md5(concat_ws('|', CAST(t.repeat + 42 AS VARCHAR), CAST(o_orderkey AS VARCHAR))) AS o
           FROM orders CROSS JOIN range(1, 3) t(repeat))
SELECT repeat, o_orderkey, CAST(ntile(5) OVER (PARTITION BY repeat, label ORDER BY o, o_orderkey) AS INTEGER) AS fold FROM b"""


def _nested_sql(src, ids, label, fracs=(0.25, 0.5, 0.75)):
    parts = " UNION ALL ".join(
        f"SELECT {ids}, {int(round(f * 100))} AS pct FROM r WHERE pos <= {ratio('m', f)}" for f in fracs)
    return f"""WITH r AS (SELECT {ids}, row_number() OVER (PARTITION BY {label} ORDER BY {seeded_md5(42, ids)}, {ids}) AS pos,
                    count(*) OVER (PARTITION BY {label}) AS m FROM {src})
{parts}"""


def e7_nested_subsets_orders(spark, sf):
    return X.nested_subsets(table(spark, sf, "orders"), "o_orderkey", "o_orderstatus", seed=42)


def p7_nested_ablation_customer(spark, sf):
    return X.nested_subsets(table(spark, sf, "customer"), "c_custkey", "c_mktsegment", seed=42, check=True)


SQL_E7 = _nested_sql("orders", "o_orderkey", "o_orderstatus")
SQL_P7 = _nested_sql("customer", "c_custkey", "c_mktsegment")


def e8_capped_sample_orders(spark, sf):
    return X.capped_stratified_sample(table(spark, sf, "orders"), "o_orderkey",
                                      ["o_orderstatus", "o_orderpriority"], fraction=0.5, cap=10_000, seed=42)


SQL_E8 = f"""WITH n AS (SELECT count(*) AS n FROM orders),
sz AS (SELECT CASE WHEN n > 10000 THEN 10000::DOUBLE / n::DOUBLE * 0.5::DOUBLE ELSE 0.5::DOUBLE END AS s FROM n),
b AS (SELECT o_orderkey, concat_ws('_', o_orderstatus, o_orderpriority) AS stratum, {seeded_md5(42, 'o_orderkey')} AS o FROM orders),
r AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY o, o_orderkey) AS pos,
             count(*) OVER (PARTITION BY stratum) AS m FROM b)
SELECT o_orderkey, stratum FROM r, sz WHERE pos <= CAST(floor(m::DOUBLE * sz.s) AS INTEGER)"""


# ------------------------------------------------------------------ D4 / H6 / H7 / H8
def _orders_split(spark, sf):
    o = table(spark, sf, "orders")
    return o, X.stratified_split(o, "o_orderkey", "o_orderpriority", seed=42)


SQL_ORDERS_SPLIT = _three_way_sql("orders", "o_orderkey", "o_orderpriority", seeded_md5(42, "o_orderkey"))


def d4_split_summary(spark, sf):
    o, s = _orders_split(spark, sf)
    return X.split_summary(o, "o_orderkey", "o_orderpriority", s)


SQL_D4 = f"""WITH s AS ({SQL_ORDERS_SPLIT}),
j AS (SELECT CAST(o.o_orderpriority AS VARCHAR) AS label, s.split FROM orders o LEFT JOIN s USING (o_orderkey)),
a AS (SELECT label, count(*) AS total, CAST(count_if(split = 'train') AS BIGINT) AS train,
             CAST(count_if(split = 'val') AS BIGINT) AS val, CAST(count_if(split = 'test') AS BIGINT) AS test FROM j GROUP BY label
      UNION ALL SELECT '__all__', count(*), CAST(count_if(split = 'train') AS BIGINT), CAST(count_if(split = 'val') AS BIGINT),
             CAST(count_if(split = 'test') AS BIGINT) FROM j)
SELECT label, total, train, val, test, round(train / total, 6) AS train_share, round(val / total, 6) AS val_share,
       round(test / total, 6) AS test_share FROM a"""


def h7_split_violations(spark, sf):
    o, s = _orders_split(spark, sf)
    return X.split_violations(o, "o_orderkey", s)


SQL_H7 = f"""WITH s AS ({SQL_ORDERS_SPLIT}),
p AS (SELECT o_orderkey, count(*) AS n, count(split) AS k, max(CAST(split = 'test' AS INTEGER)) AS t FROM s GROUP BY o_orderkey),
j AS (SELECT o.o_orderkey AS a, 1 AS in_t, p.* FROM (SELECT o_orderkey FROM orders) o FULL JOIN p USING (o_orderkey))
SELECT CAST(count_if(in_t IS NOT NULL AND coalesce(k, 0) = 0) AS BIGINT) AS missing,
       CAST(count_if(n > 1) AS BIGINT) AS overlapping, CAST(count_if(in_t IS NULL) AS BIGINT) AS unknown_rows, CAST(coalesce(sum(t), 0) = 0 AS INTEGER) AS empty_test FROM j"""


def h6_fit_set(spark, sf):
    o, s = _orders_split(spark, sf)
    return X.fit_set(o, "o_orderkey", s)["fit"].select("o_orderkey", "o_totalprice", "split")


SQL_H6 = f"""WITH s AS ({SQL_ORDERS_SPLIT})
SELECT o.o_orderkey, o.o_totalprice, s.split FROM orders o JOIN s USING (o_orderkey) WHERE s.split IN ('train', 'val')"""


def h8_explicit_split(spark, sf):
    o = table(spark, sf, "orders")
    return X.explicit_split(o, "o_orderkey", o.filter("o_orderstatus = 'F'"), o.filter("o_orderstatus = 'O'"),
                            o.filter("o_orderpriority = '1-URGENT' AND o_orderstatus = 'P'"))


SQL_H8 = """SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'train' WHEN o_orderstatus = 'O' THEN 'test'
  WHEN o_orderpriority = '1-URGENT' AND o_orderstatus = 'P' THEN 'val' END AS split FROM orders"""


# ------------------------------------------------------------------ G2-G4
def g2_seeded_sample_orders(spark, sf):
    return S.sample_exact(table(spark, sf, "orders"), "o_orderkey", n=1000, seed=42).select("o_orderkey", "o_totalprice")


SQL_G2 = f"""SELECT o_orderkey, o_totalprice FROM orders
ORDER BY {seeded_md5(42, 'o_orderkey')}, o_orderkey LIMIT 1000"""


def g3_seeded_shuffle(spark, sf):
    o, s = _orders_split(spark, sf)
    fit = X.fit_set(o, "o_orderkey", s)["fit"]
    return S.seeded_shuffle(fit, "o_orderkey", seed=7).select("o_orderkey", "split", "shuffle_pos")


SQL_G3 = f"""WITH s AS ({SQL_ORDERS_SPLIT})
SELECT o_orderkey, split, row_number() OVER (ORDER BY {seeded_md5(7, 'o_orderkey')}, o_orderkey) AS shuffle_pos
FROM s WHERE split IN ('train', 'val')"""


def g4_balanced_draw_labels(spark, sf):
    return S.balanced_draw(table(spark, sf, "labels"), "doc_id", "quality", n=100, seed=42)


SQL_G4 = f"""SELECT doc_id, quality FROM (
  SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY {seeded_md5(42, 'doc_id')}, doc_id) AS pos
  FROM labels WHERE quality IN (0, 1)) WHERE pos <= 50"""


G5_COLS = ["o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]


def g5_row_chunks(spark, sf):
    """Training rows: orders whose key is no multiple of 7 (an odd number of them)."""
    train = table(spark, sf, "orders").filter("o_orderkey % 7 <> 0")
    return S.row_chunks(train, "o_orderkey", 2, G5_COLS, seed=42)


# Five columns by md5('42|<column>'): two slices of two, one column left for the first
# chunk; each chunk draws one more by md5('42|<chunk>|<column>').
SQL_G5 = """WITH c AS (SELECT * FROM (VALUES ('o_custkey'), ('o_orderstatus'), ('o_totalprice'), ('o_orderdate'), ('o_orderpriority')) t(col)),
dealt AS (SELECT col, (row_number() OVER (ORDER BY md5('42|' || col)) - 1) // 2 AS slice FROM c),
drawn AS (SELECT chunk, col FROM (SELECT k.chunk, d.col, row_number() OVER (PARTITION BY k.chunk ORDER BY md5('42|' || k.chunk || '|' || d.col)) AS rn
            FROM dealt d CROSS JOIN (VALUES (0), (1)) k(chunk) WHERE d.slice <> k.chunk) WHERE rn = 1),
has AS (SELECT slice AS chunk, col FROM dealt WHERE slice < 2 UNION SELECT chunk, col FROM drawn UNION SELECT 0, col FROM dealt WHERE slice = 2),
r AS (SELECT *, CAST(ntile(2) OVER (ORDER BY o_orderkey) - 1 AS INTEGER) AS chunk FROM orders WHERE o_orderkey % 7 <> 0)
SELECT o_orderkey,
  CASE WHEN (chunk, 'o_custkey') IN (SELECT (chunk, col) FROM has) THEN o_custkey END AS o_custkey,
  CASE WHEN (chunk, 'o_orderstatus') IN (SELECT (chunk, col) FROM has) THEN o_orderstatus END AS o_orderstatus,
  CASE WHEN (chunk, 'o_totalprice') IN (SELECT (chunk, col) FROM has) THEN o_totalprice END AS o_totalprice,
  CASE WHEN (chunk, 'o_orderdate') IN (SELECT (chunk, col) FROM has) THEN o_orderdate END AS o_orderdate,
  CASE WHEN (chunk, 'o_orderpriority') IN (SELECT (chunk, col) FROM has) THEN o_orderpriority END AS o_orderpriority,
  chunk FROM r"""


def e6_shuffle_splits_orders(spark, sf):
    return X.repeated_shuffle_split(table(spark, sf, "orders"), "o_orderkey", 2, 0.2, seed=42, label="o_orderstatus")


SQL_E6B = """WITH b AS (SELECT CAST(t.repeat AS INTEGER) AS repeat, o_orderkey, o_orderstatus AS label,
                  md5(concat_ws('|', CAST(t.repeat + 42 AS VARCHAR), CAST(o_orderkey AS VARCHAR))) AS o
           FROM orders CROSS JOIN range(1, 3) t(repeat)),
r AS (SELECT *, row_number() OVER (PARTITION BY repeat, label ORDER BY o, o_orderkey) AS pos, count(*) OVER (PARTITION BY repeat, label) AS m FROM b)
SELECT repeat, o_orderkey, CASE WHEN pos <= ceil(m::DOUBLE * 0.2::DOUBLE) THEN 'test' ELSE 'train' END AS part FROM r"""

QUERIES = {
    "g5_row_chunks": (g5_row_chunks, SQL_G5),
    "e1_stratified_split_lineitem": (e1_stratified_split_lineitem, SQL_E1),
    "p6_mask_customer": (p6_mask_customer, SQL_P6),
    "e2_temporal_split_orders": (e2_temporal_split_orders, SQL_E2),
    "e3_random_split_orders": (e3_random_split_orders, SQL_E3),
    "e4_holdout_then_val_orders": (e4_holdout_then_val_orders, SQL_E4),
    "e5_group_split_events": (e5_group_split_events, SQL_E5),
    "e6_repeated_kfold_orders": (e6_repeated_kfold_orders, SQL_E6),
    "e6_shuffle_splits_orders": (e6_shuffle_splits_orders, SQL_E6B),
    "e7_nested_subsets_orders": (e7_nested_subsets_orders, SQL_E7),
    "p7_nested_ablation_customer": (p7_nested_ablation_customer, SQL_P7),
    "e8_capped_sample_orders": (e8_capped_sample_orders, SQL_E8),
    "d4_split_summary": (d4_split_summary, SQL_D4),
    "h7_split_violations": (h7_split_violations, SQL_H7),
    "h6_fit_set": (h6_fit_set, SQL_H6),
    "h8_explicit_split": (h8_explicit_split, SQL_H8),
    "g2_seeded_sample_orders": (g2_seeded_sample_orders, SQL_G2),
    "g3_seeded_shuffle": (g3_seeded_shuffle, SQL_G3),
    "g4_balanced_draw_labels": (g4_balanced_draw_labels, SQL_G4),
}
