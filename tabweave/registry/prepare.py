"""Preparation queries (B1-B19, D1) on frames derived from the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..core import TableSpec, table
from ..functions import text as T
from ..operators import prepare as P
from ..operators.aggregate import column_profile


def messy(spark, sf):
    """Customer re-shaped into a typical raw table: awkward names, a column
    two-thirds empty, one exactly half empty, a constant, text-typed numbers."""
    c = table(spark, sf, "customer")
    k = F.col("c_custkey")
    return c.select(
        k.alias("id"),
        F.col("c_name").alias("Customer Name"),
        F.when(k % 3 == 0, F.col("c_acctbal")).alias("Acct%"),
        F.when(k % 2 == 0, F.col("c_nationkey")).alias("half_null"),
        F.lit("c").alias("const"),
        F.col("c_mktsegment").alias("segment"),
        F.concat(F.lit("$"), F.col("c_acctbal").cast("decimal(12,2)").cast("string")).alias("price_text"),
        F.when(k % 5 == 0, "N/A").when(k % 7 == 0, "1d").otherwise(F.col("c_nationkey").cast("string")).alias("nation_text"),
        F.concat(F.col("c_mktsegment"), F.lit("\n"), F.lit("x®")).alias("messy_text"),
    )


MESSY_SQL = """SELECT c_custkey AS id, c_name AS "Customer Name", CASE WHEN c_custkey % 3 = 0 THEN c_acctbal END AS "Acct%",
  CASE WHEN c_custkey % 2 = 0 THEN c_nationkey END AS half_null, 'c' AS const, c_mktsegment AS segment,
  '$' || CAST(CAST(c_acctbal AS DECIMAL(12,2)) AS VARCHAR) AS price_text,
  CASE WHEN c_custkey % 5 = 0 THEN 'N/A' WHEN c_custkey % 7 = 0 THEN '1d' ELSE CAST(c_nationkey AS VARCHAR) END AS nation_text,
  c_mktsegment || chr(10) || 'x®' AS messy_text FROM customer"""
MESSY_COLS = ["id", "Customer Name", "Acct%", "half_null", "const", "segment", "price_text", "nation_text", "messy_text"]


def _cols(names):
    return ", ".join(f'"{c}"' for c in names)


# ------------------------------------------------------------------ D1 / B1 / B2 / B3
def d1_column_profile(spark, sf):
    return column_profile(messy(spark, sf))


SQL_D1 = f"WITH m AS ({MESSY_SQL}) " + " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count(*) AS n_rows, CAST(count_if("{c}" IS NULL) AS BIGINT) AS n_null, count(DISTINCT "{c}") AS n_distinct FROM m"""
    for c in MESSY_COLS)


def b1_drop_high_null(spark, sf):
    return P.drop_high_null(messy(spark, sf), 0.5)


SQL_B1 = f"WITH m AS ({MESSY_SQL}) SELECT {_cols([c for c in MESSY_COLS if c != 'Acct%'])} FROM m"


def b2_drop_single_unique(spark, sf):
    return P.drop_single_unique(messy(spark, sf))


SQL_B2 = f"WITH m AS ({MESSY_SQL}) SELECT {_cols([c for c in MESSY_COLS if c != 'const'])} FROM m"


def b3_clean_column_names(spark, sf):
    return P.clean_column_names(messy(spark, sf))


SQL_B3 = f"""WITH m AS ({MESSY_SQL}) SELECT id, "Customer Name" AS Customer_Name, "Acct%" AS AcctPercentage, half_null, const,
  segment, price_text, nation_text, messy_text FROM m"""


# ------------------------------------------------------------------ B4 / B6 / B7 / B8 / B9
def b4_clean_text_cells(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    return P.clean_text_cells(d, ["text"])


SQL_B4 = r"""SELECT doc_id, regexp_replace(regexp_replace(text, '[\r\n]', ' ', 'g'),
  '[®™\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', '', 'g') AS text FROM documents"""


def b6_b7_drop_rename(spark, sf):
    li = table(spark, sf, "lineitem")
    out = P.drop_columns(li, names=["l_tax", "no_such"], contains=["ship"], positions=[1], errors="ignore")
    return P.rename_columns(out, {"l_orderkey": "order", "l_extendedprice": "price"})


SQL_B6 = """SELECT l_orderkey AS "order", l_suppkey, l_linenumber, l_quantity, l_extendedprice AS price, l_discount,
  l_returnflag, l_linestatus FROM lineitem"""


def b8_drop_null_target(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang")
    return P.drop_null_rows(d.join(table(spark, sf, "labels"), "doc_id", "left"), ["quality"])


SQL_B8 = "SELECT d.doc_id, d.lang, l.quality, l.toxic FROM documents d JOIN labels l USING (doc_id)"


def b9_row_predicates(spark, sf):
    o = table(spark, sf, "orders")
    o = o.select("o_orderkey", F.when(F.col("o_orderkey") % 4 == 0, F.lit(None)).otherwise(
        F.col("o_orderpriority")).alias("prio"), "o_totalprice")
    pred = F.col("prio").contains("URGENT") | F.col("prio").contains("HIGH")
    kept = P.keep_rows(o, pred & (F.col("o_totalprice") >= 100000)).withColumn("rule", F.lit("keep"))
    dropped = P.drop_rows(o, pred | ~F.col("prio").contains("LOW")).withColumn("rule", F.lit("exclude"))
    return kept.unionByName(dropped)


SQL_B9 = """WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderpriority END AS prio, o_totalprice FROM orders)
SELECT *, 'keep' AS rule FROM o WHERE coalesce((contains(prio, 'URGENT') OR contains(prio, 'HIGH')) AND o_totalprice >= 100000, false)
UNION ALL SELECT *, 'exclude' FROM o WHERE NOT coalesce(contains(prio, 'URGENT') OR contains(prio, 'HIGH') OR NOT contains(prio, 'LOW'), false)"""


# ------------------------------------------------------------------ B10 / B11 / B19
def b10_numeric_coerce(spark, sf):
    m = messy(spark, sf)
    return P.coerce_numeric(m.select("id", "nation_text", "half_null"), ["nation_text", "half_null"])


SQL_B10 = f"""WITH m AS ({MESSY_SQL})
SELECT id, CASE WHEN regexp_matches(nation_text, '{T.NUMERIC_TEXT}') THEN TRY_CAST(trim(nation_text) AS DOUBLE) END AS nation_text,
       CAST(half_null AS DOUBLE) AS half_null FROM m"""


def b11_category_cast(spark, sf):
    return P.as_category(messy(spark, sf).select("id", "half_null", "segment"), ["half_null"])


SQL_B11 = f"WITH m AS ({MESSY_SQL}) SELECT id, coalesce(CAST(half_null AS VARCHAR), 'nan') AS half_null, segment FROM m"


def b19_fit_cells(spark, sf):
    spec = TableSpec(kinds={"segment": "cat", "half_null": "num", "nation_text": "num", "price_text": "num"})
    return P.fit_cells(messy(spark, sf).select("id", "segment", "half_null", "nation_text", "price_text"), spec)


SQL_B19 = f"""WITH m AS ({MESSY_SQL})
SELECT id, segment, coalesce(CAST(half_null AS DOUBLE), 0.0) AS half_null,
  coalesce(CASE WHEN regexp_matches(nation_text, '{T.NUMERIC_TEXT}') THEN TRY_CAST(trim(nation_text) AS DOUBLE) END, 0.0) AS nation_text,
  coalesce(CASE WHEN regexp_matches(price_text, '{T.NUMERIC_TEXT}') THEN TRY_CAST(trim(price_text) AS DOUBLE) END, 0.0) AS price_text
FROM m"""


# ------------------------------------------------------------------ B12 / B13 / B14
def b12_binary_indicator(spark, sf):
    e = table(spark, sf, "events")
    txt = (F.when(F.col("event_type") == "click", "Yes").when(F.col("event_type") == "view", "true")
           .when(F.col("event_type") == "purchase", " T ").when(F.col("event_type") == "signup", None).otherwise("T"))
    return e.select("event_id", T.binary_indicator(txt).alias("flag"))


SQL_B12 = """SELECT event_id, CASE WHEN lower(CASE event_type WHEN 'click' THEN 'Yes' WHEN 'view' THEN 'true'
  WHEN 'purchase' THEN ' T ' WHEN 'signup' THEN NULL ELSE 'T' END) IN ('1','yes','true','positive','t','y') THEN 1 ELSE 0 END AS flag FROM events"""


def b13_binarize_target(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                     T.binarize("l_discount", 0.05).alias("disc_lt"),
                     T.binarize("l_discount", 0.05, inclusive=True).alias("disc_le"),
                     T.binarize_contains("l_returnflag", "R").alias("returned"))


SQL_B13 = """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  CASE WHEN l_discount IS NULL THEN NULL WHEN l_discount < 0.05 THEN 0 ELSE 1 END AS disc_lt,
  CASE WHEN l_discount IS NULL THEN NULL WHEN l_discount <= 0.05 THEN 0 ELSE 1 END AS disc_le,
  CASE WHEN l_returnflag IS NULL THEN NULL WHEN contains(l_returnflag, 'R') THEN 1 ELSE 0 END AS returned FROM lineitem"""


def b14_log_target(spark, sf):
    o = table(spark, sf, "orders")
    return o.select("o_orderkey",
                    F.round(T.log_target("o_totalprice", "e"), 6).alias("ln"),
                    F.round(T.log_target("o_totalprice", "e", plus_one=True), 6).alias("ln1p"),
                    F.round(T.log_target("o_totalprice", "10"), 6).alias("log10"),
                    F.round(T.log_target("o_totalprice", "100"), 6).alias("log100"),
                    F.round(T.log_target(F.col("o_totalprice") - 100000, "10"), 6).alias("log10_shift"))


SQL_B14 = """SELECT o_orderkey, round(ln(o_totalprice), 6) AS ln, round(ln(o_totalprice + 1), 6) AS ln1p,
  round(log10(o_totalprice), 6) AS log10, round(ln(o_totalprice) / ln(100), 6) AS log100,
  round(CASE WHEN o_totalprice - 100000 > 0 THEN log10(o_totalprice - 100000) END, 6) AS log10_shift FROM orders"""


# ------------------------------------------------------------------ B15 / B17
def b15_kind_order(spark, sf):
    c = table(spark, sf, "customer")
    c = c.toDF(*[x.upper() for x in c.columns])
    spec = TableSpec.from_kinds(num_cols=["C_ACCTBAL", "C_NATIONKEY"], cat_cols=["C_NAME"], bin_cols=[],
                                target="c_mktsegment")
    c = c.toDF(*[x.lower() for x in c.columns])
    return c.select(*P.kind_order(spec), "c_mktsegment")


SQL_B15 = "SELECT c_acctbal, c_nationkey, c_name, c_mktsegment FROM customer"


def b17_lowercase_first(spark, sf):
    c = table(spark, sf, "customer")
    frame = c.select("c_custkey", "c_name", "c_acctbal").toDF("Key", "key", "Bal")
    return P.lowercase_first(frame)


SQL_B17 = "SELECT c_custkey AS key, c_acctbal AS bal FROM customer"


QUERIES = {
    "d1_column_profile": (d1_column_profile, SQL_D1),
    "b1_drop_high_null": (b1_drop_high_null, SQL_B1),
    "b2_drop_single_unique": (b2_drop_single_unique, SQL_B2),
    "b3_clean_column_names": (b3_clean_column_names, SQL_B3),
    "b4_clean_text_cells": (b4_clean_text_cells, SQL_B4),
    "b6_b7_drop_rename": (b6_b7_drop_rename, SQL_B6),
    "b8_drop_null_target": (b8_drop_null_target, SQL_B8),
    "b9_row_predicates": (b9_row_predicates, SQL_B9),
    "b10_numeric_coerce": (b10_numeric_coerce, SQL_B10),
    "b11_category_cast": (b11_category_cast, SQL_B11),
    "b19_fit_cells": (b19_fit_cells, SQL_B19),
    "b12_binary_indicator": (b12_binary_indicator, SQL_B12),
    "b13_binarize_target": (b13_binarize_target, SQL_B13),
    "b14_log_target": (b14_log_target, SQL_B14),
    "b15_kind_order": (b15_kind_order, SQL_B15),
    "b17_lowercase_first": (b17_lowercase_first, SQL_B17),
}
