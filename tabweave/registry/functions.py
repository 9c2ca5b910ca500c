"""Scalar-function queries (I1-I20, I23-I25) on columns derived from the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..core import table
from ..functions import text as T
from ..functions import vectors as V

NUM = T.NUMERIC_TEXT


def _num_sql(x: str) -> str:
    return f"CASE WHEN regexp_matches({x}, '{NUM}') THEN TRY_CAST(trim({x}) AS DOUBLE) END"


# ------------------------------------------------------------------ I1 - I4, I25
def i1_currency(spark, sf):
    c = table(spark, sf, "customer")
    sym = F.when(F.col("c_custkey") % 3 == 0, "$").when(F.col("c_custkey") % 3 == 1, "€").otherwise("£")
    txt = F.concat(sym, F.format_number("c_acctbal", 2))
    return c.select("c_custkey", txt.alias("price_text"), T.strip_currency(txt).alias("price"))


SQL_I1 = f"""WITH t AS (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN '$' WHEN 1 THEN '€' ELSE '£' END
                      || format('{{:,.2f}}', c_acctbal) AS price_text FROM customer)
SELECT c_custkey, price_text, {_num_sql("regexp_replace(price_text, '[$,€£¥]', '', 'g')")} AS price FROM t"""


def i2_percent(spark, sf):
    li = table(spark, sf, "lineitem")
    txt = F.concat((F.col("l_discount") * 100).cast("decimal(6,2)").cast("string"), F.lit("%"))
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", T.strip_percent(txt).alias("discount_pct"))


SQL_I2 = f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  {_num_sql("regexp_replace(CAST(CAST(l_discount * 100 AS DECIMAL(6,2)) AS VARCHAR) || '%', '%+$', '')")} AS discount_pct FROM lineitem"""


def i3_unit_suffix(spark, sf):
    p = table(spark, sf, "part")
    return p.select("p_partkey",
                    T.strip_suffix(F.concat(F.col("p_size").cast("string"), F.lit(" mi.")), " mi.").alias("miles"),
                    T.to_number(T.drop_last_char(F.concat(F.col("p_size").cast("string"), F.lit("L")))).alias("litres"),
                    T.to_number(T.drop_first_char(F.concat(F.lit("#"), F.col("p_size").cast("string")))).alias("size"))


SQL_I3 = """SELECT p_partkey, CAST(p_size AS DOUBLE) AS miles, CAST(p_size AS DOUBLE) AS litres, CAST(p_size AS DOUBLE) AS size FROM part"""


def i4_duration(spark, sf):
    o = table(spark, sf, "orders")
    h, m = F.col("o_orderkey") % 3, F.col("o_orderkey") % 60
    txt = F.when(h > 0, F.concat(h.cast("string"), F.lit(" hr "), m.cast("string"), F.lit(" min"))) \
        .otherwise(F.concat(m.cast("string"), F.lit(" min per ep")))
    return o.select("o_orderkey", txt.alias("duration_text"), T.duration_minutes(txt).alias("minutes"))


SQL_I4 = """WITH t AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 > 0
    THEN CAST(o_orderkey % 3 AS VARCHAR) || ' hr ' || CAST(o_orderkey % 60 AS VARCHAR) || ' min'
    ELSE CAST(o_orderkey % 60 AS VARCHAR) || ' min per ep' END AS duration_text FROM orders),
u AS (SELECT *, coalesce(TRY_CAST(regexp_extract(replace(duration_text, ' per ep', ''), '^(\\d+) hr', 1) AS DOUBLE), 0) * 60
              + coalesce(TRY_CAST(regexp_extract(replace(duration_text, ' per ep', ''), '(\\d+) min', 1) AS DOUBLE), 0) AS total FROM t)
SELECT o_orderkey, duration_text, CASE WHEN total = 0 THEN NULL ELSE total END AS minutes FROM u"""


def i25_rescale(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", T.rescale("l_quantity", 1000).alias("ml"))


SQL_I25 = "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity * 1000 AS ml FROM lineitem"


# ------------------------------------------------------------------ I5 - I8, I16
def i5_split_part(spark, sf):
    p = table(spark, sf, "part")
    return p.select("p_partkey", T.split_part("p_name", " ", 0).alias("first"), T.split_part("p_name", " ", -1).alias("last"),
                    T.split_part("p_brand", "#", 1).alias("brand_no"))


SQL_I5 = """SELECT p_partkey, string_split(p_name, ' ')[1] AS first, string_split(p_name, ' ')[-1] AS last,
  string_split(p_brand, '#')[2] AS brand_no FROM part"""


def i6_regex(spark, sf):
    e = table(spark, sf, "events").select("event_id", T.regex_extract("props", r"(\d+)").alias("k"))
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("event_id"),
                                             T.regex_count("text", "[A-Z]+").cast("string").alias("k"))
    return e.withColumn("src", F.lit("events")).unionByName(d.withColumn("src", F.lit("documents")))


SQL_I6 = """SELECT event_id, CASE WHEN regexp_matches(props, '(\\d+)') THEN regexp_extract(props, '(\\d+)', 1) END AS k, 'events' AS src FROM events
UNION ALL SELECT doc_id, CAST(CASE WHEN len(regexp_extract_all(text, '[A-Z]+')) = 0 THEN NULL
                                   ELSE len(regexp_extract_all(text, '[A-Z]+'))::DOUBLE END AS VARCHAR), 'documents' FROM documents"""


def i7_substrings(spark, sf):
    o = table(spark, sf, "orders")
    return o.select("o_orderkey", T.year_text(F.year("o_orderdate").cast("double")).alias("year"),
                    T.prefix("o_orderpriority", 1).alias("prio_no"), T.suffix("o_orderpriority", 3).alias("tail"))


SQL_I7 = """SELECT o_orderkey, split_part(CAST(CAST(year(o_orderdate) AS DOUBLE) AS VARCHAR), '.', 1) AS year,
  substr(o_orderpriority, 1, 1) AS prio_no, right(o_orderpriority, 3) AS tail FROM orders"""


def i8_trim_chars(spark, sf):
    p = table(spark, sf, "part")
    return p.select("p_partkey", T.trim_chars(F.col("p_size").cast("double").cast("string"), ".0").alias("t"))


SQL_I8 = "SELECT p_partkey, trim(CAST(CAST(p_size AS DOUBLE) AS VARCHAR), '.0') AS t FROM part"


def i16_space_after(spark, sf):
    p = table(spark, sf, "part")
    return p.select("p_partkey", T.space_after(F.concat_ws(",", "p_brand", "p_type", "p_name")).alias("tags"))


SQL_I16 = "SELECT p_partkey, replace(concat_ws(',', p_brand, p_type, p_name), ',', ', ') AS tags FROM part"


# ------------------------------------------------------------------ I9 - I13
def i9_date_reformat(spark, sf):
    o = table(spark, sf, "orders")
    txt = F.when(F.col("o_orderkey") % 10 == 0, "not a date").otherwise(
        F.date_format("o_orderdate", "MM/dd/yyyy hh:mm:ss a"))
    return o.select("o_orderkey", T.reformat_date(txt, ["MM/dd/yyyy hh:mm:ss a", "yyyy-MM-dd"], "yyyy-MM-dd").alias("day"))


SQL_I9 = "SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders"

PRIO_MAP = {"1-URGENT": "high", "2-HIGH": "high", "3-MEDIUM": "mid"}


def i10_dictionary_map(spark, sf):
    o = table(spark, sf, "orders")
    return o.select("o_orderkey", T.map_values("o_orderpriority", PRIO_MAP).alias("mapped"),
                    T.map_values("o_orderpriority", PRIO_MAP, keep_unmapped=True).alias("recoded"))


SQL_I10 = """SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'high' WHEN '2-HIGH' THEN 'high' WHEN '3-MEDIUM' THEN 'mid' END AS mapped,
  coalesce(CASE o_orderpriority WHEN '1-URGENT' THEN 'high' WHEN '2-HIGH' THEN 'high' WHEN '3-MEDIUM' THEN 'mid' END, o_orderpriority) AS recoded
FROM orders"""


def i11_conditional_null(spark, sf):
    o = table(spark, sf, "orders")
    k = F.col("o_orderkey")
    blank = F.when(k % 5 == 0, "  ").otherwise(F.col("o_orderpriority"))
    nan = F.when(k % 7 == 0, "nan").otherwise(F.col("o_orderstatus"))
    return o.select("o_orderkey", T.null_if_value("o_orderstatus", "P").alias("status"),
                    T.null_if_blank(blank).alias("prio"), T.null_tokens(nan, ["nan"]).alias("status2"))


SQL_I11 = """SELECT o_orderkey, nullif(o_orderstatus, 'P') AS status,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderpriority END AS prio,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderstatus END AS status2 FROM orders"""


def i12_fill_from(spark, sf):
    o = table(spark, sf, "orders")
    gap = F.when(F.col("o_orderkey") % 3 == 0, F.lit(None)).otherwise(F.col("o_orderpriority"))
    return o.select("o_orderkey", T.fill_from(gap, "o_orderstatus").alias("filled"))


SQL_I12 = "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus ELSE o_orderpriority END AS filled FROM orders"


def i13_concat_strict(spark, sf):
    p = table(spark, sf, "part")
    brand = F.when(F.col("p_size") % 5 == 0, F.lit(None)).otherwise(F.col("p_brand"))
    return p.select("p_partkey", T.concat_strict(brand, "p_type", "p_name", sep=" ").alias("label"))


SQL_I13 = "SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_brand || ' ' || p_type || ' ' || p_name END AS label FROM part"


# ------------------------------------------------------------------ I14 / I15
def i14_nested_names(spark, sf):
    c = table(spark, sf, "conversations")
    lit = F.when(F.col("turn") % 4 == 3, F.lit("[]")).otherwise(
        F.concat(F.lit("[{'name': '"), F.col("role"), F.lit("'}, {'name': 'turn "), F.col("turn").cast("string"), F.lit("'}]")))
    return c.select("conv_id", "turn", T.names_from_literal_list(lit).alias("names"))


SQL_I14 = """WITH t AS (SELECT conv_id, turn, CASE WHEN turn % 4 = 3 THEN '[]' ELSE
  '[{''name'': ''' || role || '''}, {''name'': ''turn ' || CAST(turn AS VARCHAR) || '''}]' END AS lit FROM conversations),
p AS (SELECT conv_id, turn, from_json(replace(lit, '''', '"'), '[{"name": "VARCHAR"}]') AS arr FROM t)
SELECT conv_id, turn, CASE WHEN len(arr) > 0 THEN array_to_string(list_transform(arr, lambda x: x.name), ', ') END AS names FROM p"""


def i15_json_field(spark, sf):
    e = table(spark, sf, "events")
    return e.select("event_id", T.json_field("props", "$.k").alias("k"))


SQL_I15 = "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events"


# ------------------------------------------------------------------ I17 - I20
def i17_clean_entity(spark, sf):
    c = table(spark, sf, "customer")
    raw = F.concat(F.lit("<"), F.col("c_name"), F.lit(">_"), F.col("c_mktsegment"), F.lit("\n"))
    return c.select("c_custkey", T.clean_entity(raw).alias("entity"))


SQL_I17 = "SELECT c_custkey, lower(replace(c_name || ' ' || c_mktsegment, '_', ' ')) AS entity FROM customer"


def _cust_blank(spark, sf):
    c = table(spark, sf, "customer")
    return c.select("c_custkey", "c_name", F.when(F.col("c_custkey") % 4 == 0, " ").otherwise(F.col("c_mktsegment"))
                    .alias("c_mktsegment"), "c_nationkey", "c_acctbal")


def i18_row_text(spark, sf):
    c = _cust_blank(spark, sf)
    return c.select("c_custkey", T.row_text(["c_name", "c_mktsegment", "c_nationkey"]).alias("row_text"))


SQL_I18 = """SELECT c_custkey, concat_ws(', ', 'c_name: ' || trim(c_name),
  CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE 'c_mktsegment: ' || trim(c_mktsegment) END,
  'c_nationkey: ' || CAST(c_nationkey AS VARCHAR)) AS row_text FROM customer"""


def i19_row_sentence(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_name", F.when(F.col("c_custkey") % 4 == 0, F.lit(None))
                                            .otherwise(F.col("c_mktsegment")).alias("c_mktsegment"), "c_nationkey")
    return c.select("c_custkey", T.row_sentence(["c_name", "c_mktsegment", "c_nationkey"]).alias("sentence"))


SQL_I19 = """SELECT c_custkey, 'query: ' || concat_ws(' ', 'c_name ' || lower(c_name) || '.',
  CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE 'c_mktsegment ' || lower(c_mktsegment) || '.' END,
  'c_nationkey ' || CAST(c_nationkey AS VARCHAR) || '.') AS sentence FROM customer"""


def i20_encoder_text(spark, sf):
    c = table(spark, sf, "customer").withColumn("rich", (F.col("c_acctbal") > 5000).cast("int"))
    return c.select("c_custkey", T.encoder_text(["c_mktsegment", "c_nationkey"], ["rich"]).alias("enc"))


SQL_I20 = """SELECT c_custkey, concat_ws(' ', 'c_mktsegment ' || c_mktsegment, 'c_nationkey ' || CAST(c_nationkey AS VARCHAR),
  CASE WHEN c_acctbal > 5000 THEN 'rich' END) AS enc FROM customer"""


# ------------------------------------------------------------------ I23 / I24
def i23_significance(spark, sf):
    d = table(spark, sf, "documents")
    p = F.round((F.col("doc_id") % 60) / 1000.0, 4)  # 0.001, 0.01 and 0.05 are among them
    return d.select("doc_id", T.significance(p).alias("stars"), T.significant(p, 0.05).alias("sig"))


SQL_I23 = """WITH t AS (SELECT doc_id, round((doc_id % 60) / 1000.0, 4) AS p FROM documents)
SELECT doc_id, CASE WHEN p > 0.05 THEN 'NS' WHEN p >= 0 AND p < 0.001 THEN '***' WHEN p >= 0.001 AND p < 0.01 THEN '**'
    WHEN p >= 0.01 AND p < 0.05 THEN '*' ELSE CAST(p AS VARCHAR) END AS stars,
  CAST(CASE WHEN p > 0.05 THEN 0 WHEN p > 0 AND p < 0.05 THEN 1 ELSE p END AS DOUBLE) AS sig FROM t"""


def i24_vector_math(spark, sf):
    e = table(spark, sf, "embeddings")
    unit = V.l2_normalize("embedding")
    return e.select("vec_id", F.round(V.l2_norm(unit), 6).alias("unit_norm"),
                    F.round(V.cosine("embedding", F.reverse("embedding")), 6).alias("cos_rev"),
                    F.round(V.cosine_distance("embedding", F.reverse("embedding")), 6).alias("dist_rev"))


SQL_I24 = """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
n AS (SELECT vec_id, e, list_reverse(e) AS r, sqrt(list_dot_product(e, e)) AS ne FROM v)
SELECT vec_id, CAST(round(CASE WHEN ne > 0 THEN 1.0 ELSE 0.0 END, 6) AS DOUBLE) AS unit_norm,
  round(CASE WHEN ne = 0 THEN 0.0 ELSE list_dot_product(e, r) / (ne * ne) END, 6) AS cos_rev,
  round(1 - CASE WHEN ne = 0 THEN 0.0 ELSE list_dot_product(e, r) / (ne * ne) END, 6) AS dist_rev FROM n"""


QUERIES = {
    "i1_currency": (i1_currency, SQL_I1),
    "i2_percent": (i2_percent, SQL_I2),
    "i3_unit_suffix": (i3_unit_suffix, SQL_I3),
    "i4_duration": (i4_duration, SQL_I4),
    "i25_rescale": (i25_rescale, SQL_I25),
    "i5_split_part": (i5_split_part, SQL_I5),
    "i6_regex": (i6_regex, SQL_I6),
    "i7_substrings": (i7_substrings, SQL_I7),
    "i8_trim_chars": (i8_trim_chars, SQL_I8),
    "i16_space_after": (i16_space_after, SQL_I16),
    "i9_date_reformat": (i9_date_reformat, SQL_I9),
    "i10_dictionary_map": (i10_dictionary_map, SQL_I10),
    "i11_conditional_null": (i11_conditional_null, SQL_I11),
    "i12_fill_from": (i12_fill_from, SQL_I12),
    "i13_concat_strict": (i13_concat_strict, SQL_I13),
    "i14_nested_names": (i14_nested_names, SQL_I14),
    "i15_json_field": (i15_json_field, SQL_I15),
    "i17_clean_entity": (i17_clean_entity, SQL_I17),
    "i18_row_text": (i18_row_text, SQL_I18),
    "i19_row_sentence": (i19_row_sentence, SQL_I19),
    "i20_encoder_text": (i20_encoder_text, SQL_I20),
    "i23_significance": (i23_significance, SQL_I23),
    "i24_vector_math": (i24_vector_math, SQL_I24),
}
