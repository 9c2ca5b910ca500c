"""Feature-operator queries (J1-J10, K1-K3) and row-graph queries (M1-M5)."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ..core import table
from ..operators import features as J
from ..operators import graph as G
from ..operators import split as X
from ..operators.encoder import HashingEncoder, encode, encode_distinct
from ..session import ensure_checkpoint_dir
from .prepare import MESSY_SQL, messy
from .sqlparts import ratio, seeded_md5


def _r6(df):
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# ------------------------------------------------------------------ J1 - J4
def j1_label_encode(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    return J.label_encode_apply(o, "o_orderpriority", J.label_encode_fit(o, "o_orderpriority"))


SQL_J1 = "SELECT o_orderkey, CAST(dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS INTEGER) AS o_orderpriority FROM orders"

CUST_SPLIT_SQL = f"""SELECT c_custkey, CASE WHEN pos <= {ratio('m', 0.7)} THEN 'train'
  WHEN pos <= {ratio('m', 0.7)} + {ratio('m', 0.1)} THEN 'val' ELSE 'test' END AS split
  FROM (SELECT c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY {seeded_md5(42, 'c_custkey')}, c_custkey) AS pos,
               count(*) OVER (PARTITION BY c_mktsegment) AS m FROM customer)"""


def _cust_split(spark, sf):
    c = table(spark, sf, "customer")
    return c.join(X.stratified_split(c, "c_custkey", "c_mktsegment", seed=42), "c_custkey")


def j2_ordinal_encode(spark, sf):
    c = _cust_split(spark, sf)
    out = J.ordinal_encode(c.filter("split = 'train'"), c.select("c_custkey", "c_name", "c_mktsegment"),
                           ["c_name", "c_mktsegment"])
    return out


SQL_J2 = f"""WITH s AS ({CUST_SPLIT_SQL}), c AS (SELECT * FROM customer JOIN s USING (c_custkey)),
n AS (SELECT c_name AS v, CAST(row_number() OVER (ORDER BY c_name) - 1 AS INTEGER) AS code FROM (SELECT DISTINCT c_name FROM c WHERE split = 'train')),
m AS (SELECT c_mktsegment AS v, CAST(row_number() OVER (ORDER BY c_mktsegment) - 1 AS INTEGER) AS code FROM (SELECT DISTINCT c_mktsegment FROM c WHERE split = 'train'))
SELECT c.c_custkey, coalesce(n.code, -1) AS c_name, coalesce(m.code, -1) AS c_mktsegment
FROM c LEFT JOIN n ON n.v = c.c_name LEFT JOIN m ON m.v = c.c_mktsegment"""


def j3_one_hot(spark, sf):
    c = _cust_split(spark, sf)
    cats = J.one_hot_fit(c.filter("split = 'train'"), "c_mktsegment")
    return J.one_hot_apply(c.select("c_custkey", "c_mktsegment"), "c_mktsegment", cats)


SQL_J3 = "SELECT c_custkey, " + ", ".join(
    f"CAST(c_mktsegment = '{s}' AS INTEGER) AS c_mktsegment_{s}"
    for s in ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]) + " FROM customer"


def j4_target_encode(spark, sf, smoothing="auto"):
    ensure_checkpoint_dir(spark)
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority",
                                          (F.col("o_orderstatus") == "F").cast("int").alias("y"))
    split = X.stratified_split(o, "o_orderkey", "o_orderpriority", seed=42)
    # the folds and every table of means read these rows: each step is computed once
    o = o.join(split, "o_orderkey").checkpoint(eager=True)
    folds = X.repeated_kfold(o.filter("split = 'train'"), "o_orderkey", k=5, repeats=1, seed=7).drop("repeat")
    o = o.join(folds, "o_orderkey", "left").fillna(-1, ["fold"]).checkpoint(eager=True)
    te = J.target_encode(o, "o_orderpriority", "y", "fold", F.col("split") == "train", smoothing)
    return _r6(te.select("o_orderkey", "split", "o_orderpriority_te"))


def j4_target_encode_fixed(spark, sf):
    return j4_target_encode(spark, sf, smoothing=10.0)


SQL_J4_ROWS = f"""WITH o AS (SELECT o_orderkey, o_orderpriority, CAST(o_orderstatus = 'F' AS INTEGER) AS y FROM orders),
s AS (SELECT o_orderkey, CASE WHEN pos <= {ratio('m', 0.7)} THEN 'train' WHEN pos <= {ratio('m', 0.7)} + {ratio('m', 0.1)} THEN 'val' ELSE 'test' END AS split
      FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY {seeded_md5(42, 'o_orderkey')}, o_orderkey) AS pos,
                   count(*) OVER (PARTITION BY o_orderpriority) AS m FROM orders)),
os AS (SELECT o.*, s.split FROM o JOIN s USING (o_orderkey)),
f AS (SELECT o_orderkey, ntile(5) OVER (ORDER BY md5(concat_ws('|', '8', CAST(o_orderkey AS VARCHAR))), o_orderkey) AS fold
      FROM os WHERE split = 'train'),
t AS (SELECT os.*, f.fold FROM os JOIN f USING (o_orderkey)),
"""
SQL_J4_FIXED = SQL_J4_ROWS + """g AS (SELECT sum(y)::DOUBLE AS gs, count(*) AS gn FROM t),
pc AS (SELECT o_orderpriority, sum(y) AS S, count(*) AS N FROM t GROUP BY 1),
pf AS (SELECT fold, o_orderpriority, sum(y) AS s, count(*) AS n FROM t GROUP BY 1, 2),
ft AS (SELECT fold, sum(y) AS fs, count(*) AS fn FROM t GROUP BY 1)
SELECT t.o_orderkey, t.split, round((pc.S - coalesce(pf.s, 0) + 10.0 * ((g.gs - ft.fs) / (g.gn - ft.fn))) / (pc.N - coalesce(pf.n, 0) + 10.0), 6) AS o_orderpriority_te
FROM t JOIN pc USING (o_orderpriority) LEFT JOIN pf USING (fold, o_orderpriority) JOIN ft USING (fold) CROSS JOIN g
UNION ALL
SELECT os.o_orderkey, os.split, round((coalesce(pc.S, 0) + 10.0 * (g.gs / g.gn)) / (coalesce(pc.N, 0) + 10.0), 6)
FROM os LEFT JOIN pc USING (o_orderpriority) CROSS JOIN g WHERE os.split <> 'train'"""
# variance of the target within a category against that of all rows, over the rows that the encoded row may learn from
SQL_J4 = SQL_J4_ROWS + """src AS (SELECT o_orderkey, split, o_orderpriority, fold FROM t UNION ALL SELECT o_orderkey, split, o_orderpriority, -1 FROM os WHERE split <> 'train'),
folds AS (SELECT DISTINCT fold FROM src),
seen AS (SELECT folds.fold, t.o_orderpriority, t.y FROM folds JOIN t ON t.fold <> folds.fold),
every AS (SELECT fold, avg(y) AS mean, var_pop(y) AS var FROM seen GROUP BY fold),
cat AS (SELECT fold, o_orderpriority, count(*) AS n, avg(y) AS mean, var_pop(y) AS var FROM seen GROUP BY fold, o_orderpriority),
w AS (SELECT cat.*, every.mean AS prior, CASE WHEN every.var = 0 THEN 0 ELSE n * every.var / (n * every.var + cat.var) END AS lam FROM cat JOIN every USING (fold))
SELECT o_orderkey, split, round(coalesce(lam * w.mean + (1 - lam) * w.prior, every.mean), 6) AS o_orderpriority_te
FROM src JOIN every USING (fold) LEFT JOIN w USING (fold, o_orderpriority)"""


# ------------------------------------------------------------------ J5 - J7
def j5_imputers(spark, sf):
    m = messy(spark, sf).select("id", "Acct%", "half_null", "segment")
    vals = J.impute_fit(m, mean_cols=["Acct%"], mode_cols=["half_null"])
    return _r6(J.impute_apply(m, vals).withColumn("half_null", F.col("half_null").cast("int")))


SQL_J5 = f"""WITH m AS ({MESSY_SQL}),
mo AS (SELECT half_null AS v FROM m WHERE half_null IS NOT NULL GROUP BY half_null ORDER BY count(*) DESC, half_null LIMIT 1)
SELECT id, round(coalesce("Acct%", (SELECT avg("Acct%") FROM m)), 6) AS "Acct%",
  CAST(coalesce(half_null, (SELECT v FROM mo)) AS INTEGER) AS half_null, segment FROM m"""


def j6_minmax_scale(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice",
                                             "l_quantity", F.lit(3.0).alias("const"))
    return _r6(J.minmax_apply(li, J.minmax_fit(li, ["l_extendedprice", "l_quantity", "const"])))


SQL_J6 = """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  round((l_extendedprice - min(l_extendedprice) OVER ()) / (max(l_extendedprice) OVER () - min(l_extendedprice) OVER ()), 6) AS l_extendedprice,
  round((l_quantity - min(l_quantity) OVER ()) / (max(l_quantity) OVER () - min(l_quantity) OVER ()), 6) AS l_quantity,
  0.0::DOUBLE AS const FROM lineitem"""


def j7_standard_scale(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice",
                                             "l_discount")
    return _r6(J.standard_apply(li, J.standard_fit(li, ["l_extendedprice", "l_discount"])))


SQL_J7 = """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  round((l_extendedprice - avg(l_extendedprice) OVER ()) / stddev_pop(l_extendedprice) OVER (), 6) AS l_extendedprice,
  round((l_discount - avg(l_discount) OVER ()) / stddev_pop(l_discount) OVER (), 6) AS l_discount FROM lineitem"""


def j8_power_transform(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    fitted = J.PowerTransformer().fit(li, ["l_extendedprice"])
    out = fitted.transform(li)
    return out.withColumn("l_extendedprice", F.round("l_extendedprice", 4)).withColumn(
        "lambda", F.round(F.lit(float(fitted.lambdas["l_extendedprice"])), 6))


def _slope_sql(lam: str) -> str:
    """The slope of the log-likelihood (per row) for values that are not negative."""
    return (f"sum(ln(1 + x)) / count(*) - covar_pop((pow(1 + x, {lam}) - 1) / {lam}, "
            f"(pow(1 + x, {lam}) * ({lam} * ln(1 + x) - 1) + 1) / ({lam} * {lam})) / var_pop((pow(1 + x, {lam}) - 1) / {lam})")


# bisection of the slope between powers that enclose its zero
_HALVES = ",\n".join(f"b{i + 1} AS MATERIALIZED (SELECT CASE WHEN g > 0 THEN mid ELSE lo END AS lo, CASE WHEN g > 0 THEN hi ELSE mid END AS hi "
                     f"FROM (SELECT lo, hi, mid, {_slope_sql('mid')} AS g FROM li CROSS JOIN (SELECT lo, hi, (lo + hi) / 2 AS mid FROM b{i}) GROUP BY lo, hi, mid))"
                     for i in range(40))
SQL_J8 = f"""WITH li AS MATERIALIZED (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice AS x FROM lineitem),
b0 AS (SELECT 0.01::DOUBLE AS lo, 5.0::DOUBLE AS hi),
{_HALVES},
lam AS MATERIALIZED (SELECT (lo + hi) / 2 AS lam FROM b40),
y AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, (pow(1 + x, lam) - 1) / lam AS y, lam FROM li CROSS JOIN lam)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round((y - avg(y) OVER ()) / stddev_pop(y) OVER (), 4) AS l_extendedprice,
  round(lam, 6) AS lambda FROM y"""


def j9_pca(spark, sf):
    """The coordinate of every row along the components that hold 90 % of the variance (here one)."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    v = J.assemble(li, {"num": ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]})
    got = J.pca(v, "features", variance=0.9)
    return got.select("l_orderkey", F.transform(vector_to_array("pca"), lambda x: F.round(x, 3)).alias("pca"))


_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_COV = "[" + ", ".join("[" + ", ".join(f"covar_pop({a}, {b})" for b in _COLS) + "]" for a in _COLS) + "]"


def _power_sql(rounds: int) -> str:
    """Power iteration on the covariance matrix, from the first column's axis turned a little towards the others."""
    step = "(SELECT list_transform(w, lambda x: x / sqrt(list_dot_product(w, w))) AS v FROM (SELECT list_transform(c, lambda r: list_dot_product(r, v)) AS w FROM m, {b}))"
    return ",\n".join(f"p{i + 1} AS MATERIALIZED {step.format(b=f'p{i}')}" for i in range(rounds))


SQL_J9_PCA = f"""WITH m AS MATERIALIZED (SELECT {_COV} AS c, [{", ".join(f"avg({a})" for a in _COLS)}] AS mean FROM lineitem),
p0 AS (SELECT [1.0, 1.0, 1.0, 1.0]::DOUBLE[] AS v),
{_power_sql(20)}
SELECT l_orderkey, [round(sign(v[2]) * ({" + ".join(f"(l.{c} - mean[{i + 1}]) * v[{i + 1}]" for i, c in enumerate(_COLS))}), 3)] AS pca
FROM lineitem l, m, p20"""


def j9_pca_share(spark, sf):
    """The fewest components with 90 % of the variance: their number, as rows see it."""
    return j9_pca(spark, sf).groupBy(F.size("pca").alias("components")).agg(F.count(F.lit(1)).alias("n_rows"))


# one column has nearly all variance, so its share is a bound on that of the first component
SQL_J9 = """SELECT CASE WHEN greatest(var_pop(l_extendedprice), var_pop(l_quantity), var_pop(l_discount), var_pop(l_tax))
  >= 0.9 * (var_pop(l_extendedprice) + var_pop(l_quantity) + var_pop(l_discount) + var_pop(l_tax)) THEN 1 END AS components, count(*) AS n_rows FROM lineitem"""


def j10_assemble(spark, sf):
    c = table(spark, sf, "customer").withColumn("rich", (F.col("c_acctbal") > 5000).cast("int"))
    got = J.assemble(c, {"num": ["c_acctbal", "c_nationkey"], "bin": ["rich"]})
    return got.select("c_custkey", vector_to_array("features").alias("features"))


SQL_J10 = """SELECT c_custkey, [CAST(c_acctbal > 5000 AS DOUBLE), CAST(c_acctbal AS DOUBLE), CAST(c_nationkey AS DOUBLE)] AS features FROM customer"""


def j3_one_hot_vector(spark, sf):
    c = _cust_split(spark, sf)
    got = J.one_hot_vector(c.filter("split = 'train'"), c.select("c_custkey", "c_mktsegment"), "c_mktsegment", out="v")
    return got.select("c_custkey", vector_to_array("v").alias("v"))


SQL_J3B = f"""WITH s AS ({CUST_SPLIT_SQL}), t AS (SELECT DISTINCT c_mktsegment AS m FROM customer JOIN s USING (c_custkey) WHERE split = 'train')
SELECT c_custkey, (SELECT list(CAST(t.m = customer.c_mktsegment AS DOUBLE) ORDER BY t.m) FROM t) AS v FROM customer"""


# ------------------------------------------------------------------ K1 / K2 (hashing encoder, 8 dims)
def _hash_sql(term: str, d: int = 8) -> str:
    p = f"(' ' || lower(coalesce({term}, '')) || ' ')"
    pairs = (f"list_transform(CASE WHEN length({p}) >= 3 THEN list_transform(range(1, length({p}) - 1), lambda i: substr({p}, i, 3)) "
             f"ELSE [] END, lambda gr: {{'b': ('0x' || substr(md5(gr), 1, 8))::BIGINT % {d}, "
             f"'w': CASE WHEN ('0x' || substr(md5(gr), 9, 1))::INTEGER < 8 THEN 1.0 ELSE -1.0 END}})")
    return (f"list_transform(range({d}), lambda j: coalesce(list_sum(list_transform(list_filter({pairs}, lambda q: q.b = j), "
            f"lambda q: q.w)), 0.0))")


def _norm_sql(raw: str, digits: int | None = 6) -> str:
    val = "x / sqrt(list_sum(list_transform({raw}, lambda y: y * y)))".format(raw=raw)
    if digits is not None:
        val = f"round({val}, {digits})"
    return (f"list_transform({raw}, lambda x: CASE WHEN sqrt(list_sum(list_transform({raw}, lambda y: y * y))) > 0 "
            f"THEN {val} ELSE 0.0 END)")


def k1_hash_encode(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_name")
    out = encode(p, "p_name", HashingEncoder(8))
    return out.select("p_partkey", F.transform("vec", lambda x: F.round(x, 6)).alias("vec"))


SQL_K1 = f"SELECT p_partkey, {_norm_sql(_hash_sql('p_name'))} AS vec FROM part"


def k2_encode_distinct(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    out = encode_distinct(c, "c_mktsegment", HashingEncoder(8))
    return out.select("c_custkey", "c_mktsegment", F.transform("vec", lambda x: F.round(x, 6)).alias("vec"))


SQL_K2 = f"""WITH v AS (SELECT c_mktsegment AS t, {_norm_sql(_hash_sql('c_mktsegment'))} AS vec FROM (SELECT DISTINCT c_mktsegment FROM customer))
SELECT c.c_custkey, c.c_mktsegment, v.vec FROM customer c LEFT JOIN v ON v.t IS NOT DISTINCT FROM c.c_mktsegment"""


# ------------------------------------------------------------------ M1 - M5
TEXT = ["c_name", "c_mktsegment"]
NUMS = ["c_acctbal", "c_nationkey"]


def _cust(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", *TEXT, *NUMS)


def m1_star_edges(spark, sf):
    return G.star_edges(_cust(spark, sf), "c_custkey", TEXT, NUMS, HashingEncoder(8))


def m3_vocabulary(spark, sf):
    return G.vocabulary(_cust(spark, sf), TEXT, NUMS)


TERMS_SQL = ("SELECT 'c_name' AS term UNION SELECT 'c_mktsegment' UNION SELECT 'c_acctbal' UNION SELECT 'c_nationkey' "
             "UNION SELECT lower(c_name) FROM customer WHERE c_name IS NOT NULL "
             "UNION SELECT lower(c_mktsegment) FROM customer WHERE c_mktsegment IS NOT NULL")
SQL_M3 = f"SELECT term, row_number() OVER (ORDER BY term) - 1 AS idx FROM ({TERMS_SQL})"
EDGES_SQL = f"""vocab AS (SELECT term, {_norm_sql(_hash_sql('term'), None)} AS v FROM ({TERMS_SQL})),
leaves AS (SELECT c_custkey AS row_id, 'c_name' AS "column", 'text' AS kind, lower(c_name) AS term, 1.0 AS scale FROM customer
  UNION ALL SELECT c_custkey, 'c_mktsegment', 'text', lower(c_mktsegment), 1.0 FROM customer
  UNION ALL SELECT c_custkey, 'c_acctbal', 'num', 'c_acctbal', CAST(c_acctbal AS DOUBLE) FROM customer
  UNION ALL SELECT c_custkey, 'c_nationkey', 'num', 'c_nationkey', CAST(c_nationkey AS DOUBLE) FROM customer),
edges AS (SELECT l.row_id, l."column", l.kind, list_transform(e.v, lambda x: CASE WHEN round(x, 6) = 0 THEN 0.0 ELSE round(x, 6) END) AS edge,
    list_transform(xv.v, lambda x: CASE WHEN round(x * l.scale, 6) = 0 THEN 0.0 ELSE round(x * l.scale, 6) END) AS x
  FROM leaves l JOIN vocab xv ON xv.term = l.term JOIN vocab e ON e.term = l."column"
  WHERE l.term IS NOT NULL AND l.scale IS NOT NULL)"""
SQL_M1 = f"""WITH {EDGES_SQL}
SELECT * FROM edges UNION ALL SELECT row_id, "column", 'self', [1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0], NULL FROM edges"""


def m2_centre_vectors(spark, sf):
    return G.centre_vectors(m1_star_edges(spark, sf))


SQL_M2 = f"""WITH {EDGES_SQL},
u AS (SELECT row_id, i, avg(edge[i] * x[i]) AS v, count(*) AS n FROM edges, range(1, 9) t(i) GROUP BY row_id, i)
SELECT row_id, list(CASE WHEN round(v, 6) = 0 THEN 0.0 ELSE round(v, 6) END ORDER BY i) AS centre FROM u GROUP BY row_id"""


def m4_column_views(spark, sf):
    c = table(spark, sf, "customer")
    return G.column_views(c, ["c_name", "c_nationkey", "c_acctbal", "c_mktsegment"], 2, 0.5, keep=["c_custkey"])


SQL_M4 = """SELECT c_custkey, c_name, c_nationkey, c_acctbal, 0 AS view, NULL AS c_mktsegment FROM customer
UNION ALL SELECT c_custkey, NULL, c_nationkey, c_acctbal, 1, c_mktsegment FROM customer"""


def m5_corrupted_view(spark, sf):
    c = table(spark, sf, "customer")
    return G.corrupted_view(c, "c_custkey", ["c_name", "c_nationkey", "c_acctbal", "c_mktsegment"], seed=42)


SQL_M5 = f"""WITH a AS (SELECT c_custkey, c_acctbal, c_mktsegment, row_number() OVER (ORDER BY c_custkey) AS r FROM customer),
b AS (SELECT c_name, c_nationkey, row_number() OVER (ORDER BY {seeded_md5(42, 'c_custkey')}, c_custkey) AS r FROM customer)
SELECT a.c_custkey, a.c_acctbal, a.c_mktsegment, b.c_name, b.c_nationkey FROM a JOIN b USING (r)"""


QUERIES = {
    "j1_label_encode": (j1_label_encode, SQL_J1),
    "j2_ordinal_encode": (j2_ordinal_encode, SQL_J2),
    "j3_one_hot": (j3_one_hot, SQL_J3),
    "j4_target_encode": (j4_target_encode, SQL_J4),
    "j4_target_encode_fixed": (j4_target_encode_fixed, SQL_J4_FIXED),
    "j5_imputers": (j5_imputers, SQL_J5),
    "j6_minmax_scale": (j6_minmax_scale, SQL_J6),
    "j7_standard_scale": (j7_standard_scale, SQL_J7),
    "j8_power_transform": (j8_power_transform, SQL_J8),
    "j9_pca": (j9_pca, SQL_J9_PCA),
    "j9_pca_share": (j9_pca_share, SQL_J9),
    "j10_assemble": (j10_assemble, SQL_J10),
    "j3_one_hot_vector": (j3_one_hot_vector, SQL_J3B),
    "k1_hash_encode": (k1_hash_encode, SQL_K1),
    "k2_encode_distinct": (k2_encode_distinct, SQL_K2),
    "m1_star_edges": (m1_star_edges, SQL_M1),
    "m2_centre_vectors": (m2_centre_vectors, SQL_M2),
    "m3_vocabulary": (m3_vocabulary, SQL_M3),
    "m4_column_views": (m4_column_views, SQL_M4),
    "m5_corrupted_view": (m5_corrupted_view, SQL_M5),
}
