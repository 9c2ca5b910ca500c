"""Row graphs and column views (M1-M5).

A table row becomes a star: one leaf per non-null cell. In long form each
leaf is a row ``(row_id, column, kind, edge, x)``: ``edge`` = vector of the
column name, ``x`` = vector of the lower-cased text value, or value x vector
of the column name for numbers. Vectors come from the vocabulary (M3), encoded
once per distinct string (K2) and joined in.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..core import positions, seeded_hash
from .encoder import HashingEncoder, encode


def vocabulary(df: DataFrame, text_cols: list[str], num_cols: list[str]) -> DataFrame:
    """M3: column names and lower-cased distinct text values, indexed 0.. in sort order."""
    spark = df.sparkSession
    names = spark.createDataFrame([(c,) for c in text_cols + num_cols], "term string")
    terms = names
    if text_cols:  # one read for all columns
        cells = F.array(*[F.lower(F.col(f"`{c}`").cast("string")) for c in text_cols])
        terms = names.unionByName(df.select(F.explode(cells).alias("term")).filter("term is not null"))
    terms = terms.distinct()
    return positions(terms, [], ["term"], out="_p").select("term", (F.col("_p") - 1).alias("idx"))


def _rounded(v, digits: int):
    """Element-wise rounding; a negative zero becomes zero."""
    def one(x):
        r = F.round(x, digits)
        return F.when(r == 0, F.lit(0.0)).otherwise(r)
    return F.transform(v, one)


def star_edges(df: DataFrame, row_id: str, text_cols: list[str], num_cols: list[str], encoder=None,
               digits: int = 6, num_transformer=None, fit_on: DataFrame | None = None) -> DataFrame:
    """M1: leaves of every row's star graph, and one self-loop per leaf (edge of
    ones); the centre has none.

    Vectors of the column names are literals (a few columns); vectors of text
    values are encoded once per distinct value and joined on the value. The table is read once: each row is
    unpivoted into its leaves.

    ``num_transformer`` (K3) takes an object with ``fit(df, cols)`` and ``transform(df)``, such as ``features.PowerTransformer``;
    it is fitted on ``fit_on`` (the training rows) or on ``df``, and numbers enter the graph as it leaves them."""
    encoder = encoder or HashingEncoder(8)
    spark = df.sparkSession
    if num_transformer is not None and num_cols:
        df = num_transformer.fit(df if fit_on is None else fit_on, num_cols).transform(df)
    names = spark.createDataFrame([(c,) for c in [*text_cols, *num_cols]], "term string")
    of_name = {r["term"]: r["v"] for r in encode(names, "term", encoder, "v").select("term", "v").collect()}
    name_vector = {c: F.array(*[F.lit(float(x)) for x in v]) for c, v in of_name.items()}

    def leaf(c: str, kind: str):
        text, value = F.lower(F.col(f"`{c}`").cast("string")), F.col(f"`{c}`").cast("double")
        none = F.lit(None)
        return F.struct(F.lit(c).alias("column"), F.lit(kind).alias("kind"), name_vector[c].alias("edge"),
                        (text if kind == "text" else none).cast("string").alias("term"), (value if kind == "num" else none).cast("double").alias("value"))

    wanted = [(c, "text") for c in text_cols] + [(c, "num") for c in num_cols]
    leaves = (df.select(F.col(row_id).alias("row_id"), F.explode(F.array(*[leaf(c, k) for c, k in wanted])).alias("l"))
              .select("row_id", "l.*").filter("term is not null or value is not null"))
    x = F.transform("edge", lambda e: e * F.col("value"))
    if text_cols:
        values = encode(leaves.select("term").filter("term is not null").distinct(), "term", encoder, "xv").select("term", "xv")
        leaves = leaves.join(values, "term", "left")
        x = F.when(F.col("value").isNotNull(), x).otherwise(F.col("xv"))
    leaves = leaves.withColumn("x", x)
    leaves = leaves.select("row_id", "column", "kind", _rounded(F.col("edge"), digits).alias("edge"),
                           _rounded(F.col("x"), digits).alias("x"))
    ones = F.array_repeat(F.lit(1.0), encoder.dim)
    loop = F.struct(F.lit("self").alias("kind"), ones.alias("edge"), F.lit(None).cast("array<double>").alias("x"))
    both = F.explode(F.array(F.struct("kind", "edge", "x"), loop)).alias("l")
    return leaves.select("row_id", "column", both).select("row_id", "column", "l.*")


def centre_vectors(edges: DataFrame, digits: int = 6) -> DataFrame:
    """M2: centre = mean over a row's leaves of edge * x (element-wise).
    Leaves per row are bounded by the column count, so the per-row list is small."""
    leaves = edges.filter(F.col("kind") != "self").withColumn(
        "_p", F.zip_with("edge", "x", lambda a, b: a * b))
    g = leaves.groupBy("row_id").agg(F.collect_list("_p").alias("_l"), F.count(F.lit(1)).alias("_n"))
    first = F.col("_l")[0]
    summed = F.aggregate(F.slice(F.col("_l"), F.lit(2), F.size("_l")), first, lambda acc, a: F.zip_with(acc, a, lambda x, y: x + y))
    return g.select("row_id", _rounded(F.transform(summed, lambda x: x / F.col("_n")), digits).alias("centre"))


def view_columns(cols: list[str], n: int, overlap_ratio: float) -> list[list[str]]:
    """M4 plan: ``n`` consecutive groups whose sizes differ by at most one, the
    larger first; each borrows ``ceil(first size * ratio)`` columns of its neighbour:
    the beginning of the next group, for the last group the end of the one before."""
    bound = [i * (len(cols) // n) + min(i, len(cols) % n) for i in range(n + 1)]
    group = [cols[bound[i]:bound[i + 1]] for i in range(n)]
    borrow = math.ceil(len(group[0]) * overlap_ratio)

    def borrowed(i: int) -> list[str]:
        if n == 1 or not borrow:
            return []
        return group[i + 1][:borrow] if i + 1 < n else group[i - 1][-borrow:]

    return [group[i] + borrowed(i) for i in range(n)]


def column_views(df: DataFrame, cols: list[str], n: int, overlap_ratio: float, keep: list[str] = ()) -> DataFrame:
    """M4: the views of ``view_columns`` as one frame with a ``view`` number; columns
    that a view lacks are NULL."""
    views = [df.select(*keep, *picked, F.lit(i).alias("view"))
             for i, picked in enumerate(view_columns(cols, n, overlap_ratio))]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), views)


def corrupted_view(df: DataFrame, row_id: str, cols: list[str], seed: int = 42) -> DataFrame:
    """M5: the first ``int(len(cols) * 0.5)`` columns are permuted as one block
    across rows: the row at id-rank r takes the block of the row at seeded rank r."""
    n_c = int(len(cols) * 0.5)
    block, rest = cols[:n_c], cols[n_c:]
    # ids alone are ranked; the rows join their places
    ids = df.select(row_id)
    by_id = positions(ids, [], [row_id], out="_r")
    keyed = ids.withColumn("_o", seeded_hash(seed, row_id))
    by_perm = positions(keyed, [], ["_o", row_id], out="_r").select(F.col(row_id).alias("_from"), "_r")
    give = df.select(F.col(row_id).alias("_from"), *block)
    return (df.select(row_id, *rest).join(by_id, row_id).join(by_perm, "_r").join(give, "_from")
            .select(row_id, *rest, *block))
