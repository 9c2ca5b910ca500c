"""Exact dedup by skew-safe combining.

Texts are equal when identical after lower-casing A-Z. Equal texts are combined
in three steps, each of which groups on the full text beside its digest, so a
digest collision can never merge different texts:

1. *locally*: the map-side partial aggregate folds the copies inside one input
   partition into one row;
2. *salted*: groups of (digest, salt, text), salt = input partition modulo
   ``salts``, so that the copies of one text arrive in up to ``salts`` tasks;
3. *globally*: the at most ``salts`` winners of each text.

Text is shuffled in steps 2 and 3 only, already combined. What goes back to the
rows is (digest, winner, size): a digest with one text needs no further
comparison; digests that several texts share (none, with SHA-256) take a join
on digest and text.

Defined results: a null text counts as empty; a null id loses against any other
id; rows that repeat an id and a text are one group of which exactly one row has
``kept``; an empty table gives an empty table; further columns are ignored by
``exact_groups`` and carried by ``exact_dedup``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, free_name, pinned

SALTS = 16


def sha256_hex(norm: Column) -> Column:
    return F.sha2(norm, 256)


def _normalised(text: str) -> Column:
    return ascii_lower(F.coalesce(F.col(text).cast("string"), F.lit("")))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS,
                 digest: Callable[[Column], Column] = sha256_hex) -> DataFrame:
    """One row per row of ``docs``: the id, ``keep_id`` (largest id of its group),
    ``group_size``, ``kept`` and ``text_sha256`` of the normalised text."""
    rows = docs.select(F.col(id_col).alias("id"), _normalised(text_col).alias("norm"))
    rows = rows.withColumn("dig", digest(F.col("norm")))
    salted = (rows.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
              .groupBy("dig", "salt", "norm").agg(F.max("id").alias("top"), F.count(F.lit(1)).alias("n")))
    texts = salted.groupBy("dig", "norm").agg(F.max("top").alias("top"), F.sum("n").alias("n"))
    winners = pinned(texts.groupBy("dig").agg(
        F.count(F.lit(1)).alias("texts"), F.max("top").alias("keep_id"), F.max("n").alias("group_size")))

    sha = sha256_hex(F.col("norm"))
    thin = rows.select("id", "dig", (F.col("dig") if digest is sha256_hex else sha).alias("text_sha256"))
    out = (thin.join(winners.filter("texts = 1").drop("texts"), "dig")
           .select("id", "keep_id", "group_size", "text_sha256"))
    shared = winners.filter("texts > 1").select("dig")
    if not shared.isEmpty():  # different texts with one digest: told apart by their text
        exact = texts.join(shared, "dig").select("dig", "norm", F.col("top").alias("keep_id"),
                                                 F.col("n").alias("group_size"))
        out = out.unionByName(rows.join(exact, ["dig", "norm"])
                              .select("id", "keep_id", "group_size", sha.alias("text_sha256")))
    repeat = F.row_number().over(Window.partitionBy("text_sha256", "id").orderBy(F.lit(1)))
    return out.withColumn("kept", F.col("id").eqNullSafe(F.col("keep_id")) & (repeat == 1)).select(
        F.col("id").alias(id_col), "keep_id", "group_size", "kept", "text_sha256")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    sha, key = free_name("_sha", docs), free_name("_key", docs)
    name = lambda c: F.coalesce(F.concat(F.lit("i"), c.cast("string")), F.lit("null"))  # noqa: E731  never null
    kept = (exact_groups(docs, id_col, text_col, salts).filter("kept")
            .select(name(F.col(id_col)).alias(key), F.col("text_sha256").alias(sha)))
    tagged = docs.withColumns({key: name(F.col(f"`{id_col}`")), sha: sha256_hex(_normalised(text_col))})
    # rows that repeat an id and a text are combined before they are shuffled; the join keeps that partitioning, so texts move once
    once = tagged.dropDuplicates([key, sha])
    return once.join(kept, [key, sha], "left_semi").select([F.col(f"`{c}`") for c in docs.columns])


ORACLE = f"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), '{'ABCDEFGHIJKLMNOPQRSTUVWXYZ'}', '{'abcdefghijklmnopqrstuvwxyz'}') AS norm
           FROM documents),
g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY norm)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.norm) AS text_sha256
FROM d JOIN g USING (norm)
"""
