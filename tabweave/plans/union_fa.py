"""P2 Union-FA: widen each task row with its most similar auxiliary row, where
the two tables share no key and only partly share a schema. Rows are turned
into ``col: value`` texts (I18) and matched by TF-IDF cosine (C5)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import row_text
from ..operators import match as M
from ..operators.aggregate import similarity_buckets
from ..operators.prepare import resolve_text_columns


def union_fa(task: DataFrame, task_id: str, aux: DataFrame, aux_id: str, include_task=None, include_aux=None,
             exclude=(), threshold: float | None = None, prefix: str = "aux_") -> dict:
    # one list excludes columns of either table; a name that neither has raises
    unknown = sorted(set(exclude).difference(task.columns, aux.columns))
    if unknown:
        raise ValueError(f"columns to exclude in neither table: {unknown}")
    t_cols = resolve_text_columns(task.columns, include_task, [task_id, *[c for c in exclude if c in task.columns]])
    a_cols = resolve_text_columns(aux.columns, include_aux, [aux_id, *[c for c in exclude if c in aux.columns]])
    t = task.withColumn("_text", row_text(t_cols))
    a = aux.withColumn("_text", row_text(a_cols))
    # every output reads the matches
    m = M.apply_threshold(M.text_knn(t, task_id, "_text", a, aux_id, "_text", k=1).checkpoint(eager=True), threshold)
    ti = t.select(F.col(task_id).cast("bigint").alias("task_index"), F.col("_text").alias("task_text"))
    ai = a.select(F.col(aux_id).cast("bigint").alias("_a"), F.col("_text").alias("aux_text"))
    mapping = (ti.join(m.select(F.col("t1_id").alias("task_index"), F.col("t2_id").alias("_a"), "sim"), "task_index", "left")
               .join(ai, "_a", "left")
               .select("task_index", F.coalesce("_a", F.lit(-1)).alias("aux_index"), "task_text",
                       "aux_text", F.round("sim", 6).alias("cosine_similarity"),
                       F.round(1 - F.round("sim", 6), 6).alias("cosine_distance")))
    enriched = M.enrich(task, task_id, aux, aux_id, m, prefix)
    names = M.enriched_names(task.columns, aux.columns, prefix)
    col_map = task.sparkSession.createDataFrame([(k, v, k != v) for k, v in names.items()],
                                                "aux_column string, augmented_column string, renamed boolean")
    stats = similarity_buckets(mapping.withColumn("t2_index", F.when(F.col("aux_index") >= 0, F.col("aux_index"))))
    return {"mapping": mapping, "enriched": enriched, "column_map": col_map, "buckets": stats,
            "matched": M.matched_aux(task, task_id, aux, aux_id, m)}
