"""P1 Join-FA and P3 rank/random ablation: match, map, widen, summarise.

Spark shape: one scan + tokenise/encode stage per table, one blocked top-k
shuffle, then two equi joins on row ids. The driver only sees counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..core import table
from ..functions.vectors import cosine
from ..operators import match as M
from ..operators.aggregate import match_statistics, similarity_buckets
from ..operators.encoder import encode_distinct
from ..operators.ivf import VectorIndex, ivf_knn
from ..session import ensure_checkpoint_dir


def join_fa_text(spark: SparkSession, sf_dir: str, threshold: float | None = None,
                 prefix: str = "t2_") -> dict[str, DataFrame]:
    """Task = ``documents`` (text), aux = ``benchmark`` (text); TF-IDF 1-NN."""
    t1 = table(spark, sf_dir, "documents")
    t2 = table(spark, sf_dir, "benchmark")
    matches = M.text_knn(t1, "doc_id", "text", t2, "item_id", "text", k=1).checkpoint(eager=True)  # every output reads it
    return join_fa(t1, "doc_id", "text", t2, "item_id", "text", matches, threshold, prefix)


def encoded_pair(t1: DataFrame, t1_id: str, t1_text: str, t2: DataFrame, t2_id: str, t2_text: str,
                 encoder) -> tuple[DataFrame, DataFrame]:
    """(id, _vec) of both tables: each distinct text is encoded once (K1, K2); pinned, since matching reads it more than once."""
    ensure_checkpoint_dir(t1.sparkSession)
    return tuple(encode_distinct(t.select(i, c), c, encoder, "_vec").select(i, "_vec").checkpoint(eager=True)
                 for t, i, c in ((t1, t1_id, t1_text), (t2, t2_id, t2_text)))


def join_fa_encoded(t1: DataFrame, t1_id: str, t1_text: str, t2: DataFrame, t2_id: str, t2_text: str, encoder,
                    threshold: float | None = None, prefix: str = "t2_", cells: int | None = None,
                    nprobe: int = 8) -> dict[str, DataFrame]:
    """P1 by encoded text: each row's match from the ``nprobe`` nearest lists of an inverted file with exact scores (C2),
    then the outputs of ``join_fa``."""
    left, right = encoded_pair(t1, t1_id, t1_text, t2, t2_id, t2_text, encoder)
    matches = ivf_knn(left, t1_id, "_vec", VectorIndex(right, t2_id, "_vec", cells), nprobe).checkpoint(eager=True)
    return join_fa(t1, t1_id, t1_text, t2, t2_id, t2_text, matches, threshold, prefix)


def join_fa(t1: DataFrame, t1_id: str, t1_text: str, t2: DataFrame, t2_id: str, t2_text: str,
            matches: DataFrame, threshold: float | None = None, prefix: str = "t2_") -> dict[str, DataFrame]:
    matches = M.apply_threshold(matches, threshold)
    mapping = M.mapping_table(matches, t1, t1_id, t1_text, t2, t2_id, t2_text)
    return {
        "matches": matches,
        "mapping": mapping,
        "matched": M.matched_aux(t1, t1_id, t2, t2_id, matches),
        "enriched": M.enrich(t1, t1_id, t2, t2_id, matches, prefix),
        "stats": match_statistics(mapping),
        "buckets": similarity_buckets(mapping),
    }


def rank_ablation(t1: DataFrame, t1_id: str, t1_vec: str, t2: DataFrame, t2_id: str, t2_vec: str,
                  ranks: list[int], seed: int = 42, exclude_same_id: bool = False, include_random: bool = True,
                  prefix: str = "t2_", drop_t2: list[str] = ()) -> dict[str, dict[str, DataFrame]]:
    """One exact pass of depth ``max(ranks)``, pinned; of each rank (and of a
    random draw) the ``mapping`` (t1_index, t2_index, match_type, rank,
    cosine_similarity, cosine_distance), the ``enriched`` table and its ``stats``."""
    ensure_checkpoint_dir(t1.sparkSession)
    if t2.count() < max(ranks):
        raise ValueError(f"the auxiliary table has fewer rows than rank {max(ranks)}")
    knn = M.vector_knn(t1, t1_id, t1_vec, t2, t2_id, t2_vec, k=max(ranks), exclude_same_id=exclude_same_id)
    knn = knn.checkpoint(eager=True)  # every rank reads it
    picks = {f"rank{r}": (M.rank_match(knn, r), "rank_nn", r) for r in ranks}
    if include_random:
        drawn = M.random_match(t1, t1_id, t2, t2_id, seed)
        a = t1.select(F.col(t1_id).cast("bigint").alias("t1_id"), F.col(t1_vec).alias("_a"))
        b = t2.select(F.col(t2_id).cast("bigint").alias("t2_id"), F.col(t2_vec).alias("_b"))
        drawn = drawn.join(a, "t1_id").join(b, "t2_id").select("t1_id", "t2_id", cosine("_a", "_b").alias("sim"))
        picks["random"] = (drawn, "random", None)
    out = {}
    for name, (matches, kind, rank) in picks.items():
        sim = F.round("sim", 6)
        mapping = matches.select(F.col("t1_id").alias("t1_index"), F.col("t2_id").alias("t2_index"),
                                 F.lit(kind).alias("match_type"), F.lit(rank).cast("int").alias("rank"),
                                 sim.alias("cosine_similarity"), F.round(1 - sim, 6).alias("cosine_distance"))
        out[name] = {"matches": matches, "mapping": mapping, "stats": match_statistics(mapping),
                     "enriched": M.enrich(t1, t1_id, t2, t2_id, matches, prefix, drop_t2)}
    return out
