"""Row matching between a task table (T1) and an auxiliary table.

* ``tfidf_vectors`` / ``text_knn``     — C5/J11: TF-IDF cosine nearest rows
* ``vector_knn``                        — C1: exact cosine top-k on vectors, by pivots
* ``ivf.ivf_knn``                       — C2: inverted file + exact re-rank
* ``lsh_knn``                           — C2 by random-hyperplane buckets
* ``rank_match`` / ``random_match``     — C3 / C4
* ``apply_threshold``                   — C6
* ``mapping_table`` / ``matched_aux`` / ``enrich`` — C7 / C9 / C8

All matchers return ``t1_id, t2_id, sim, rank``; ties go to the smaller t2 id.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..core import measured, seeded_uint, spread
from ..session import ensure_checkpoint_dir
from ..functions.text import TOKEN_SPLIT, char_ngrams
from .blocked import (DEFAULT_BLOCK_ROWS, blocked_pairs_topk, dense_cosine_kernel,
                      one_block_topk, sparse_dot_kernel)
from .ivf import INDEX_GROUPS, MOST_BLOCK_NUMBERS, VectorIndex, pivot_knn
from .textbounds import bounded_topk

SPARSE_BLOCK_ROWS = 1024
TILE_ROWS = 4  # searched rows that share a bound
SENT_TERMS = 1 << 20  # terms that go to every task
GROUPS, MOST_BLOCK_ROWS = 32, 32_768  # blocks of a hot bucket, and rows of one


# ------------------------------------------------------------------ TF-IDF
def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row's distinct term hashes, ascending, and how often each occurs."""
    for batch in batches:
        lists = batch.column(2)
        n = len(lists)
        row = np.repeat(np.arange(n), np.diff(lists.offsets.to_numpy()))
        tok = lists.flatten().to_numpy()
        order = np.lexsort((tok, row))
        row, tok = row[order], tok[order]
        first = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (tok[1:] != tok[:-1]))) if len(row) else np.zeros(0, np.int64)
        ends = pa.array(np.append(0, np.cumsum(np.bincount(row[first], minlength=n))), pa.int32())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.ListArray.from_arrays(ends, pa.array(tok[first], pa.int64())),
             pa.ListArray.from_arrays(ends, pa.array(np.diff(np.append(first, len(row))), pa.int32()))], names=["side", "id", "tok", "tf"])


def term_rows(corpus: DataFrame, analyzer: str = "word") -> tuple[DataFrame, DataFrame]:
    """``side, id, text`` -> (``side, id, tok, tf`` of every row, ``tok, df``): 64-bit hashes of the distinct terms of the whole
    text, how often each occurs, and in how many texts. Rows with the same id are one text; a row without an id has no terms.
    ``analyzer``: ``word`` (letter/digit runs) or ``char3`` (padded trigrams). Terms are counted where the text is
    read: no shuffle takes one row a term."""
    if analyzer == "word":
        terms = F.split(F.lower(F.coalesce(F.col("text"), F.lit(""))), TOKEN_SPLIT)
    else:
        terms = char_ngrams("text", 3)
    hashed = F.transform(F.filter(F.coalesce(terms, F.array().cast("array<string>")), lambda t: t != ""), lambda t: F.xxhash64(t))
    ids = corpus.groupBy("side", "id").agg(F.count(F.lit(1)).alias("n"))
    unique = ids.filter("n > 1 or id is null").isEmpty()
    rows = spread(corpus).select("side", "id", hashed.alias("tok"))
    if not unique:
        rows = rows.groupBy("side", "id").agg(F.flatten(F.collect_list("tok")).alias("tok"))
    texts = measured(rows.mapInArrow(_counted, "side int, id bigint, tok array<bigint>, tf array<int>"))
    df_ = measured(texts.select(F.explode("tok").alias("tok")).groupBy("tok").agg(F.count(F.lit(1)).alias("df")))
    if not unique:
        texts = corpus.select("side", "id").join(texts, ["side", "id"], "left").select(
            "side", "id", F.coalesce("tok", F.array().cast("array<bigint>")).alias("tok"), F.coalesce("tf", F.array().cast("array<int>")).alias("tf"))
    return texts, df_


def weighted(texts: DataFrame, idf: DataFrame, sent_terms: int = SENT_TERMS) -> DataFrame:
    """``side, id, tok, tf`` and ``tok, df, idf`` -> ``side, id, tok, w, nrm``. The terms of the most texts, at most ``sent_terms``, go to
    every task (16 bytes each). Where the others all occur in one text, they share one number; else only they are joined, one row
    each time a text has one, and the vectors once."""
    spark = texts.sparkSession
    size = F.floor(F.log2("df")).cast("int")
    sizes = {r["b"]: r["n"] for r in idf.groupBy(size.alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a power of two
    least, held = max(sizes, default=-1) + 1, 0
    while least and held + sizes.get(least - 1, 0) <= sent_terms:
        least, held = least - 1, held + sizes.get(least - 1, 0)
    got = idf.filter(size >= least).orderBy("tok").toArrow()  # at most sent_terms rows
    rest = idf.filter(size < least)
    alone = rest.first()["idf"] if least == 1 else None  # of a term that only one text has
    sent = spark.sparkContext.broadcast((got.column("tok").to_numpy(), got.column("idf").to_numpy()))

    def found(flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which terms were sent, and the idf of these."""
        known, idf = sent.value
        if not len(known):
            return np.zeros(len(flat), bool), np.ones(len(flat))
        at = np.minimum(np.searchsorted(known, flat), len(known) - 1)
        return known[at] == flat, idf[at]

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tok = batch.column(2)
            flat = tok.flatten().to_numpy()
            row = np.repeat(np.arange(len(tok)), np.diff(tok.offsets.to_numpy()))
            at = np.flatnonzero(~found(flat)[0])
            of = pa.array(row[at])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(of), batch.column(1).take(of), pa.array(flat[at])], names=["side", "id", "tok"])

    if least > 1:
        each = texts.mapInArrow(others, "side int, id bigint, tok bigint").join(rest.select("tok", "idf"), "tok")
        # one set filled by one aggregate keeps terms and numbers together, and takes a text that comes twice once
        each = each.groupBy("side", "id").agg(F.sort_array(F.collect_set(F.struct("tok", "idf")))["idf"].alias("idf"))
        texts = texts.join(each, ["side", "id"], "left").select("side", "id", "tok", "tf", "idf")  # ascending terms, as in tok
    else:
        texts = texts.withColumn("idf", F.lit(None).cast("array<double>"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tok = batch.column(2)
            ends = np.append(0, np.cumsum(np.diff(tok.offsets.to_numpy())))
            flat = tok.flatten().to_numpy()
            there, idf = found(flat)
            idf = np.where(there, idf, alone if alone is not None else 0.0)
            if least > 1:
                idf[~there] = batch.column(4).flatten().to_numpy()
            w = batch.column(3).flatten().to_numpy() * idf if len(flat) else np.zeros(0)
            row = np.repeat(np.arange(len(tok)), np.diff(ends))
            nrm = np.sqrt(np.bincount(row, w * w, minlength=len(tok)))
            at = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(at, pa.array(flat, pa.int64())),
                                              pa.ListArray.from_arrays(at, pa.array(w, pa.float64())), pa.array(nrm, pa.float64())],
                                             names=["side", "id", "tok", "w", "nrm"])

    return texts.mapInArrow(run, "side int, id bigint, tok array<bigint>, w array<double>, nrm double")


def tfidf_vectors(corpus: DataFrame, analyzer: str = "word") -> DataFrame:
    """TF-IDF vectors, idf = ln((1+N)/(1+df)) + 1 over the corpus.

    Output ``side, id, tok array<bigint>`` (64-bit term hashes), ``w
    array<double>`` (raw weights) and ``nrm`` (their L2 norm; the kernel
    divides). A text with no token gets empty arrays (a zero vector).
    """
    texts, idf = _texts_and_idf(corpus, analyzer)
    return weighted(texts, idf)


def _texts_and_idf(corpus: DataFrame, analyzer: str) -> tuple[DataFrame, DataFrame]:
    n_docs = corpus.count()
    texts, df_ = term_rows(corpus, analyzer)
    return texts, df_.select("tok", "df", (F.ln((F.lit(n_docs) + 1).cast("double") / (F.col("df") + 1).cast("double")) + 1).alias("idf"))


def text_knn(t1: DataFrame, t1_id: str, t1_text: str, t2: DataFrame, t2_id: str, t2_text: str,
             k: int = 1, block_rows: int = SPARSE_BLOCK_ROWS, analyzer: str = "word", tile_rows: int = TILE_ROWS,
             counted: list | None = None) -> DataFrame:
    """TF-IDF cosine top-k of each T1 text among T2 texts (exact). Where T2 fills several blocks, a row goes
    only to those that a bound does not rule out (``textbounds``); a single block meets every row once anyway."""
    ensure_checkpoint_dir(t1.sparkSession)
    corpus = (t1.select(F.lit(1).alias("side"), F.col(t1_id).cast("bigint").alias("id"), F.col(t1_text).alias("text"))
              .unionByName(t2.select(F.lit(2).alias("side"), F.col(t2_id).cast("bigint").alias("id"),
                                     F.col(t2_text).alias("text"))))
    # one vector per input row: the block counts come from the (cheap) input counts
    sizes = t1.count(), t2.count()
    texts, idf = _texts_and_idf(corpus, analyzer)
    if sizes[1] > block_rows:
        # both sides and the bounds read the vectors: compute them once
        vec = weighted(texts, idf).checkpoint(eager=True)
        return bounded_topk(vec.filter("side = 1").drop("side"), vec.filter("side = 2").drop("side"), k, block_rows, tile_rows, sizes, counted)
    left, right = (weighted(texts.filter(F.col("side") == side), idf).drop("side") for side in (1, 2))
    if (texts.filter("side = 2").agg(F.sum(F.size("tok"))).first()[0] or 0) <= SENT_TERMS:
        return one_block_topk(left, right, k, sparse_dot_kernel, block_rows)
    return blocked_pairs_topk(left, right, [], k, sparse_dot_kernel, "tok array<bigint>, w array<double>",
                              block_rows, sizes=sizes)


# ------------------------------------------------------------------ dense vectors
def vector_knn(t1: DataFrame, t1_id: str, t1_vec: str, t2: DataFrame, t2_id: str, t2_vec: str,
               k: int = 1, exclude_same_id: bool = False, block_rows: int = DEFAULT_BLOCK_ROWS,
               cells: int | None = None, nprobe: int = 2) -> DataFrame:
    """Exact cosine top-k by pivots: the rows of the nearest cells first, then those of every cell that the
    triangle inequality does not rule out (``ivf.pivot_knn``). Where T2 is a single block every row meets it once anyway, and
    no cell is worth its bound. Null vectors match nothing; zero ones have similarity 0.

    ``exclude_same_id`` drops the row itself when T1 and T2 are the same table.
    """
    n2 = t2.count()
    if n2 <= block_rows:
        left, right = (t.select(F.col(i).cast("bigint").alias("id"), F.col(v).alias("vec")).filter("vec is not null")
                       for t, i, v in ((t1, t1_id, t1_vec), (t2, t2_id, t2_vec)))
        return blocked_pairs_topk(left, right, [], k, dense_cosine_kernel, "vec array<double>", block_rows, exclude_same_id, sizes=(t1.count(), n2))
    # every row goes to most groups where the vectors have no clusters: their number has a limit, or the shuffle grows by the square
    dim = t2.agg(F.max(F.size(t2_vec))).first()[0] or 1
    index = VectorIndex(t2, t2_id, t2_vec, cells, block_rows=max(block_rows, min(MOST_BLOCK_NUMBERS // max(1, dim), -(-n2 // INDEX_GROUPS))))
    return pivot_knn(t1, t1_id, t1_vec, index, nprobe, k, exclude_same_id)


# ------------------------------------------------------------------ LSH
def _hyperplanes(dim: int, bits: int, tables: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dim, bits * tables))


def lsh_signatures(df: DataFrame, id_col: str, vec_col: str, dim: int, bits: int, tables: int,
                   seed: int = 42, probes: int = 0) -> DataFrame:
    """``id, vec, bucket``: one bucket per hash table (random hyperplanes) and, with
    ``probes``, the buckets across the ``probes`` nearest hyperplanes of each table."""
    planes = _hyperplanes(dim, bits, tables, seed)
    weights = (1 << np.arange(bits)).astype(np.int64)

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def buckets(v: pd.Series) -> pd.Series:
        if len(v) == 0:
            return pd.Series([], dtype=object)
        m = (np.vstack([np.asarray(x, np.float64) for x in v]) @ planes).reshape(len(v), tables, bits)
        own = ((m > 0) * weights).sum(axis=2)
        every = [own]
        if probes and bits:
            near = np.abs(m).argsort(axis=2)[:, :, :probes]
            every += [own ^ (1 << near[:, :, p]) for p in range(near.shape[2])]
        at = np.arange(tables) << bits
        return pd.Series(list(np.concatenate([e + at for e in every], axis=1)))

    return (spread(df.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).alias("vec")))
            .select("id", "vec", F.explode(buckets("vec")).alias("_bucket")))


def lsh_knn(t1: DataFrame, t1_id: str, t1_vec: str, t2: DataFrame, t2_id: str, t2_vec: str, dim: int,
            bits: int = 5, tables: int = 12, probes: int = 2, seed: int = 42, exclude_same_id: bool = False,
            block_rows: int = DEFAULT_BLOCK_ROWS) -> DataFrame:
    """C2 by hash buckets: approximate 1-NN, every T1 row with a match. ``ivf.ivf_knn`` reaches the same recall with
    fewer pairs.

    A T1 row is scored exactly against the T2 rows of its own bucket in each of
    ``tables`` hash tables and of ``probes`` neighbouring buckets. ``bits`` sets the
    bucket size (n2 / 2^bits rows): raise it with the table, the work per row stays
    about ``tables * (1 + probes) * n2 / 2^bits`` cells. Each bucket is scored by
    itself (a hot one in blocks). T1 rows whose buckets were all empty go on with half
    the bits, at last with none, which is the exact search. The arguments are the
    caller's; nothing switches on size. Recall depends on the data and is measured
    against ``vector_knn``."""
    spark = t1.sparkSession
    ensure_checkpoint_dir(spark)
    todo = t1.select(F.col(t1_id).cast("bigint").alias("id"), F.col(t1_vec).alias("vec"))
    there = t2.select(F.col(t2_id).cast("bigint").alias("id"), F.col(t2_vec).alias("vec"))
    # a hot bucket's rows go to each of its blocks: larger blocks, or the shuffle grows by the square
    block_rows = max(block_rows, min(MOST_BLOCK_ROWS, there.count() // GROUPS))
    found = None
    while True:
        if bits:
            left = lsh_signatures(todo, "id", "vec", dim, bits, tables, seed, probes)
            right = lsh_signatures(there, "id", "vec", dim, bits, tables, seed)
            best = blocked_pairs_topk(left, right, [], 1, dense_cosine_kernel, "vec array<float>", block_rows,
                                      exclude_same_id, bucket="_bucket")
        else:
            best = blocked_pairs_topk(todo, there, [], 1, dense_cosine_kernel, "vec array<float>", block_rows, exclude_same_id)
        best = best.checkpoint(eager=True)
        found = best if found is None else found.unionByName(best)
        todo = todo.join(best.select(F.col("t1_id").alias("id")), "id", "left_anti").checkpoint(eager=True)
        if not bits or todo.isEmpty():
            return found
        bits //= 2


# ------------------------------------------------------------------ rank / random
def rank_match(knn: DataFrame, rank: int) -> DataFrame:
    """Only the ``rank``-th neighbour (requires a top-k with k >= rank)."""
    if rank < 1:
        raise ValueError("rank must be >= 1")
    return knn.filter(F.col("rank") == rank)


def parse_ranks(text: str) -> list[int]:
    """``'8,1,2,2'`` -> ``[1, 2, 8]``; every rank must be >= 1."""
    ranks = sorted({int(x) for x in text.split(",") if x.strip()})
    if not ranks or ranks[0] < 1:
        raise ValueError(f"ranks must be positive integers: {text!r}")
    return ranks


def random_match(t1: DataFrame, t1_id: str, t2: DataFrame, t2_id: str, seed: int = 42) -> DataFrame:
    """Each T1 row draws a T2 row with replacement: position = seeded uint mod n2
    over T2 ordered by id (a dense 0..n2-1 index built without a global window)."""
    from ..core import positions
    n2 = t2.count()
    idx = positions(t2.select(F.col(t2_id).cast("bigint").alias("t2_id")), [], ["t2_id"], out="_pos")
    idx = idx.select("t2_id", (F.col("_pos") - 1).alias("_slot"))
    draw = t1.select(F.col(t1_id).cast("bigint").alias("t1_id"),
                     F.pmod(seeded_uint(seed, F.col(t1_id)), F.lit(n2)).alias("_slot"))
    return draw.join(idx, "_slot").select("t1_id", "t2_id")


# ------------------------------------------------------------------ threshold + outputs
def apply_threshold(matches: DataFrame, threshold: float | None) -> DataFrame:
    """Below the threshold the match is dropped (t2_id NULL); similarity is kept."""
    if threshold is None:
        return matches
    return matches.withColumn("t2_id", F.when(F.col("sim") >= threshold, F.col("t2_id")))


def mapping_table(matches: DataFrame, t1: DataFrame, t1_id: str, t1_text: str,
                  t2: DataFrame, t2_id: str, t2_text: str) -> DataFrame:
    """Ids, both texts, similarity and distance = 1 - similarity."""
    a = t1.select(F.col(t1_id).cast("bigint").alias("t1_index"), F.col(t1_text).alias("t1_text"))
    b = t2.select(F.col(t2_id).cast("bigint").alias("t2_index"), F.col(t2_text).alias("t2_text"))
    m = matches.select(F.col("t1_id").alias("t1_index"), F.col("t2_id").alias("t2_index"),
                       F.round("sim", 6).alias("cosine_similarity"))
    return (a.join(m, "t1_index", "left").join(b, "t2_index", "left")
            .select("t1_index", "t2_index", "t1_text", "t2_text", "cosine_similarity",
                    F.round(1 - F.col("cosine_similarity"), 6).alias("cosine_distance")))


def enriched_names(t1_cols: list[str], t2_cols: list[str], prefix: str = "t2_") -> dict[str, str]:
    """T2 column -> output name; a clash with T1 gets ``prefix``; still a clash raises."""
    taken = Counter(c.lower() for c in t1_cols)
    out = {c: f"{prefix}{c}" if c.lower() in taken else c for c in t2_cols}
    taken.update(c.lower() for c in out.values())
    clash = sorted(c for c, n in taken.items() if n > 1)
    if clash:
        raise ValueError(f"enriched table would have two columns named {clash}; choose another prefix than {prefix!r}")
    return out


def enrich(t1: DataFrame, t1_id: str, t2: DataFrame, t2_id: str, matches: DataFrame,
           prefix: str = "t2_", drop_t2: list[str] = (), check_rows: bool = False) -> DataFrame:
    """Each task row widened with its matched aux row (left join on ids).

    Aux columns listed in ``drop_t2`` are dropped first (absent ones ignored).
    The row count equals T1's by construction (one match per t1 id); with
    ``check_rows`` it is also verified by two counts.
    """
    t2 = t2.drop(*[c for c in drop_t2 if c in t2.columns])
    names = enriched_names(t1.columns, t2.columns, prefix)
    aux = t2.select(F.col(t2_id).cast("bigint").alias("_t2"), *[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    m = matches.select(F.col("t1_id").alias("_t1"), F.col("t2_id").alias("_t2"))
    out = (t1.join(m, t1[t1_id].cast("bigint") == m["_t1"], "left").join(aux, "_t2", "left")
           .select(*[t1[f"`{c}`"] for c in t1.columns], *[aux[f"`{n}`"] for n in names.values()]))
    if check_rows and out.count() != t1.count():
        raise RuntimeError("enriched table must keep the task row count")
    return out


def matched_aux(t1: DataFrame, t1_id: str, t2: DataFrame, t2_id: str, matches: DataFrame) -> DataFrame:
    """The matched aux row for each task row, keyed by the task row id."""
    m = matches.select(F.col("t1_id").alias("t1_index"), F.col("t2_id").alias("_t2"))
    ids = t1.select(F.col(t1_id).cast("bigint").alias("t1_index"))
    return (ids.join(m, "t1_index", "left")
            .join(t2.withColumn("_t2", F.col(t2_id).cast("bigint")), "_t2", "left").drop("_t2"))
