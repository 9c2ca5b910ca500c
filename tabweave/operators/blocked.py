"""Blocked top-k similarity join — the engine room of exact and bucketed matching.

Exact nearest-neighbour search needs every (left, right) comparison. Emitting
those comparisons as rows (a cross join, or all pairs inside an LSH bucket /
a shared token) is quadratic in *rows* and melts at scale. Here:

1. per join key, each side is cut into hash blocks of at most ``block_rows``
   rows (``pmod(xxhash64(id), n_blocks)``; ids are unique, so blocks are
   balanced even when one key holds a third of all rows);
2. every left block meets every right block of the same key through a
   ``cogroup`` on ``(key, left_block, right_block)`` — a block is shipped once
   per partner block, never once per partner row;
3. a vectorised numpy kernel scores the block pair and keeps only the local
   top-k per left row;
4. local winners are merged per left row (at most ``k`` x right blocks rows).

Ties break on the smaller right id, so results are deterministic.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_BLOCK_ROWS = 4096
HOT_COLUMNS = 1024  # columns of the dense part of the sparse kernel at once
COLD_PAIRS = 1 << 21  # posting pairs at once
MATRIX = 1 << 24  # similarities of a block pair at once


def _block_counts(df: DataFrame, key: list[str], block_rows: int, name: str) -> DataFrame:
    return df.groupBy(*key).agg(
        F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / F.lit(block_rows))).cast("int").alias(name))


def blocked_pairs_topk(left: DataFrame, right: DataFrame, key: list[str], k: int,
                       kernel, payload_schema: str, block_rows: int = DEFAULT_BLOCK_ROWS,
                       exclude_same_id: bool = False, bucket: str | None = None,
                       sizes: tuple[int, int] | None = None) -> DataFrame:
    """Top-k right rows per left row, scored by ``kernel`` block pair by block pair.

    ``left`` and ``right`` carry ``id`` (bigint), the ``key`` columns and the
    payload columns the kernel reads. ``kernel(lp, rp)`` gets two pandas
    frames (right sorted by id) and returns the similarity matrix.
    With ``bucket`` (a bigint column, e.g. an LSH signature) only pairs in the
    same bucket are candidates: buckets are packed into super-buckets of about
    ``block_rows`` rows (hash of the bucket), so thousands of tiny buckets do not
    each pay a Python call; inside one, each bucket's slices are scored apart.
    ``sizes`` (row counts of both sides) spares two count jobs when known.
    Output: ``t1_id, t2_id, sim, rank`` (rank 1..k).
    """
    left, right = _fresh(left), _fresh(right)  # new attribute ids: T1 and T2 may share a lineage
    if bucket is not None:
        n_super = max(1, -(-left.count() // block_rows))
        left = left.withColumn("_sb", F.pmod(F.xxhash64(bucket), F.lit(n_super)))
        right = right.withColumn("_sb", F.pmod(F.xxhash64(bucket), F.lit(n_super)))
        key = [*key, "_sb"]
    if key:
        nl = _block_counts(left, key, block_rows, "_nl")
        nr = _block_counts(right, key, block_rows, "_nr")
        counts = nl.join(nr, key, "inner")  # keys present on one side only have no pairs
        left = left.join(_fresh(counts), key, "inner")
        right = right.join(_fresh(counts), key, "inner")
        n_l, n_r = F.col("_nl"), F.col("_nr")
    else:
        # one global key: block counts are plain numbers (no join on a constant key)
        sizes = sizes or (left.count(), right.count())
        n_l = F.lit(max(1, -(-sizes[0] // block_rows)))
        n_r = F.lit(max(1, -(-sizes[1] // block_rows)))
    lx = (left.withColumn("_lb", F.pmod(F.xxhash64("id"), n_l).cast("int"))
          .withColumn("_rb", F.explode(F.sequence(F.lit(0), n_r - 1)))
          .drop("_nl", "_nr"))
    rx = (right.withColumn("_rb", F.pmod(F.xxhash64("id"), n_r).cast("int"))
          .withColumn("_lb", F.explode(F.sequence(F.lit(0), n_l - 1)))
          .drop("_nl", "_nr"))
    gk = [*key, "_lb", "_rb"]

    def run(lp: pd.DataFrame, rp: pd.DataFrame) -> pd.DataFrame:
        if len(lp) == 0 or len(rp) == 0:
            return pd.DataFrame({"t1_id": pd.Series(dtype="int64"), "t2_id": pd.Series(dtype="int64"),
                                 "sim": pd.Series(dtype="float64")})
        lp = lp.reset_index(drop=True)
        rp = rp.sort_values("id", kind="stable").reset_index(drop=True)
        t1 = lp["id"].to_numpy(np.int64)
        t2 = rp["id"].to_numpy(np.int64)
        step, best = max(1, MATRIX // len(rp)), []
        for at in range(0, len(lp), step):
            part = slice(at, at + step)
            sims = kernel(lp[part].reset_index(drop=True), rp)
            if exclude_same_id:
                sims[t1[part][:, None] == t2[None, :]] = -np.inf
            best.append(_topk_rows(sims, t1[part], t2, k))
        return pd.concat(best)

    def run_buckets(lp: pd.DataFrame, rp: pd.DataFrame) -> pd.DataFrame:
        right = dict(list(rp.groupby(bucket)))
        found = [run(part, right[b]) for b, part in lp.groupby(bucket) if b in right]
        return pd.concat([run(lp[:0], rp[:0]), *found])

    local = (lx.groupBy(*gk).cogroup(rx.groupBy(*gk))
             .applyInPandas(run if bucket is None else run_buckets, "t1_id bigint, t2_id bigint, sim double"))
    # duplicates (the same pair found in two buckets) collapse before ranking
    return _merged_topk(local, k, bucket is not None)


def _merged_topk(local: DataFrame, k: int, once: bool = False) -> DataFrame:
    """The best ``k`` of each row of the blocks' results; ``once``: a pair may have been found twice."""
    if k == 1:
        # Partial aggregation: max of (sim, -t2_id) picks the best, smaller id on ties.
        best = local.groupBy("t1_id").agg(F.max(F.struct(F.col("sim"), (-F.col("t2_id")).alias("neg"))).alias("b"))
        return best.select("t1_id", (-F.col("b.neg")).alias("t2_id"), F.col("b.sim").alias("sim"),
                           F.lit(1).alias("rank"))
    local = local.groupBy("t1_id", "t2_id").agg(F.max("sim").alias("sim")) if once else local
    w = Window.partitionBy("t1_id").orderBy(F.col("sim").desc(), F.col("t2_id").asc())
    return (local.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k))


def one_block_topk(left: DataFrame, right: DataFrame, k: int, kernel, block_rows: int = DEFAULT_BLOCK_ROWS) -> DataFrame:
    """As ``blocked_pairs_topk`` where ``right`` is one block that may go to every task: the left rows meet it where they
    are, none is shuffled. The caller bounds the rows and bytes of ``right``."""
    rp = right.toPandas().sort_values("id", kind="stable").reset_index(drop=True)
    sent = left.sparkSession.sparkContext.broadcast(rp)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rp = sent.value
        t2 = rp["id"].to_numpy(np.int64)
        for part in parts:
            for at in range(0, len(part) if len(rp) else 0, block_rows):
                lp = part.iloc[at:at + block_rows].reset_index(drop=True)
                yield _topk_rows(kernel(lp, rp), lp["id"].to_numpy(np.int64), t2, k)

    return _merged_topk(left.mapInPandas(run, "t1_id bigint, t2_id bigint, sim double"), k)


def blocked_apply(left: DataFrame, right: DataFrame, run, schema: str, block_rows: int, sizes: tuple[int, int]) -> DataFrame:
    """``run(left block, right block)`` on every pair of hash blocks of about ``block_rows`` rows; both sides carry ``id``."""
    n_l, n_r = (max(1, -(-n // block_rows)) for n in sizes)
    lx = _fresh(left).withColumn("_lb", F.pmod(F.xxhash64("id"), F.lit(n_l))).withColumn(
        "_rb", F.explode(F.sequence(F.lit(0), F.lit(n_r - 1))))
    rx = _fresh(right).withColumn("_rb", F.pmod(F.xxhash64("id"), F.lit(n_r)).cast("int")).withColumn(
        "_lb", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_l - 1).cast("bigint"))))
    return lx.groupBy("_lb", "_rb").cogroup(rx.groupBy("_lb", "_rb")).applyInPandas(run, schema)


def _fresh(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(f"`{c}`").alias(c) for c in df.columns])


def _topk_rows(sims: np.ndarray, t1_ids: np.ndarray, t2_ids: np.ndarray, k: int) -> pd.DataFrame:
    """Local top-k per row of ``sims`` (columns already in ascending t2 id order)."""
    kk = min(k, sims.shape[1])
    if kk == 1:
        idx = np.argmax(sims, axis=1)[:, None]  # first max = smallest id
    else:
        # stable sort on -sim keeps ascending id order among equal sims
        idx = np.argsort(-sims, axis=1, kind="stable")[:, :kk]
    rows = np.repeat(np.arange(sims.shape[0]), kk)
    cols = idx.reshape(-1)
    vals = sims[rows, cols]
    keep = np.isfinite(vals)
    return pd.DataFrame({"t1_id": t1_ids[rows][keep], "t2_id": t2_ids[cols][keep], "sim": vals[keep]})


# ------------------------------------------------------------------- kernels
def dense_cosine_kernel(lp: pd.DataFrame, rp: pd.DataFrame) -> np.ndarray:
    """Cosine on L2-normalised dense vectors (``vec`` column), float64 accumulation."""
    a = _l2(np.vstack([np.asarray(v, dtype=np.float64) for v in lp["vec"]]))
    b = _l2(np.vstack([np.asarray(v, dtype=np.float64) for v in rp["vec"]]))
    return a @ b.T


def _l2(m: np.ndarray) -> np.ndarray:
    n = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)  # zero vectors stay zero


def sparse_dot_kernel(lp: pd.DataFrame, rp: pd.DataFrame) -> np.ndarray:
    """Cosine of sparse vectors (``tok`` bigint[] ids, ``w`` double[] weights,
    ``nrm`` their L2 norm). Tokens frequent on both sides go through a dense
    matmul, the long tail through a sorted posting merge — exact either way."""
    n1, n2 = len(lp), len(rp)
    l_len = lp["tok"].map(len).to_numpy()
    r_len = rp["tok"].map(len).to_numpy()
    l_doc = np.repeat(np.arange(n1), l_len)
    r_doc = np.repeat(np.arange(n2), r_len)
    l_tok = np.concatenate([np.asarray(t, np.int64) for t in lp["tok"]]) if l_len.sum() else np.zeros(0, np.int64)
    l_w = np.concatenate([np.asarray(t, np.float64) for t in lp["w"]]) if l_len.sum() else np.zeros(0)
    r_tok = np.concatenate([np.asarray(t, np.int64) for t in rp["tok"]]) if r_len.sum() else np.zeros(0, np.int64)
    r_w = np.concatenate([np.asarray(t, np.float64) for t in rp["w"]]) if r_len.sum() else np.zeros(0)
    if "nrm" in lp:
        ln, rn = lp["nrm"].to_numpy(np.float64), rp["nrm"].to_numpy(np.float64)
        l_w = l_w / np.where(ln > 0, ln, 1.0)[l_doc]
        r_w = r_w / np.where(rn > 0, rn, 1.0)[r_doc]
    sims = np.zeros((n1, n2), dtype=np.float64)
    if len(l_tok) and len(r_tok):
        vocab, inv = np.unique(np.concatenate([l_tok, r_tok]), return_inverse=True)
        li, ri = inv[: len(l_tok)], inv[len(l_tok):]
        df1 = np.bincount(li, minlength=len(vocab))
        df2 = np.bincount(ri, minlength=len(vocab))
        hot = (df1 * df2) * 64 >= max(n1 * n2, 1)
        hot &= (df1 > 0) & (df2 > 0)
        if hot.any():
            hot_tokens = np.flatnonzero(hot)
            for at in range(0, len(hot_tokens), HOT_COLUMNS):  # dense, some columns at a time
                column = -np.ones(len(vocab), np.int64)
                part = hot_tokens[at:at + HOT_COLUMNS]
                column[part] = np.arange(len(part))
                a, b = np.zeros((n1, len(part))), np.zeros((n2, len(part)))
                lm, rm = column[li] >= 0, column[ri] >= 0
                a[l_doc[lm], column[li[lm]]] = l_w[lm]
                b[r_doc[rm], column[ri[rm]]] = r_w[rm]
                sims += a @ b.T
        lm = ~hot[li]
        rm = ~hot[ri]
        lt, ld, lw = li[lm], l_doc[lm], l_w[lm]
        rt, rd, rw = ri[rm], r_doc[rm], r_w[rm]
        order = np.argsort(rt, kind="stable")
        rt, rd, rw = rt[order], rd[order], rw[order]
        lo = np.searchsorted(rt, lt, "left")
        hi = np.searchsorted(rt, lt, "right")
        cnt = hi - lo
        flat_sims = sims.reshape(-1)
        upto = np.cumsum(cnt)
        at = 0
        while at < len(lt):  # posting pairs, some at a time (a token that is not hot has few)
            end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + COLD_PAIRS, "right")))
            n = cnt[at:end]
            if n.sum():
                rep = np.repeat(np.arange(at, end), n)
                ridx = np.arange(n.sum()) + np.repeat(lo[at:end] - (np.cumsum(n) - n), n)
                np.add.at(flat_sims, ld[rep] * n2 + rd[ridx], lw[rep] * rw[ridx])
            at = end
    return sims
