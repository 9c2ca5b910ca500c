"""Exact sparse top-k: rare terms joined, common ones bounded.

A pair's similarity is the sum over its shared terms. Terms are parted by the pairs that share them: the rare ones, which make at most
``PAIRS_A_ROW`` pairs a row in all, are joined, and each pair that shares one is scored in full (``bounded_topk``). What is left of a row are its
common terms. Rows with the same common terms and weights are searched for once, and of the searched rows with the same ones only the ``k``
shortest vectors can be a match: any other is no nearer by common terms, and a pair with a rare term has been scored. So what grows
with the square is the number of combinations of common terms, not of rows.

Where those combinations fill several blocks they meet by bounds (``tiled_topk``): searched rows are grouped into tiles of a few similar
ones, tiles into blocks. Of each tile the largest weight per token is kept: its product with a row's vector bounds the row's similarity to every
row of the tile. A row is scored against the tiles with the highest bounds first; after that only tiles whose bound reaches the row's
k-th best are open, and a row is shipped once to every block that holds an open tile, to no other.

Tiles are the cells of a quantiser over the vectors' signed projections to ``PROJECTION`` numbers (trained on a bounded
sample, ``ivf.VectorIndex``). They decide which rows share a bound, not which rows are found: the result is exact.
Weights are not negative, so a row without a shared token has similarity 0; rows that nothing matches get the smallest ids.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..core import measured
from .blocked import _block_counts, _fresh, _topk_rows, blocked_apply, blocked_pairs_topk, sparse_dot_kernel
from .ivf import MAX_CELLS, VectorIndex

PROJECTION = 64
SLACK = 1e-9
PAIRS_A_ROW = 16  # pairs that share a rare term, for each row of either side
FIRST = 2  # tiles with the highest bounds that are scored first

_FOUND = "t1_id bigint, t2_id bigint, sim double"
_NONE = pd.DataFrame({"t1_id": pd.Series(dtype="int64"), "t2_id": pd.Series(dtype="int64"), "sim": pd.Series(dtype="float64")})


def projected(vectors: DataFrame) -> DataFrame:
    """(id, vec): each token adds its weight, with a sign, to one of ``PROJECTION`` numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tok, w = batch.column(1), batch.column(2)
            row = np.repeat(np.arange(len(tok)), np.diff(tok.offsets.to_numpy()))
            t, x = tok.flatten().to_numpy(), w.flatten().to_numpy()
            out = np.zeros((len(tok), PROJECTION))
            np.add.at(out, (row, t & (PROJECTION - 1)), np.where(t & PROJECTION, -x, x))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(out), pa.list_(pa.float64()))], names=["id", "vec"])

    return vectors.select("id", "tok", "w").mapInArrow(run, "id bigint, vec array<double>")


def bounded_topk(left: DataFrame, right: DataFrame, k: int, block_rows: int, tile_rows: int, sizes: tuple[int, int],
                 counted: list | None = None) -> DataFrame:
    """``t1_id, t2_id, sim, rank`` from pinned sparse vectors ``id, tok, w, nrm``. Similarities that differ by less than the noise of their
    sums (1e-11) are equal. ``counted`` takes the numbers of pairs of rows that were scored and that there are."""
    spark = left.sparkSession
    low = [r["id"] for r in right.select("id").orderBy("id").limit(k).collect()]
    every = left.select("id")
    left, right = (_once(d.filter(F.size("tok") > 0)) for d in (left, right))
    # of copies of a vector, those with the smallest ids
    copies = Window.partitionBy("tok", "w").orderBy("id")
    right = right.withColumn("nth", F.row_number().over(copies)).filter(F.col("nth") <= k).drop("nth").checkpoint(eager=True)
    d1, d2 = (d.select(F.explode("tok").alias("tok")).groupBy("tok").agg(F.count(F.lit(1)).alias(n)) for d, n in ((left, "d1"), (right, "d2")))
    shared = measured(d2.join(d1, "tok").select("tok", (F.col("d1").cast("double") * F.col("d2")).alias("pairs")))
    size = F.floor(F.log2("pairs")).cast("int")
    room, most = PAIRS_A_ROW * sum(sizes), -1
    for r in sorted(shared.groupBy(size.alias("b")).agg(F.sum("pairs").alias("n")).collect()):  # a row a power of two
        if r["n"] > room:
            break
        room, most = room - r["n"], r["b"]
    # each of these makes more than 2^most pairs, so there are few
    common = spark.sparkContext.broadcast(shared.filter(size > most).select("tok").orderBy("tok").toArrow().column("tok").to_numpy())
    rare = shared.filter(size <= most).select("tok")

    def parted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tok, w = batch.column(1), batch.column(2)
            t, x = tok.flatten().to_numpy(), w.flatten().to_numpy()
            row = np.repeat(np.arange(len(tok)), np.diff(tok.offsets.to_numpy()))
            here = np.isin(t, common.value)
            lists = []
            for some in (here, ~here):
                at = pa.array(np.append(0, np.cumsum(np.bincount(row[some], minlength=len(tok)))), pa.int32())
                lists += [pa.ListArray.from_arrays(at, pa.array(t[some], pa.int64())), pa.ListArray.from_arrays(at, pa.array(x[some], pa.float64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(3), *lists], names=["id", "nrm", "tok", "w", "rtok", "rw"])

    left, right = (d.select("id", "tok", "w", "nrm").mapInArrow(
        parted, "id bigint, nrm double, tok array<bigint>, w array<double>, rtok array<bigint>, rw array<double>").checkpoint(eager=True) for d in (left, right))

    # pairs that share a rare term, with all their terms
    a, b = (d.select(F.col("id").alias(i), F.explode(F.arrays_zip("rtok", "rw")).alias("x")).select(i, F.col("x.rtok").alias("tok"), F.col("x.rw").alias(n))
            for d, i, n in ((left, "t1_id", "w1"), (right, "t2_id", "w2")))
    pairs = a.join(rare, "tok").join(b, "tok").groupBy("t1_id", "t2_id").agg(F.sum(F.col("w1") * F.col("w2")).alias("s"))
    pairs = (pairs.join(_fresh(left).select(F.col("id").alias("t1_id"), F.col("nrm").alias("n1"), F.col("tok").alias("tok1"), F.col("w").alias("w1")), "t1_id")
             .join(_fresh(right).select(F.col("id").alias("t2_id"), F.col("nrm").alias("n2"), F.col("tok").alias("tok2"), F.col("w").alias("w2")), "t2_id")
             .select("t1_id", "t2_id", "s", "n1", "n2", "tok1", "w1", "tok2", "w2").mapInArrow(_dots, _FOUND))

    # by common terms alone
    some = left.filter(F.size("tok") > 0)
    kinds = measured(some.groupBy("tok", "w").agg(F.min("id").alias("kind")))
    short = Window.partitionBy("tok", "w").orderBy("nrm", "id")
    ends = (right.filter(F.size("tok") > 0).withColumn("nrm", F.round("nrm", 12)).withColumn("nth", F.row_number().over(short))
            .filter(F.col("nth") <= k).select("id", "tok", "w", "nrm").checkpoint(eager=True))
    asked = kinds.select(F.col("kind").alias("id"), "tok", "w", F.lit(1.0).alias("nrm"))
    n = asked.count(), ends.count()
    tiled = n[1] > block_rows
    parts: list | None = [] if counted is not None else None
    if tiled:
        near = tiled_topk(asked, ends, k, block_rows, tile_rows, n, parts)
    else:
        near = blocked_pairs_topk(asked, ends, [], k, _even, "tok array<bigint>, w array<double>", block_rows, sizes=n)
    near = measured(near.select(F.col("t1_id").alias("kind"), "t2_id", "sim"))
    near = (some.select("id", "nrm", "tok", "w").join(kinds, ["tok", "w"]).select("id", "nrm", "kind").join(near, "kind")
            .select(F.col("id").alias("t1_id"), "t2_id", (F.col("sim") / F.col("nrm")).alias("sim")))
    if counted is not None:
        # a row that is shipped to a block is scored with its rows
        counted += [pairs.count() + (parts[0] * block_rows if tiled else n[0] * n[1]), sizes[0] * sizes[1]]
    none = every.select(F.col("id").alias("t1_id"), F.explode(F.array(*[F.lit(i).cast("bigint") for i in low])).alias("t2_id"), F.lit(0.0).alias("sim"))
    found = pairs.unionByName(near).unionByName(none).withColumn("s", F.round("sim", 11))
    if k == 1:
        best = found.groupBy("t1_id").agg(F.max(F.struct("s", (-F.col("t2_id")).alias("neg"), "sim")).alias("b"))
        return best.select("t1_id", (-F.col("b.neg")).alias("t2_id"), F.col("b.sim").alias("sim"), F.lit(1).alias("rank"))
    found = found.groupBy("t1_id", "t2_id").agg(F.max("s").alias("s"), F.max("sim").alias("sim"))
    w = Window.partitionBy("t1_id").orderBy(F.desc("s"), "t2_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("t1_id", "t2_id", "sim", "rank")


def _once(rows: DataFrame) -> DataFrame:
    """One row an id: rows with the same id are the same text."""
    return rows if rows.select("id").distinct().count() == rows.count() else rows.dropDuplicates(["id"])


def _dots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``s`` plus the product of the two sparse vectors of each row, over both lengths."""
    for batch in batches:
        n = batch.num_rows
        tok, w, row = [], [], []
        for t, x in ((5, 6), (7, 8)):
            lists = batch.column(t)
            row.append(np.repeat(np.arange(n), np.diff(lists.offsets.to_numpy())))
            tok.append(lists.flatten().to_numpy())
            w.append(batch.column(x).flatten().to_numpy())
        tok, w, row = (np.concatenate(v) for v in (tok, w, row))
        order = np.lexsort((tok, row))
        tok, w, row = tok[order], w[order], row[order]
        both = np.flatnonzero((tok[1:] == tok[:-1]) & (row[1:] == row[:-1]))  # a term comes once a vector
        sim = batch.column(2).to_numpy() + np.bincount(row[both], w[both] * w[both + 1], minlength=n)
        sim = sim / batch.column(3).to_numpy() / batch.column(4).to_numpy()
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sim, pa.float64())], names=["t1_id", "t2_id", "sim"])


def _even(lp: pd.DataFrame, rp: pd.DataFrame) -> np.ndarray:
    """Similarities without the noise of their sums, so that equal ones are equal."""
    return sparse_dot_kernel(lp, rp).round(12)


def tiled_topk(left: DataFrame, right: DataFrame, k: int, block_rows: int, tile_rows: int, sizes: tuple[int, int],
               counted: list | None = None) -> DataFrame:
    """``t1_id, t2_id, sim, rank`` from pinned sparse vectors ``id, tok, w, nrm``. ``counted`` takes the numbers of (row, block)
    pairs that were shipped and that there are."""
    n1, n2 = sizes
    left, right = (d.select("id", "tok", F.transform("w", lambda x: F.when(F.col("nrm") > 0, x / F.col("nrm")).otherwise(0.0)).alias("w"))
                   for d in (left, right))
    index = VectorIndex(projected(right), "id", "vec", min(MAX_CELLS, -(-n2 // tile_rows)), block_rows=block_rows)
    placed = right.join(index.rows.select("id", "cell", "grp"), "id").checkpoint(eager=True)
    # one list filled by one aggregate keeps tokens and weights together
    tiles = (placed.select("grp", "cell", F.explode(F.arrays_zip("tok", "w")).alias("x"))
             .groupBy("grp", "cell", F.col("x.tok").alias("tok")).agg(F.max("x.w").alias("w"))
             .groupBy("grp", "cell").agg(F.collect_list(F.struct("tok", "w")).alias("x"))
             .select(F.col("cell").cast("bigint").alias("id"), "grp", F.col("x.tok").alias("tok"), F.col("x.w").alias("w"))).checkpoint(eager=True)
    n_tiles = tiles.count()

    def highest(lp: pd.DataFrame, rp: pd.DataFrame) -> pd.DataFrame:
        if not len(lp) or not len(rp):
            return pd.DataFrame({"id": pd.Series(dtype="int64"), "grp": pd.Series(dtype="int32"), "cell": pd.Series(dtype="int32"), "bound": pd.Series(dtype="float64")})
        best = _topk_rows(sparse_dot_kernel(lp, rp), lp["id"].to_numpy(np.int64), np.arange(len(rp)), FIRST)
        at = best["t2_id"].to_numpy()
        return pd.DataFrame({"id": best["t1_id"], "grp": rp["grp"].to_numpy()[at], "cell": rp["id"].to_numpy()[at], "bound": best["sim"]})

    tops = blocked_apply(left, tiles, highest, "id bigint, grp int, cell int, bound double", block_rows, (n1, n_tiles))
    w = Window.partitionBy("id").orderBy(F.desc("bound"), "cell")
    tops = tops.filter("bound > 0").withColumn("nth", F.row_number().over(w)).filter(F.col("nth") <= FIRST)
    first_cells = tops.groupBy("id", "grp").agg(F.collect_list("cell").alias("cells")).checkpoint(eager=True)
    first = _scored(left.join(first_cells, "id"), placed, k, block_rows).checkpoint(eager=True)
    kth = first.groupBy("t1_id").agg(F.collect_list("sim").alias("s")).select(
        F.col("t1_id").alias("id"), F.coalesce(F.get(F.sort_array("s", asc=False), F.lit(k - 1)), F.lit(0.0)).alias("kth"))
    done = first_cells.groupBy("id").agg(F.flatten(F.collect_list("cells")).alias("done"))
    known = left.join(kth, "id").join(done, "id")  # a row without a first tile shares no token with any

    def still_open(lp: pd.DataFrame, rp: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"id": pd.Series(dtype="int64"), "grp": pd.Series(dtype="int32"), "cells": pd.Series(dtype="object")})
        if not len(lp) or not len(rp):
            return none
        bound = sparse_dot_kernel(lp, rp)
        row, col = np.nonzero((bound > 0) & (bound + SLACK >= lp["kth"].to_numpy()[:, None]))
        cell, grp = rp["id"].to_numpy()[col], rp["grp"].to_numpy()[col]
        done = lp["done"].to_numpy()
        fresh = np.array([c not in done[r] for r, c in zip(row.tolist(), cell.tolist())], bool)
        found = pd.DataFrame({"id": lp["id"].to_numpy()[row], "grp": grp, "cells": cell})[fresh]
        return found.groupby(["id", "grp"])["cells"].agg(list).reset_index() if len(found) else none

    open_cells = blocked_apply(known, tiles, still_open, "id bigint, grp int, cells array<int>", block_rows, (n1, n_tiles))
    open_cells = open_cells.groupBy("id", "grp").agg(F.flatten(F.collect_list("cells")).alias("cells")).checkpoint(eager=True)
    if counted is not None:
        both = first_cells.select("id", "grp").unionByName(open_cells.select("id", "grp")).distinct()
        counted += [both.count(), n1 * placed.select("grp").distinct().count()]
    second = _scored(left.join(open_cells, "id"), placed, k, block_rows)
    low = [r["id"] for r in right.select("id").orderBy("id").limit(k).collect()]
    none = left.select(F.col("id").alias("t1_id"), F.explode(F.array(*[F.lit(i) for i in low])).alias("t2_id"), F.lit(0.0).alias("sim"))
    found = first.unionByName(second).unionByName(none)
    if k == 1:
        best = found.groupBy("t1_id").agg(F.max(F.struct("sim", (-F.col("t2_id")).alias("neg"))).alias("b"))
        return best.select("t1_id", (-F.col("b.neg")).alias("t2_id"), F.col("b.sim").alias("sim"), F.lit(1).alias("rank"))
    found = found.groupBy("t1_id", "t2_id").agg(F.max("sim").alias("sim"))
    w = Window.partitionBy("t1_id").orderBy(F.desc("sim"), "t2_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _scored(routed: DataFrame, placed: DataFrame, k: int, block_rows: int) -> DataFrame:
    """The best ``k`` of each routed row (``id, tok, w, grp, cells``) within the open tiles of each block."""
    left, right = _fresh(routed), _fresh(placed)
    counts = _block_counts(left, ["grp"], block_rows, "_nl").join(_block_counts(right, ["grp"], block_rows, "_nr"), "grp")
    left, right = left.join(counts, "grp"), right.join(_fresh(counts), "grp")
    lx = (left.withColumn("_lb", F.pmod(F.xxhash64("id"), "_nl").cast("int"))
          .withColumn("_rb", F.explode(F.sequence(F.lit(0), F.col("_nr") - 1))).drop("_nl", "_nr"))
    rx = (right.withColumn("_rb", F.pmod(F.xxhash64("id"), "_nr").cast("int"))
          .withColumn("_lb", F.explode(F.sequence(F.lit(0), F.col("_nl") - 1))).drop("_nl", "_nr"))

    def run(lp: pd.DataFrame, rp: pd.DataFrame) -> pd.DataFrame:
        if not len(lp) or not len(rp):
            return _NONE
        lp, rp = lp.reset_index(drop=True), rp.sort_values("id").reset_index(drop=True)
        sims = _even(lp, rp)
        cells, cell = np.unique(rp["cell"].to_numpy(), return_inverse=True)
        wanted = np.zeros((len(lp), len(cells) + 1), bool)  # the last column takes cells of other blocks
        row = np.repeat(np.arange(len(lp)), lp["cells"].map(len))
        asked = np.concatenate(lp["cells"].to_numpy())
        at = np.minimum(np.searchsorted(cells, asked), len(cells) - 1)
        wanted[row, np.where(cells[at] == asked, at, len(cells))] = True
        sims[~wanted[:, cell]] = -np.inf
        return _topk_rows(sims, lp["id"].to_numpy(np.int64), rp["id"].to_numpy(np.int64), k)

    return lx.groupBy("grp", "_lb", "_rb").cogroup(rx.groupBy("grp", "_lb", "_rb")).applyInPandas(run, _FOUND)
