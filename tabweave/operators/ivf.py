"""Nearest vectors through an inverted file: cells of a coarse quantiser, lists joined on the cell.

* ``train_centres`` fits the quantiser (spherical k-means) on a bounded, documented sample, whose rows are dealt over the tasks where
  there are many;
* ``VectorIndex`` puts every row of the searched table into the list of its nearest centre and keeps, per cell, the size and the
  widest angle to the centre (at most ``MAX_CELLS`` rows);
* ``ivf_knn`` (C2) scores each row exactly against the lists of its ``nprobe`` nearest cells;
* ``pivot_knn`` (C1) goes on where that is not proven to be the answer: a cell whose nearest possible vector (the angle to
  its centre less its widest angle) is farther than the k-th found so far holds nothing better, all others are
  visited in a second round. Its result is exact.

Cells are packed into groups of near cells of about ``block_rows`` rows. A row goes once to each group that holds one of its cells; a
group with more rows (a hot cell) is cut into blocks by a hash of the id, so none meets in one task. The cells that a row asks
for travel as one bit a cell of the group. Within a task only pairs of rows and lists of the same cell count. Zero vectors have similarity 0 to everything: those of the
searched table are a cell of their own, those that search get the smallest ids.

Results are ``t1_id, t2_id, sim, rank``; ties go to the smaller t2 id. Every row has ``k`` matches if the searched
table has as many other rows: probing goes on until enough rows are reached.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..core import seeded_uint, spread
from ..session import ensure_checkpoint_dir
from .blocked import DEFAULT_BLOCK_ROWS, _block_counts, _fresh, _l2

MAX_CELLS = 65_536
MAX_CENTRE_BYTES = 64 << 20  # of the broadcast centres
SAMPLE_ROWS = 65_536  # rows the quantiser is trained on
TRAIN_PAIRS = 1 << 26  # of a sample's rows and centres that one task compares
INDEX_GROUPS, MOST_BLOCK_NUMBERS = 8, 1 << 23  # groups of cells of an index, and numbers of the vectors of one
COUNTED = 16  # of so many rows one is counted to size the blocks
ROUTED = 4096  # routed rows that leave a task at once
SLACK = 1e-7  # of a similarity bound; arccos is that coarse near 1
SLICE = 4096  # rows compared with the centres at once, fewer where there are many centres:
SLICE_CELLS = 1 << 21  # numbers of a slice's matrix of rows and centres
TILE_ROWS, TILE = 2048, 4096  # rows and columns of the similarities held at once
FRESH = 512  # columns from which a row without matches gets its first bound
SPARSE = 32  # pairs are reckoned one by one where a product would make more than so many for each that is wanted
FOLD = 1 << 23  # numbers of the pairs reckoned as doubles at once
SMALL = 64  # rows of a list that is not worth a product of its own


def _matrix(column: pa.Array) -> np.ndarray:
    """A list column of equal lengths as a float64 matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _lists(x: np.ndarray) -> pa.Array:
    """The rows of a matrix as a list column."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))


def _slice_rows(cells: int) -> int:
    return max(1, min(SLICE, SLICE_CELLS // max(1, cells)))


def _vectors(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    kind = dict(df.dtypes)[vec_col]  # floats stay floats on their way; tasks reckon with doubles
    return df.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).cast(kind if kind == "array<float>" else "array<double>").alias("vec"))


def _nearest(x: np.ndarray, centres: np.ndarray, own: np.ndarray, moved: np.ndarray) -> np.ndarray:
    """The nearest centre of each row, by float products. ``own`` has those of before (-1: none) and ``moved`` marks the centres that
    are others since: a row whose own centre stayed is only compared with these."""
    out = own.copy()
    some = np.flatnonzero(moved)
    c = centres[some]
    known = (own >= 0) & ~moved[own]
    for those, against in ((np.flatnonzero(~known), centres), (np.flatnonzero(known), c)):
        step = _slice_rows(len(against))
        for a in range(0, len(those) if len(against) else 0, step):
            at = those[a:a + step]
            sims = x[at] @ against.T
            best = sims.argmax(1)
            if against is centres:
                out[at] = best
                continue
            now, sim = np.einsum("ij,ij->i", x[at], centres[own[at]]), sims[np.arange(len(at)), best]
            better = (sim > now) | ((sim == now) & (some[best] < own[at]))
            out[at[better]] = some[best[better]]
    return out


def _centres_of(total: np.ndarray, centres: np.ndarray) -> np.ndarray:
    moved = _l2(total)
    return np.where((np.abs(moved).sum(1) > 0)[:, None], moved, centres)


def kmeans(x: np.ndarray, cells: int, rounds: int = 10, seed: int = 42) -> np.ndarray:
    """Unit centres of spherical k-means over unit rows (Lloyd); a centre without rows stays where it is."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(cells, len(x)), replace=False)]
    own, moved, x32 = np.full(len(x), -1), np.ones(len(centres), bool), x.astype(np.float32)
    for _ in range(rounds):
        before, own = own, _nearest(x32, centres.astype(np.float32), own, moved)
        if (own == before).all():
            break
        total = np.zeros_like(centres)
        np.add.at(total, own, x)
        last, centres = centres, _centres_of(total, centres)
        moved = (centres != last).any(1)
    return centres


def _spread_kmeans(sample: DataFrame, n: int, cells: int, rounds: int, seed: int) -> np.ndarray:
    """``kmeans`` over the rows of ``at, x`` (``at`` is 0..n - 1), which stay in their tasks: a round sends the centres out
    and gets the changes of their sums back."""
    sc = sample.sparkSession.sparkContext
    start = np.random.default_rng(seed).choice(n, cells, replace=False)
    chosen = sc.broadcast(np.sort(start))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(np.isin(batch.column(0).to_numpy(), chosen.value)))

    got = sample.mapInArrow(first, sample.schema).toArrow()  # cells rows
    centres = np.zeros((cells, len(got.column(1)[0])))
    centres[np.argsort(start)] = _matrix(got.column(1))[np.argsort(got.column(0).to_numpy())]
    own, moved = np.full(n, -1, np.int32), np.ones(cells, bool)
    total, rows = np.zeros_like(centres), np.zeros(cells, np.int64)
    for _ in range(rounds):
        sent = sc.broadcast((centres.astype(np.float32), own, moved))

        def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            centres, own, moved = sent.value
            parts = [(b.column(0).to_numpy(), _matrix(b.column(1))) for b in batches if b.num_rows]
            if not parts:
                return
            at, x = (np.concatenate(p) for p in zip(*parts))
            now = _nearest(x.astype(np.float32), centres, own[at], moved)
            new = np.flatnonzero(now != own[at])
            old = new[own[at[new]] >= 0]
            cell, row = np.unique(np.concatenate([now[new], own[at[old]]]), return_inverse=True)
            more, less = np.zeros((len(cell), x.shape[1])), row[len(new):]
            np.add.at(more, row[:len(new)], x[new])
            np.subtract.at(more, less, x[old])
            count = np.bincount(row[:len(new)], minlength=len(cell)) - np.bincount(less, minlength=len(cell))
            yield pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary()) for v in (at[new], now[new], cell, count, more)],
                                             names=["at", "own", "cell", "count", "more"])

        own, moved = own.copy(), np.zeros(cells, bool)
        for r in sample.mapInArrow(step, "at binary, own binary, cell binary, count binary, more binary").collect():  # a row a task: what changed
            own[np.frombuffer(r["at"], np.int64)] = np.frombuffer(r["own"], np.int32)
            cell = np.frombuffer(r["cell"], np.int32)
            rows[cell] += np.frombuffer(r["count"], np.int64)
            total[cell] += np.frombuffer(r["more"]).reshape(len(cell), centres.shape[1])
            moved[cell] = True
        sent.destroy()
        some = np.flatnonzero(moved)
        if not len(some):
            break
        total[some[rows[some] == 0]] = 0  # nothing is left of sums
        there = _centres_of(total[some], centres[some])
        moved[some] = (there != centres[some]).any(1)
        centres[some] = there
    return centres


def train_centres(df: DataFrame, id_col: str, vec_col: str, cells: int, sample_rows: int = SAMPLE_ROWS, rounds: int = 10,
                  seed: int = 42) -> np.ndarray:
    """``cells`` unit centres, fitted on the ``sample_rows`` rows with the least seeded hashes of their ids; in one task where these rows x
    cells are at most ``TRAIN_PAIRS``."""
    if not 1 <= cells <= MAX_CELLS:
        raise ValueError(f"cells must lie in 1..{MAX_CELLS}: {cells}")
    rows = _vectors(df, id_col, vec_col).filter("vec is not null").orderBy(seeded_uint(seed, "id"), "id").limit(sample_rows)

    def unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for batch in batches:
            x = _l2(_matrix(batch.column(1))) if batch.num_rows else np.zeros((0, 0))
            x = x[np.abs(x).sum(1) > 0]
            if len(x):
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(n, n + len(x))), _lists(x)], names=["at", "x"])
            n += len(x)

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [_matrix(b.column(1)) for b in batches if b.num_rows]
        if parts:
            yield pa.RecordBatch.from_arrays([_lists(kmeans(np.concatenate(parts), cells, rounds, seed))], names=["c"])

    sample = rows.repartition(1).mapInArrow(unit, "at bigint, x array<double>")
    if cells * sample_rows > TRAIN_PAIRS:
        ensure_checkpoint_dir(df.sparkSession)
        sample = spread(sample).checkpoint(eager=True)  # each round reads it
        n = sample.count()
    if cells * sample_rows > TRAIN_PAIRS and n > cells:
        centres = _spread_kmeans(sample, n, cells, rounds, seed)
    else:
        got = sample.repartition(1).sortWithinPartitions("at").mapInArrow(fit, "c array<double>").toArrow()  # cells rows
        centres = _matrix(got.column(0)) if got.num_rows else np.zeros((0, 1))
    if centres.astype(np.float32).nbytes > MAX_CENTRE_BYTES:
        raise ValueError(f"the centres take more than {MAX_CENTRE_BYTES} bytes: fewer cells or dimensions")
    return centres


@dataclass
class Cells:
    """What the tasks need: centres, and per cell (the last one holds the zero vectors) its size, widest angle and group."""

    centres: np.ndarray
    size: np.ndarray
    angle: np.ndarray
    group: np.ndarray

    def near(self, x: np.ndarray) -> np.ndarray:
        """Similarity of unit rows to all cells; 0 to the cell of zero vectors."""
        return np.concatenate([x @ self.centres.T if len(self.centres) else np.zeros((len(x), 0)), np.zeros((len(x), 1))], axis=1)

    # ------------------------------------------------------------------ the cells that hold rows, those of a group side by side
    @cached_property
    def held(self) -> np.ndarray:
        cell = np.flatnonzero(self.size)
        return cell[np.argsort(self.group[cell], kind="stable")]

    @cached_property
    def groups(self) -> tuple[np.ndarray, np.ndarray]:
        """The groups with rows, and where each begins among the held cells (and the end of the last)."""
        group, first = np.unique(self.group[self.held], return_index=True)
        return group, np.append(first, len(self.held))

    @cached_property
    def place(self) -> np.ndarray:
        """The place of each held cell in its group."""
        out = np.full(len(self.size), -1)
        group, first = self.groups
        out[self.held] = np.arange(len(self.held)) - np.repeat(first[:-1], np.diff(first))
        return out

    @cached_property
    def _held32(self) -> np.ndarray:
        centres = self.centres if len(self.centres) else np.zeros((0, 1))
        return np.concatenate([centres, np.zeros((1, centres.shape[1]))]).astype(np.float32)[self.held]

    def near_held(self, x: np.ndarray) -> np.ndarray:
        """Similarity of unit rows to the held cells, as floats."""
        return np.nan_to_num(x.astype(np.float32)) @ self._held32.T if len(self.centres) else np.zeros((len(x), len(self.held)), np.float32)

    def probes(self, sims: np.ndarray, nprobe: int, least: int) -> np.ndarray:
        """True for the ``nprobe`` nearest held cells, and further ones until ``least`` rows are reached. No row's cells are sorted: each holds
        a row, so ``max(nprobe, least)`` are enough."""
        n = sims.shape[1]
        most = min(n, max(nprobe, least))
        if not most or min(nprobe, n) == n:
            return np.ones(sims.shape, bool)
        kth = np.partition(sims, n - most, axis=1)[:, n - most] if most < n else sims.min(1)
        out = sims >= kth[:, None]
        for r in np.flatnonzero(out.sum(1) > most):  # of equal ones the first
            tied = np.flatnonzero(sims[r] == kth[r])
            out[r, tied[most - np.count_nonzero(sims[r] > kth[r]):]] = False
        if nprobe < least:
            row, col = np.nonzero(out)
            order = np.lexsort((col, -sims[row, col], row))
            col, row = col[order].reshape(-1, most), row[order].reshape(-1, most)
            size = self.size[self.held][col]
            take = (np.arange(most) < nprobe) | (np.cumsum(size, axis=1) - size < least)  # reached by the cells before
            out[row[~take], col[~take]] = False
        return out

    def may_hold(self, sims: np.ndarray, kth: np.ndarray) -> np.ndarray:
        """False for held cells without a row as similar as ``kth``: the angle to the centre is wider than the cell and ``kth`` are together."""
        least = np.clip(kth - SLACK, -1, 1)
        angle = self.angle[self.held]
        both = np.stack([least, -np.sqrt(1 - least * least)], axis=1) @ np.stack([np.cos(angle), np.sin(angle)])
        slack = (self.centres.shape[1] + 8) * 2.0 ** -23 + 1e-6  # of the float products
        return (sims >= (both - slack).astype(np.float32)) | (angle >= (np.pi - np.arccos(least))[:, None])

    def bound(self, sims: np.ndarray) -> np.ndarray:
        """The greatest similarity that a row of each cell can have."""
        apart = np.arccos(np.clip(sims, -1, 1)) - self.angle
        out = np.where(apart <= 0, 1.0, np.cos(np.clip(apart, 0, np.pi)))
        out[:, -1] = 0
        return np.where(self.size > 0, out + SLACK, -np.inf)


class VectorIndex:
    """Every row of a table in the list of its nearest centre. ``block_rows``: rows of a group of cells; without it there are ``INDEX_GROUPS``
    groups at any size (a row goes to each that holds one of its cells) unless one had more than ``MOST_BLOCK_NUMBERS`` numbers."""

    def __init__(self, t2: DataFrame, id_col: str, vec_col: str, cells: int | None = None, sample_rows: int = SAMPLE_ROWS,
                 block_rows: int | None = None, seed: int = 42):
        spark = t2.sparkSession
        ensure_checkpoint_dir(spark)
        self.count = t2.count()
        if cells is None:
            cells = int(min(MAX_CELLS, max(1, np.ceil(np.sqrt(self.count)))))
        centres = train_centres(t2, id_col, vec_col, cells, sample_rows, seed=seed)
        self.block_rows = block_rows or max(DEFAULT_BLOCK_ROWS, min(MOST_BLOCK_NUMBERS // centres.shape[1], -(-self.count // INDEX_GROUPS)))
        groups = max(1, min(len(centres), -(-self.count // self.block_rows)))
        group = (centres @ kmeans(centres, groups, seed=seed).T).argmax(1) if len(centres) else np.zeros(0, np.int64)
        group = np.append(group, group.max(initial=-1) + 1)
        sent = spark.sparkContext.broadcast((centres, group))  # at most MAX_CENTRE_BYTES, and a number a cell

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            centres, group = sent.value
            c32, every = centres.astype(np.float32), np.ones(len(centres), bool)
            for batch in batches:
                x = _l2(_matrix(batch.column(1))) if batch.num_rows else np.zeros((0, 1))
                cell, cos = np.full(len(x), len(centres), np.int32), np.ones(len(x))
                some = np.flatnonzero(np.abs(x).sum(1) > 0)
                if len(some):
                    cell[some] = _nearest(x[some].astype(np.float32), c32, np.full(len(some), -1), every)
                    cos[some] = np.einsum("ij,ij->i", x[some], centres[cell[some]])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(cell), pa.array(cos), pa.array(group[cell], pa.int32())],
                    names=["id", "vec", "cell", "cos", "grp"])

        rows = _vectors(t2, id_col, vec_col).filter("vec is not null")
        placed = spread(rows).mapInArrow(place, f"id bigint, vec {dict(rows.dtypes)['vec']}, cell int, cos double, grp int").checkpoint(eager=True)
        size, least = np.zeros(len(centres) + 1, np.int64), np.ones(len(centres) + 1)
        for r in placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("cos").alias("cos")).collect():  # one row a cell
            size[r["cell"]], least[r["cell"]] = r["n"], r["cos"]
        self.cells = Cells(centres, size, np.arccos(np.clip(least, -1, 1)), group)
        self.sent = spark.sparkContext.broadcast(self.cells)  # the centres and three numbers a cell
        self.rows = placed.drop("cos")
        self.first_ids = [r["id"] for r in placed.select("id").orderBy("id").limit(1000).collect()]

    # ------------------------------------------------------------------ probing
    def routed(self, rows: DataFrame, choose, packed: bool = True) -> DataFrame:
        """(id, vec, kth, grp, bits): each row once for every group with one of its cells; ``choose(cells, unit rows, batch)``
        gives a mask over the held cells. ``kth``, where the rows have it: nothing less similar is wanted. ``bits`` has a bit for each held
        cell of the group; not ``packed``, the cells are a list, ``cells``. Zero vectors are left out."""
        sent = self.sent
        rows = rows if "kth" in rows.columns else rows.withColumn("kth", F.lit(-2.0))
        kind = dict(rows.dtypes)["vec"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            cells = sent.value
            group, first = cells.groups
            step, out = _slice_rows(len(cells.size)), []
            for whole in batches:
                ids, vec, kth = (whole.column(whole.schema.get_field_index(c)) for c in ("id", "vec", "kth"))
                for a in range(0, whole.num_rows if len(group) else 0, step):
                    batch = whole.slice(a, step)
                    x = _l2(_matrix(batch.column(batch.schema.get_field_index("vec"))))
                    mask = choose(cells, x, batch) & (np.abs(x).sum(1) > 0)[:, None]
                    for g in np.flatnonzero(np.logical_or.reduceat(mask.any(0), first[:-1])):
                        part = mask[:, first[g]:first[g + 1]]
                        row = np.flatnonzero(part.any(1))
                        if packed:
                            asked = _binary(np.packbits(part[row], axis=1))
                        else:
                            at, col = np.nonzero(part[row])
                            asked = pa.ListArray.from_arrays(pa.array(np.searchsorted(at, np.arange(len(row) + 1)), pa.int32()),
                                                             pa.array(cells.held[first[g]:first[g + 1]][col], pa.int32()))
                        of = pa.array(row + a)
                        out.append(pa.RecordBatch.from_arrays([ids.take(of), vec.take(of), kth.take(of), pa.array(np.full(len(row), group[g]), pa.int32()), asked],
                                                              names=["id", "vec", "kth", "grp", "bits" if packed else "cells"]))
                    if sum(len(b) for b in out) >= ROUTED:
                        yield _one_batch(out)
                        out = []
            if out:
                yield _one_batch(out)

        return rows.mapInArrow(run, f"id bigint, vec {kind}, kth double, grp int, " + ("bits binary" if packed else "cells array<int>"))

    def pairs(self, routed: DataFrame) -> int:
        """How many pairs of rows the routed rows are scored with."""
        sent, packed = self.sent, "bits" in routed.columns

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            cells, n = sent.value, 0
            group, first = cells.groups
            size = cells.size[cells.held]
            for batch in batches:
                if not packed:
                    n += int(cells.size[batch.column(1).flatten().to_numpy()].sum())
                    continue
                grp = batch.column(0).to_numpy()
                for g in np.unique(grp):
                    at = np.searchsorted(group, g)
                    each = _byte_sizes(size[first[at]:first[at + 1]])
                    bits = batch.column(1).filter(pa.array(grp == g)).to_pylist()
                    step = _slice_rows(len(each))
                    for a in range(0, len(bits), step):
                        asked = np.frombuffer(b"".join(bits[a:a + step]), np.uint8).reshape(-1, len(each))
                        n += int(each[np.arange(len(each)), asked].sum())
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

        return int(routed.select("grp", "bits" if packed else "cells").mapInArrow(run, "n bigint").agg(F.sum("n")).first()[0] or 0)

    def scored(self, rows: DataFrame, choose, k: int, exclude_same_id: bool) -> DataFrame:
        """The best ``k`` of each row among its cells of each group: ``t1_id, t2_id, sim``. One row of ``COUNTED`` is routed beforehand: it says
        into how many blocks the rows of each group go, not which rows meet."""
        sent = self.sent
        some = self.routed(rows.filter(F.pmod(F.xxhash64("id"), F.lit(COUNTED)) == 0), choose)
        n_l = {r["grp"]: r["count"] * COUNTED for r in some.groupBy("grp").count().collect()}  # one row a group
        n_r = np.bincount(self.cells.group, self.cells.size)
        blocks = [(int(g), *(max(1, int(-(-n // self.block_rows))) for n in (n_l.get(g, 1), n_r[g]))) for g in self.cells.groups[0]]
        counts = F.broadcast(rows.sparkSession.createDataFrame(blocks, "grp int, _nl int, _nr int"))
        left, right = _fresh(self.routed(rows, choose)).join(counts, "grp"), _fresh(self.rows).join(counts, "grp")
        lx = (left.withColumn("_lb", F.pmod(F.xxhash64("id"), "_nl").cast("int"))
              .withColumn("_rb", F.explode(F.sequence(F.lit(0), F.col("_nr") - 1))).drop("_nl", "_nr"))
        rx = (right.withColumn("_rb", F.pmod(F.xxhash64("id"), "_nr").cast("int"))
              .withColumn("_lb", F.explode(F.sequence(F.lit(0), F.col("_nl") - 1))).drop("_nl", "_nr"))
        key = ["grp", "_lb", "_rb"]
        return lx.groupBy(*key).cogroup(rx.groupBy(*key)).applyInPandas(
            lambda lp, rp: _score_lists(lp, rp, k, exclude_same_id, sent.value), "t1_id bigint, t2_id bigint, sim double")

    def zero_rows(self, rows: DataFrame, k: int, exclude_same_id: bool) -> DataFrame:
        """Zero vectors that search: similarity 0 to all, so the smallest ids."""
        if k >= 1000:
            raise ValueError("k must be below 1000")
        zero = rows.filter(~F.exists("vec", lambda v: v != 0)).select(F.col("id").alias("t1_id"))
        ids = F.array(*[F.lit(i).cast("bigint") for i in self.first_ids[:k + 1]]).cast("array<bigint>")
        if exclude_same_id:
            ids = F.filter(ids, lambda i: i != F.col("t1_id"))
        return zero.select("t1_id", F.explode(F.slice(ids, 1, k)).alias("t2_id"), F.lit(0.0).alias("sim"))


def _binary(bits: np.ndarray) -> pa.Array:
    """The rows of a byte matrix as a binary column."""
    at = pa.array(np.arange(len(bits) + 1, dtype=np.int32) * np.int32(bits.shape[1]))
    return pa.BinaryArray.from_buffers(pa.binary(), len(bits), [None, at.buffers()[1], pa.py_buffer(bits.tobytes())])


def _byte_sizes(size: np.ndarray) -> np.ndarray:
    """For each byte of a row's bits, and each value it can have, the rows in the cells of its ones."""
    padded = np.append(size, np.zeros(-len(size) % 8, size.dtype)).reshape(-1, 8)
    return padded @ np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).T.astype(np.int64)


def _unpacked(bits) -> np.ndarray:
    """A truth value a bit of byte strings of equal lengths."""
    return np.unpackbits(np.frombuffer(b"".join(bits), np.uint8).reshape(len(bits), -1), axis=1).view(bool)


def _one_batch(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches([b.cast(batches[0].schema) for b in batches]).combine_chunks().to_batches()[0]


def _score_lists(lp: pd.DataFrame, rp: pd.DataFrame, k: int, exclude_same_id: bool, cells: Cells | None = None) -> pd.DataFrame:
    """Each left row against the lists of its cells in this block, named by ``cells`` or by ``bits`` of the group's. Tiles of lists are multiplied as floats; only pairs that their
    error leaves open are reckoned as doubles, and each tile raises the bound of the next ones."""
    none = pd.DataFrame({"t1_id": pd.Series(dtype="int64"), "t2_id": pd.Series(dtype="int64"), "sim": pd.Series(dtype="float64")})
    if not len(lp) or not len(rp):
        return none
    rp = rp.sort_values(["cell", "id"])
    b = np.vstack(rp["vec"].to_numpy())
    some = _few_copies(b, rp["cell"].to_numpy(), rp["id"].to_numpy(np.int64), k + int(exclude_same_id)) & np.isfinite(b).all(1)
    if not some.any():
        return none
    rp, b = rp[some], _l2(b[some].astype(np.float64))
    a = _l2(np.vstack(lp["vec"].to_numpy()).astype(np.float64))
    a32, b32 = a.astype(np.float32), b.astype(np.float32)
    slack = (a.shape[1] + 8) * 2.0 ** -23 + SLACK  # of a float product of unit vectors, and of the bound itself
    bound = lp["kth"].to_numpy(np.float64) if "kth" in lp else np.full(len(lp), -2.0)
    t1, t2 = lp["id"].to_numpy(np.int64), rp["id"].to_numpy(np.int64)
    cell, first, own = np.unique(rp["cell"].to_numpy(), return_index=True, return_inverse=True)
    ends = np.append(first[1:], len(rp))
    size = ends - first
    if "bits" in lp:
        bits, place = lp["bits"].to_numpy(), cells.place[cell]
        asked = lambda lo: _unpacked(bits[lo:lo + TILE_ROWS])[:, place]
    else:
        row = np.repeat(np.arange(len(lp)), lp["cells"].map(len))
        probed = np.concatenate(lp["cells"].to_numpy())
        at = np.minimum(np.searchsorted(cell, probed), len(cell) - 1)
        there = cell[at] == probed
        wanted = np.zeros((len(lp), len(cell)), bool)
        wanted[row[there], at[there]] = True
        asked = lambda lo: wanted[lo:lo + TILE_ROWS]
    out = []
    for lo in range(0, len(lp), TILE_ROWS):
        want = asked(lo)
        best = _Best(len(want), k, bound[lo:lo + TILE_ROWS])
        for c0, c1 in _tiles(want, size):
            rows = np.flatnonzero(want[:, c0:c1].any(1))
            if not len(rows):
                continue
            step = max(1, TILE_ROWS * TILE // (ends[c1 - 1] - first[c0]))
            for p in range(0, len(rows), step):
                part = rows[p:p + step]
                cols = slice(first[c0], ends[c1 - 1])
                if (want[part, c0:c1].sum(0) @ size[c0:c1]) * SPARSE < len(part) * (ends[c1 - 1] - first[c0]):
                    y, c = np.nonzero(want[part, c0:c1])
                    n = size[c0:c1][c]
                    y, x = np.repeat(part[y], n), np.arange(n.sum()) + np.repeat(first[c0:c1][c] - np.cumsum(n) + n, n)
                    keep = ~(exclude_same_id & (t1[lo + y] == t2[x]))
                    best.add(y[keep], x[keep], a[lo:lo + TILE_ROWS], b, t2)
                    continue
                sims = a32[lo + part] @ b32[cols].T
                least = best.least(part)
                fresh = np.flatnonzero(least <= -1.5)  # nothing is known of these rows
                if len(fresh) and sims.shape[1] > k:
                    those = sims[fresh, :max(FRESH, 2 * k)]
                    some = slice(first[c0], first[c0] + those.shape[1])
                    those[~want[part[fresh]][:, own[some]]] = -np.inf
                    if exclude_same_id:
                        those[t1[lo + part[fresh]][:, None] == t2[some][None, :]] = -np.inf
                    least[fresh] = those.max(1) if k == 1 else np.partition(those, those.shape[1] - k, axis=1)[:, -k]
                good = np.flatnonzero(sims >= np.maximum(least - 2 * slack, -1.5).astype(np.float32)[:, None])  # much faster than nonzero
                y, x = part[good // sims.shape[1]], good % sims.shape[1] + first[c0]
                keep = want[y, own[x]] & ~(exclude_same_id & (t1[lo + y] == t2[x]))
                best.add(y[keep], x[keep], a[lo:lo + TILE_ROWS], b, t2)
        y, x, sim = best.rows()
        out.append(pd.DataFrame({"t1_id": t1[lo + y], "t2_id": t2[x], "sim": sim}))
    return pd.concat(out)


def _few_copies(vec: np.ndarray, cell: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """False for copies of a vector in a list beyond those with its ``k`` smallest ids: equal similarities go to the smaller id."""
    raw = np.ascontiguousarray(vec).view(np.dtype((np.void, vec.dtype.itemsize * vec.shape[1]))).ravel()
    kind = np.unique(raw, return_inverse=True)[1].ravel()
    order = np.lexsort((ids, cell, kind))
    new = np.append(True, (np.diff(kind[order]) != 0) | (np.diff(cell[order]) != 0))
    nth = np.cumsum(new | np.append(True, np.diff(ids[order]) != 0))
    nth -= nth[np.flatnonzero(new)[np.cumsum(new) - 1]]
    out = np.zeros(len(vec), bool)
    out[order[nth < k]] = True
    return out


def _tiles(want: np.ndarray, size: np.ndarray) -> list[tuple[int, int]]:
    """Runs of lists of about ``TILE`` rows; a large list that few of the rows ask for stays by itself, so little
    is multiplied in vain."""
    much = (want.mean(0) >= 0.5) | (size < SMALL)
    out, at = [], 0
    for c in range(len(size)):
        if c + 1 == len(size) or not much[c] or not much[c + 1] or size[at:c + 2].sum() > TILE:
            out.append((at, c + 1))
            at = c + 1
    return out


class _Best:
    """The ``k`` best so far of some rows, by similarity and smaller id."""

    def __init__(self, n: int, k: int, known: np.ndarray):
        self.k, self.known = k, known
        self.col, self.sim = np.full((n, k), -1, np.int64), np.full((n, k), -np.inf)

    def least(self, rows: np.ndarray) -> np.ndarray:
        """Nothing less similar is wanted of these rows."""
        return np.maximum(self.known[rows], self.sim[rows, -1])

    def add(self, row: np.ndarray, col: np.ndarray, a: np.ndarray, b: np.ndarray, t2: np.ndarray) -> None:
        """Candidates, rows ascending."""
        step = max(1, FOLD // a.shape[1])
        for lo in range(0, len(row), step):
            r, c = row[lo:lo + step], col[lo:lo + step]
            sim = np.einsum("ij,ij->i", a[r], b[c])
            touched = np.unique(r)
            old, nth = np.nonzero(self.col[touched] >= 0)
            r = np.concatenate([touched[old], r])
            c = np.concatenate([self.col[touched][old, nth], c])
            sim = np.concatenate([self.sim[touched][old, nth], sim])
            order = np.lexsort((t2[c], -sim, r))
            r, c, sim = r[order], c[order], sim[order]
            nth = np.arange(len(r)) - np.searchsorted(r, r)
            keep = nth < self.k
            self.col[touched], self.sim[touched] = -1, -np.inf
            self.col[r[keep], nth[keep]], self.sim[r[keep], nth[keep]] = c[keep], sim[keep]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        y, nth = np.nonzero(self.col >= 0)
        return y, self.col[y, nth], self.sim[y, nth]


def _merged(found: DataFrame, k: int) -> DataFrame:
    """The best ``k`` of each row of the groups' results."""
    if k == 1:
        best = found.groupBy("t1_id").agg(F.max(F.struct("sim", (-F.col("t2_id")).alias("neg"))).alias("b"))
        return best.select("t1_id", (-F.col("b.neg")).alias("t2_id"), F.col("b.sim").alias("sim"), F.lit(1).alias("rank"))
    w = Window.partitionBy("t1_id").orderBy(F.desc("sim"), "t2_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _probing(nprobe: int, least: int):
    return lambda cells, x, batch: cells.probes(cells.near_held(x), nprobe, least)


def ivf_routes(index: VectorIndex, t1: DataFrame, t1_id: str, t1_vec: str, nprobe: int, k: int = 1,
               exclude_same_id: bool = False, packed: bool = False) -> DataFrame:
    """The rows of ``t1`` routed to the lists of their ``nprobe`` nearest cells."""
    rows = spread(_vectors(t1, t1_id, t1_vec).filter("vec is not null"))
    return index.routed(rows, _probing(nprobe, k + int(exclude_same_id)), packed)


def ivf_knn(t1: DataFrame, t1_id: str, t1_vec: str, index: VectorIndex, nprobe: int, k: int = 1,
            exclude_same_id: bool = False) -> DataFrame:
    """Approximate top-k by the ``nprobe`` nearest lists, exactly re-ranked. Recall depends on the data, the cells and
    ``nprobe``; measure it against ``pivot_knn``."""
    rows = _vectors(t1, t1_id, t1_vec).filter("vec is not null")
    near = index.scored(spread(rows), _probing(nprobe, k + int(exclude_same_id)), k, exclude_same_id)
    return _merged(near.unionByName(index.zero_rows(rows, k, exclude_same_id)), k)


def _with_probed(index: VectorIndex, rows: DataFrame, nprobe: int, least: int) -> DataFrame:
    """``rows`` with ``seen``, the held cells that they probe first; pinned, since float products of other batches may differ by a bit."""
    sent = index.sent

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = sent.value
        step = _slice_rows(len(cells.size))
        for whole in batches:
            for a in range(0, whole.num_rows, step):
                batch = whole.slice(a, step)
                row, col = np.nonzero(cells.probes(cells.near_held(_l2(_matrix(batch.column(1)))), nprobe, least))
                seen = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(batch.num_rows + 1)), pa.int32()), pa.array(col, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), seen], names=["id", "vec", "seen"])

    return spread(rows).mapInArrow(run, f"id bigint, vec {dict(rows.dtypes)['vec']}, seen array<int>").checkpoint(eager=True)


def _seen(cells: Cells, x: np.ndarray, batch: pa.RecordBatch) -> np.ndarray:
    lists = batch.column(batch.schema.get_field_index("seen"))
    out = np.zeros((len(lists), len(cells.held)), bool)
    out[np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy())), lists.flatten().to_numpy()] = True
    return out


def _still_open(cells: Cells, x: np.ndarray, batch: pa.RecordBatch) -> np.ndarray:
    kth = batch.column(batch.schema.get_field_index("kth")).to_numpy(zero_copy_only=False)
    return cells.may_hold(cells.near_held(x), kth) & ~_seen(cells, x, batch)


def pivot_knn(t1: DataFrame, t1_id: str, t1_vec: str, index: VectorIndex, nprobe: int = 2, k: int = 1,
              exclude_same_id: bool = False, counted: list | None = None) -> DataFrame:
    """Exact top-k. ``counted`` takes the numbers of pairs scored in the two rounds."""
    rows = _vectors(t1, t1_id, t1_vec).filter("vec is not null")
    probed = _with_probed(index, rows, nprobe, k + int(exclude_same_id))
    first = _merged(index.scored(probed, _seen, k, exclude_same_id), k).select("t1_id", "t2_id", "sim").checkpoint(eager=True)
    # the k-th similarity so far; a row with fewer matches has no bound
    so_far = first.groupBy("t1_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("sim")).alias("kth"))
    known = probed.join(so_far, F.col("id") == F.col("t1_id"), "left").select("id", "vec", F.coalesce("kth", F.lit(-2.0)).alias("kth"), "seen")
    if counted is not None:
        counted += [index.pairs(index.routed(probed, _seen)), index.pairs(index.routed(known, _still_open))]
    found = first.unionByName(index.scored(known, _still_open, k, exclude_same_id)).unionByName(index.zero_rows(rows, k, exclude_same_id))
    return _merged(found, k)
