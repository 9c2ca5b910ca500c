"""Seeded sampling (G1-G5). Exact-size samples are prefixes of the seeded
order — never ``sample(fraction)``, whose size varies — and the prefix is
cut by position, so n may be any fraction of the table."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..core import positions, seeded_hash, seeded_uint
from .cuts import sliced
from .split import _ntile


def _ids(ids):
    return [ids] if isinstance(ids, str) else list(ids)


def append_budget(base_rows: int, ratio: float, aux_rows: int) -> int:
    """G1: ``min(int(base * ratio), aux_rows)``."""
    return min(int(base_rows * ratio), aux_rows)


def sample_exact(df: DataFrame, ids, n: int, seed: int = 42) -> DataFrame:
    """Exactly ``min(n, rows)`` rows without replacement; n = 0 gives an
    empty frame with the input schema.

    No row is sorted: rows are counted by the first three hex digits of their
    order key (4,096 groups), which tells the group that the cut falls into; rows
    before it stay, and only that group's keys are ranked."""
    ids = _ids(ids)
    if n <= 0:
        return df.limit(0)
    order = seeded_hash(seed, *ids)
    group = F.substring(order, 1, 3)
    sizes = {r["g"]: r["n"] for r in df.groupBy(group.alias("g")).agg(F.count(F.lit(1)).alias("n")).collect()}
    if sum(sizes.values()) <= n:
        return df
    before, cut = 0, None
    for g in sorted(sizes):
        if before + sizes[g] > n:
            cut = g
            break
        before += sizes[g]
    whole = df.filter(group < cut)
    edge = df.filter(group == cut).withColumn("_o", order)
    return whole.unionByName(positions(edge, [], ["_o", *ids], out="_pos")
                             .filter(F.col("_pos") <= n - before).drop("_o", "_pos"))


def seeded_shuffle(df: DataFrame, ids, seed: int = 42, out: str = "shuffle_pos") -> DataFrame:
    """A seeded permutation kept as a 1-based position column (ids and keys are
    ranked; the rows join their position)."""
    ids = _ids(ids)
    ranked = positions(df.select(*ids, seeded_uint(seed, *ids).alias("_o")), [], ["_o", *ids], out=out).drop("_o")
    return df.join(ranked, ids)


def balanced_draw(df: DataFrame, ids, label: str, n: int, seed: int = 42) -> DataFrame:
    """``n/2`` rows of class 1 and ``n/2`` of class 0 (seeded order)."""
    ids = _ids(ids)
    half = n // 2
    keyed = df.filter(F.col(label).isin(0, 1)).select(*ids, label, seeded_uint(seed, *ids).alias("_o"))
    return sliced(keyed, [label], "_o", ids, lambda m: [F.lit(half)], "_slice").filter("_slice = 0").select(*ids, label)


def chunk_columns(columns: list[str], n_chunks: int, seed: int = 42) -> list[list[str]]:
    """G5 column plan. Columns in seeded order are dealt in slices of
    ``len // n_chunks``; chunk i has slice i and half a slice of columns drawn from
    the others. Columns beyond the last whole slice go one each to the first
    chunks (a column that a chunk already drew is not repeated)."""
    key = lambda *part: hashlib.md5("|".join(map(str, part)).encode()).hexdigest()
    size = len(columns) // n_chunks
    if not size:
        raise ValueError(f"{len(columns)} columns do not fill {n_chunks} chunks")
    dealt = sorted(columns, key=lambda c: key(seed, c))
    plan = []
    for i in range(n_chunks):
        own = dealt[i * size:(i + 1) * size]
        drawn = sorted(set(columns).difference(own), key=lambda c: key(seed, i, c))[:size // 2]
        over = dealt[n_chunks * size:][i:i + 1]
        plan.append([c for c in columns if c in {*own, *drawn, *over}])
    return plan


def row_chunks(train: DataFrame, ids, n_chunks: int, columns: list[str], seed: int = 42) -> DataFrame:
    """The training rows in id order, cut into ``n_chunks`` runs whose sizes differ
    by at most one (the larger first), each with the columns of ``chunk_columns``. One
    frame with a ``chunk`` number; columns that a chunk lacks are NULL."""
    ids = _ids(ids)
    n = train.count()
    chunk = _ntile(F.col("_pos"), F.lit(n), n_chunks) - 1
    # ids alone are ranked; the rows join their chunk
    place = positions(train.select(*ids), [], ids, out="_pos").select(*ids, chunk.alias("chunk"))
    ranked = train.select(*ids, *columns).join(place, ids)
    plan = chunk_columns(columns, n_chunks, seed)
    has = {c: [i for i, picked in enumerate(plan) if c in picked] for c in columns}
    return ranked.select(*ids, *[F.when(F.col("chunk").isin(has[c]), F.col(c)).alias(c) for c in columns], "chunk")
