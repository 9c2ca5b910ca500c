"""SimHash near-dedup with a binary trie self-join.

A fingerprint has bit i set when over half of the shingle hashes (XXH64, seed
42) have it. Texts whose fingerprints differ in at most ``max_bits`` bits are
linked; links are closed to components.

The distinct fingerprints form a binary trie. Pairs of its nodes are traversed
together from the root: a pair of nodes spawns the pairs of their children, the
differing bits of the two paths are added up, and a pair over the budget is
dropped with everything below it. The upper part of the trie is walked as a
DataFrame, ``step`` bits a round, until both nodes of a pair hold at most
``leaf`` fingerprints; a crowded node simply goes deeper (at 64 bits it holds one
fingerprint). The lower part of each pair of nodes is then walked in a task of
its own, breadth first in slices of bounded length, over at most 2 x ``leaf``
sorted fingerprints. A task returns a spanning forest of the links it found
(fewer rows than it has fingerprints), which has the same components.

Copies share a fingerprint and are one trie leaf, so a hot group costs nothing;
its rows meet their component again in a join that adaptive execution can split.

Defined results: null counts as empty; a text without words has fingerprint
zero and is linked like any other; repeated rows get equal results; null ids are
never the component id unless all ids of the component are null; an empty table
gives an empty result; further columns are ignored by ``simhash_classes`` and
carried by ``simhash_dedup``, which leaves one row per component whatever the ids.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, map_batches, pinned, utf8
from .graph import components
from .suffix_dedup import _stored

SHINGLE = 3
MAX_BITS = 2
SEED = 42
LEAF = 16_384
STEP = 4
SLICE = 1 << 18  # node pairs that one step of the walk inside a task expands at once
BLOCK = 1 << 16  # shingles of one text that are counted at once


def fingerprint_of(text: bytes, shingle: int = SHINGLE) -> int:
    """The fingerprint of a text as an unsigned integer."""
    words = text.lower().split()  # on bytes: A-Z only, and the six ASCII white-space characters
    if not words:
        return 0
    digest, n = xxhash.xxh64_digest, max(1, len(words) - shingle + 1)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, BLOCK):
        part = words[at:min(at + BLOCK, n) + shingle - 1]
        joined = b" ".join(part)
        size = np.fromiter(map(len, part), np.int64, len(part))
        ends = np.cumsum(size + 1) - 1
        starts = (ends - size).tolist()
        k = min(BLOCK, n - at)
        ends = ends[min(shingle, len(part)) - 1:].tolist()
        raw = b"".join([digest(joined[a:b], SEED) for a, b in zip(starts[:k], ends)])
        counts += np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, fp): the fingerprint as a signed 64-bit integer, one row per row."""

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def turn(batch: pa.RecordBatch) -> pa.RecordBatch:
            fps = np.array([fingerprint_of(t, shingle) for t in utf8(batch.column("_text"))], np.uint64)
            return pa.RecordBatch.from_arrays([batch.column("id"), pa.array(fps.view(np.int64))], names=["id", "fp"])

        return turn

    thin = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("_text"))
    return map_batches(thin, make, f"id {thin.schema['id'].dataType.simpleString()}, fp bigint")


# ------------------------------------------------------------------ inside a task
class _Forest:
    """Union of links between numbered fingerprints; keeps the smaller root."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self._roots(a), self._roots(b)
            apart = a != b
            a, b = a[apart], b[apart]
            high, low = np.maximum(a, b), np.minimum(a, b)
            np.minimum.at(self.up, high, low)
            # a root that several links lower takes the least of them; the others are tried again
            a, b = high, low
            again = self.up[high] != low
            a, b = a[again], b[again]

    def _roots(self, x: np.ndarray) -> np.ndarray:
        while True:
            above = self.up[x]
            if (above == x).all():
                return x
            self.up[x] = self.up[above]
            x = self.up[x]


def _bounds(sorted_fps: np.ndarray, lo: np.ndarray, hi: np.ndarray, depth: int, path: np.ndarray) -> np.ndarray:
    """Where the 1-child of the node at ``path`` (its first ``depth`` bits) begins."""
    first_one = path | np.uint64(1 << (63 - depth))
    return np.clip(np.searchsorted(sorted_fps, first_one), lo, hi)


def trie_pairs(left: np.ndarray, right: np.ndarray, max_bits: int, same: bool,
               slice_len: int = SLICE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i, j) of two sorted arrays of distinct fingerprints that
    differ in at most ``max_bits`` bits; with ``same`` (one array) i < j only."""
    start = (np.zeros(1, np.int64), np.array([len(left)]), np.zeros(1, np.uint64),
             np.zeros(1, np.int64), np.array([len(right)]), np.zeros(1, np.uint64), np.zeros(1, np.int64))
    stack = [(0, start)]
    while stack:
        depth, pairs = stack.pop()
        if len(pairs[0]) > slice_len:
            half = len(pairs[0]) // 2
            stack += [(depth, tuple(x[:half] for x in pairs)), (depth, tuple(x[half:] for x in pairs))]
            continue
        alo, ahi, apath, blo, bhi, bpath, err = pairs
        one = ((ahi - alo) == 1) & ((bhi - blo) == 1)  # both paths lead to one leaf: compare the rest at once
        if one.any():
            i, j = alo[one], blo[one]
            near = np.bitwise_count(left[i] ^ right[j]) <= max_bits
            if same:
                near &= i < j
            if near.any():
                yield i[near], j[near]
            alo, ahi, apath, blo, bhi, bpath, err = (x[~one] for x in pairs)
        if not len(alo) or depth == 64:
            continue
        amid, bmid = _bounds(left, alo, ahi, depth, apath), _bounds(right, blo, bhi, depth, bpath)
        bit = np.uint64(1 << (63 - depth))
        kids = []
        for x, (al, ah) in enumerate(((alo, amid), (amid, ahi))):
            for y, (bl, bh) in enumerate(((blo, bmid), (bmid, bhi))):
                e = err + (x != y)
                ok = (e <= max_bits) & (al < ah) & (bl < bh)
                if same:
                    ok &= al < bh  # below the diagonal the mirror pair is walked
                kids.append((al[ok], ah[ok], (apath | bit if x else apath)[ok], bl[ok], bh[ok], (bpath | bit if y else bpath)[ok], e[ok]))
        stack.append((depth + 1, tuple(np.concatenate(k) for k in zip(*kids))))


def _links(group: pd.DataFrame, max_bits: int) -> pd.DataFrame:
    """Spanning forest of the links between the two nodes of a pair (side 0, 1;
    a node paired with itself has side 0 only)."""
    sides = []
    for s in (0, 1):
        part = group[group["side"] == s]
        fp = part["fp"].to_numpy(np.int64).view(np.uint64)
        order = np.argsort(fp)
        sides.append((fp[order], part["rep"].to_numpy()[order]))
    (left, lrep), (right, rrep) = sides
    same = not len(right)
    if same:
        right, rrep, shift = left, lrep, 0
    else:
        shift = len(left)
    reps = lrep if same else np.concatenate([lrep, rrep])
    forest = _Forest(len(reps))
    for i, j in trie_pairs(left, right, max_bits, same):
        forest.link(i, j + shift)
    root = forest._roots(np.arange(len(reps)))
    held = np.flatnonzero(root != np.arange(len(reps)))
    return pd.DataFrame({"a": reps[held], "b": reps[root[held]]})


# ------------------------------------------------------------------ the upper trie, as DataFrames
def _prefix(fp: str, depth: int):
    return F.shiftrightunsigned(F.col(fp), 64 - depth) if depth else F.lit(0).cast("bigint")


def trie_links(points: DataFrame, max_bits: int = MAX_BITS, leaf: int = LEAF, step: int = STEP) -> DataFrame:
    """Links (a, b) between the ``rep`` of distinct fingerprints (fp, rep): a
    spanning forest per pair of nodes, so the links have the components of all
    pairs within ``max_bits``."""
    done: list[DataFrame] = []
    front = points.groupBy().agg(F.count(F.lit(1)).alias("na")).select(
        F.lit(0).cast("bigint").alias("pa"), F.lit(0).cast("bigint").alias("pb"), F.lit(0).alias("err"),
        "na", F.col("na").alias("nb"))
    front = pinned(front)  # a join on the constant root would be planned as a nested loop
    depth = 0
    while True:
        small = (F.col("na") <= leaf) & (F.col("nb") <= leaf) if depth < 64 else F.lit(True)
        done.append(front.filter(small).select(F.lit(depth).alias("depth"), "pa", "pb"))
        front = front.filter(~small)
        if depth >= 64 or front.isEmpty():
            break
        deeper = min(64, depth + step)
        kids = points.groupBy(_prefix("fp", deeper).alias("kid")).agg(F.count(F.lit(1)).alias("n"))
        kids = kids.withColumn("parent", F.shiftrightunsigned("kid", deeper - depth))
        left = kids.select(F.col("parent").alias("pa"), F.col("kid").alias("ka"), F.col("n").alias("na"))
        right = kids.select(F.col("parent").alias("pb"), F.col("kid").alias("kb"), F.col("n").alias("nb"))
        front = (front.select("pa", "pb").join(left, "pa").join(right, "pb")
                 .withColumn("err", F.bit_count(F.col("ka").bitwiseXOR(F.col("kb"))))  # over the whole paths
                 .filter((F.col("err") <= max_bits) & ((F.col("pa") < F.col("pb")) | (F.col("ka") <= F.col("kb"))))
                 .select(F.col("ka").alias("pa"), F.col("kb").alias("pb"), "err", "na", "nb"))
        front, depth = pinned(front), deeper
    pairs = done[0]
    for more in done[1:]:
        pairs = pairs.union(more)
    pairs = pinned(pairs.withColumn("pair", F.monotonically_increasing_id()))
    ends = pairs.select("pair", "depth", F.col("pa").alias("node"), F.lit(0).alias("side")).union(
        pairs.filter("pa <> pb").select("pair", "depth", "pb", F.lit(1)))
    at = [points.withColumn("depth", F.lit(d)).withColumn("node", _prefix("fp", d)) for d in range(0, depth + 1, step)]
    if depth % step:
        at.append(points.withColumn("depth", F.lit(depth)).withColumn("node", _prefix("fp", depth)))
    placed = at[0]
    for more in at[1:]:
        placed = placed.union(more)
    kind = points.schema["rep"].dataType.simpleString()
    return (placed.join(ends, ["depth", "node"]).select("pair", "side", "fp", "rep")
            .groupBy("pair").applyInPandas(lambda g: _links(g, max_bits), f"a {kind}, b {kind}"))


def simhash_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                    max_bits: int = MAX_BITS, leaf: int = LEAF, step: int = STEP) -> DataFrame:
    """One row per row of ``docs``: the id, ``fingerprint`` (16 hex digits) and
    ``component_id``, the smallest id reachable over links."""
    marked = pinned(fingerprints(docs, id_col, text_col, shingle))
    points = marked.groupBy("fp").agg(F.min("id").alias("least"))
    # a fingerprint stands for itself in the trie; ids come in at the end, so any type of id will do
    points = pinned(points.select("fp", F.col("fp").alias("rep"), "least"))
    found = components(trie_links(points.select("fp", "rep"), max_bits, leaf, step))
    grouped = points.join(found, points["fp"] == found["node"], "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("component"))
    lowest = grouped.groupBy("component").agg(F.min("least").alias("component_id"))
    by_fp = pinned(grouped.join(lowest, "component").select("fp", "component_id"))
    return marked.join(by_fp, "fp").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """The rows of ``docs`` that stay: of each component one row, with the smallest id that
    is not null. Where ids are null or repeated, rows are told apart by a number."""
    shared = docs.groupBy(F.col(id_col).alias("id")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1 or id is null")
    if shared.isEmpty():
        stay = simhash_classes(docs, id_col, text_col, **kw).filter(F.col(id_col) == F.col("component_id"))
        return docs.join(stay.select(id_col), id_col, "left_semi").select([F.col(f"`{c}`") for c in docs.columns])
    row = free_name("_row", docs)
    numbered = _stored(docs.withColumn(row, F.monotonically_increasing_id()))
    who = F.struct(F.col(id_col).isNull().alias("absent"), F.col(id_col).alias("id"), F.col(row).alias("row"))
    stay = simhash_classes(numbered.select(who.alias("who"), F.col(text_col).alias("text")), "who", "text", **kw)
    stay = stay.filter("who = component_id").select(F.col("who.row").alias(row))
    return numbered.join(stay, row, "left_semi").select([F.col(f"`{c}`") for c in docs.columns])
