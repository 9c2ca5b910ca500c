"""Suffix-array dedup: bytes covered by a string of ``SIZE`` bytes that also starts elsewhere.

The suffix array cannot be built over all texts at once, so its suffixes are dealt
to tasks by *anchors*. Each window of ``SIZE`` bytes is owned by its least
``GRAM``-byte gram (by hash; the leftmost of equals). The owner depends on the
window's bytes alone, so equal windows have equal anchors, and every window of a
corpus is in exactly one anchor's care:

1. Each text is cut into runs of consecutive windows with one owner. A run is
   written as (anchor, hash of the run's bytes, row, place). Anchors that occur once
   cannot hold a repeat and go.
2. Runs with equal bytes are counted, not copied. Where all runs of an anchor are
   equal, all their windows occur as often as the run does.
3. Where the runs of an anchor differ, one run of each kind goes to a bucket of
   anchors of about ``BUCKET`` bytes. There the Burrows-Wheeler transform of the
   runs is built, and intervals are expanded breadth first by backward extension,
   which derives the longest common prefixes by increasing value; it stops at
   ``SIZE``. Neighbours in the suffix array without a value below that share a window.
4. An anchor with more than ``HOT`` kinds of runs (a common line in many
   surroundings) would not fit a task. It grows to the whole window: its windows are
   counted one by one under a 128-bit digest of their bytes.
5. Repeated windows go back to their rows, where the bytes that they cover are
   removed.

Every shuffle is of short rows or of combined ones but for two of the texts by
row, which fetch the runs of step 3 and remove the bytes of step 5. Anchors meet
their counts, and runs their verdict, in joins that adaptive execution can split.

Defined results: null counts as empty; texts under ``SIZE`` bytes lose nothing;
rows that repeat an id are different rows, and copies of each other, if their texts
agree; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ensure_checkpoint_dir
from .common import map_batches, utf8

SIZE = 200
GRAM = 32  # bytes of an anchor; a power of two
BUCKET = 1 << 20
HOT = 3_000
PIECE = 1 << 18  # bytes that are hashed at once
_ODD1, _ODD2 = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93  # multipliers of the gram and run hashes
_PLACE = 24  # low bits of a gram's key that hold its place


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


class Anchors:
    """Runs of windows with one owner, over pieces of up to ``PIECE`` bytes plus overlap."""

    def __init__(self, size: int = SIZE, gram: int = GRAM, piece: int = PIECE):
        self.size, self.gram, self.piece = size, gram, piece
        with np.errstate(over="ignore"):
            n = 2 * piece + size
            inverse = pow(_ODD2, -1, 1 << 64)
            self.power = np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, _ODD2, np.uint64))])
            self.back = np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, inverse, np.uint64))])

    def _grams(self, b: np.ndarray) -> np.ndarray:
        h, n, p = b.astype(np.uint64) + np.uint64(1), 1, _ODD1
        while n < self.gram:  # hash of 2n bytes from two of n bytes
            h = h[:-n] * np.uint64(p) + h[n:]
            n, p = 2 * n, p * p % (1 << 64)
        return _mixed(h)

    def _runs(self, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(anchor, run hash, first window, number of windows) over all windows of ``b``."""
        h = self._grams(b)
        key = (h & np.uint64(~((1 << _PLACE) - 1) % (1 << 64))) | np.arange(len(h), dtype=np.uint64)
        width, have = self.size - self.gram + 1, 1
        while 2 * have <= width:
            key = np.minimum(key[:-have], key[have:])
            have *= 2
        if width > have:
            key = np.minimum(key[:have - width], key[width - have:])
        own = (key & np.uint64((1 << _PLACE) - 1)).astype(np.int64)
        return h, own

    def of_texts(self, texts: list[bytes]) -> Iterator[tuple[np.ndarray, ...]]:
        """(anchor, run hash, text number, first window, number of windows)."""
        pieces: list[tuple[int, int, bytes]] = []
        have = 0
        for k, text in enumerate(texts):
            if len(text) < self.size:
                continue
            for at in range(0, len(text) - self.size + 1, self.piece):
                part = text[at:at + self.piece + self.size - 1]
                pieces.append((k, at, part))
                have += len(part)
                if have >= self.piece:
                    yield self._joined(pieces)
                    pieces, have = [], 0
        if pieces:
            yield self._joined(pieces)

    def _joined(self, pieces: list[tuple[int, int, bytes]]) -> tuple[np.ndarray, ...]:
        b = np.frombuffer(b"".join([p for _, _, p in pieces]), np.uint8)
        sizes = np.array([len(p) for _, _, p in pieces])
        begins = np.cumsum(sizes) - sizes
        h, own = self._runs(b)
        windows = len(own)
        piece = np.repeat(np.arange(len(pieces)), sizes)[:windows]
        inside = np.arange(windows) + self.size <= (begins + sizes)[piece]
        new = np.ones(windows, bool)
        new[1:] = (own[1:] != own[:-1]) | (piece[1:] != piece[:-1])
        starts = np.flatnonzero(new & inside)
        # a run ends at the next one, or with the last window of its piece
        nexts = np.append(np.flatnonzero(new), windows)
        ends = np.minimum(nexts[np.searchsorted(nexts, starts, "right")], (begins + sizes)[piece[starts]] - self.size + 1)
        sums = np.concatenate([[np.uint64(0)], np.cumsum((b.astype(np.uint64) + np.uint64(1)) * self.power[:len(b)])])
        run = _mixed((sums[ends + self.size - 1] - sums[starts]) * self.back[starts])
        run ^= (ends - starts).astype(np.uint64) * np.uint64(_ODD1)
        text = np.array([k for k, _, _ in pieces])[piece[starts]]
        first = starts - begins[piece[starts]] + np.array([at for _, at, _ in pieces])[piece[starts]]
        return h[own[starts]], run, text, first, ends - starts


def runs(rows: DataFrame) -> DataFrame:
    """(anchor, run, row, place): ``place`` is 256 times the first window plus the number of windows."""

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        anchors = Anchors()

        def turn(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            got = list(anchors.of_texts(utf8(batch.column("text"))))
            if not got:
                return None
            a, c, text, first, n = (np.concatenate(x) for x in zip(*got))
            row = batch.column("row").to_numpy()[text]
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(c.view(np.int64)), pa.array(row),
                                               pa.array(first * 256 + n)], names=["anchor", "run", "row", "place"])

        return turn

    return map_batches(rows.select("row", "text"), make, "anchor bigint, run bigint, row bigint, place bigint")


# ------------------------------------------------------------------ inside a bucket
def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in the order of their first ``depth`` symbols or more, by prefix doubling."""
    n = len(text)
    bits = max(9, int(n).bit_length() + 1)
    first = 3 if 27 + bits <= 64 else 1
    padded = np.concatenate([text.astype(np.uint64), np.zeros(first, np.uint64)])
    key = padded[:n].copy()
    for k in range(1, first):
        key = (key << np.uint64(9)) | padded[k:k + n]
    have = first
    place = np.arange(n, dtype=np.uint64)
    packs = 3 * bits <= 64
    low = np.uint64((1 << bits) - 1)
    while True:
        if packs:
            joint = np.sort((key << np.uint64(bits)) | place)
            order = (joint & low).astype(np.int64)
            joint >>= np.uint64(bits)
        else:
            order = np.argsort(key, kind="stable")
            joint = key[order]
        if have >= depth:
            return order
        new = np.ones(n, np.uint64)
        new[0] = 1
        new[1:] = joint[1:] != joint[:-1]
        grade = np.cumsum(new)
        if int(grade[-1]) == n:
            return order
        rank = np.empty(n, np.uint64)
        rank[order] = grade
        follow = np.zeros(n, np.uint64)
        follow[:n - have] = rank[have:]
        key = (rank << np.uint64(bits)) | follow
        have *= 2


def class_bounds(text: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """Per place of the suffix array, whether its suffix and the one before share
    fewer than ``depth`` symbols (symbol 0 separates texts and is never part of a
    common prefix that counts).

    Breadth-first backward extension: the interval of a string w, extended by each
    symbol c in front of it, gives the interval of cw. The place behind that
    interval gets the common prefix length |w| if it has none yet, and only then
    the interval is expanded in its turn."""
    n = len(text)
    bwt = text[order - 1]
    by_symbol = np.argsort(bwt, kind="stable")  # the last-to-first mapping, inverted
    to_first = np.empty(n, np.int64)
    to_first[by_symbol] = np.arange(n)
    same = bwt[by_symbol[1:]] == bwt[by_symbol[:-1]]
    before, after = np.full(n, -1), np.full(n, n)  # nearest place with the same symbol
    before[by_symbol[1:][same]] = by_symbol[:-1][same]
    after[by_symbol[:-1][same]] = by_symbol[1:][same]
    known = np.zeros(n + 1, bool)
    known[[0, n]] = True
    lo, hi = np.array([0]), np.array([n])
    for length in range(depth):
        if not len(lo):
            break
        size = hi - lo
        base = np.repeat(lo, size)
        at = base + (np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size))
        symbol = bwt[at] > 0 if length else np.ones(len(at), bool)
        # intervals of one length do not overlap, so sorted beginnings and ends pair up
        begin = np.sort(to_first[at[symbol & (before[at] < base)]])
        end = np.sort(to_first[at[symbol & (after[at] >= np.repeat(hi, size))]]) + 1
        fresh = ~known[end]
        known[end] = True
        if not length:
            fresh[:] = True
        lo, hi = begin[fresh], end[fresh]
    return known[:n]


def repeated_windows(contents: list[bytes], weights: np.ndarray, size: int = SIZE) -> list[np.ndarray]:
    """Per run (its bytes, its number of occurrences): whether each of its windows
    occurs more than once in all of them."""
    lengths = np.array([len(c) for c in contents])
    flat = np.zeros(int(lengths.sum()) + len(contents), np.uint16)
    begins = np.cumsum(lengths + 1) - lengths - 1
    joined = np.frombuffer(b"".join(contents), np.uint8)
    body = np.arange(len(joined)) + np.repeat(np.arange(len(contents)), lengths)
    flat[body] = joined.astype(np.uint16) + 1
    order = suffix_array(flat, size)
    kind = np.cumsum(class_bounds(flat, order, size)) - 1
    of = np.empty(len(flat), np.int64)
    of[order] = kind
    windows = lengths - size + 1
    starts = np.repeat(begins, windows) + (np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows))
    total = np.bincount(of[starts], np.repeat(weights, windows), int(kind[-1]) + 1)
    return np.split(total[of[starts]] > 1, np.cumsum(windows)[:-1])


def _ranges(flags: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


# ------------------------------------------------------------------ the whole
def _stored(df: DataFrame) -> DataFrame:
    """A written table in the shared folder: it is compressed, which a checkpoint is not."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/suffix-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)


def _with_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, row, text) where ``row`` tells rows apart: the id if it does, else a number
    that is fixed in a stored copy."""
    thin = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    if isinstance(thin.schema["id"].dataType, (T.LongType, T.IntegerType, T.ShortType, T.ByteType)):
        shared = thin.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 or id is null")
        if shared.isEmpty():
            return thin.withColumn("row", F.col("id").cast("bigint"))
    return _stored(thin.withColumn("row", F.monotonically_increasing_id()))


def _fetched(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (row, place, anchor, run, ...) with ``content``, the bytes of the run."""
    lists = wanted.groupBy("row").agg(F.collect_list(F.struct("place", "anchor", "run", "n", "hot")).alias("runs"))

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def turn(batch: pa.RecordBatch) -> pa.RecordBatch:
            out: list[tuple] = []
            for text, found in zip(utf8(batch.column("text")), batch.column("runs").to_pylist()):
                for r in found:
                    first, windows = divmod(r["place"], 256)
                    out.append((r["anchor"], r["run"], r["n"], r["hot"], text[first:first + windows + SIZE - 1]))
            cols = list(zip(*out)) or [[]] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)],
                                              names=["anchor", "run", "n", "hot", "content"])

        return turn

    return map_batches(rows.join(lists, "row").select("text", "runs"), make,
                       "anchor bigint, run bigint, n bigint, hot boolean, content binary")


_RANGES = "anchor bigint, run bigint, ranges array<array<int>>"


def _expand(group: pd.DataFrame) -> pd.DataFrame:
    """The repeated windows of the runs in one bucket, as ranges."""
    group = group.sort_values(["anchor", "run"])
    flags = repeated_windows([bytes(c) for c in group["content"]], group["n"].to_numpy())
    found = [[list(r) for r in _ranges(f)] for f in flags]
    out = pd.DataFrame({"anchor": group["anchor"].to_numpy(), "run": group["run"].to_numpy(), "ranges": found})
    return out[[len(r) > 0 for r in found]]


def _hot_ranges(contents: DataFrame) -> DataFrame:
    """The repeated windows of runs of hot anchors: windows are counted one by one."""

    def windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 2000):
                part, out = batch.iloc[at:at + 2000], []
                for a, c, n, content in zip(part["anchor"], part["run"], part["n"], part["content"]):
                    content = bytes(content)
                    out += [(a, c, n, i, hashlib.blake2b(content[i:i + SIZE], digest_size=16).digest())
                            for i in range(len(content) - SIZE + 1)]
                yield pd.DataFrame(out, columns=["anchor", "run", "n", "at", "digest"])

    each = contents.mapInPandas(windows, "anchor bigint, run bigint, n bigint, at int, digest binary")
    twice = each.groupBy("digest").agg(F.sum("n").alias("total")).filter("total > 1").select("digest")
    return (each.join(twice, "digest", "left_semi").groupBy("anchor", "run")
            .agg(F.transform(F.array_sort(F.collect_list("at")), lambda i: F.array(i, i + 1)).alias("ranges")))


def repeated_places(rows: DataFrame, bucket: int = BUCKET, hot: int = HOT) -> DataFrame:
    """(row, ranges): the windows of each row that occur elsewhere, as ranges of starts."""
    cut = runs(rows)
    twice = cut.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("anchor")
    # stored, so that the join shuffles both sides afresh and can split a hot anchor
    shared = _stored(cut.join(_stored(twice), "anchor"))
    kinds = shared.groupBy("anchor", "run").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("row", "place")).alias("one"))
    kinds = _stored(kinds.select("anchor", "run", "n", "one.row", "one.place"))
    several = _stored(kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1"))
    whole = F.array(F.array(F.lit(0), (F.col("place") % 256).cast("int")))
    settled = kinds.filter("n > 1").select("anchor", "run", whole.alias("ranges"))  # equal runs repeat as a whole
    wanted = kinds.join(several, "anchor").select("row", "place", "anchor", "run", "n", (F.col("kinds") > hot).alias("hot"))
    contents = _stored(_fetched(rows, wanted))
    size = contents.filter("not hot").agg(F.sum(F.octet_length("content"))).first()[0] or 0
    buckets = max(1, -(-size // bucket))
    cold = (contents.filter("not hot").withColumn("bucket", F.pmod(F.xxhash64("anchor"), F.lit(buckets)))
            .groupBy("bucket").applyInPandas(_expand, _RANGES))
    hot_ones = _hot_ranges(contents.filter("hot"))
    # runs that occur more than once are settled; they take part above so that others meet them
    found = settled.unionByName(
        cold.unionByName(hot_ones).join(kinds.filter("n = 1").select("anchor", "run"), ["anchor", "run"], "left_semi"))
    first = F.floor(F.col("place") / 256).cast("bigint")
    return (shared.join(found, ["anchor", "run"])
            .select("row", F.transform("ranges", lambda r: F.array(r[0] + first, r[1] + first)).alias("ranges"))
            .groupBy("row").agg(F.flatten(F.collect_list("ranges")).alias("ranges")))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket: int = BUCKET,
                   hot: int = HOT) -> DataFrame:
    """Per row: the id, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256``, ``spans``
    (byte ranges that are removed) and ``kept`` (the remaining bytes)."""
    rows = _with_rows(docs, id_col, text_col)
    marked = rows.join(repeated_places(rows, bucket, hot), "row", "left").select("id", "text", "ranges")

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def turn(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = []
            for text, ranges in zip(utf8(batch.column("text")), batch.column("ranges").to_pylist()):
                spans: list[list[int]] = []
                for a, b in sorted(ranges or ()):
                    b += SIZE - 1
                    if spans and a <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], b)
                    else:
                        spans.append([a, b])
                kept, last = [], 0
                for a, b in spans:
                    kept.append(text[last:a])
                    last = b
                rest = b"".join([*kept, text[last:]])
                out.append((len(text), sum(b - a for a, b in spans), len(spans), hashlib.sha256(rest).hexdigest(), spans, rest))
            cols = list(zip(*out)) or [[]] * 6
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.list_(pa.int64())), pa.binary())
            return pa.RecordBatch.from_arrays([batch.column("id"), *[pa.array(c, k) for c, k in zip(cols, kinds)]],
                                              names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"])

        return turn

    out = map_batches(marked, make, f"id {marked.schema['id'].dataType.simpleString()}, n_bytes bigint, n_removed bigint, "
                                    "n_spans bigint, kept_sha256 string, spans array<array<bigint>>, kept binary")
    return out.withColumnRenamed("id", id_col)


ORACLE = """WITH d AS (SELECT row_number() OVER () AS rn, doc_id, hex(encode(coalesce(text, ''))) AS h, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n FROM documents),
w AS (SELECT rn, i, md5(substr(h, 2 * i - 1, 400)) AS k FROM (SELECT rn, h, unnest(range(1, n - 198)) AS i FROM d WHERE n >= 200)),
hit AS (SELECT rn, i FROM w WHERE k IN (SELECT k FROM w GROUP BY k HAVING count(*) > 1)),
new AS (SELECT rn, i, CASE WHEN i > lag(i) OVER (PARTITION BY rn ORDER BY i) + 200 THEN 1 ELSE 0 END AS s FROM hit),
run AS (SELECT rn, min(i) AS a, max(i) + 200 AS b FROM (SELECT rn, i, sum(s) OVER (PARTITION BY rn ORDER BY i) AS r FROM new) GROUP BY rn, r),
cut AS (SELECT rn, a, b, coalesce(lag(b) OVER (PARTITION BY rn ORDER BY a), 1) AS since FROM run),
per AS (SELECT d.rn, sum(b - a) AS removed, count(*) AS spans, string_agg(substr(d.h, 2 * since - 1, 2 * (a - since)), '' ORDER BY a) AS before, max(b) AS last
        FROM cut JOIN d USING (rn) GROUP BY d.rn)
SELECT d.doc_id, d.n AS n_bytes, CAST(coalesce(per.removed, 0) AS BIGINT) AS n_removed, coalesce(per.spans, 0) AS n_spans,
  sha256(unhex(CASE WHEN per.rn IS NULL THEN d.h ELSE per.before || substr(d.h, 2 * per.last - 1) END)) AS kept_sha256
FROM d LEFT JOIN per USING (rn)"""
