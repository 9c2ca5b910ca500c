"""Quality: nearest-neighbour voting over latent-semantic vectors.

A text is the counts of its hashed terms: words, word shapes (runs of upper-case and lower-case
letters and of digits as one character each, marks as they are), pairs of neighbouring shapes, and whether a word repeats the one
before it. The square roots of the terms' shares, weighted by inverse document frequency, are
projected to ``DIM`` latent dimensions (truncated SVD by subspace iteration) and scaled to unit length. The
vectors and labels of the training rows are broadcast; every text meets all of them in blocked, exact cosine products, and its
``k`` nearest vote with a power of their similarity. A label's votes are scaled to its share in all training rows.

The model is fitted on at most ``per_class`` labelled rows of either label, those with the least hashes of their id: a documented
bound. The training rows' counts are made in a map over all tasks; one task then holds them as at most
2 * per_class * 2 ** BITS numbers, whatever the texts' length. What is broadcast is bounded too: the
projection (2 ** BITS * DIM numbers) and the vectors (2 * per_class * DIM). Scoring is one map over all rows and whole texts.

Defined results: null counts as empty; a text without terms, or with none the model knows, gets the share of label 1 in the
training rows; so does every text when the training rows hold one label or none (then the share lies within
1e-9 of 0 or 1, 0.5 without any); labels other than 0 and 1, rows without a label and labels without a row are not learned from; a
repeated row is learned from once and scored alike each time; ties among neighbours go by the order of the training rows; an
empty table gives an empty result; other columns are never inputs.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, utf8

BITS = 12
DIM = 48
PER_CLASS = 2_000
NEIGHBOURS = 15
POWER = 8
THRESHOLD = 0.3
BLOCK = 256  # texts whose counts, vectors and products are held at once
SEGMENT = 1 << 20  # bytes of one text whose words are held at once
MOST_WORDS = 300_000  # words whose slots a task remembers
_REPEAT, _PAIR = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
_CLASS = bytes(65 if 65 <= c <= 90 else 97 if 97 <= c <= 122 else 57 if 48 <= c <= 57 else c for c in range(256))
_BEYOND = bytes(range(128, 256))
_RUN = re.compile(rb"([Aa9])\1+")


def held_out(doc_id: Column) -> Column:
    """True for the fifth of the rows that labels are never learned from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def shape_of(word: bytes) -> bytes:
    """``Word***`` -> ``Aa***``: one A, a or 9 for a run of ASCII letters or digits, marks as they are, no other letters;
    at most 12 characters."""
    return _RUN.sub(rb"\1", word.translate(_CLASS, _BEYOND))[:12]


# ------------------------------------------------------------------ terms
class Terms:
    """Counts of the hashed terms of texts."""

    def __init__(self, bits: int = BITS):
        self.shift, self.slots = np.uint64(64 - bits), 1 << bits
        self._begin()

    def _begin(self) -> None:
        self.row: dict[bytes, int] = {}
        self.table = np.zeros((1024, 2), np.uint64)  # hashes of the word and of its shape

    def _rows(self, words: list[bytes]) -> np.ndarray:
        if len(self.row) > MOST_WORDS:
            self._begin()
        row, fresh = self.row, []
        for w in set(words).difference(row):
            row[w] = len(row)
            fresh.append((xxhash.xxh64_intdigest(w.lower(), 1), xxhash.xxh64_intdigest(shape_of(w), 2)))
        if fresh:
            while len(self.table) < len(row):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            self.table[len(row) - len(fresh):len(row)] = np.array(fresh, np.uint64)
        return np.fromiter(map(row.__getitem__, words), np.int64, len(words))

    def counts(self, text: bytes) -> np.ndarray:
        out = np.zeros(self.slots, np.int64)
        before = None  # the last word of the segment before
        for words in segments(text):
            if before is not None:
                words.insert(0, before)
            rows = self._rows(words)
            own = self.table[rows]
            repeat = np.uint64(_REPEAT) * (1 + (rows[1:] == rows[:-1]).astype(np.uint64))
            pair = (own[:-1, 1] * np.uint64(3) + own[1:, 1]) * np.uint64(_PAIR)
            first = 0 if before is None else 1  # that word has been counted
            slots = np.concatenate([own[first:, 0], own[first:, 1], repeat, pair]) >> self.shift
            out += np.bincount(slots.astype(np.int64), minlength=self.slots)
            before = words[-1]
        return out


def segments(text: bytes, size: int = SEGMENT) -> Iterator[list[bytes]]:
    """The words of a text, some ``size`` bytes at a time; a word is never cut."""
    at = 0
    while at < len(text):
        end = at + size
        if end < len(text):
            found = re.compile(rb"\s").search(text, end)
            end = found.start() if found else len(text)
        words = text[at:end].split()
        if words:
            yield words
        at = end


# ------------------------------------------------------------------ the model
@dataclass
class Model:
    """Projection (with the idf weights in it), unit vectors, votes of each training row for labels 0 and 1, and the share of 1."""

    projection: np.ndarray
    vectors: np.ndarray
    votes: np.ndarray
    share: float

    def embed(self, counts: np.ndarray) -> np.ndarray:
        return _unit(_shares(counts) @ self.projection)

    def scores(self, counts: np.ndarray, k: int, power: float) -> np.ndarray:
        """Of every row of counts, the share of label 1 in its neighbours' votes."""
        out = np.full(len(counts), self.share)
        if not len(self.vectors):
            return out
        k = min(k, len(self.vectors))
        at = self.embed(counts)
        near = np.maximum(at @ self.vectors.T, 0)
        best = np.argpartition(near, len(self.vectors) - k, axis=1)[:, len(self.vectors) - k:]
        weight = np.take_along_axis(near, best, axis=1).astype(np.float64) ** power
        one, every = (weight * self.votes[best, 1]).sum(1), (weight * self.votes[best].sum(2)).sum(1)
        return np.where(every > 0, one / np.where(every > 0, every, 1), out)


def _shares(counts: np.ndarray) -> np.ndarray:
    return np.sqrt(counts / np.maximum(counts.sum(1, keepdims=True), 1)).astype(np.float32)


def _unit(x: np.ndarray) -> np.ndarray:
    size = np.sqrt((x * x).sum(1, keepdims=True))
    return x / np.where(size > 0, size, 1)


def latent(counts: np.ndarray, dim: int = DIM, rounds: int = 6) -> np.ndarray:
    """The projection onto the leading right singular vectors of the weighted shares, the weights included."""
    idf = np.log((1 + len(counts)) / (1 + (counts > 0).sum(0))).astype(np.float32) + 1
    x = _shares(counts) * idf
    dim = min(dim, *x.shape)
    basis = np.random.default_rng(0).standard_normal((x.shape[1], min(dim + 8, x.shape[1]))).astype(np.float32)
    for _ in range(rounds):
        basis = np.linalg.qr(x.T @ (x @ basis))[0]
    _, _, turn = np.linalg.svd(x @ basis, full_matrices=False)
    return idf[:, None] * (basis @ turn[:dim].T)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
        per_class: int = PER_CLASS, bits: int = BITS, dim: int = DIM) -> Model:
    """Fit on the labelled rows that ``held_out`` leaves, at most ``per_class`` of either label (0 or 1)."""
    marks = (labels.filter(F.col(label_col).isin(0, 1) & ~held_out(F.col(id_col)))
             .groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("label")))
    known = docs.select(F.col(id_col).alias("id")).join(marks, "id").distinct()
    totals = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
    n0, n1 = totals.get(0, 0), totals.get(1, 0)
    if not n0 or not n1:
        share = min(max(n1 / (n0 + n1), 1e-9), 1 - 1e-9) if n0 + n1 else 0.5
        return Model(np.zeros((1 << bits, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros((0, 2)), share)
    order = F.xxhash64("id")
    picked = known.filter("label = 0").orderBy(order, "id").limit(per_class).union(
        known.filter("label = 1").orderBy(order, "id").limit(per_class))
    sample = (docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
              .join(F.broadcast(picked), "id"))  # at most 2 * per_class ids

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms(bits)
        for batch in batches:
            for i, text in enumerate(utf8(batch.column("text"))):
                n = terms.counts(text)
                on = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(i, 1), batch.column("label").slice(i, 1), pa.array([on.astype(np.int32)], pa.list_(pa.int32())),
                     pa.array([n[on]], pa.list_(pa.int64()))], names=["id", "label", "slot", "n"])

    kind = sample.schema["id"].dataType.simpleString()
    counted = (sample.mapInArrow(count, f"id {kind}, label int, slot array<int>, n array<bigint>")
               .groupBy("id").agg(F.max(F.struct("slot", "n")).alias("c"), F.max("label").alias("label"))
               .withColumn("nth", order).select("id", "nth", "label", "c.slot", "c.n")
               .repartition(1).sortWithinPartitions("nth", "id").drop("nth", "id"))

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks, rows = [], []
        for batch in batches:
            marks += batch.column("label").to_pylist()
            for slot, n in zip(batch.column("slot"), batch.column("n")):
                rows.append((slot.values.to_numpy(), n.values.to_numpy()))
        counts = np.zeros((len(rows), 1 << bits), np.float32)
        for out, (slot, n) in zip(counts, rows):
            out[slot] = n
        projection = latent(counts, dim)
        vectors = _unit(_shares(counts) @ projection)
        for label, row in [*[(-1, r) for r in projection], *zip(marks, vectors)]:
            yield pa.RecordBatch.from_arrays([pa.array([label], pa.int32()), pa.array([row], pa.list_(pa.float32()))], names=["label", "row"])

    got = counted.mapInArrow(train, "label int, row array<float>").toPandas()  # 2 ** bits + 2 * per_class rows of dim numbers
    rows = np.stack(got["row"].to_numpy()).astype(np.float32)
    label = got["label"].to_numpy()
    votes = np.zeros((int((label >= 0).sum()), 2))
    scale = np.array([n0 / max(1, (label == 0).sum()), n1 / max(1, (label == 1).sum())])
    votes[np.arange(len(votes)), label[label >= 0]] = scale[label[label >= 0]]
    return Model(rows[label < 0], rows[label >= 0], votes, n1 / (n0 + n1))


def score(docs: DataFrame, model: Model, text_col: str = "text", out: str = "score", k: int = NEIGHBOURS, power: float = POWER) -> DataFrame:
    """``docs`` with one more column, the share of label 1 in the votes of the nearest training rows."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    thin = free_name("_text", docs)
    rows = docs.withColumn(thin, F.col(text_col).cast("string"))
    schema = T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = score_texts(sent.value, k, power)
        for batch in batches:
            i = batch.schema.get_field_index(thin)
            kept = [batch.column(c) for c in range(batch.num_columns) if c != i]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(turn(utf8(batch.column(i))))],
                                             names=[*[n for n in batch.schema.names if n != thin], out])

    return rows.mapInArrow(run, schema)


def score_texts(model: Model, k: int = NEIGHBOURS, power: float = POWER) -> Callable[[list[bytes]], np.ndarray]:
    """A scorer of lists of texts, ``BLOCK`` at a time."""
    terms = Terms(int(np.log2(len(model.projection))))

    def turn(texts: list[bytes]) -> np.ndarray:
        out = np.zeros(len(texts))
        for at in range(0, len(texts), BLOCK):
            some = texts[at:at + BLOCK]
            counts = np.stack([terms.counts(t) for t in some])
            found = model.scores(counts, k, power)
            found[counts.sum(1) == 0] = model.share
            out[at:at + BLOCK] = found
        return out

    return turn
