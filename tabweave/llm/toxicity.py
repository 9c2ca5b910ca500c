"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams.

Features of a text (present or not, whatever its length): its words, their
beginnings (``PREFIXES`` bytes; inflected forms share them), pairs of
neighbouring words and skip-grams (pairs with one or two words between), hashed
to ``2 ** BITS`` slots. FTRL-proximal keeps two sums per slot: its own learning
rate falls with the squared gradients it has seen, and the L1 term leaves a slot
at zero until its evidence outweighs it. What is broadcast are the slots that
are not zero: at most ``2 ** BITS``, in practice a few thousand.

The model is fitted on at most ``per_class`` labelled rows of either label,
those with the least hashes of their id: a documented bound. Their texts become slots in a map
over all tasks; only the slots (at most ``2 ** BITS`` numbers a text, whatever its length) reach the one task that trains. The
intercept is corrected for the share of labels in all training rows. Scoring is
one map over all rows and whole texts.

Defined results: a text without words gets the score of the intercept; null
counts as empty; rows without a label, and labels without a row, are not
learned from; a repeated row is learned from once and scored alike each time;
with one label (or none) in the training rows every score is the share of label 1;
an empty table gives an empty result; other columns are never inputs.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, utf8
from .decontam import words_of

BITS = 20
PREFIXES = (3, 4, 5, 6, 7, 8)
SKIPS = (1, 2, 3)  # distance between the words of a pair; 1 is the plain bigram
PER_CLASS = 6_000
PIECE = 1 << 19  # bytes of text whose features are made at once
EPOCHS = 6
ALPHA, BETA, L1, L2 = 1.0, 1.0, 5.0, 0.0
THRESHOLD = 0.3
_PAIR = {1: 0x9E3779B97F4A7C15, 2: 0xC2B2AE3D27D4EB4F, 3: 0x165667B19E3779F9}  # one odd multiplier per distance


def held_out(doc_id: Column) -> Column:
    """True for the quarter of the rows that labels are never learned from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


class Hasher:
    """Slots of the features of many texts at once."""

    def __init__(self, bits: int = BITS, most: int = 100_000):
        self.shift, self.most = np.uint64(64 - bits), most
        self.row: dict[bytes, int] = {}  # word -> row of its table
        self._begin()

    def _begin(self) -> None:
        self.row.clear()
        self.table = np.zeros((1024, 1 + len(PREFIXES)), np.uint64)

    def _rows(self, words: list[bytes]) -> np.ndarray:
        row, fresh = self.row, []
        if len(row) > self.most:
            self._begin()
        for w in set(words).difference(row):
            row[w] = len(row)
            fresh.append([xxhash.xxh64_intdigest(w, 1), *(xxhash.xxh64_intdigest(w[:p], 2 + p) for p in PREFIXES)])
        if fresh:
            while len(self.table) < len(row):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            self.table[len(row) - len(fresh):len(row)] = np.array(fresh, np.uint64)
        return np.fromiter(map(row.__getitem__, words), np.int64, len(words))

    def features(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(text number, slot) of every feature occurrence."""
        words, sizes = [], []
        for t in texts:
            w = words_of(t)
            sizes.append(len(w))
            words += w
        owner = np.repeat(np.arange(len(texts)), sizes)
        own = self.table_of(words)
        owners, slots = [owner] * own.shape[1], [own[:, k] for k in range(own.shape[1])]
        h = own[:, 0]
        for d in SKIPS:
            if len(h) > d:
                pair = (h[:-d] * np.uint64(3) + h[d:]) * np.uint64(_PAIR[d])
                same = owner[:-d] == owner[d:]
                owners.append(owner[:-d][same])
                slots.append(pair[same])
        return np.concatenate(owners), (np.concatenate(slots) >> self.shift).astype(np.int64)

    def table_of(self, words: list[bytes]) -> np.ndarray:
        rows = self._rows(words)  # may replace the table
        return self.table[rows]


@dataclass
class Weights:
    """A fitted model: the slots that are not zero."""

    slots: np.ndarray
    values: np.ndarray
    intercept: float

    def table(self, bits: int = BITS) -> np.ndarray:
        out = np.zeros(1 << bits, np.float32)
        out[self.slots] = self.values
        return out


class Ftrl:
    """FTRL-proximal logistic regression over sets of slots; the last slot is the intercept (no L1)."""

    def __init__(self, slots: int, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2):
        self.z, self.n = np.zeros(slots + 1), np.zeros(slots + 1)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at: np.ndarray) -> np.ndarray:
        z = self.z[at]
        l1 = np.where(at == len(self.z) - 1, 0.0, self.l1)
        w = -(z - np.sign(z) * l1) / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2)
        return np.where(np.abs(z) <= l1, 0.0, w)

    def learn(self, at: np.ndarray, label: int) -> None:
        w = self.weights(at)
        g = 1 / (1 + math.exp(-max(-35.0, min(35.0, w.sum())))) - label
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
        per_class: int = PER_CLASS, epochs: int = EPOCHS, bits: int = BITS) -> Weights:
    """Fit on the labelled rows that ``held_out`` leaves, at most ``per_class`` of
    either label (0 or 1; other labels are left out)."""
    marks = (labels.filter(F.col(label_col).isin(0, 1) & ~held_out(F.col(id_col)))
             .groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("label")))
    known = docs.select(F.col(id_col).alias("id")).join(marks, "id").distinct()
    totals = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    n0, n1 = totals.get(0, 0), totals.get(1, 0)
    if not n0 or not n1:
        share = min(max(n1 / (n0 + n1 + 1), 1e-9), 1 - 1e-9)
        return Weights(np.zeros(0, np.int64), np.zeros(0, np.float32), math.log(share / (1 - share)))
    order = F.xxhash64("id")
    picked = known.filter("label = 0").orderBy(order, "id").limit(per_class).union(
        known.filter("label = 1").orderBy(order, "id").limit(per_class))
    sample = (docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
              .join(F.broadcast(picked), "id"))  # at most 2 * per_class ids

    def slots_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(bits)
        for batch in batches:
            texts = utf8(batch.column("text"))
            for a, b in pieces(texts):
                # the slots of some texts as one array, each text with the intercept at its end
                owner, slots = hasher.features(texts[a:b])
                key = np.unique(np.concatenate([(owner << (bits + 1)) | slots, (np.arange(b - a) << (bits + 1)) | (1 << bits)]))
                ends = np.cumsum(np.bincount(key >> (bits + 1), minlength=b - a))
                flat = pa.array((key & ((1 << (bits + 1)) - 1)).astype(np.int32))
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), flat)
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(a, b - a), batch.column("label").slice(a, b - a), lists],
                                                 names=["id", "label", "slots"])

    kind = sample.schema["id"].dataType.simpleString()
    slotted = (sample.mapInArrow(slots_of, f"id {kind}, label int, slots array<int>")
               .groupBy("id").agg(F.max("label").alias("label"), F.max("slots").alias("slots"))  # a repeated row once
               .withColumn("nth", order).repartition(1).sortWithinPartitions("nth", "id").drop("nth", "id"))

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, model = [], Ftrl(1 << bits)
        for batch in batches:
            lists = batch.column("slots")
            ends = lists.offsets.to_numpy()[1:] - lists.offsets[0].as_py()
            parts.append((batch.column("label").to_pylist(), lists.flatten().to_numpy().copy(), ends.copy()))
        for _ in range(epochs):
            for marks, flat, ends in parts:
                for label, at in zip(marks, np.split(flat, ends[:-1])):
                    model.learn(at, label)
        del parts
        every = np.arange((1 << bits) + 1)
        w = model.weights(every)
        on = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(on, pa.int64()), pa.array(w[on], pa.float64())], names=["slot", "w"])

    got = slotted.mapInArrow(train, "slot bigint, w double").toPandas()  # at most 2 ** bits + 1 rows
    slots, w = got["slot"].to_numpy(), got["w"].to_numpy()
    bias = slots == 1 << bits
    s0, s1 = min(n0, per_class), min(n1, per_class)
    intercept = float(w[bias].sum()) + math.log(n1 / n0) - math.log(s1 / s0)
    return Weights(slots[~bias], w[~bias].astype(np.float32), intercept)


def pieces(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``PIECE`` bytes."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= PIECE:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def score_batches(model: Weights, bits: int = BITS) -> Callable[[], Callable[[list[bytes]], np.ndarray]]:
    """A per-task set-up for scoring lists of texts."""

    def make() -> Callable[[list[bytes]], np.ndarray]:
        hasher, table = Hasher(bits), model.table(bits)
        on = table != 0

        def score(texts: list[bytes]) -> np.ndarray:
            out = np.full(len(texts), model.intercept)
            for at, end in pieces(texts):
                owner, slots = hasher.features(texts[at:end])
                hit = on[slots]
                key = np.unique((owner[hit] << bits) | slots[hit])
                out[at:end] += np.bincount(key >> bits, table[key & ((1 << bits) - 1)].astype(np.float64), end - at)
            return 1 / (1 + np.exp(-np.clip(out, -35, 35)))

        return score

    return make


def score(docs: DataFrame, model: Weights, text_col: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with one more column, the probability of label 1."""
    packed = docs.sparkSession.sparkContext.broadcast(model)
    thin = free_name("_text", docs)
    rows = docs.withColumn(thin, F.col(text_col).cast("string"))
    schema = T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = score_batches(packed.value)()
        for batch in batches:
            i = batch.schema.get_field_index(thin)
            kept = [batch.column(k) for k in range(batch.num_columns) if k != i]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(turn(utf8(batch.column(i))))],
                                             names=[*[n for n in batch.schema.names if n != thin], out])

    return rows.mapInArrow(run, schema)

