"""Pluggable text encoders (K1) and the encode-distinct-values pattern (K2).

Two encoder shapes:
* ``HashingEncoder`` — dependency-free, deterministic: signed hashing of
  character trigrams (md5 buckets) into ``dim`` slots, L2-normalised. Trigrams
  are counted as numbers in numpy; md5 is reckoned once for each that a task
  does not remember, not once for each that a text has.
* ``BatchEncoder`` — wraps any ``f(list[str]) -> np.ndarray`` (for example a
  sentence-embedding model); runs as an Arrow-batched pandas UDF, the model is
  loaded once per Python worker by ``loader`` and cached.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHARS = 1 << 18  # characters of a batch's texts at once
SLOTS = 1 << 20  # trigrams remembered
COUNTS = 1 << 22  # counts of a batch's texts at once


class HashingEncoder:
    def __init__(self, dim: int = 16):
        self.dim = dim

    def apply(self, df: DataFrame, text: Column, out: str) -> DataFrame:
        """Add ``out``: the padded lower-case text (of Spark's rules) is what the trigrams are taken from."""
        dim = self.dim

        @F.arrow_udf(T.ArrayType(T.DoubleType()))
        def unit(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            grams = _Trigrams(dim)
            for batch in batches:
                x = grams.counts(batch)
                n = np.sqrt((x * x).sum(1, keepdims=True))  # of whole numbers: exact
                x = np.divide(x, n, out=np.zeros_like(x), where=n > 0)
                yield pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * np.int32(dim)), pa.array(x.ravel()))

        padded = F.concat(F.lit(" "), F.lower(F.coalesce(text, F.lit(""))), F.lit(" "))
        return df.withColumn(out, unit(padded.cast("binary")))


class _Trigrams:
    """Signed counts of the trigrams of texts by slot. A trigram of code points is one number; the last that met its place in a table of
    ``SLOTS`` is remembered with its slot and sign."""

    def __init__(self, dim: int):
        self.dim = dim
        self.gram, self.of = np.full(SLOTS, -1, np.int64), np.zeros(SLOTS, np.int32)

    def counts(self, texts: pa.Array) -> np.ndarray:
        """``len(texts)`` x ``dim``."""
        out = np.zeros((len(texts), self.dim))
        row, part, held = [], [], 0
        for i, text in enumerate(texts):
            text = text.as_py().decode("utf-8", "replace")
            for a in range(0, max(1, len(text) - 2), CHARS):  # pieces share two characters
                row.append(i)
                part.append(text[a:a + CHARS + 2])
                held += len(part[-1])
                if held >= CHARS or len(row) * self.dim * 2 >= COUNTS:
                    self._add(out, row, part)
                    row, part, held = [], [], 0
        if row:
            self._add(out, row, part)
        return out

    def _add(self, out: np.ndarray, row: list[int], part: list[str]) -> None:
        size = np.fromiter(map(len, part), np.int64, len(part))
        c = np.frombuffer("".join(part).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        whole = np.ones(len(c), bool)  # a trigram of one text begins here
        ends = np.cumsum(size)
        whole[ends - 1] = False
        whole[ends[size > 1] - 2] = False
        at = np.flatnonzero(whole)
        of = self._slots((c[at] << 42) | (c[at + 1] << 21) | c[at + 2])
        n = np.bincount(np.repeat(np.arange(len(part)) * (2 * self.dim), np.maximum(size - 2, 0)) + of, minlength=len(part) * 2 * self.dim)
        n = n.reshape(len(part), self.dim, 2)
        np.add.at(out, row, n[:, :, 0] - n[:, :, 1])

    def _slots(self, gram: np.ndarray) -> np.ndarray:
        """Twice the slot of each trigram, and one more where its sign is negative."""
        place = ((gram.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64) % SLOTS
        out, new = self.of[place], np.flatnonzero(self.gram[place] != gram)
        if len(new):
            kind, nth = np.unique(gram[new], return_inverse=True)
            of = np.fromiter(map(self._hashed, kind.tolist()), np.int32, len(kind))
            out[new] = of[nth]
            last = dict(zip(place[new].tolist(), nth.tolist()))  # of those that share a place one stays
            to, stays = np.fromiter(last, np.int64, len(last)), np.fromiter(last.values(), np.int64, len(last))
            self.gram[to], self.of[to] = kind[stays], of[stays]
        return out

    def _hashed(self, gram: int) -> int:
        text = chr(gram >> 42) + chr(gram >> 21 & 0x1FFFFF) + chr(gram & 0x1FFFFF)
        h = hashlib.md5(text.encode("utf-8", "surrogatepass")).hexdigest()
        return 2 * (int(h[:8], 16) % self.dim) + (int(h[8], 16) >= 8)


class BatchEncoder:
    """``loader()`` returns ``f(texts) -> float32[n, dim]``; called once per worker.
    ``batch_size``: texts per call; ``max_length``: longest text in white-space words,
    as an encoder's own limit (None leaves texts whole)."""

    _cache: dict = {}

    def __init__(self, loader, dim: int, name: str = "model", batch_size: int = 32, max_length: int | None = None):
        self.loader, self.dim, self.name = loader, dim, name
        self.batch_size, self.max_length = batch_size, max_length

    def apply(self, df: DataFrame, text: Column, out: str) -> DataFrame:
        return df.withColumn(out, self.expr(text))

    def expr(self, text: Column) -> Column:
        loader, name, size, longest = self.loader, self.name, self.batch_size, self.max_length

        @F.pandas_udf(T.ArrayType(T.FloatType()))
        def enc(s: pd.Series) -> pd.Series:
            fn = BatchEncoder._cache.get(name)
            if fn is None:
                fn = BatchEncoder._cache[name] = loader()
            texts = s.fillna("").astype(str).tolist()
            if longest is not None:
                texts = [" ".join(t.split()[:longest]) for t in texts]
            parts = [np.asarray(fn(texts[i:i + size]), dtype=np.float32) for i in range(0, len(texts), size)]
            return pd.Series(list(np.concatenate(parts))) if parts else pd.Series([], dtype=object)

        return enc(text)


def encode(df: DataFrame, text_col: str, encoder, out: str = "vec") -> DataFrame:
    """K1: add the vector of every row's text."""
    return encoder.apply(df, F.coalesce(F.col(text_col).cast("string"), F.lit("")), out)


def encode_distinct(df: DataFrame, text_col: str, encoder, out: str = "vec") -> DataFrame:
    """K2: encode each distinct value once, then equi-join back (a repeated
    value costs one encoding however many rows carry it)."""
    key = F.sha2(F.col(text_col).cast("string").cast("binary"), 256)
    vocab = df.select(key.alias("_key"), F.col(text_col).alias("_t")).distinct()  # the only shuffle of texts: they are joined by their digest
    vocab = encode(vocab, "_t", encoder, out).select(F.col("_key").alias("_of"), out)
    df = df.withColumn("_key", key)
    return df.join(vocab, df["_key"].eqNullSafe(vocab["_of"]), "left").drop("_key", "_of")
