"""The hashing encoder counts trigrams as numbers: the vectors of a plain loop, few digests, one shuffle of texts."""

import hashlib
import math

import numpy as np
import pyarrow as pa
import pytest

from tabweave.operators import encoder as K
from tabweave.operators.encoder import BatchEncoder, HashingEncoder, encode, encode_distinct

TEXTS = [None, "", "a", "ab", "  ", "Plain Text, plain text", "a\nb\tc\x00d", "naïve café ÉTÉ", "\U0001f600\U0001f600 x \U0001d538\U0001d538", "ΑΒΓ αβγ", "aaaa " * 50]


def plain(text, dim):
    """``text`` is padded and in lower case."""
    out = [0.0] * dim
    for i in range(len(text) - 2):
        h = hashlib.md5(text[i:i + 3].encode()).hexdigest()
        out[int(h[:8], 16) % dim] += 1.0 if int(h[8], 16) < 8 else -1.0
    return out


def unit(x):
    n = math.sqrt(sum(v * v for v in x))
    return [v / n if n else 0.0 for v in x]


@pytest.mark.parametrize("dim", [16, 5, 1])
def test_vectors_of_a_plain_loop(spark, dim):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id bigint, text string")
    got = {r["id"]: r["v"] for r in encode(df, "text", HashingEncoder(dim), "v").collect()}
    assert got == {i: unit(plain(f" {(t or '').lower()} ", dim)) for i, t in enumerate(TEXTS)}


@pytest.mark.parametrize("chars, slots, counts", [(7, 1 << 20, 1 << 22), (1 << 18, 4, 1 << 22), (50, 16, 40)])
def test_pieces_and_forgotten_trigrams(monkeypatch, chars, slots, counts):
    """Long texts in pieces, and a table too small for all trigrams, change no count."""
    for name, v in (("CHARS", chars), ("SLOTS", slots), ("COUNTS", counts)):
        monkeypatch.setattr(K, name, v)
    texts = [f" {(t or '').lower()} " for t in TEXTS]
    grams = K._Trigrams(6)
    for _ in range(2):
        got = grams.counts(pa.array([t.encode() for t in texts], pa.binary()))
        assert got.tolist() == [plain(t, 6) for t in texts]


def test_a_trigram_is_hashed_once(monkeypatch):
    seen = []
    hashed = K._Trigrams._hashed
    monkeypatch.setattr(K._Trigrams, "_hashed", lambda self, gram: (seen.append(gram), hashed(self, gram))[1])
    grams = K._Trigrams(8)
    for _ in range(3):
        grams.counts(pa.array([b" one and one and one ", b" and one "] * 20, pa.binary()))
    assert len(seen) == len(set(seen)) == len({t[i:i + 3] for t in (" one and one and one ", " and one ") for i in range(len(t) - 2)})


def test_texts_are_shuffled_once(spark):
    """Distinct texts meet their rows by digest; nulls and repeated texts keep theirs."""
    rows = [(i, t) for i, t in enumerate(TEXTS * 3)]
    df = spark.createDataFrame(rows, "id bigint, text string")
    seen = encode_distinct(df, "text", HashingEncoder(4), "v").select("id", "v")
    plan = seen._jdf.queryExecution().sparkPlan().toString() + seen._jdf.queryExecution().executedPlan().toString()
    dealt = [x for x in plan.splitlines() if "Exchange hashpartitioning" in x]
    assert dealt and sum("_t#" in x or "text#" in x for x in dealt) == 1
    assert {r["id"]: r["v"] for r in seen.collect()} == {i: unit(plain(f" {(t or '').lower()} ", 4)) for i, t in rows}


def test_each_distinct_text_is_encoded_once(spark):
    count = spark.sparkContext.accumulator(0)

    def loader():
        return lambda texts: (count.add(len(texts)), np.ones((len(texts), 2), np.float32))[1]

    df = spark.createDataFrame([(i, f"text {i % 5}" if i % 6 else None) for i in range(60)], "id bigint, text string")
    out = encode_distinct(df, "text", BatchEncoder(loader, 2, name="counting"), "v").select("id", "v").collect()
    assert len(out) == 60 and all(r["v"] == [1.0, 1.0] for r in out)
    assert count.value == 6
