"""Collocations, spelling variants and the quality classifier against plain versions and edge cases."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tabweave.core import table
from tabweave.llm import collocations, quality, spelling

from ..conftest import SF_CHECK, SF_SMALL
from . import brute
from .test_contracts import SCHEMA, empty, odd, ordered, query, rows_of

FOUND = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


# ------------------------------------------------------------------ collocations
def phrase_rows(df):
    return ordered(df.select(*FOUND).collect())


def made_up(spark, n=400, seed=5):
    """Texts of few words, with a hot phrase, two languages and a null one, and words that hold separators' neighbours."""
    rng = random.Random(seed)
    words = ["a", "b", "c", "A", "\x00", "\x01", "\x02\x03", "x\x00", "é", "É", "zz"]
    rows = []
    for i in range(n):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", ". ", "\n", "  ", "\x0b", "!?"]) for _ in range(rng.randrange(40)))
        rows.append((i, text + " a b c a b c" * (i % 3), rng.choice(["en", "de", None, "und", "\x00"])))
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), rows


@pytest.mark.parametrize("piece, rows, bits", [(1 << 23, 1_000_000, 26), (64, 50, 17), (300, 7, 15)])
def test_collocations_random(spark, monkeypatch, piece, rows, bits):
    monkeypatch.setattr(collocations, "PIECE", piece)
    df, made = made_up(spark)
    got = collocations.collocations(df.repartition(3), least=4, top=60, rows=rows, bits=bits)
    assert phrase_rows(got) == ordered(brute.collocations([(lang, text) for _, text, lang in made], least=4, top=60))


def test_collocations_query(spark, duck):
    docs = table(spark, SF_SMALL, "documents")
    got = phrase_rows(query(spark, "op11_collocations"))
    assert got == ordered(brute.collocations([(r["lang"], r["text"]) for r in docs.collect()]))
    assert got == ordered(duck.execute(f"SELECT {', '.join(FOUND)} FROM ({entry.oracle_sql()['op11_collocations']})").fetchall())


def test_collocations_all_of_a_hot_suffix(spark):
    """One phrase in every row: its suffix fills several ranges, and all its counts add up."""
    df = spark.range(500).select(F.col("id").alias("doc_id"), F.lit("one two three four five").alias("text"), F.lit("en").alias("lang"))
    got = collocations.collocations(df.repartition(6), rows=20).collect()
    assert [(r["phrase"], r["a"], r["n"], r["score"]) for r in got] == [("one two three four five", 500, 2500, 5000)]


def test_quicksort_counts_beginnings():
    rng = np.random.default_rng(3)
    for _ in range(30):
        codes = rng.integers(0, 4, (rng.integers(1, 200), 5)).astype(np.int32)
        codes[np.logical_or.accumulate(rng.random(codes.shape) < 0.2, axis=1)] = -1
        weight = rng.integers(1, 4, len(codes))
        want = {}
        for row, w in zip(codes.tolist(), weight.tolist()):
            for d in range(2, 6):
                if row[d - 1] >= 0:
                    want[tuple(row[:d])] = want.get(tuple(row[:d]), 0) + w
        got = [(tuple(codes[i, :d].tolist()), n) for i, d, n in collocations.sorted_counts(codes, weight, 6, [])]
        assert sorted(got) == sorted((k, n) for k, n in want.items() if n >= 6)


def test_collocations_edges(spark):
    df, _ = odd(spark)
    wide = df.withColumn("phrase", F.lit(1)).withColumn("a", F.lit(2)).withColumn("rank", F.lit(3)).withColumn("part", F.lit("x"))
    texts = [(r["lang"], r["text"]) for r in df.collect()]
    got = collocations.collocations(wide, least=2)
    assert phrase_rows(got) == ordered(brute.collocations(texts, least=2))
    assert collocations.collocations(empty(spark)).count() == 0
    assert collocations.collocations(df.select("text", "lang"), least=10**6).count() == 0
    with pytest.raises(ValueError):
        collocations.collocations(df, most=1)


# ------------------------------------------------------------------ spelling variants
def spelling_rows(df):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


@pytest.mark.parametrize("leaf, step", [(16_384, 2), (40, 3)])
def test_spelling_query(spark, small_texts, leaf, step):
    docs = table(spark, SF_CHECK, "documents").filter("doc_id < 250")
    got = spelling_rows(spelling.spelling_groups(docs, leaf=leaf, step=step))
    assert got == brute.spelling_groups([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert any(v[0] for v in got.values())


@pytest.fixture(scope="module")
def small_texts(spark):
    return rows_of(spark)


def test_spelling_registered(spark, small_texts):
    assert spelling_rows(query(spark, "op12_spelling")) == brute.spelling_groups(small_texts)


@pytest.mark.parametrize("leaf, step, cut", [(1 << 14, 2, 199), (8, 1, 3), (3, 30, 2)])
def test_spelling_random(spark, monkeypatch, leaf, step, cut):
    monkeypatch.setattr(spelling, "SLICE", 64)
    rng = random.Random(leaf)
    rows = []
    for i in range(60):
        text = " ".join("".join(rng.choice("abÀé") for _ in range(rng.randrange(1, 8))) for _ in range(200))
        rows.append((i if i % 9 else None, text))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = spelling.spelling_groups(df, least_length=2, least_count=2, ratio=2, divisor=cut, leaf=leaf, step=step)
    assert spelling_rows(got) == brute.spelling_groups(rows, 2, 2, 2, cut)


def test_spelling_edges(spark):
    df, rows = odd(spark)
    wide = df.withColumn("word", F.lit("w")).withColumn("n", F.lit(1)).withColumn("vec", F.lit("v"))
    got = spelling_rows(spelling.spelling_groups(wide, least_length=1, least_count=1))
    assert got == brute.spelling_groups(rows, 1, 1)
    assert spelling.spelling_groups(empty(spark)).count() == 0
    long = "q" * 30_000
    two = spark.createDataFrame([(1, f"{long} {long}x {long[:-1]}z")], "doc_id bigint, text string")
    assert {k: v[3] for k, v in spelling_rows(spelling.spelling_groups(two, least_count=1)).items()} == {long: 2, long + "x": 1, long[:-1] + "z": 1}


def test_one_letter_apart():
    rng = random.Random(1)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randrange(1, 9))) for _ in range(150)})
    flat = spelling.Words(words)
    i, j = (x.ravel() for x in np.meshgrid(np.arange(len(words)), np.arange(len(words))))
    got = spelling._one_apart(flat, i, flat, j)
    for a, b, ok in zip(i.tolist(), j.tolist(), got.tolist()):
        x, y = sorted((words[a], words[b]), key=len)
        want = (sum(p != q for p, q in zip(x, y)) == 1) if len(x) == len(y) else any(y[:k] + y[k + 1:] == x for k in range(len(y)))
        assert ok == want


# ------------------------------------------------------------------ quality
def test_quality_held_out(spark):
    docs, labels = table(spark, "/root/testdata/sf0.1", "documents"), table(spark, "/root/testdata/sf0.1", "labels")
    got = quality.score(docs.select("doc_id", "text"), quality.fit(docs, labels))
    marked = got.filter(quality.held_out(F.col("doc_id"))).join(labels, "doc_id").select("quality", (F.col("score") >= 0.3).alias("kept")).collect()
    clean, junk = [r["kept"] for r in marked if r["quality"] == 1], [r["kept"] for r in marked if r["quality"] == 0]
    assert len(junk) > 50 and 1 - sum(junk) / len(junk) >= 0.95 and sum(clean) / len(clean) >= 0.99


def test_quality_query(spark):
    got = query(spark, "op13_quality").collect()
    assert len(got) == table(spark, SF_SMALL, "documents").count()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)


def test_quality_votes_are_those_of_all_rows(spark):
    """The blocked products against one loop over all training rows."""
    docs, labels = table(spark, SF_SMALL, "documents"), table(spark, SF_SMALL, "labels")
    model = quality.fit(docs, labels, dim=8)
    texts = [(t or "").encode() for _, t in rows_of(spark)]
    got = quality.score_texts(model)(texts)
    terms = quality.Terms()
    for text, score in zip(texts, got.tolist()):
        counts = terms.counts(text)
        if not counts.sum():
            assert score == model.share
            continue
        x = np.sqrt(counts / counts.sum()) @ model.projection.astype(float)
        x = x / (np.sqrt(x @ x) or 1)
        near = sorted(((float(x @ v), i) for i, v in enumerate(model.vectors.astype(float))), reverse=True)[:quality.NEIGHBOURS]
        votes = sum(max(s, 0) ** quality.POWER * model.votes[i] for s, i in near)
        assert abs(score - votes[1] / votes.sum()) < 1e-3


def test_quality_counts_do_not_depend_on_segments(monkeypatch):
    text = "One two TWO two!! 99 né É | | x*** one one\n" * 50
    whole = quality.Terms().counts(text.encode())
    assert list(quality.segments(text.encode(), 7)) and whole.sum() == 3 * 600 + 599 - 600 + 599
    pieces = quality.segments
    monkeypatch.setattr(quality, "segments", lambda t: pieces(t, 13))
    assert (quality.Terms().counts(text.encode()) == whole).all()


def test_quality_edges(spark):
    df, rows = odd(spark)
    df = df.drop("score")
    labels = spark.createDataFrame([(i, i % 2) for i in range(3, 17)] + [(None, 1), (5, 7), (900, 0)], "doc_id bigint, quality int")
    scored = quality.score(df, quality.fit(df, labels))
    assert scored.columns == [*df.columns, "score"] and scored.count() == len(rows)
    assert all(0 <= r["score"] <= 1 for r in scored.select("score").collect())
    again = {(r["doc_id"], r["text"]): set() for r in scored.collect()}
    for r in scored.collect():
        again[r["doc_id"], r["text"]].add(r["score"])
    assert all(len(v) == 1 for v in again.values())
    one = quality.fit(df, labels.filter("quality = 1"))
    assert set(quality.score(df, one).select("score").distinct().toPandas()["score"]) == {1 - 1e-9}
    none = quality.fit(df, labels.limit(0))
    assert set(quality.score(df, none).select("score").distinct().toPandas()["score"]) == {0.5}
    assert quality.score(empty(spark), none).count() == 0


def test_schema_of_the_queries(spark):
    assert SCHEMA.startswith("doc_id")
    assert query(spark, "op12_spelling").columns == ["word", "form", "root", "n", "n_near", "form_n"]
