"""The pipeline and each of its stages against plain versions, with odd rows among the documents."""

import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tabweave.core import table
from tabweave.llm import mixing, toxicity

from ..conftest import SF_SMALL
from . import brute
from .test_contracts import SCHEMA

HELD_OUT = lambda doc: zlib.crc32(str(doc).encode()) % 4 == 2


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """The small tables, with null and repeated ids, repeated rows, empty texts and extra columns that clash."""
    path = tmp_path_factory.mktemp("tables")
    docs = table(spark, SF_SMALL, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    first = docs.orderBy("doc_id").first()
    rows = [(None, None, None, None, None), (None, "", "en", "s", 0), (None, "only here once, with no id", "en", None, 5),
            (first["doc_id"], first["text"], "en", "other", 1), (first["doc_id"], "another text of the same id", "de", "s", 9),
            (90_001, "ONLY HERE ONCE, WITH NO ID", "en", "s", 3), (90_002, "", "fr", "s", 0)]
    odd = docs.unionByName(spark.createDataFrame(rows, SCHEMA))
    for name in ("toxic_score", "row", "kept", "spans", "key"):
        odd = odd.withColumn(name, F.lit("z"))
    odd.repartition(3).write.parquet(f"{path}/documents.parquet")
    for name in ("labels", "benchmark"):
        table(spark, SF_SMALL, name).write.parquet(f"{path}/{name}.parquet")
    return str(path)


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def same(got, want):
    return sorted(got, key=repr) == sorted(want, key=repr)


def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "simhash_dedup", "decontamination", "mixing"]


def test_every_stage_and_the_whole(spark, folder):
    docs = table(spark, folder, "documents")
    rows = pairs(docs)
    stage = dict(corpus_pipeline.STAGES)
    labels = {r["doc_id"]: r["toxic"] for r in table(spark, folder, "labels").collect()}

    score = brute.ftrl_scores(rows, labels, HELD_OUT)
    want = [r for i, r in enumerate(rows) if score[i] < toxicity.THRESHOLD]
    after = stage["toxicity"](spark, docs, folder).checkpoint()
    assert after.columns == list(corpus_pipeline.COLUMNS) and same(pairs(after), want)
    assert len(want) < len(rows)

    groups = {}
    for doc, text in want:
        groups.setdefault((text or "").translate(brute.LOWER), []).append((doc, text))
    got = stage["exact_dedup"](spark, after, folder).checkpoint()
    for doc, text in pairs(got):
        mine = groups.pop((text or "").translate(brute.LOWER))  # one row of each group, with the largest id
        assert doc == max((d for d, _ in mine if d is not None), default=None)
    assert not groups
    after, want = got, pairs(got)

    groups = {}
    for (doc, _), (_, _, c) in zip(want, brute.simhash_classes([(i, text) for i, (_, text) in enumerate(want)])):
        groups.setdefault(c, []).append(doc)
    got = stage["simhash_dedup"](spark, after, folder).checkpoint()
    # one row of each component, with its smallest id
    stay = [min((d for d in ids if d is not None), default=None) for ids in groups.values()]
    assert sorted((doc for doc, _ in pairs(got)), key=repr) == sorted(stay, key=repr) and set(pairs(got)) <= set(want)
    after, want = got, pairs(got)

    items = [(str(r["item_id"]), r["text"]) for r in table(spark, folder, "benchmark").collect()]
    judged = dict(zip(map(repr, want), brute.decontaminate(want, items)))
    got = stage["decontamination"](spark, after, folder).checkpoint()
    clean = {repr(r): j for r, j in judged.items() if not j[5]}
    assert sorted((r["doc_id"] for r in got.collect()), key=repr) == sorted((j[0] for j in clean.values()), key=repr)
    by_id = {}
    for r in want:
        by_id.setdefault(r[0], []).append(judged[repr(r)])
    for r in got.collect():
        words = len(brute.WORD.findall((r["text"] or "").translate(brute.LOWER)))
        assert any(words == j[1] - j[2] for j in by_id[r["doc_id"]])  # what was hit is gone, the rest is there
        if words and not any(j[2] for j in by_id[r["doc_id"]]):
            assert (r["doc_id"], r["text"]) in want
    after = got

    got = stage["mixing"](spark, after, folder)
    with duckdb.connect() as con:
        documents = after.toPandas()  # noqa: F841  read by the SQL
        kept = con.execute(f"SELECT doc_id FROM ({mixing.ORACLE}) WHERE kept").fetchall()
    want = [None if k[0] is None or k[0] != k[0] else int(k[0]) for k in kept]
    assert sorted((r["doc_id"] for r in got.collect()), key=repr) == sorted(want, key=repr)

    whole = corpus_pipeline.run(spark, folder)
    assert whole.columns == list(corpus_pipeline.COLUMNS) and same(pairs(whole), pairs(got))


def test_empty_documents(spark, folder, tmp_path):
    table(spark, folder, "documents").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("labels", "benchmark"):
        table(spark, folder, name).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_toxicity_scores_are_those_of_a_plain_version(spark):
    docs, labels = table(spark, SF_SMALL, "documents"), table(spark, SF_SMALL, "labels")
    rows = pairs(docs)
    want = brute.ftrl_scores(rows, {r["doc_id"]: r["toxic"] for r in labels.collect()}, HELD_OUT)
    got = {r["doc_id"]: r["p"] for r in toxicity.score(docs, toxicity.fit(docs, labels), out="p").collect()}
    assert all(abs(got[doc] - want[i]) < 1e-4 for i, (doc, _) in enumerate(rows))
