"""Corpus pipeline: five stages over ``documents``, each on all that its predecessor kept.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns
the columns of ``documents`` (the last one adds its weights). ``run`` writes each
stage's result as Parquet to the folder of ``spark.checkpoint.dir`` and reads it again
as the next one's input. The first stage learns from labels, which SQL cannot express,
so ``ORACLE_SQL`` is None; ``tests/llm/test_pipeline.py`` holds ``run`` and every stage
against plain versions.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabweave.core import table
from tabweave.llm import decontam, exact_dedup, mixing, simhash, toxicity
from tabweave.llm.common import free_name
from tabweave.session import ensure_checkpoint_dir

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model scores below the threshold stay."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    score = free_name("toxic_score", docs)
    return toxicity.score(docs, model, out=score).filter(F.col(score) < toxicity.THRESHOLD).select(*COLUMNS)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id stays."""
    return exact_dedup.exact_dedup(docs).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts linked by their fingerprints the row with the smallest id stays."""
    return simhash.simhash_dedup(docs).select(*COLUMNS)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go; shorter passages of test items are cut out of the others."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample of ``mixing.RATE`` of the tokens, weighted towards the target margins."""
    return mixing.mix_sample(docs).select(*COLUMNS)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("simhash_dedup", drop_near_copies),
    ("decontamination", drop_benchmark),
    ("mixing", mix),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for nth, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{nth}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
