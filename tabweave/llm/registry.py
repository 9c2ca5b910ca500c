"""The registered queries of the operators: thin digests of their results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..core import table
from . import collocations, decontam, exact_dedup, html_text, mixing, pii, quality, secrets, simhash, spelling, suffix_dedup, token_count, toxicity

TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_suffix_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf, "documents")).drop("spans", "kept")


def op2_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    model = toxicity.fit(docs, table(spark, sf, "labels"))
    scored = toxicity.score(docs.select("doc_id", "text"), model, out="score")
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op3_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf, "documents"))


def op4_secrets(spark: SparkSession, sf: str) -> DataFrame:
    return secrets.find_secrets(table(spark, sf, "documents")).drop("matches")


def op5_html_text(spark: SparkSession, sf: str) -> DataFrame:
    return html_text.extract_text(table(spark, sf, "pages"))


def op6_decontaminate(spark: SparkSession, sf: str) -> DataFrame:
    found = decontam.match_items(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), "items_sha256",
                        "contaminated")


def op7_pii(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return pii.find_spans(docs, pii.fit(docs))


def op8_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    return token_count.count_tokens(table(spark, sf, "documents"), tokenizer_path())


def op9_mixing(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix_weights(table(spark, sf, "documents")).withColumns(
        {c: F.round(c, 6) for c in ("weight", "margin_gap", "probability")})


def op10_simhash(spark: SparkSession, sf: str) -> DataFrame:
    return simhash.simhash_classes(table(spark, sf, "documents"))


def op11_collocations(spark: SparkSession, sf: str) -> DataFrame:
    return collocations.collocations(table(spark, sf, "documents"))


def op12_spelling(spark: SparkSession, sf: str) -> DataFrame:
    return spelling.spelling_groups(table(spark, sf, "documents"))


def op13_quality(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    model = quality.fit(docs, table(spark, sf, "labels"))
    scored = quality.score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


QUERIES = {
    "op1_suffix_dedup": (op1_suffix_dedup, suffix_dedup.ORACLE),
    "op2_toxicity": (op2_toxicity, None),
    "op3_exact_dedup": (op3_exact_dedup, exact_dedup.ORACLE),
    "op4_secrets": (op4_secrets, None),
    "op5_html_text": (op5_html_text, None),
    "op6_decontaminate": (op6_decontaminate, decontam.ORACLE),
    "op7_pii": (op7_pii, None),
    "op8_token_counts": (op8_token_counts, None),
    "op9_mixing": (op9_mixing, mixing.ORACLE),
    "op10_simhash": (op10_simhash, None),
    "op11_collocations": (op11_collocations, collocations.ORACLE),
    "op12_spelling": (op12_spelling, None),
    "op13_quality": (op13_quality, None),
}
