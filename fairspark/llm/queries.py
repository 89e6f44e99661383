"""The registered queries of this package, one per operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fairspark.llm import collocations, decontamination, divergence, language, ngram_join, packing, pii, quality, scoring, secrets, sharding, token_counts, toxicity
from fairspark.llm.tables import id_remainder, table


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file on driver and executors."""
    import public_tokenizers

    return public_tokenizers.path(name)


#: Key of the registered query's surrogates. A production run passes its own secret.
SURROGATE_KEY = "registered-query"


def op1_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    replaced = pii.replace_pii(table(spark, sf_dir, "documents"), SURROGATE_KEY)
    return replaced.select("doc.doc_id", "doc.text", F.size("found").alias("n_replaced"), "found")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), digest=True)
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.score_texts(table(spark, sf_dir, "documents"), id_remainder(F.col("doc_id"), 7) == 2)


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents"), 8)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    base = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    return judged.select("doc.doc_id", *[f"m.{c}" for c in base], "kept")


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.link_documents(table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = id_remainder(F.col("doc_id"), 3) == 1
    model = language.fit(docs.where(~held_out), order=F.col("doc_id"))
    found = language.predict(docs, model, carry={"held_out": held_out})
    return found.select("doc_id", "held_out", "lang_pred", "score")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = id_remainder(F.col("doc_id"), 5) == 0
    index = toxicity.fit(docs, labels.where(~held_out))
    scored = toxicity.score_documents(docs, index, carry={"held_out": held_out})
    return scored.select("doc_id", "held_out", "score", "predicted", "neighbours")


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(table(spark, sf_dir, "documents"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii_surrogates": op1_pii_surrogates,
    "op2_packing": op2_packing,
    "op3_lm_scoring": op3_lm_scoring,
    "op4_sharding": op4_sharding,
    "op5_decontamination": op5_decontamination,
    "op6_token_counts": op6_token_counts,
    "op7_quality_rules": op7_quality_rules,
    "op8_ngram_join": op8_ngram_join,
    "op9_language_id": op9_language_id,
    "op10_toxicity": op10_toxicity,
    "op11_secret_scan": op11_secret_scan,
    "op12_collocations": op12_collocations,
    "op13_source_divergence": op13_source_divergence,
}

ORACLES: dict[str, str] = {
    "op4_sharding": sharding.SHARD_SQL,
    "op7_quality_rules": quality.QUALITY_SQL,
    "op12_collocations": collocations.COLLOCATION_SQL,
    "op13_source_divergence": divergence.DIVERGENCE_SQL,
}
