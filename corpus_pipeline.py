"""From raw documents to packed sequences: rules, near copies, test passages, personal data, packing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fairspark.llm import decontamination, ngram_join, packing, pii, quality
from fairspark.llm.queries import SURROGATE_KEY, tokenizer_path
from fairspark.llm.tables import stored, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the adaptive rules keep; null, empty and short texts go, repeated rows are judged alike."""
    return quality.keep_documents(docs)


def _digest() -> Column:
    return F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the least id, without one the least digest.

    A row is told by its id and the digest of its text, so several texts under one id, and texts without
    an id, are documents of their own; a row that repeats both is a copy. Texts without words (null texts
    too) are in no group; of those under one id, or without one, one stays. An empty table stays empty.
    """
    key = F.struct(F.col("doc_id").isNull().alias("unnamed"), F.col("doc_id"), _digest().alias("digest"))
    keyed = docs.withColumn("__key", key)
    linked = ngram_join.link_documents(keyed.select("__key", "text"), id_col="__key")
    heads = stored(linked.where(F.col("__key") == F.col("component_id")).select(F.col("__key").alias("__head")).distinct(), "heads")
    kept = keyed.join(heads, F.col("__key") == F.col("__head"), "left_semi")
    return kept.dropDuplicates(["__key"]).drop("__key")


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark.

    A leak belongs to a text, not to an id: rows with that text go, others under the same id or without one
    stay. Null and empty texts hold nothing and stay, repeated rows too; an empty table stays empty.
    """
    keyed = docs.withColumn("__text_key", _digest())
    leaks = decontamination.find_leaks(keyed.select("__text_key", "text"), table(spark, sf_dir, "benchmark"), id_col="__text_key")
    leaked = stored(leaks.select(F.col("__text_key").alias("__leak")).distinct(), "leaks")
    return keyed.join(leaked, F.col("__text_key") == F.col("__leak"), "left_anti").drop("__text_key")


def pii_surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with personal data replaced; ``n_chars`` follows the new text. Null texts stay null, repeated rows stay."""
    replaced = pii.replace_pii(docs, SURROGATE_KEY).select("doc.*")
    return replaced.withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their token ids, dealt into sequences; a null or empty text is its end id."""
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_decontamination),
    ("PII surrogates", pii_surrogates),
    ("packing", pack_sequences),
]

#: Sketches, tiling, keyed draws and a tokenizer have no SQL; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again by the next one."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, "stage")
    return docs
