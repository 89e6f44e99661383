"""Reading the test tables, written intermediates, and shared column rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fairspark.session import stored  # noqa: F401

#: White space of every word rule: space, tab, line feed, vertical tab, form feed, carriage return.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
BREAK_PATTERN = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_remainder(doc_id: Column, divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor``; null ids count as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(divisor))


def prefixed(df: DataFrame, prefix: str) -> DataFrame:
    """All columns renamed, so that joins never meet a caller's column names."""
    return df.select(*[F.col(f"`{c}`").alias(f"{prefix}{c}") for c in df.columns])
