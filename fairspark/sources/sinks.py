"""Result sinks: JSON reports and append-only audit tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def read_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)


def append_audit(results: DataFrame, path: str, dataset: str, model: str, run_id: str) -> None:
    """Append audit rows, partitioned by dataset. A run id makes repeated rows visible."""
    stamped = results.select("*", F.lit(model).alias("model_name"), F.lit(run_id).alias("run_id"), F.lit(dataset).alias("dataset_name"))
    stamped.write.mode("append").partitionBy("dataset_name").parquet(path)
