"""Micro-batch plumbing: file sources, foreachBatch runs and per-batch state tables.

State that has to survive between batches is a small table written per batch id into
the shared folder. A batch that is retried after a failure overwrites its own output
and its own state, so the effect is exactly once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Process = Callable[[DataFrame, int], None]


def run_available(spark: SparkSession, source: str, schema: T.StructType, process: Process, checkpoint: str) -> None:
    """Process everything new below ``source`` and stop; repeat calls continue."""
    stream = spark.readStream.schema(schema).parquet(source)
    query = (
        stream.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()


def replay(df: DataFrame, order_col: str, source: str, n_batches: int, after_each: Callable[[], None]) -> None:
    """Append a table to ``source`` in order, in ``n_batches`` parts, as if it arrived."""
    low, high = df.agg(F.min(order_col), F.max(order_col)).first()
    if low is None:
        return
    step = (high - low) / n_batches
    for i in range(n_batches):
        part = df.where(F.col(order_col) >= F.lit(low + i * step)) if i else df
        if i < n_batches - 1:
            part = part.where(F.col(order_col) < F.lit(low + (i + 1) * step))
        part.write.mode("append").parquet(source)
        after_each()


def state_path(root: str, batch_id: int) -> str:
    return f"{root}/state/{batch_id:010d}"


def output_path(root: str, batch_id: int) -> str:
    return f"{root}/out/batch={batch_id}"


def late_path(root: str, batch_id: int) -> str:
    return f"{root}/late/batch={batch_id}"


def read_state(spark: SparkSession, root: str, batch_id: int) -> DataFrame | None:
    return spark.read.parquet(state_path(root, batch_id - 1)) if batch_id > 0 else None


def read_output(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(f"{root}/out")
