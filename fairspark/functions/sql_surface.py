"""The scalar and table functions as SQL functions of a session.

They are SQL-bodied temporary functions, so the optimizer inlines them; nothing runs
row by row in Python. Table functions expand one row into several and are used with
``LATERAL``.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

DOT = "aggregate(zip_with({0}, {1}, (x, y) -> x * y), 0D, (s, x) -> s + x)"

FUNCTIONS = {
    "fs_sigmoid": "(x DOUBLE) RETURNS DOUBLE RETURN CASE WHEN x >= 0 THEN 1 / (1 + exp(-x)) ELSE exp(x) / (1 + exp(x)) END",
    "fs_safe_ratio": "(num DOUBLE, den DOUBLE) RETURNS DOUBLE RETURN CASE WHEN den <> 0 THEN num / den ELSE 0D END",
    "fs_cosine_distance": "(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE RETURN CASE WHEN size(a) = size(b) THEN 1 - "
    + DOT.format("a", "b")
    + " / greatest(sqrt("
    + DOT.format("a", "a")
    + ") * sqrt("
    + DOT.format("b", "b")
    + "), 1e-10D) END",
    "fs_bias_level": "(d DOUBLE) RETURNS STRING RETURN CASE WHEN d > 1.0D THEN 'severe' WHEN d > 0.6D THEN 'high' WHEN d > 0.3D THEN 'medium'"
    " WHEN d > 0.1D THEN 'low' ELSE 'none' END",
    "fs_bias_score": "(d DOUBLE) RETURNS DOUBLE RETURN bround(100 / (1 + exp(-6D * (d - 0.5D))), 2)",
    "fs_window_ids": "(rn BIGINT, size INT, stride INT) RETURNS TABLE (window_id BIGINT)"
    " RETURN SELECT explode(sequence(greatest(0L, floor((rn - 1 - size) / stride) + 1), floor((rn - 1) / stride)))",
    "fs_steps": "(n INT) RETURNS TABLE (step INT, share DOUBLE) RETURN SELECT s, s / CAST(n AS DOUBLE) FROM (SELECT explode(sequence(0, n)) AS s)",
    "fs_variants": "(n INT) RETURNS TABLE (sample INT) RETURN SELECT explode(sequence(1, n))",
}


def register(spark: SparkSession) -> None:
    for name, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")
