"""Connected components of a link table, without collecting links or labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairspark.llm.tables import stored


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, root`` for every node of a link; the root is the least node of its component.

    Alternating large and small stars: each round hangs a node's neighbours on the least of them, so
    long chains shrink by about half. Rounds end when the edges stop changing. Each round is written,
    so that a lost executor does not repeat earlier ones. Only minima are grouped, never neighbour
    lists, so a node with very many links is combined before the shuffle.
    """

    def least(edges: DataFrame) -> DataFrame:
        """Per ``u`` the least of its partners and itself."""
        return edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("mu"), F.least("u", "m").alias("m"))

    def attach(edges: DataFrame) -> DataFrame:
        return edges.join(least(edges), F.col("u") == F.col("mu")).drop("mu")

    edges = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    edges = stored(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = attach(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        linked = attach(large)
        small = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        small = small.unionByName(linked.select("u", F.col("m").alias("v"))).distinct()
        edges = stored(small, "edges")
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if now == mark:
            break
        mark = now
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
