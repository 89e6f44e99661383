"""A reference distribution written once in order, and batches that look only their own values up in it."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fairspark.functions.ordering import next_in_order, running_sums, split_points
from fairspark.operators import drift as dr
from fairspark.session import materialise

#: Distinct values of a block, and blocks of a folder. A lookup reads folders, and in them the blocks it needs.
VALUES_PER_BLOCK = 1_000
BLOCKS_PER_PART = 256
#: Shares of a feature's lookups, so that a feature which fills a batch is searched by several tasks.
SHARES = 16


def write_reference(ref: DataFrame, path: str, values_per_block: int = VALUES_PER_BLOCK, blocks_per_part: int = BLOCKS_PER_PART) -> None:
    """Write ``ref(feature, value)`` as ``blocks``, ``directory`` and ``totals`` below ``path``.

    A block is one row: its ascending distinct values, how many rows of the feature lie at or below each,
    and the primitive of the CDF there. The directory names the blocks' first values and ranks.
    """
    clean = ref.where(F.col("value").isNotNull()).select("feature", F.col("value").cast("double").alias("value"))
    counts = materialise(clean.groupBy("feature", "value").agg(F.count("*").alias("cnt")))
    points = split_points(counts, "value")
    ranked = running_sums(counts, ["feature"], ["value"], {"cum": F.col("cnt"), "place": F.lit(1).cast("bigint")}, points)
    chained = next_in_order(ranked, ["feature"], "value", "next_value", points)
    totals = materialise(
        clean.groupBy("feature").agg(
            F.count("*").alias("n_ref"), F.avg("value").alias("mu"), F.greatest(F.stddev_pop("value"), F.lit(dr.STD_FLOOR)).alias("sd"), F.max("value").alias("ref_max")
        )
    )
    step = F.coalesce(F.col("next_value") - F.col("value"), F.lit(0.0)) * F.col("cum") / F.col("n_ref")
    area = running_sums(chained.join(totals.select("feature", "n_ref"), "feature").withColumn("piece", step), ["feature"], ["value"], {"A_next": F.col("piece")}, points)
    block = F.floor((F.col("place") - 1) / values_per_block).cast("bigint")
    rows = area.select("feature", block.alias("block"), F.struct("value", "cum", (F.col("A_next") - F.col("piece")).alias("A")).alias("v"), "cnt")
    blocks = rows.groupBy("feature", "block").agg(F.sort_array(F.collect_list("v")).alias("v"), F.sum("cnt").alias("rows"))
    blocks = blocks.select(
        "feature",
        F.floor(F.col("block") / blocks_per_part).cast("bigint").alias("part"),
        "block",
        "rows",
        F.transform("v", lambda x: x["value"]).alias("value"),
        F.transform("v", lambda x: x["cum"]).alias("cum"),
        F.transform("v", lambda x: x["A"]).alias("A"),
    )
    blocks.repartition("feature", "part").sortWithinPartitions("feature", "part", "block").write.partitionBy("feature", "part").parquet(f"{path}/blocks")
    written = ref.sparkSession.read.schema(blocks.schema).parquet(f"{path}/blocks")
    directory = written.select("feature", "part", "block", F.col("value")[0].alias("first"), F.element_at("cum", -1).alias("last_cum"))
    directory.write.parquet(f"{path}/directory")
    ends = directory.groupBy("feature").agg(F.max_by("part", "block").alias("part"), F.max("block").alias("block"))
    top = written.join(ends, ["feature", "part", "block"]).select("feature", F.element_at("A", -1).alias("A_max"))
    totals.join(top, "feature").withColumn("status", F.when(F.col("n_ref") >= dr.MIN_REFERENCE, "fitted").otherwise("insufficient")).write.parquet(f"{path}/totals")


def read_totals(spark: SparkSession, path: str) -> DataFrame:
    """One row per feature: rows, mean, deviation, greatest value, primitive there, status."""
    return spark.read.parquet(f"{path}/totals")


def _located(points: DataFrame, directory: DataFrame) -> DataFrame:
    """Block of each lookup ``feature, kind, x``: kind ``value`` by value, kind ``rank`` by rows at or below."""
    shared = points.withColumn("share", F.pmod(F.xxhash64("x", "kind"), F.lit(SHARES)))
    spread = directory.withColumn("share", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SHARES - 1).cast("bigint"))))

    def search(mine: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
        if not len(mine) or not len(blocks):
            return mine.iloc[:0][["feature", "kind", "x"]].assign(part=np.zeros(0, np.int64), block=np.zeros(0, np.int64))
        blocks = blocks.sort_values("block")
        x, by_rank = mine["x"].to_numpy(), (mine["kind"] == "rank").to_numpy()
        at = np.where(
            by_rank,
            np.searchsorted(blocks["last_cum"].to_numpy(), x, side="left"),
            np.searchsorted(blocks["first"].to_numpy(), x, side="right") - 1,
        )
        at = np.clip(at, 0, len(blocks) - 1)
        return pd.DataFrame({"feature": mine["feature"], "kind": mine["kind"], "x": x, "part": blocks["part"].to_numpy()[at], "block": blocks["block"].to_numpy()[at]})

    return shared.groupBy("feature", "share").cogroup(spread.groupBy("feature", "share")).applyInPandas(search, "feature string, kind string, x double, part bigint, block bigint")


def blocks_for(spark: SparkSession, path: str, located: DataFrame) -> DataFrame:
    """The blocks that the lookups need; folders without any are never listed or read.

    The driver receives the numbers of the folders in use, of which a feature has one per
    ``VALUES_PER_BLOCK * BLOCKS_PER_PART`` distinct values.
    """
    needed: dict[str, list[int]] = {}
    for r in located.select("feature", "part").distinct().collect():
        needed.setdefault(r["feature"], []).append(r["part"])
    keep = F.lit(False)
    for feature, parts in sorted(needed.items()):
        keep = keep | ((F.col("feature") == feature) & F.col("part").isin(sorted(parts)))
    blocks = spark.read.schema("feature string, part bigint, block bigint, rows bigint, value array<double>, cum array<bigint>, A array<double>").parquet(f"{path}/blocks")
    return blocks.where(keep).join(located.select("feature", "part", "block").distinct(), ["feature", "part", "block"], "left_semi")


def look_up(spark: SparkSession, path: str, points: DataFrame) -> DataFrame:
    """``feature, kind, x, found, below, upto, A`` of each lookup.

    For a value: the reference rows below it and up to it, and the primitive of the CDF there. For a rank:
    the value ``found`` at which so many rows are reached, and the primitive there. Values outside the
    reference are answered from its ends.
    """
    located = materialise(_located(points, spark.read.parquet(f"{path}/directory")))
    share = F.pmod(F.xxhash64("x", "kind"), F.lit(SHARES))
    asked = located.groupBy("feature", "part", "block", share.alias("share")).agg(F.collect_list(F.struct("kind", "x")).alias("asked"))
    rows = asked.join(blocks_for(spark, path, located), ["feature", "part", "block"]).join(read_totals(spark, path).select("feature", "n_ref"), "feature")

    def answer(batches):
        for pdf in batches:
            out = []
            for feature, n, asked, value, cum, area in zip(pdf["feature"], pdf["n_ref"], pdf["asked"], pdf["value"], pdf["cum"], pdf["A"]):
                value, cum, area = np.asarray(value, float), np.asarray(cum, np.int64), np.asarray(area, float)
                kind = np.array([a["kind"] for a in asked])
                x = np.array([a["x"] for a in asked], dtype=float)
                by_rank = kind == "rank"
                at = np.clip(np.where(by_rank, np.searchsorted(cum, x, side="left"), np.searchsorted(value, x, side="right") - 1), -1, len(value) - 1)
                inside = np.maximum(at, 0)
                # Before a feature's first value nothing has been reached and the primitive is 0.
                upto = np.where(at < 0, 0, cum[inside])
                equal = (at >= 0) & (value[inside] == x)
                # Rows before this block come from the first value's own count, which the block cannot tell: use its neighbour.
                before = np.where(inside > 0, cum[inside - 1], -1)
                primitive = np.where(at < 0, 0.0, area[inside] + np.where(by_rank, 0.0, x - value[inside]) * cum[inside] / n)
                out.append(pd.DataFrame({"feature": feature, "kind": kind, "x": x, "found": np.where(by_rank, value[inside], x), "below": np.where(equal, before, upto), "upto": upto, "A": primitive}))
            if out:
                yield pd.concat(out, ignore_index=True)

    answered = rows.select("feature", "n_ref", "asked", "value", "cum", "A").mapInPandas(
        answer, "feature string, kind string, x double, found double, below bigint, upto bigint, A double"
    )
    # A value that opens its block takes the count of the block before it.
    previous = spark.read.parquet(f"{path}/directory").select("feature", F.col("first").alias("x"), "block", "last_cum")
    ahead = previous.select("feature", (F.col("block") + 1).alias("block"), F.col("last_cum").alias("before"))
    openers = previous.select("feature", "x", "block").join(ahead, ["feature", "block"], "left").select("feature", "x", F.coalesce("before", F.lit(0)).alias("before"))
    open_ = answered.where("below < 0").join(openers, ["feature", "x"]).withColumn("below", F.col("before")).drop("before")
    return answered.where("below >= 0").unionByName(open_)


def distances_to_reference(spark: SparkSession, path: str, batch: DataFrame) -> DataFrame:
    """Wasserstein-1 and Kolmogorov-Smirnov of a batch ``feature, value`` against the stored reference.

    Between neighbouring values the batch's CDF is a constant c while the reference rises, so the integral
    of the difference needs the primitive at the values and at the reference's c-quantile. Work and reads
    follow the batch's distinct values: at most two blocks each, whatever the reference holds. A feature
    that the reference lacks has null distances; one that the batch lacks has no row.
    """
    counts = materialise(batch.where(F.col("value").isNotNull()).groupBy("feature", F.col("value").cast("double").alias("value")).agg(F.count("*").alias("cnt")))
    points = split_points(counts, "value")
    ranked = running_sums(counts, ["feature"], ["value"], {"cum": F.col("cnt")}, points)
    chained = next_in_order(ranked, ["feature"], "value", "next_value", points)
    sizes = counts.groupBy("feature").agg(F.sum("cnt").alias("n_new"))
    totals = read_totals(spark, path).select("feature", "n_ref", "ref_max", "A_max")
    rows = materialise(
        chained.join(sizes, "feature").join(totals, "feature").select("*", F.ceil(F.col("cum") * F.col("n_ref") / F.col("n_new")).cast("double").alias("rank"))
    )
    asked = rows.select("feature", F.lit("value").alias("kind"), F.col("value").alias("x")).unionByName(
        rows.where("next_value IS NOT NULL").select("feature", F.lit("rank").alias("kind"), F.col("rank").alias("x")).distinct()
    )
    answers = materialise(look_up(spark, path, asked))
    at = answers.where("kind = 'value'").select("feature", F.col("x").alias("value"), "below", "upto", "A")
    following = at.select("feature", F.col("value").alias("next_value"), F.col("below").alias("next_below"), F.col("A").alias("next_A"))
    quantile = answers.where("kind = 'rank'").select("feature", F.col("x").alias("rank"), F.col("found").alias("qv"), F.col("A").alias("qA"))
    joined = rows.join(at, ["feature", "value"]).join(following, ["feature", "next_value"], "left").join(quantile, ["feature", "rank"], "left")
    c = F.col("cum") / F.col("n_new")
    q = F.least(F.greatest("qv", "value"), "next_value")
    qa = F.when(F.col("qv") <= F.col("value"), F.col("A")).when(F.col("qv") >= F.col("next_value"), F.col("next_A")).otherwise(F.col("qA"))
    middle = (c * (q - F.col("value")) - (qa - F.col("A"))) + ((F.col("next_A") - qa) - c * (F.col("next_value") - q))
    first = F.when(F.col("cum") == F.col("cnt"), F.col("A")).otherwise(F.lit(0.0))
    tail = F.greatest(F.lit(0.0), F.col("ref_max") - F.col("value")) - F.greatest(F.lit(0.0), F.col("A_max") - F.col("A"))
    last = F.when(F.col("next_value").isNull() & (F.col("ref_max") > F.col("value")), tail).otherwise(F.lit(0.0))
    before = (F.col("cum") - F.col("cnt")) / F.col("n_new")
    gap = F.greatest(
        F.abs(F.col("upto") / F.col("n_ref") - c),
        F.abs(F.col("below") / F.col("n_ref") - before),
    )
    agg = joined.groupBy("feature").agg(F.max("n_ref").alias("n_ref"), F.sum(F.coalesce(middle, F.lit(0.0)) + first + last).alias("w1"), F.max(gap).alias("ks_statistic"))
    every = sizes.join(agg, "feature", "left")
    return every.withColumn("ks_p", dr.kolmogorov_p(F.col("ks_statistic"), F.col("n_ref"), F.col("n_new")))
