"""Text-bias audit: framed prompts, hashed embeddings, cosine distances and their summary."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairspark.functions.numeric import count_if, ladder_label, r6
from fairspark.functions.ordering import attach_row, exact_quantiles, hash_key
from fairspark.functions.permutation import coefficients, labels, permutation_cuts
from fairspark.functions.vectors import NORM_FLOOR, cosine_distance, cosine_similarity, l2_normalise
from fairspark.operators.prompts import CONTEXTS, DEMOGRAPHICS, PROFESSIONS, STEREOTYPES, TEMPLATES
from fairspark.session import materialise

LEVELS = [(1.0, "severe"), (0.6, "high"), (0.3, "medium"), (0.1, "low")]
LEVEL_NAMES = ["none", "low", "medium", "high", "severe"]
TIE_MARGIN = 2.0


# Prompts -------------------------------------------------------------------------


def _strings(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _pick(n: Column | int, *parts: Column) -> Column:
    """Reproducible index below ``n`` from the md5 of the parts."""
    number = F.conv(F.substring(hash_key(*parts), 1, 8), 16, 10).cast("bigint")
    return F.pmod(number, F.lit(n) if isinstance(n, int) else n)


def fill_template(template: Column, demographic: Column, profession: Column) -> Column:
    return F.replace(F.replace(template, F.lit("{demographic}"), demographic), F.lit("{profession}"), profession)


def _demographics_of(category: Column) -> Column:
    return F.create_map(*[x for k, v in DEMOGRAPHICS.items() for x in (F.lit(k), _strings(v))])[category]


def prompt_pairs(
    df: DataFrame,
    id_col: str,
    category: Column | None = None,
    template: Column | None = None,
    profession: Column | None = None,
    seed: int = 42,
) -> DataFrame:
    """One pair of prompts per input row that differ only in the demographic.

    Whatever the caller leaves out is drawn from the fixed lists by the hash of the
    row id and the seed; the two demographics are always different.
    """
    s, key = F.lit(seed), F.col(id_col)
    cats = _strings(list(DEMOGRAPHICS))
    staged = df.select(
        F.col(id_col),
        (category if category is not None else cats[_pick(len(DEMOGRAPHICS), key, s, F.lit("category"))]).alias("category"),
        (template if template is not None else _strings(TEMPLATES)[_pick(len(TEMPLATES), key, s, F.lit("template"))]).alias("template"),
        (profession if profession is not None else _strings(PROFESSIONS)[_pick(len(PROFESSIONS), key, s, F.lit("profession"))]).alias("profession"),
    ).withColumn("demos", _demographics_of(F.col("category")))
    first = _pick(F.size("demos"), key, s, F.lit("first"))
    gap = 1 + _pick(F.size("demos") - 1, key, s, F.lit("second"))
    chosen = staged.withColumn("i", first).withColumn("j", F.pmod(F.col("i") + gap, F.size("demos")))
    a, b = F.col("demos")[F.col("i")], F.col("demos")[F.col("j")]
    return chosen.select(
        id_col, "category", "template", "profession", a.alias("demographic_a"), b.alias("demographic_b"),
        fill_template(F.col("template"), a, F.col("profession")).alias("prompt_a"),
        fill_template(F.col("template"), b, F.col("profession")).alias("prompt_b"),
    )


def stereotype_pairs(df: DataFrame, id_col: str, per_category: int = 0) -> DataFrame:
    """The built-in stereotype / anti-stereotype sentences for every row (0 = all of them)."""
    rows = [
        F.struct(F.lit(c).alias("category"), F.lit(i).alias("position"), F.lit(a).alias("prompt_a"), F.lit(b).alias("prompt_b"))
        for c, pairs in STEREOTYPES.items()
        for i, (a, b) in enumerate(pairs)
        if per_category <= 0 or i < per_category
    ]
    return df.select(id_col, F.inline(F.array(*rows)))


def audit_set(df: DataFrame, id_col: str, templates_per_category: int = 3, stereotypes_per_category: int = 0, seed: int = 42) -> DataFrame:
    """The whole prompt set of each audited subject: sampled templates per category plus
    the stereotype sentences. Templates are the first by md5 of (subject, category, seed)."""
    key = F.col(id_col)
    spread = df.select(id_col, F.explode(_strings(list(DEMOGRAPHICS))).alias("category"))
    ranked = F.sort_array(
        F.transform(_strings(TEMPLATES), lambda t: F.struct(hash_key(key, F.col("category"), F.lit(seed), t).alias("h"), t.alias("t")))
    )
    sampled = spread.select(id_col, "category", F.explode(F.slice(ranked, 1, templates_per_category)).alias("pick"))
    asked = sampled.select(
        id_col, "category", F.col("pick.t").alias("template"),
        F.concat_ws("/", key.cast("string"), F.col("category"), F.col("pick.t")).alias("request"),
    )
    framed = prompt_pairs(
        asked.withColumnRenamed(id_col, "subject"), "request", F.col("category"), F.col("template"), seed=seed
    ).withColumn(id_col, F.substring_index("request", "/", 1))
    templates = framed.select(id_col, "category", F.lit("template").alias("type"), "prompt_a", "prompt_b")
    fixed = stereotype_pairs(df, id_col, stereotypes_per_category).select(
        F.col(id_col).cast("string").alias(id_col), "category", F.lit("stereoset").alias("type"), "prompt_a", "prompt_b"
    )
    return templates.unionByName(fixed)


def frame_with_context(sentence: Column, demographic: Column, context: Column) -> Column:
    """Prefix by context type (unknown: neutral) with the demographic filled in."""
    prefixes = F.create_map(*[x for k, v in CONTEXTS.items() for x in (F.lit(k), F.lit(v))])
    prefix = F.coalesce(F.try_element_at(prefixes, F.lower(context)), F.lit(CONTEXTS["neutral"]))
    return F.concat(F.replace(prefix, F.lit("{demographic}"), demographic), sentence)


# Embeddings ----------------------------------------------------------------------


#: Bigrams that a task keeps, and those of one text that it takes at once.
MOST_BIGRAMS, BIGRAMS_PER_PASS = 100_000, 1 << 16


def _bigram_vector(text: str, dim: int, cache: dict) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    vec = np.zeros(dim)
    if len(codes) < 2:
        return vec
    # A text passes in parts, so memory does not follow its length.
    for lo in range(0, len(codes) - 1, BIGRAMS_PER_PASS):
        part = codes[lo : lo + BIGRAMS_PER_PASS + 1]
        pairs = part[:-1] << 21 | part[1:]
        distinct, inverse = np.unique(pairs, return_inverse=True)
        for p in distinct:
            if p not in cache:
                cache[p] = _bigram_steps(chr(p >> 21) + chr(p & 0x1FFFFF))
        steps = [cache[p] for p in distinct]
        at = (np.arange(lo, lo + len(pairs))[:, None] + np.array([s[0] for s in steps])[inverse]) % dim
        vec += np.bincount(at.ravel(), weights=np.array([s[1] for s in steps])[inverse].ravel(), minlength=dim)
    return vec


def _bigram_steps(bigram: str) -> tuple[list[int], list[float]]:
    import hashlib

    digits = hashlib.sha256(bigram.encode("utf-8", "surrogatepass")).hexdigest()[:8]
    return [ord(ch) for ch in digits], [(int(ch, 16) - 7.5) / 7.5 for ch in digits]


def hash_embedding(text: Column, dim: int = 384) -> Column:
    """Deterministic L2-normalised embedding: every character bigram of the whole text
    adds its first eight sha256 digits, centred, at positions shifted by its offset."""

    def unit(v: np.ndarray) -> np.ndarray:
        length = np.sqrt(v @ v)
        return v if length < NORM_FLOOR else v / length

    @F.arrow_udf("array<double>")
    def embed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        cache: dict = {}
        for batch in batches:
            out = np.empty((len(batch), dim))
            for i, t in enumerate(batch):
                if len(cache) > MOST_BIGRAMS:
                    cache.clear()
                out[i] = unit(_bigram_vector(t.as_py() or "", dim, cache))
            yield pa.ListArray.from_arrays(pa.array(np.arange(len(batch) + 1, dtype=np.int32) * dim), pa.array(out.ravel()))

    return embed(text)


def pool_embeddings(tokens: DataFrame, doc: str, pos: str, vector: str) -> DataFrame:
    """Mean, max and first-row pooling of token vectors per document, one row per dimension."""
    long = tokens.select(doc, pos, F.posexplode(vector).alias("dim", "v"))
    return long.groupBy(doc, "dim").agg(
        F.avg("v").alias("mean"), F.max("v").alias("max"), F.min_by("v", pos).alias("first")
    )


# Distances and scores ------------------------------------------------------------


def pair_distances(pairs: DataFrame, a: str = "emb_a", b: str = "emb_b") -> DataFrame:
    """Similarity and distance of aligned pairs; a length mismatch is a flagged row."""
    rest = [c for c in pairs.columns if c not in (a, b)]
    return pairs.select(
        *rest,
        cosine_similarity(F.col(a), F.col(b)).alias("similarity"),
        cosine_distance(F.col(a), F.col(b)).alias("distance"),
        (F.size(a) != F.size(b)).alias("length_mismatch"),
    )


def mean_cosine_matrix(df: DataFrame, group: str, vector: str) -> DataFrame:
    """Mean of the all-pairs cosine matrix between every two groups, without the pairs.

    The mean cosine of two groups is the dot product of their mean unit vectors, so one
    vector sum per group replaces the quadratic matrix; within a group the self pairs
    are taken out. The result has one row per pair of groups.
    """
    unit = df.select(group, F.posexplode(l2_normalise(F.col(vector).cast("array<double>"))).alias("dim", "v"))
    sums = unit.groupBy(group, "dim").agg(F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("ss"), F.count("*").alias("n"))
    other = sums.select(F.col(group).alias("group_b"), "dim", F.col("s").alias("s_b"), F.col("n").alias("n_b"))
    joined = sums.withColumnRenamed(group, "group_a").join(other, "dim").where(F.col("group_a") <= F.col("group_b"))
    dots = joined.groupBy("group_a", "group_b").agg(
        F.sum(F.col("s") * F.col("s_b")).alias("dot"), F.sum("ss").alias("self"), F.max("n").alias("n_a"), F.max("n_b").alias("n_b")
    )
    same = F.col("group_a") == F.col("group_b")
    n_pairs = F.when(same, F.col("n_a") * (F.col("n_a") - 1)).otherwise(F.col("n_a") * F.col("n_b"))
    total = F.when(same, F.col("dot") - F.col("self")).otherwise(F.col("dot"))
    return dots.select("group_a", "group_b", n_pairs.alias("n_pairs"), F.when(n_pairs > 0, total / n_pairs).alias("mean_cosine"))


def mean_difference_test(df: DataFrame, id_col: str, value: str, in_a: Column, n_perm: int = 1000, seed: int = 42) -> DataFrame:
    """Permutation p-value of the absolute mean difference of two samples, one row.

    Each task adds the values that a permutation puts into the first sample; only one
    number per permutation and partition leaves a task.
    """
    rows = df.where(F.col(value).isNotNull()).select(
        F.lit("all").alias("grp"), F.col(id_col).cast("bigint").alias("id"), F.col(value).cast("double").alias("value"), in_a.alias("in_a")
    )
    sizes = rows.groupBy("grp").agg(F.count("*").alias("n"), count_if(F.col("in_a")).alias("m"))
    cuts = permutation_cuts(rows.select("grp", "id"), sizes, n_perm, seed)
    coef = coefficients(n_perm, seed)

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(n_perm)
        for pdf in batches:
            total += pdf["value"].to_numpy() @ labels(pdf["id"].to_numpy(), coef, cuts["all"])
        yield pd.DataFrame({"perm": np.arange(n_perm, dtype=np.int32), "part": total})

    sums = rows.select("id", "value").mapInPandas(add, "perm int, part double").groupBy("perm").agg(F.sum("part").alias("sum_a"))
    whole = rows.agg(
        F.count("*").alias("n"), count_if(F.col("in_a")).alias("m"), F.sum("value").alias("total"),
        F.sum(F.when(F.col("in_a"), F.col("value"))).alias("obs_a"),
    )

    def difference(sum_a: Column) -> Column:
        return F.abs(F.try_divide(sum_a, F.col("m")) - F.try_divide(F.col("total") - sum_a, F.col("n") - F.col("m")))

    tested = attach_row(sums, whole).select(
        "n", "m", difference(F.col("obs_a")).alias("observed"), difference(F.col("sum_a")).alias("d")
    )
    hits = count_if(F.bround("d", 9) >= F.bround("observed", 9))
    return tested.agg(
        F.max("m").alias("n_a"), F.max(F.col("n") - F.col("m")).alias("n_b"), F.max("observed").alias("observed"),
        F.when(F.max("observed").isNotNull(), (hits + 1) / (F.count("*") + 1)).alias("p_value"),
    ).withColumn("significant", F.col("p_value") < 0.05)


def bias_level(distance: Column) -> Column:
    return ladder_label(distance, LEVELS, "none", strict=True)


def bias_score(distance: Column) -> Column:
    raw = 100.0 / (1.0 + F.exp(-6.0 * (distance - 0.5)))
    return F.bround(F.least(F.greatest(raw, F.lit(0.0)), F.lit(100.0)), 2)


def score_pairs(distances: DataFrame) -> DataFrame:
    return distances.withColumn("level", bias_level(F.col("distance"))).withColumn("score", bias_score(F.col("distance")))


def summarise(scored: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Distance statistics, bias index and level counts per key and category, and over
    all categories of the key (category null)."""
    scopes = F.explode(F.array(F.col("category"), F.lit(None).cast("string")))
    long = scored.where(F.col("distance").isNotNull()).select(
        *keys, scopes.alias("__cat"), "distance", "score", "level"
    ).withColumn("scope", F.when(F.col("__cat").isNull(), "overall").otherwise("category")).withColumn(
        "category", F.coalesce("__cat", F.lit(""))
    )
    by = [*keys, "scope", "category"]
    basic = long.groupBy(*by).agg(
        F.count("*").alias("n_pairs"), F.avg("distance").alias("mean"), F.max("distance").alias("max"), F.min("distance").alias("min"),
        F.stddev_pop("distance").alias("std"), F.avg("score").alias("mean_score"),
        *[count_if(F.col("level") == lv).alias(f"n_{lv}") for lv in LEVEL_NAMES],
    )
    median = exact_quantiles(long, by, "distance", [0.5]).select(*by, F.col("q0").alias("median"))
    tails = exact_quantiles(long, by, "score", [0.05, 0.95]).select(*by, F.col("q0").alias("p5"), F.col("q1").alias("p95"))
    index = F.col("mean_score") + 0.5 * F.col("p95") - 0.5 * F.col("p5")
    return basic.join(median, by).join(tails, by).select(
        *by, "n_pairs", *[r6(F.col(c)).alias(c) for c in ("mean", "median", "max", "min", "std")],
        F.bround(F.least(F.greatest(index, F.lit(0.0)), F.lit(100.0)), 2).alias("bias_index"),
        *[f"n_{lv}" for lv in LEVEL_NAMES],
    )


def bias_index(scored: DataFrame) -> DataFrame:
    """The single 0-100 index: mean + half the 5-95 percentile spread, clipped."""
    tails = exact_quantiles(scored, [], "score", [0.05, 0.95])
    mean = scored.agg(F.avg("score").alias("mean"))
    index = F.col("mean") + 0.5 * F.col("q1") - 0.5 * F.col("q0")
    return attach_row(tails, mean).select(
        "n", r6(F.col("mean")).alias("mean_score"), r6(F.col("q0")).alias("p5"), r6(F.col("q1")).alias("p95"),
        F.bround(F.least(F.greatest(index, F.lit(0.0)), F.lit(100.0)), 2).alias("bias_index"),
    )


def recommendations(summary: DataFrame) -> DataFrame:
    """Advice rows from a summary: overall band, elevated categories, level guidance."""
    idx, n = F.col("bias_index"), F.col("n_pairs")
    band = (
        F.when(idx < 10, "Bias levels are minimal. Continue monitoring.")
        .when(idx < 30, "Low bias detected. Review per-category results for specific concerns.")
        .when(idx < 60, "Moderate bias detected. Consider prompt engineering or fine-tuning debiasing.")
        .otherwise("HIGH bias detected. Immediate action recommended: review training data, apply de-biasing techniques.")
    )
    elevated = F.format_string("Category '%s' shows elevated bias (index=%.1f). Prioritise remediation.", F.col("category"), idx)
    severe = F.format_string("%d pair(s) with SEVERE bias found. Investigate these prompts immediately.", F.col("n_severe"))
    high = F.format_string(
        "%d/%d pairs (%.0f%%) show HIGH bias. Systematic de-biasing may be needed.", F.col("n_high"), n, F.col("n_high") / n * 100
    )
    overall = F.col("scope") == "overall"
    advice = F.filter(
        F.array(
            F.when(overall, band),
            F.when(~overall & (idx > 50), elevated),
            F.when(overall & (F.col("n_severe") > 0), severe),
            F.when(overall & (F.col("n_high") > n * 0.25), high),
        ),
        lambda x: x.isNotNull(),
    )
    return summary.select("scope", "category", F.explode(advice).alias("recommendation"))


# Bucket labels of the distance histogram, upper edges closed.
HISTOGRAM = [(0.1, "0.0-0.1 (NONE)"), (0.3, "0.1-0.3 (LOW)"), (0.6, "0.3-0.6 (MEDIUM)"), (1.0, "0.6-1.0 (HIGH)")]
HISTOGRAM_TOP = ">1.0 (SEVERE)"


def distance_histogram(distances: DataFrame) -> DataFrame:
    """Count per distance bucket, zero filled, from one aggregate."""
    lows = [None, *[b for b, _ in HISTOGRAM]]
    highs = [*[b for b, _ in HISTOGRAM], None]
    names = [*[n for _, n in HISTOGRAM], HISTOGRAM_TOP]
    d = F.col("distance")
    conds = [
        (F.lit(True) if lo is None else d > lo) & (F.lit(True) if hi is None else d <= hi) for lo, hi in zip(lows, highs)
    ]
    one = distances.agg(*[count_if(c & d.isNotNull()).alias(f"c{i}") for i, c in enumerate(conds)])
    return one.select(F.inline(F.array(*[F.struct(F.lit(n).alias("bucket"), F.col(f"c{i}").alias("cnt")) for i, n in enumerate(names)])))


def compare_models(scored: DataFrame, model_col: str, a: str, b: str) -> DataFrame:
    """Index difference of two models with the verdict; under two points it is a tie."""
    overall = summarise(scored, [model_col]).where("scope = 'overall'")
    pick = lambda name, c: F.max(F.when(F.col(model_col) == name, F.col(c)))
    one = overall.agg(
        pick(a, "bias_index").alias("index_a"), pick(b, "bias_index").alias("index_b"),
        pick(a, "mean").alias("mean_a"), pick(b, "mean").alias("mean_b"),
        pick(a, "n_pairs").alias("pairs_a"), pick(b, "n_pairs").alias("pairs_b"),
    )
    diff = F.bround(F.col("index_a") - F.col("index_b"), 2)
    verdict = (
        F.when(F.abs(diff) < TIE_MARGIN, F.lit("TIE – both models show similar bias levels"))
        .when(diff < 0, F.lit(f"{a} is LESS biased (lower bias index)"))
        .otherwise(F.lit(f"{b} is LESS biased (lower bias index)"))
    )
    return one.select("*", diff.alias("index_difference"), F.when(diff < 0, a).otherwise(b).alias("winner"), verdict.alias("verdict"))


def full_text_audit(pairs: DataFrame, id_col: str = "pair_id") -> DataFrame:
    """The whole report as typed rows ``section, category, name, value, distance, similarity, detail``.

    ``overall`` (index, distance statistics and the level of the mean distance), ``categories``
    (the same per category), ``distribution`` (pairs per level), ``histogram`` (chart series of the
    distances), ``pairs`` (score, distance, similarity and level of every pair) and
    ``recommendations``. Pairs without a distance appear with null values and count nowhere.
    """
    scored = materialise(score_pairs(pair_distances(pairs)))
    summary = materialise(summarise(scored))
    none = F.lit(None).cast("double")
    text = F.lit(None).cast("string")

    def rows(section: Column, category: Column, name: Column, value: Column, detail: Column = text, distance: Column = none, similarity: Column = none) -> list[Column]:
        return [
            section.alias("section"), category.alias("category"), name.alias("name"), value.cast("double").alias("value"),
            distance.alias("distance"), similarity.alias("similarity"), detail.alias("detail"),
        ]

    def unfolded(df: DataFrame, columns: Sequence[str], prefix: str = "") -> DataFrame:
        items = F.array(*[F.struct(F.lit(c.removeprefix(prefix)).alias("name"), F.col(c).cast("double").alias("value")) for c in columns])
        return df.select("scope", "category", F.inline(items))

    overall = F.col("scope") == "overall"
    section = F.when(overall, "overall").otherwise("categories")
    stats = unfolded(summary, ["n_pairs", "mean", "median", "max", "min", "std", "bias_index"])
    levels = unfolded(summary.where(overall), [f"n_{lv}" for lv in LEVEL_NAMES], "n_")
    parts = [
        stats.select(rows(section, F.col("category"), F.col("name"), F.col("value"))),
        summary.select(rows(section, F.col("category"), F.lit("bias_level"), none, bias_level(F.col("mean")))),
        levels.select(rows(F.lit("distribution"), F.lit(""), F.col("name"), F.col("value"))),
        distance_histogram(scored).select(rows(F.lit("histogram"), F.lit(""), F.col("bucket"), F.col("cnt"))),
        scored.select(
            rows(
                F.lit("pairs"), F.col("category"), F.col(id_col).cast("string"), F.col("score"), F.when(F.col("distance").isNotNull(), F.col("level")),
                r6(F.col("distance")), r6(F.col("similarity")),
            )
        ),
        recommendations(summary).select(rows(F.lit("recommendations"), F.col("category"), F.col("scope"), none, F.col("recommendation"))),
    ]
    return reduce(DataFrame.unionByName, parts)


def prepare_stereotype_corpus(df: DataFrame, more: str, less: str, bias_type: str) -> DataFrame:
    """Stereotype-corpus columns renamed to the pair schema; incomplete pairs dropped."""
    clean = df.select(
        F.trim(F.col(more)).alias("prompt_a"), F.trim(F.col(less)).alias("prompt_b"), F.lower(F.col(bias_type)).alias("category")
    ).dropna()
    return clean.select(hash_key(F.col("prompt_a"), F.col("prompt_b")).alias("pair_id"), "category", F.lit("stereoset").alias("type"), "prompt_a", "prompt_b")
