"""Correlation, independence tests and edge scores over numeric columns.

The rows are read once to fill a d x d moment table (or contingency counts); the
search over column pairs and conditioning sets only needs that table, which is
bounded by the number of columns.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fairspark.functions.numeric import count_if
from fairspark.functions.ordering import ROWS_PER_BLOCK, attach_row, row_index, running_sums
from fairspark.functions.special import chi2_sf, inversion_two_sided, normal_two_sided, t_two_sided
from fairspark.session import materialise

Z_975 = 1.959963984540054
EDGE_THRESHOLD = 0.3
MAX_CONDITION = 5
CORR_EPS = 1e-10


def moments(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, means and population covariances of all column pairs, as one row.

    A first pass gives the means; the second sums products of centred values, which is
    stable and stays in plain generated code however many pairs there are.
    """
    clean = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).dropna()
    means = clean.agg(*[F.avg(c).alias(c) for c in columns]).first()
    centre = [F.col(c) - F.lit(means[c] if means[c] is not None else 0.0) for c in columns]
    products = [
        (F.sum(a * b) / F.count("*")).alias(f"c_{i}_{j}") for i, a in enumerate(centre) for j, b in enumerate(centre) if i <= j
    ]
    return clean.agg(F.count("*").alias("n"), *[F.lit(means[c]).alias(f"m_{i}") for i, c in enumerate(columns)], *products)


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Upper triangle ``(a, b, n, r, var_a, var_b)`` from one aggregate."""
    one = moments(df, columns)
    rows = []
    for (i, a), (j, b) in combinations(list(enumerate(columns)), 2):
        va, vb = F.col(f"c_{i}_{i}"), F.col(f"c_{j}_{j}")
        r = F.col(f"c_{i}_{j}") / F.sqrt(va * vb)
        rows.append(
            F.struct(
                F.lit(a).alias("a"), F.lit(b).alias("b"), F.col("n").alias("n"),
                F.when((va > 0) & (vb > 0), F.least(F.lit(1.0), F.greatest(F.lit(-1.0), r))).alias("r"),
                va.alias("var_a"), vb.alias("var_b"),
            )
        )
    return one.select(F.inline(F.array(*rows)))


def both_directions(corr: DataFrame) -> DataFrame:
    back = corr.select(
        F.col("b").alias("a"), F.col("a").alias("b"), "n", "r", F.col("var_b").alias("var_a"), F.col("var_a").alias("var_b")
    )
    return corr.unionByName(back)


def correlation_edges(corr: DataFrame, threshold: float = EDGE_THRESHOLD) -> DataFrame:
    return corr.where(F.abs("r") > threshold).select(F.col("a").alias("src"), F.col("b").alias("dst"), F.abs("r").alias("weight"))


def partial_correlations(corr: DataFrame) -> DataFrame:
    """r(a, b | k) for every pair and every single other column."""
    full = both_directions(corr)
    ak = full.select("a", F.col("b").alias("k"), F.col("r").alias("r_ak"))
    bk = full.select(F.col("a").alias("b"), F.col("b").alias("k"), F.col("r").alias("r_bk"))
    joined = corr.join(ak, "a").join(bk, ["b", "k"])
    den = F.sqrt((1 - F.col("r_ak") ** 2) * (1 - F.col("r_bk") ** 2)) + CORR_EPS
    return joined.select("a", "b", "k", "n", ((F.col("r") - F.col("r_ak") * F.col("r_bk")) / den).alias("partial_r"))


def partial_correlations_given(corr: DataFrame, most: int) -> DataFrame:
    """``a, b, given, size, n, partial_r`` for every pair and every set of up to ``most`` other columns.

    One level per set size: r(a, b | S) with k the last name of S follows from three entries of the level
    before, so a level is two joins of the table with itself on the set without k. Work follows the number
    of sets, not the rows.
    """
    level = materialise(both_directions(corr).select("a", "b", F.array().cast("array<string>").alias("given"), "n", F.col("r").alias("partial_r")))
    levels = [level]
    for _ in range(most):
        ik = level.select("a", "given", F.col("b").alias("k"), F.col("partial_r").alias("r_ak"))
        jk = level.select(F.col("a").alias("b"), "given", F.col("b").alias("k"), F.col("partial_r").alias("r_bk"))
        last = F.try_element_at("given", F.lit(-1))
        grown = level.join(ik, ["a", "given"]).where((F.col("k") != F.col("b")) & (last.isNull() | (F.col("k") > last))).join(jk, ["b", "given", "k"])
        den = F.sqrt(F.greatest((1 - F.col("r_ak") ** 2) * (1 - F.col("r_bk") ** 2), F.lit(0.0))) + CORR_EPS
        value = (F.col("partial_r") - F.col("r_ak") * F.col("r_bk")) / den
        level = materialise(grown.select("a", "b", F.concat("given", F.array("k")).alias("given"), "n", value.alias("partial_r")))
        levels.append(level)
    out = levels[0]
    for more in levels[1:]:
        out = out.unionByName(more)
    return out.where(F.col("a") < F.col("b")).select("a", "b", "given", F.size("given").alias("size"), "n", "partial_r")


def independence_given(corr: DataFrame, most: int) -> DataFrame:
    """Fisher-Z test at the 5 % level for every pair and every conditioning set of up to ``most`` columns."""
    tested = partial_correlations_given(corr, most)
    r = F.least(F.greatest("partial_r", F.lit(-1.0)), F.lit(1.0))
    z = F.abs(0.5 * F.log((1 + r + CORR_EPS) / (1 - r + CORR_EPS))) * F.sqrt(F.greatest(F.col("n") - F.col("size") - 3, F.lit(0)))
    return tested.withColumn("z", z).withColumn("independent", F.col("z") < Z_975)


def fisher_z(r: Column, n: Column, n_conditions: int) -> Column:
    z = 0.5 * F.log((1 + r + 1e-10) / (1 - r + 1e-10))
    return F.abs(z) * F.sqrt(n - n_conditions - 3)


def fisher_tests(corr: DataFrame) -> DataFrame:
    """Unconditional Fisher-Z test of every pair at the 5 % level."""
    return corr.select("a", "b", "r", fisher_z(F.col("r"), F.col("n"), 0).alias("z")).withColumn("independent", F.col("z") < Z_975)


def residual_tests(corr: DataFrame) -> DataFrame:
    """Correlation of the residuals of a and b after regressing both on k, with its t value.

    Residual moments follow from the moment table, so no residuals are computed.
    """
    full = both_directions(corr)
    ak = full.select("a", F.col("b").alias("k"), F.col("r").alias("r_ak"))
    bk = full.select(F.col("a").alias("b"), F.col("b").alias("k"), F.col("r").alias("r_bk"))
    joined = corr.join(ak, "a").join(bk, ["b", "k"])
    # Null where a column is a multiple of k: nothing is left to correlate.
    left = F.sqrt(F.greatest((1 - F.col("r_ak") ** 2) * (1 - F.col("r_bk") ** 2), F.lit(0.0)))
    r = F.try_divide(F.col("r") - F.col("r_ak") * F.col("r_bk"), left)
    clipped = F.when(r.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(-1.0), r)))
    out = joined.select("a", "b", "k", "n", clipped.alias("residual_r"))
    return out.withColumn("t", F.col("residual_r") * F.sqrt((F.col("n") - 2) / F.greatest(1 - F.col("residual_r") ** 2, F.lit(1e-15))))


def t_p_value(t: Column, df: Column) -> Column:
    """Two-sided t tail; for result tables of a few rows."""

    @F.pandas_udf("double")
    def tail(t: pd.Series, df: pd.Series) -> pd.Series:
        return pd.Series([t_two_sided(x, d) for x, d in zip(t, df)])

    return tail(t, df)


def kendall_p_value(n: Column, z: Column, discordant: Column) -> Column:
    """Two-sided p-value of Kendall's statistic; for result tables of a few rows.

    Without ties (``discordant`` is known) and with at most 33 rows, or with at most one pair out of order
    either way, it comes from the exact distribution of inversions, else from the normal one.
    """

    @F.pandas_udf("double")
    def tail(n: pd.Series, z: pd.Series, discordant: pd.Series) -> pd.Series:
        out = []
        for size, value, d in zip(n, z, discordant):
            few = min(d, size * (size - 1) / 2 - d) if d == d and d is not None else None
            if few is not None and (size <= 33 or few <= 1):
                out.append(inversion_two_sided(int(size), int(few)))
            else:
                out.append(normal_two_sided(value) if value == value and value is not None else None)
        return pd.Series(out, dtype="float64")

    return tail(n.cast("double"), z, discordant)


def chi2_p_value(x: Column, k: Column) -> Column:
    """Upper chi-square tail; for result tables of a few rows."""

    @F.pandas_udf("double")
    def tail(x: pd.Series, k: pd.Series) -> pd.Series:
        return pd.Series([chi2_sf(a, b) if b > 0 else 1.0 for a, b in zip(x, k)])

    return tail(x, k)


def chi_square(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Chi-square statistic (Yates on 2x2) and degrees of freedom of all column pairs.

    All contingency tables come from one aggregate; zero cells contribute their
    expected count, which is what is left of the total after the observed cells.
    """
    pairs = F.array(
        *[
            F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(a).cast("string").alias("x"), F.col(b).cast("string").alias("y"))
            for a, b in combinations(columns, 2)
        ]
    )
    cells = df.select(F.inline(pairs)).dropna().groupBy("a", "b", "x", "y").agg(F.count("*").alias("o"))
    rows = cells.groupBy("a", "b", "x").agg(F.sum("o").alias("row"))
    cols = cells.groupBy("a", "b", "y").agg(F.sum("o").alias("col"))
    total = cells.groupBy("a", "b").agg(F.sum("o").alias("n"), F.count_distinct("x").alias("nx"), F.count_distinct("y").alias("ny"))
    joined = cells.join(rows, ["a", "b", "x"]).join(cols, ["a", "b", "y"]).join(total, ["a", "b"])
    e = F.col("row") * F.col("col") / F.col("n")
    yates = (F.col("nx") == 2) & (F.col("ny") == 2)
    gap = F.abs(F.col("o") - e)
    # With Yates every cell of a 2x2 table moves by the same capped half unit.
    used = F.when(yates, gap - F.least(F.lit(0.5), gap)).otherwise(gap)
    summed = joined.groupBy("a", "b").agg(
        F.max("n").alias("n"), F.max("nx").alias("nx"), F.max("ny").alias("ny"), F.sum(used * used / e).alias("seen"),
        F.sum(e).alias("expected_seen"), F.max(yates).alias("yates"), F.count("*").alias("n_cells"), F.max(gap).alias("any_gap"),
    )
    empty = F.col("n") - F.col("expected_seen")
    # A 2x2 table with an empty cell: the missing cells deviate by the same amount as the seen ones.
    moved = F.col("any_gap") - F.least(F.lit(0.5), F.col("any_gap"))
    correction = F.when(F.col("n_cells") == F.col("nx") * F.col("ny"), 0.0).when(
        F.col("yates"), F.when(empty > 1e-12, moved * moved / (empty / (4 - F.col("n_cells")))).otherwise(0.0) * (4 - F.col("n_cells"))
    ).otherwise(empty)
    degenerate = (F.col("nx") < 2) | (F.col("ny") < 2)
    return summed.select(
        "a", "b", "n",
        F.when(degenerate, 0.0).otherwise(F.col("seen") + correction).alias("statistic"),
        ((F.col("nx") - 1) * (F.col("ny") - 1)).alias("dof"),
    )


def chi_square_tests(df: DataFrame, columns: Sequence[str], alpha: float = 0.05) -> DataFrame:
    tested = chi_square(df, columns).withColumn("p_value", chi2_p_value(F.col("statistic"), F.col("dof").cast("double")))
    return tested.withColumn("independent", (F.col("dof") == 0) | (F.col("p_value") > alpha))


# Structure search ----------------------------------------------------------------


def _partial(corr: np.ndarray, i: int, j: int, given: tuple[int, ...]) -> float:
    """Partial correlation from the precision matrix of the involved columns."""
    if not given:
        return float(corr[i, j])
    idx = [i, j, *given]
    precision = np.linalg.pinv(corr[np.ix_(idx, idx)])
    den = math.sqrt(abs(precision[0, 0] * precision[1, 1])) + CORR_EPS
    return float(-precision[0, 1] / den)


def pc_edges(df: DataFrame, columns: Sequence[str], alpha: float = 0.05, test: str = "auto", max_condition: int = MAX_CONDITION) -> DataFrame:
    """Skeleton and v-structures of the PC search as ``(src, dst, directed)`` rows.

    ``auto`` tests by chi-square as soon as an integer column has fewer than ten
    distinct values, else by Fisher-Z; ``partial_correlation`` tests residuals by t.
    Under chi-square a non-empty conditioning set never separates.
    """
    names = list(columns)
    d = len(names)
    if test == "auto":
        ints = [c for c in names if isinstance(df.schema[c].dataType, T.IntegralType)]
        few = df.agg(*[F.approx_count_distinct(c).alias(c) for c in ints]).first() if ints else {}
        # The sketch is exact enough far from ten; only close calls are counted.
        close = [c for c in ints if few[c] < 20]
        exact = df.agg(*[F.count_distinct(c).alias(c) for c in close]).first() if close else {}
        test = "chi_square" if any(exact[c] < 10 for c in close) else "fisher_z"
    if test == "chi_square":
        position = {c: i for i, c in enumerate(names)}
        free = np.zeros((d, d), bool)
        for r in chi_square_tests(df, names, alpha).select("a", "b", "independent").collect():
            i, j = position[r["a"]], position[r["b"]]
            free[i, j] = free[j, i] = r["independent"]
        independent = lambda i, j, s: bool(free[i, j]) if not s else False
    else:
        row = moments(df, names).first()
        cov = np.array([[row[f"c_{min(i, j)}_{max(i, j)}"] for j in range(d)] for i in range(d)])
        dev = np.sqrt(np.diag(cov))
        corr = np.clip(cov / np.outer(dev, dev), -1.0, 1.0)
        n = row["n"]

        def independent(i: int, j: int, s: tuple[int, ...]) -> bool:
            r = max(-1.0, min(1.0, _partial(corr, i, j, s)))
            if test == "partial_correlation":
                t = r * math.sqrt((n - 2) / max(1 - r * r, 1e-15))
                return t_two_sided(t, n - 2) > alpha
            z = 0.5 * math.log((1 + r + 1e-10) / (1 - r + 1e-10))
            return normal_two_sided(z * math.sqrt(max(n - len(s) - 3, 0))) > alpha

    linked, separated = _skeleton(d, independent, max_condition)
    arrows = _colliders(d, linked, separated)
    rows = [(names[i], names[j], not arrows[j][i]) for i in range(d) for j in range(d) if arrows[i][j]]
    return df.sparkSession.createDataFrame(rows, "src string, dst string, directed boolean")


def _skeleton(d: int, independent, max_condition: int) -> tuple[list[set[int]], dict[frozenset, set[int]]]:
    """Remove pairs that some subset of either node's neighbours separates, by subset size."""
    linked = [set(range(d)) - {i} for i in range(d)]
    separated: dict[frozenset, set[int]] = {}
    for size in range(max_condition + 1):
        around = [sorted(s) for s in linked]
        for i, j in combinations(range(d), 2):
            for anchor, other in ((i, j), (j, i)):
                if other not in linked[anchor]:
                    break
                for given in combinations([k for k in around[anchor] if k != other], size):
                    if independent(anchor, other, given):
                        linked[anchor].discard(other)
                        linked[other].discard(anchor)
                        separated[frozenset((i, j))] = set(given)
                        break
        if all(len(s) <= size for s in linked):
            break
    return linked, separated


def _colliders(d: int, linked: list[set[int]], separated: dict[frozenset, set[int]]) -> list[list[bool]]:
    """Both directions of every link, minus the reversed arrows of v-structures."""
    arrows = [[j in linked[i] for j in range(d)] for i in range(d)]
    for k in range(d):
        for i, j in combinations(sorted(linked[k]), 2):
            if j not in linked[i] and k not in separated.get(frozenset((i, j)), {k}):
                arrows[i][k] = arrows[j][k] = True
                arrows[k][i] = arrows[k][j] = False
    return arrows


# Edge scores ---------------------------------------------------------------------


def bic(mse: Column, n: Column, n_parents: int) -> Column:
    """Gaussian BIC of a node from its residual variance; 0 for a degenerate fit."""
    log_lik = -n / 2 * F.log(2 * math.pi * mse) - n / 2
    return F.when(mse < 1e-10, F.lit(0.0)).otherwise(-2 * log_lik + (n_parents + 2) * F.log(n))


def bic_table(corr: DataFrame) -> DataFrame:
    """BIC of every node alone and with every single parent."""
    mse = F.col("var_b") * (1 - F.col("r") ** 2)
    return both_directions(corr).select(
        F.col("a").alias("parent"), F.col("b").alias("node"),
        bic(F.col("var_b"), F.col("n"), 0).alias("bic_alone"), bic(mse, F.col("n"), 1).alias("bic_with_parent"),
    )


def score_edges_bic(df: DataFrame, columns: Sequence[str], edges: DataFrame) -> DataFrame:
    """Confidence of each edge: BIC gain over the node's other parents, over ln n, in [0, 1].

    Residual variances for any parent set come from the covariance table.
    """
    names = list(columns)
    position = {c: i for i, c in enumerate(names)}
    d = len(names)
    row = moments(df, names).first()
    cov = np.array([[row[f"c_{min(i, j)}_{max(i, j)}"] for j in range(d)] for i in range(d)])
    n = row["n"]
    listed = [(r["src"], r["dst"], r["weight"]) for r in edges.select("src", "dst", "weight").collect()]
    parents: dict[int, set[int]] = {}
    for s, t, _ in listed:
        parents.setdefault(position[t], set()).add(position[s])

    def score(node: int, given: set[int]) -> float:
        idx = sorted(given)
        mse = cov[node, node]
        if idx:
            beta = np.linalg.lstsq(cov[np.ix_(idx, idx)], cov[idx, node], rcond=None)[0]
            mse = float(mse - cov[idx, node] @ beta)
        if mse < 1e-10:
            return 0.0
        return n * math.log(2 * math.pi * mse) + n + (len(idx) + 2) * math.log(n)

    rows = []
    for s, t, w in listed:
        i, j = position[s], position[t]
        others = parents[j] - {i}
        gain = score(j, others) - score(j, others | {i})
        rows.append((s, t, float(w), round(min(1.0, max(0.0, gain / math.log(n))), 4), round(gain, 4)))
    return df.sparkSession.createDataFrame(rows, "src string, dst string, weight double, score double, bic_improvement double")


def strongest_parent(corr: DataFrame) -> DataFrame:
    """For every column the earlier-named column with the largest abs correlation."""
    return corr.groupBy(F.col("b").alias("dst")).agg(
        F.min_by("a", F.struct(-F.bround(F.abs("r"), 12), F.col("a"))).alias("src"), F.max(F.abs("r")).alias("weight")
    ).select("src", "dst", "weight")


def _cells(df: DataFrame, x: str, y: str) -> DataFrame:
    """Distinct pairs ``(x, y)`` with their counts ``w``: the only pass over the rows."""
    clean = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).dropna()
    return materialise(clean.groupBy("x", "y").agg(F.count("*").cast("double").alias("w")))


def _value_ranks(cells: DataFrame, column: str, alias: str, rows_per_block: int) -> DataFrame:
    """Distinct values of one column with their average rank over all rows."""
    counts = materialise(cells.groupBy(column).agg(F.sum("w").alias("cnt")).withColumn("__k", F.lit(1)))
    cum = running_sums(counts, ["__k"], [column], {"cum": F.col("cnt")}, rows_per_block=rows_per_block)
    return cum.select(column, (F.col("cum") - (F.col("cnt") - 1) / 2).alias(alias))


def spearman(df: DataFrame, x: str, y: str, rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """Rank correlation of two columns from distinct cells, one row.

    A value with very many partners makes a large join partition, which adaptive execution splits.
    """
    cells = _cells(df, x, y)
    joined = cells.join(_value_ranks(cells, "x", "rx", rows_per_block), "x").join(_value_ranks(cells, "y", "ry", rows_per_block), "y")
    # The mean rank is (n + 1) / 2 on both sides, so centred sums need no second pass.
    n = cells.agg(F.coalesce(F.sum("w"), F.lit(0.0)).alias("n"))
    cx, cy = F.col("rx") - (F.col("n") + 1) / 2, F.col("ry") - (F.col("n") + 1) / 2
    sums = attach_row(joined, n).agg(
        F.sum(F.col("w") * cx * cy).alias("xy"), F.sum(F.col("w") * cx * cx).alias("xx"), F.sum(F.col("w") * cy * cy).alias("yy")
    )
    correlation = F.try_divide(F.col("xy"), F.sqrt(F.col("xx") * F.col("yy")))
    return attach_row(sums, n).select(F.lit(x).alias("a"), F.lit(y).alias("b"), F.col("n").cast("bigint").alias("n"), correlation.alias("correlation"))


def kendall(df: DataFrame, x: str, y: str, rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """Kendall tau-b of two columns over all rows, one row.

    Two different y ranks first differ in one bit: above it they agree, and the larger rank
    has the bit set. So each cell gives one row per bit, keyed by the bit and the rank above it.
    Within such a key, concordant minus discordant pairs follow from a running sum of the cells
    without the bit in order of x: those before a cell with the bit less those after it. Cells of
    equal x are added up first, so ties on either side count nothing, and no pair is formed.
    """
    cells = _cells(df, x, y)
    values = materialise(cells.select("y").distinct().withColumn("__k", F.lit(1)))
    ranks = row_index(values, ["__k"], ["y"], "rank", rows_per_block=rows_per_block).select("y", (F.col("rank") - 1).alias("rank"))
    bits = F.sequence(F.lit(0), F.length(F.bin("last")) - 1)
    last = values.agg((F.count("*") - 1).alias("last"))
    keyed = attach_row(cells.join(ranks, "y"), last).select("x", "w", "rank", F.explode(bits).alias("bit"))
    high = F.expr("(shiftright(rank, bit) & 1) = 1")
    sides = materialise(
        keyed.groupBy("bit", F.expr("shiftright(rank, bit + 1)").alias("head"), "x").agg(
            F.sum(F.when(high, 0.0).otherwise(F.col("w"))).alias("low"), F.sum(F.when(high, F.col("w")).otherwise(0.0)).alias("high")
        )
    )
    cum = running_sums(sides, ["bit", "head"], ["x"], {"upto": F.col("low")}, rows_per_block=rows_per_block)
    # Before less after equals twice the sum up to here, less the own cells, less all cells of the key.
    ordered = cum.agg(F.sum(F.col("high") * (2 * F.col("upto") - F.col("low"))).alias("s"))
    whole = sides.groupBy("bit", "head").agg(F.sum("low").alias("low"), F.sum("high").alias("high"))
    across = whole.agg(F.sum(F.col("low") * F.col("high")).alias("t"))
    t = F.col("cnt")
    ties = lambda c: cells.groupBy(c).agg(F.sum("w").alias("cnt")).agg(
        F.sum(t * (t - 1) / 2).alias(f"t{c}"), F.sum(t * (t - 1) * (t - 2)).alias(f"u{c}"), F.sum(t * (t - 1) * (2 * t + 5)).alias(f"v{c}")
    )
    n = cells.agg(F.coalesce(F.sum("w"), F.lit(0.0)).alias("n"))
    one = attach_row(attach_row(attach_row(attach_row(ordered, across), n), ties("x")), ties("y"))
    n0 = F.col("n") * (F.col("n") - 1) / 2
    excess = F.col("s") - F.col("t")
    tau = F.try_divide(excess, F.sqrt((n0 - F.col("tx")) * (n0 - F.col("ty"))))
    # Variance of concordant less discordant pairs under independence, corrected for ties on either side.
    n, pairs = F.col("n"), F.col("n") * (F.col("n") - 1)
    variance = (
        (pairs * (2 * n + 5) - F.col("vx") - F.col("vy")) / 18
        + F.try_divide(2 * F.col("tx") * F.col("ty"), pairs)
        + F.coalesce(F.try_divide(F.col("ux") * F.col("uy"), 9 * pairs * (n - 2)), F.lit(0.0))
    )
    untied = (F.col("tx") == 0) & (F.col("ty") == 0)
    found = one.select(
        F.lit(x).alias("a"), F.lit(y).alias("b"), n.cast("bigint").alias("n"), tau.alias("correlation"),
        F.try_divide(excess, F.sqrt(variance)).alias("__z"), F.when(untied, (n0 - excess) / 2).alias("__discordant"),
    )
    p = found.withColumn("p_value", F.when(F.col("correlation").isNotNull(), kendall_p_value(F.col("n"), F.col("__z"), F.col("__discordant"))))
    p = p.drop("__z", "__discordant").withColumn("abs_correlation", F.abs("correlation"))
    return p.withColumn("significant", F.col("p_value") < 0.05)


def correlation_score(result: DataFrame) -> DataFrame:
    """p-value of a Pearson or Spearman coefficient by the t distribution."""
    t = F.col("correlation") * F.sqrt((F.col("n") - 2) / F.greatest(1 - F.col("correlation") ** 2, F.lit(1e-15)))
    p = result.withColumn("p_value", t_p_value(t, (F.col("n") - 2).cast("double")))
    return p.withColumn("abs_correlation", F.abs("correlation")).withColumn("significant", F.col("p_value") < 0.05)


def rank_edges(edges: DataFrame, top_k: int | None = None) -> DataFrame:
    """Edges by abs weight (ties by name); the top ``k`` when given."""
    ordered = edges.orderBy(F.abs("weight").desc(), "src", "dst")
    return ordered.limit(top_k) if top_k else ordered


def threshold_edges(edges: DataFrame, threshold: float = EDGE_THRESHOLD) -> DataFrame:
    return edges.where((F.col("src") != F.col("dst")) & (F.col("weight") >= threshold))


def sparsity(edges: DataFrame, nodes: DataFrame, threshold: float = EDGE_THRESHOLD) -> DataFrame:
    kept = threshold_edges(edges, threshold).agg(F.count("*").alias("n_edges"))
    d = nodes.agg(F.count("*").alias("n_nodes"))
    possible = F.col("n_nodes") * (F.col("n_nodes") - 1)
    return attach_row(d, kept).select(
        "n_nodes", "n_edges", F.when(possible > 0, 1 - F.col("n_edges") / possible).otherwise(F.lit(0.0)).alias("sparsity")
    )


def compare_edges(left: DataFrame, right: DataFrame) -> DataFrame:
    """Overlap, one-sided edges and Jaccard of two edge sets, from one full outer join."""
    a = left.select("src", "dst").distinct().withColumn("l", F.lit(1))
    b = right.select("src", "dst").distinct().withColumn("r", F.lit(1))
    both = F.col("l").isNotNull() & F.col("r").isNotNull()
    return a.join(b, ["src", "dst"], "full_outer").agg(
        count_if(both).alias("n_overlap"),
        count_if(F.col("r").isNull()).alias("n_only_left"),
        count_if(F.col("l").isNull()).alias("n_only_right"),
        F.when(F.count("*") > 0, count_if(both) / F.count("*")).otherwise(F.lit(0.0)).alias("jaccard"),
    )
