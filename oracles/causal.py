"""SQL for correlation, independence tests and edge scores."""

from itertools import combinations

from oracles.views import sql

M = ["quantity", "extendedprice", "discount", "tax", "revenue", "charge", "unit_price"]
CORR = " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, count(*) AS n, corr({a}, {b}) AS r, var_pop({a}) AS var_a, var_pop({b}) AS var_b FROM numeric_matrix" for a, b in combinations(M, 2)
)
FULL = "SELECT * FROM cor UNION ALL SELECT b, a, n, r, var_b, var_a FROM cor"
PART = """SELECT c.a, c.b, x.b AS k, c.n, c.r, x.r AS r_ak, y.r AS r_bk FROM cor c JOIN full_cor x ON x.a = c.a AND x.b <> c.b JOIN full_cor y ON y.a = c.b AND y.b = x.b"""
V = {"cor": CORR, "full_cor": FULL, "part": PART}
EDGES = "SELECT a AS src, b AS dst, abs(r) AS weight FROM cor WHERE abs(r) > {t}"
CATS = "SELECT l_returnflag, l_linestatus, l_linenumber::VARCHAR AS ship_mode, (l_quantity > 25)::INT::VARCHAR AS big FROM lineitem"
CN = ["l_returnflag", "l_linestatus", "ship_mode", "big"]


def chi(names: list[str]) -> str:
    return " UNION ALL ".join(CHI_PAIR.format(a=a, b=b) for a, b in combinations(names, 2))


CHI_PAIR = (
    """SELECT '{a}' AS a, '{b}' AS b, n, CASE WHEN nx < 2 OR ny < 2 THEN 0.0::DOUBLE ELSE sum(pow(greatest(abs(o - e) - CASE WHEN nx = 2 AND ny = 2 THEN 0.5 ELSE 0 END, 0), 2) / e) END AS statistic, (nx - 1) * (ny - 1) AS dof
    FROM (SELECT coalesce(c.o, 0) AS o, rw.t::DOUBLE * cl.t / z.n AS e, z.n, z.nx, z.ny FROM (SELECT {a} AS x, count(*) AS t FROM cats GROUP BY 1) rw CROSS JOIN (SELECT {b} AS y, count(*) AS t FROM cats GROUP BY 1) cl
      CROSS JOIN (SELECT count(*) AS n, count(DISTINCT {a}) AS nx, count(DISTINCT {b}) AS ny FROM cats) z
      LEFT JOIN (SELECT {a} AS x, {b} AS y, count(*) AS o FROM cats GROUP BY 1, 2) c ON c.x = rw.x AND c.y = cl.y) GROUP BY n, nx, ny"""
)
CHI_P = """SELECT *, CASE WHEN dof = 0 OR statistic <= 0 THEN 1.0::DOUBLE WHEN statistic > 1000 THEN 0.0::DOUBLE ELSE greatest(0.0::DOUBLE, 1 - (
            SELECT sum(exp((dof / 2.0::DOUBLE + i) * ln(statistic / 2) - statistic / 2 - lgamma(dof / 2.0::DOUBLE + i + 1))) FROM range(0, 2000) t(i))) END AS p FROM chi"""
CATS5 = CATS.replace(" FROM lineitem", ", floor(l_quantity / 10)::INT::VARCHAR AS band FROM lineitem")
#: Sets of one size from the one before: k is the last name of the set.
DEEPER = """SELECT l.a, l.b, list_append(l.given, ik.b) AS given, l.n, (l.r - ik.r * jk.r) / (sqrt(greatest((1 - ik.r * ik.r) * (1 - jk.r * jk.r), 0)) + 1e-10) AS r
    FROM {p} l JOIN {p} ik ON ik.a = l.a AND ik.given = l.given AND ik.b <> l.b AND (len(l.given) = 0 OR ik.b > l.given[-1]) JOIN {p} jk ON jk.a = l.b AND jk.b = ik.b AND jk.given = l.given"""
BIC0 = "CASE WHEN {v} < 1e-10 THEN 0.0::DOUBLE ELSE n * ln(2 * pi() * {v}) + n + {k} * ln(n) END"
BIC = f"SELECT a AS parent, b AS node, n, {BIC0.format(v='var_b', k=2)} AS bic_alone, {BIC0.format(v='(var_b * (1 - r * r))', k=3)} AS bic_with_parent FROM full_cor"
PARENT = "SELECT b AS dst, (list(a ORDER BY round_even(abs(r), 12) DESC, a))[1] AS src FROM cor GROUP BY b"


#: Two-sided normal tail: 1 - erf(z / sqrt 2) by its series of positive terms, in logarithms.
TAIL = """CASE WHEN {z} > 7 THEN 0.0::DOUBLE WHEN {z} < 1e-12 THEN 1.0::DOUBLE ELSE greatest(0.0::DOUBLE, 1 - (SELECT sum(exp(ln(2 / sqrt(pi())) - {z} * {z} / 2 + (2 * i + 1) * ln({z} / sqrt(2.0::DOUBLE))
    + i * ln(2.0::DOUBLE) + (i + 1) * ln(2.0::DOUBLE) + lgamma(i + 2.0::DOUBLE) - lgamma(2 * i + 3.0::DOUBLE))) FROM range(0, 200) t(i))) END"""


def t_tail(r: str, n: str) -> str:
    """Normal tail at the value that has Student's t tail up to terms in 1 / df^2."""
    t = f"abs({r}) * sqrt(({n} - 2) / greatest(1 - {r} * {r}, 1e-15))"
    return TAIL.format(z=f"({t} * (1 - 1 / (4.0::DOUBLE * ({n} - 2))) / sqrt(1 + {t} * {t} / (2.0::DOUBLE * ({n} - 2))))")


def kendall(x: str, y: str) -> str:
    ties = lambda c: f"SELECT sum(t * (t - 1) / 2) AS t{c}, sum(t * (t - 1) * (t - 2)) AS u{c}, sum(t * (t - 1) * (2 * t + 5)) AS v{c} FROM (SELECT sum(w) AS t FROM cells GROUP BY {c})"
    return f"""SELECT '{x}' AS a, '{y}' AS b, n::BIGINT AS n, round_even(s / sqrt((n * (n - 1) / 2 - tx) * (n * (n - 1) / 2 - ty)), 6) AS correlation, round_even(p, 6) AS p_value, p < 0.05 AS significant
        FROM (SELECT *, {TAIL.format(z="z")} AS p FROM (SELECT *, abs(s) / sqrt((n * (n - 1) * (2 * n + 5) - vx - vy) / 18 + 2 * tx * ty / (n * (n - 1)) + ux * uy / (9 * n * (n - 1) * (n - 2))) AS z FROM
        (SELECT sum(w) AS n FROM cells), (SELECT sum(p.w * q.w * sign(p.y - q.y)) AS s FROM cells p JOIN cells q ON p.x > q.x), ({ties("x")}), ({ties("y")})))"""


def kendall_exact(x: str, y: str) -> str:
    """Few rows without ties: orders with so few inversions, counted by adding one element after the other."""
    return f"""SELECT '{x}' AS a, '{y}' AS b, n::BIGINT AS n, round_even((n * (n - 1) / 2 - 2 * d) / (n * (n - 1) / 2), 6) AS correlation, round_even(p, 6) AS p_value, p < 0.05 AS significant FROM (
        SELECT n, d, CASE WHEN 2 * least(d, n * (n - 1) / 2 - d) >= n * (n - 1) / 2 THEN 1.0::DOUBLE ELSE (SELECT least(1.0::DOUBLE, 2 * sum(share)) FROM ways WHERE size = n AND k <= least(d, n * (n - 1) / 2 - d)) END AS p
        FROM (SELECT sum(w) AS n FROM cells), (SELECT sum(CASE WHEN (p.x > q.x) <> (p.y > q.y) THEN 1 ELSE 0 END) / 2.0::DOUBLE AS d FROM cells p JOIN cells q ON p.x <> q.x))"""


#: Share of the orders of ``size`` elements with k inversions.
WAYS = "SELECT 1 AS size, 0 AS k, 1.0::DOUBLE AS share UNION ALL SELECT size, k, share FROM (SELECT size + 1 AS size, k + j AS k, sum(share / (size + 1)) AS share FROM ways, range(0, 33) t(j) WHERE j <= size AND size < 25 GROUP BY size, k + j)"


def cells(table: str, x: str, y: str) -> dict[str, str]:
    return {"cells": f"SELECT {x}::DOUBLE AS x, {y}::DOUBLE AS y, count(*)::DOUBLE AS w FROM {table} GROUP BY 1, 2"}


ORACLES = {
    "c1_correlation_matrix": sql("SELECT a, b, n, round_even(r, 6) AS r FROM cor", "numeric_matrix", **V),
    "c2_correlation_edges": sql("SELECT a AS src, b AS dst, round_even(abs(r), 6) AS weight FROM cor WHERE abs(r) > 0.3", "numeric_matrix", **V),
    "c3_partial_correlation": sql("SELECT a, b, k, round_even((r - r_ak * r_bk) / (sqrt((1 - r_ak * r_ak) * (1 - r_bk * r_bk)) + 1e-10), 5) AS partial_r FROM part", "numeric_matrix", **V),
    "c3_conditioning_sets": sql("""SELECT a, b, array_to_string(given, ',') AS given, len(given)::INT AS size, round_even(r, 4) AS partial_r,
        abs(0.5 * ln((1 + greatest(least(r, 1), -1) + 1e-10) / (1 - greatest(least(r, 1), -1) + 1e-10))) * sqrt(n - len(given) - 3) < 1.959963984540054 AS independent
        FROM (SELECT * FROM s0 UNION ALL SELECT * FROM s1 UNION ALL SELECT * FROM s2 UNION ALL SELECT * FROM s3) WHERE a < b""", "numeric_matrix", **V,
        s0="SELECT a, b, []::VARCHAR[] AS given, n, r FROM full_cor", s1=DEEPER.format(p="s0"), s2=DEEPER.format(p="s1"), s3=DEEPER.format(p="s2")),
    # Only the empty set separates here; an arrow remains against a collider's ends.
    "c7_pc_categorical": sql("""SELECT x.a AS src, x.b AS dst, EXISTS (SELECT 1 FROM adj y WHERE y.b = x.b AND y.a <> x.a AND NOT EXISTS (SELECT 1 FROM adj z WHERE z.a = x.a AND z.b = y.a)) AS directed
        FROM adj x WHERE NOT EXISTS (SELECT 1 FROM adj y WHERE y.b = x.a AND y.a <> x.b AND NOT EXISTS (SELECT 1 FROM adj z WHERE z.a = x.b AND z.b = y.a))""", cats=CATS5, chi=chi([*CN, "band"]),
        tested=CHI_P, adj="SELECT a, b FROM tested WHERE dof > 0 AND p <= 0.05 UNION SELECT b, a FROM tested WHERE dof > 0 AND p <= 0.05"),
    "c4_fisher_z": sql("SELECT a, b, round_even(r, 4) AS r, round_even(z, 4) AS z, z < 1.959963984540054 AS independent FROM (SELECT a, b, r, abs(0.5 * ln((1 + r + 1e-10) / (1 - r + 1e-10))) * sqrt(n - 3) AS z FROM cor)", "numeric_matrix", **V),
    "c5_residual_test": sql("SELECT a, b, k, round_even(least(1, greatest(-1, (r - r_ak * r_bk) / sqrt((1 - r_ak * r_ak) * (1 - r_bk * r_bk)))), 5) AS residual_r FROM part", "numeric_matrix", **V),
    "c6_chi_square": sql("SELECT a, b, n, round_even(statistic, 6) AS statistic, dof FROM chi", cats=CATS, chi=chi(CN)),
    # Upper tail of the gamma distribution from its power series, in logarithms; beyond 1000 it is 0 at six digits.
    "c6_chi_square_tests": sql("""SELECT a, b, n, round_even(statistic, 6) AS statistic, dof, round_even(p, 6) AS p_value, dof = 0 OR p > 0.05 AS independent FROM (
        SELECT *, CASE WHEN dof = 0 OR statistic <= 0 THEN 1.0::DOUBLE WHEN statistic > 1000 THEN 0.0::DOUBLE ELSE greatest(0.0::DOUBLE, 1 - (
            SELECT sum(exp((dof / 2.0::DOUBLE + i) * ln(statistic / 2) - statistic / 2 - lgamma(dof / 2.0::DOUBLE + i + 1))) FROM range(0, 2000) t(i))) END AS p FROM chi)""", cats=CATS, chi=chi(CN)),
    "c8_bic": sql("SELECT parent, node, round_even(bic_alone, 2) AS bic_alone, round_even(bic_with_parent, 2) AS bic_with_parent FROM bic", "numeric_matrix", **V, bic=BIC),
    "c9_edge_confidence": sql("""SELECT p.src, p.dst, round_even(least(1.0::DOUBLE, greatest(0.0::DOUBLE, (bic_alone - bic_with_parent) / ln(n))), 4) AS score, round_even(bic_alone - bic_with_parent, 2) AS bic_improvement
        FROM par p JOIN bic ON parent = src AND node = dst""", "numeric_matrix", **V, bic=BIC, par=PARENT),
    "c10_pearson_score": sql(f"SELECT a, b, round_even(r, 4) AS correlation, round_even(abs(r), 4) AS score, round_even(p, 6) AS p_value, p < 0.05 AS significant FROM (SELECT a, b, r, {t_tail('r', 'n')} AS p FROM cor)", "numeric_matrix", **V),
    "c11_spearman": sql(f"""SELECT a, b, n, round_even(r, 6) AS correlation, round_even(p, 6) AS p_value, p < 0.05 AS significant FROM (SELECT *, {t_tail('r', 'n')} AS p FROM (
        SELECT 'extendedprice' AS a, 'unit_price' AS b, count(*) AS n, corr(rx, ry) AS r FROM (
        SELECT rank() OVER (ORDER BY extendedprice) + (count(*) OVER (PARTITION BY extendedprice) - 1) / 2.0::DOUBLE AS rx,
        rank() OVER (ORDER BY unit_price) + (count(*) OVER (PARTITION BY unit_price) - 1) / 2.0::DOUBLE AS ry FROM numeric_matrix)))""", "numeric_matrix"),
    "c12_kendall": sql(kendall("quantity", "discount"), "numeric_matrix", **cells("numeric_matrix", "quantity", "discount")),
    "c12_kendall_continuous": sql(kendall("c_acctbal", "c_custkey"), **cells("customer", "c_acctbal", "c_custkey")),
    "c12_kendall_exact": sql(kendall_exact("c_nationkey", "best"), recursive=True, ways=WAYS, best="SELECT c_nationkey, max(c_acctbal) AS best FROM customer GROUP BY c_nationkey", **cells("best", "c_nationkey", "best")),
    "c13_rank_edges": sql("SELECT a AS src, b AS dst, round_even(abs(r), 6) AS weight FROM cor ORDER BY abs(r) DESC, a, b LIMIT 5", "numeric_matrix", **V),
    "c14_threshold_edges": sql("SELECT a AS src, b AS dst, round_even(abs(r), 6) AS weight FROM cor WHERE abs(r) >= 0.3", "numeric_matrix", **V),
    "c14_sparsity": sql("SELECT 7::BIGINT AS n_nodes, count(*) AS n_edges, round_even(1 - count(*) / 42.0::DOUBLE, 6) AS sparsity FROM cor WHERE abs(r) >= 0.3", "numeric_matrix", **V),
    "c15_compare_edges": sql("""SELECT count(*) FILTER (WHERE l AND r) AS n_overlap, count(*) FILTER (WHERE r IS NULL) AS n_only_left, count(*) FILTER (WHERE l IS NULL) AS n_only_right,
        round_even(count(*) FILTER (WHERE l AND r)::DOUBLE / count(*), 6) AS jaccard FROM (SELECT src, dst, true AS l FROM e) FULL OUTER JOIN (SELECT src, dst, true AS r FROM par) USING (src, dst)""",
        "numeric_matrix", **V, e=EDGES.format(t="0.3"), par=PARENT),
}
