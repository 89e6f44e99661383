"""SQL for the text-bias operators. The fixed word lists are written into the SQL."""

from fairspark.operators.prompts import CONTEXTS, DEMOGRAPHICS, PROFESSIONS, STEREOTYPES, TEMPLATES
from oracles.views import sql


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def lst(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


def pick(n: str, *parts: str) -> str:
    joined = " || '|' || ".join(f"({p})" for p in parts)
    return f"(('0x' || substring(md5({joined}), 1, 8))::BIGINT % {n})"


DEMOS = "CASE category " + " ".join(f"WHEN {q(k)} THEN {lst(v)}" for k, v in DEMOGRAPHICS.items()) + " END"
FILL = "replace(replace(template, '{{demographic}}', {d}), '{{profession}}', profession)"


def framed(source: str, key: str) -> dict[str, str]:
    """``source`` yields key, category, template (both may be drawn)."""
    return {
        "asked": source,
        "staged": f"""SELECT *, {DEMOS} AS demos, {lst(PROFESSIONS)}[{pick(str(len(PROFESSIONS)), key, "42", "'profession'")} + 1] AS profession FROM asked""",
        "ij": f"SELECT *, {pick('len(demos)', key, '42', repr('first'))} AS i, 1 + {pick('(len(demos) - 1)', key, '42', repr('second'))} AS gap FROM staged",
        "picked": "SELECT *, demos[i + 1] AS demographic_a, demos[(i + gap) % len(demos) + 1] AS demographic_b FROM ij",
        "framed": f"SELECT *, {FILL.format(d='demographic_a')} AS prompt_a, {FILL.format(d='demographic_b')} AS prompt_b FROM picked",
    }


def fixed(limit: int = 0) -> str:
    return "[" + ", ".join(
        f"{{'category': {q(c)}, 'position': {i}::INT, 'prompt_a': {q(a)}, 'prompt_b': {q(b)}}}"
        for c, ps in STEREOTYPES.items() for i, (a, b) in enumerate(ps) if limit <= 0 or i < limit
    ) + "]"


ONE = framed(
    f"""SELECT c_custkey, {lst(DEMOGRAPHICS)}[{pick(str(len(DEMOGRAPHICS)), 'c_custkey', '42', repr('category'))} + 1] AS category,
    {lst(TEMPLATES)}[{pick(str(len(TEMPLATES)), 'c_custkey', '42', repr('template'))} + 1] AS template FROM customer""", "c_custkey")
SET = framed(
    f"""SELECT s_suppkey::VARCHAR AS s_suppkey, category, template, s_suppkey || '/' || category || '/' || template AS request FROM (
        SELECT s_suppkey, category, template, row_number() OVER (PARTITION BY s_suppkey, category ORDER BY md5(s_suppkey || '|' || category || '|42|' || template)) AS r
        FROM supplier, (SELECT unnest({lst(DEMOGRAPHICS)}) AS category), (SELECT unnest({lst(TEMPLATES)}) AS template)) WHERE r <= 3""", "request")

DOT = "list_sum([a * b for a, b in zip(x, y)])"
DIST = """SELECT pair_id, category, list_dot_product(emb_a, emb_b) / greatest(sqrt(list_dot_product(emb_a, emb_a)) * sqrt(list_dot_product(emb_b, emb_b)), 1e-10) AS similarity,
    1.0::DOUBLE - list_dot_product(emb_a, emb_b) / greatest(sqrt(list_dot_product(emb_a, emb_a)) * sqrt(list_dot_product(emb_b, emb_b)), 1e-10) AS distance FROM {v}"""
SCORED = """SELECT *, CASE WHEN distance > 1.0 THEN 'severe' WHEN distance > 0.6 THEN 'high' WHEN distance > 0.3 THEN 'medium' WHEN distance > 0.1 THEN 'low' ELSE 'none' END AS level,
    round_even(least(greatest(100.0::DOUBLE / (1.0::DOUBLE + exp(-6.0::DOUBLE * (distance - 0.5::DOUBLE))), 0), 100), 2) AS score FROM {d}"""
INDEX = "round_even(least(greatest(avg(score) + 0.5::DOUBLE * quantile_cont(score, 0.95) - 0.5::DOUBLE * quantile_cont(score, 0.05), 0), 100), 2)"


def summary(scored: str) -> str:
    return f"""SELECT CASE WHEN grouping(category) = 1 THEN 'overall' ELSE 'category' END AS scope, coalesce(category, '') AS category, count(*) AS n_pairs,
    round_even(avg(distance), 6) AS mean, round_even(quantile_cont(distance, 0.5), 6) AS median, round_even(max(distance), 6) AS max, round_even(min(distance), 6) AS min,
    round_even(stddev_pop(distance), 6) AS std, {INDEX} AS bias_index, {", ".join(f"count(*) FILTER (WHERE level = '{lv}') AS n_{lv}" for lv in ("none", "low", "medium", "high", "severe"))}
    FROM {scored} GROUP BY GROUPING SETS ((category), ())"""


BASE = {"dist": DIST.format(v="pairs"), "scored": SCORED.format(d="dist")}
PERM = f"SELECT perm, {', '.join(f'''('0x' || substring(md5('42|' || perm || '|{j}'), 1, 7))::BIGINT AS k{j}''' for j in range(5))} FROM range(0, 1000) t(perm)"

ADVICE = """SELECT scope, category, recommendation FROM (SELECT scope, category, unnest([
          CASE WHEN scope = 'overall' THEN CASE WHEN bias_index < 10 THEN 'Bias levels are minimal. Continue monitoring.' WHEN bias_index < 30 THEN 'Low bias detected. Review per-category results for specific concerns.'
            WHEN bias_index < 60 THEN 'Moderate bias detected. Consider prompt engineering or fine-tuning debiasing.'
            ELSE 'HIGH bias detected. Immediate action recommended: review training data, apply de-biasing techniques.' END END,
          CASE WHEN scope = 'category' AND bias_index > 50 THEN printf('Category ''%s'' shows elevated bias (index=%.1f). Prioritise remediation.', category, bias_index) END,
          CASE WHEN scope = 'overall' AND n_severe > 0 THEN printf('%d pair(s) with SEVERE bias found. Investigate these prompts immediately.', n_severe) END,
          CASE WHEN scope = 'overall' AND n_high > n_pairs * 0.25 THEN printf('%d/%d pairs (%.0f%%) show HIGH bias. Systematic de-biasing may be needed.', n_high, n_pairs, n_high::DOUBLE / n_pairs * 100) END
          ]) AS recommendation FROM summed) WHERE recommendation IS NOT NULL"""
BUCKETS = """SELECT bucket, count(d) AS cnt FROM (SELECT unnest(['0.0-0.1 (NONE)', '0.1-0.3 (LOW)', '0.3-0.6 (MEDIUM)', '0.6-1.0 (HIGH)', '>1.0 (SEVERE)']) AS bucket)
        LEFT JOIN (SELECT distance AS d, CASE WHEN distance <= 0.1 THEN '0.0-0.1 (NONE)' WHEN distance <= 0.3 THEN '0.1-0.3 (LOW)' WHEN distance <= 0.6 THEN '0.3-0.6 (MEDIUM)'
            WHEN distance <= 1.0 THEN '0.6-1.0 (HIGH)' ELSE '>1.0 (SEVERE)' END AS bucket FROM dist) USING (bucket) GROUP BY bucket"""
LEVEL = "CASE WHEN {0} > 1.0 THEN 'severe' WHEN {0} > 0.6 THEN 'high' WHEN {0} > 0.3 THEN 'medium' WHEN {0} > 0.1 THEN 'low' ELSE 'none' END".format
SECTION = "CASE WHEN scope = 'overall' THEN 'overall' ELSE 'categories' END AS section, category"
EMPTY = "NULL::DOUBLE AS distance, NULL::DOUBLE AS similarity, NULL::VARCHAR AS detail"
REPORT = " UNION ALL ".join(
    [f"SELECT {SECTION}, '{c}' AS name, {c}::DOUBLE AS value, {EMPTY} FROM summed" for c in ("n_pairs", "mean", "median", "max", "min", "std", "bias_index")]
    + [f"SELECT 'distribution' AS section, '' AS category, '{lv}' AS name, n_{lv}::DOUBLE AS value, {EMPTY} FROM summed WHERE scope = 'overall'" for lv in ("none", "low", "medium", "high", "severe")]
    + [
        f"SELECT {SECTION}, 'bias_level', NULL, NULL, NULL, {LEVEL('mean')} FROM summed",
        f"SELECT 'histogram', '', bucket, cnt::DOUBLE, {EMPTY} FROM buckets",
        "SELECT 'pairs', category, pair_id::VARCHAR, score, round_even(distance, 6), round_even(similarity, 6), level FROM scored",
        "SELECT 'recommendations', category, scope, NULL, NULL, NULL, recommendation FROM advice",
    ]
)

ORACLES = {
    "x1_prompt_pairs": sql("SELECT c_custkey, category, template, profession, demographic_a, demographic_b, prompt_a, prompt_b FROM framed", **ONE),
    "x1_audit_set": sql(
        f"""SELECT s_suppkey, category, 'template' AS type, prompt_a, prompt_b FROM framed UNION ALL
        SELECT s_suppkey::VARCHAR, p.category, 'stereoset', p.prompt_a, p.prompt_b FROM (SELECT s_suppkey, unnest({fixed()}) AS p FROM supplier)""", **SET),
    "x2_stereotype_pairs": f"SELECT s_suppkey, p.category AS category, p.position AS position, p.prompt_a AS prompt_a, p.prompt_b AS prompt_b FROM (SELECT s_suppkey, unnest({fixed(3)}) AS p FROM supplier)",
    "x3_context_framing": f"""SELECT conv_id, turn, replace(CASE role WHEN 'user' THEN {q(CONTEXTS['social'])} WHEN 'assistant' THEN {q(CONTEXTS['professional'])} ELSE {q(CONTEXTS['neutral'])} END,
        '{{demographic}}', role || ' speaker') || text AS prompt FROM conversations""",
    "x4_hash_embedding": sql(
        """SELECT t.conv_id, t.turn, g.dim::INT AS dim, round_even(CASE WHEN coalesce(n.norm, 0) < 1e-12 THEN coalesce(a.s, 0) ELSE coalesce(a.s, 0) / n.norm END, 6) AS v
        FROM conversations t CROSS JOIN range(0, 384) g(dim) LEFT JOIN acc a ON a.conv_id = t.conv_id AND a.turn = t.turn AND a.dim = g.dim
        LEFT JOIN norms n ON n.conv_id = t.conv_id AND n.turn = t.turn""",
        grams="SELECT conv_id, turn, i, substring(text, (i + 1)::INT, 2) AS g FROM (SELECT conv_id, turn, text, unnest(range(0, length(text) - 1)) AS i FROM conversations)",
        hashed="SELECT conv_id, turn, i, substring(sha256(g), 1, 8) AS h FROM grams",
        steps="SELECT conv_id, turn, (i + ascii(substring(h, (j + 1)::INT, 1))) % 384 AS dim, (('0x' || substring(h, (j + 1)::INT, 1))::INT - 7.5::DOUBLE) / 7.5::DOUBLE AS w FROM hashed, range(0, 8) t(j)",
        acc="SELECT conv_id, turn, dim, sum(w) AS s FROM steps GROUP BY ALL",
        norms="SELECT conv_id, turn, sqrt(sum(s * s)) AS norm FROM acc GROUP BY ALL"),
    "x5_pooling": """SELECT label, dim, round_even(avg(v), 6) AS mean, round_even(max(v), 6) AS max, round_even(arg_min(v, vec_id), 6) AS first FROM (
        SELECT label, vec_id, unnest(range(0, 64))::INT AS dim, unnest(embedding)::DOUBLE AS v FROM embeddings) GROUP BY label, dim""",
    "x6_l2_normalise": """SELECT vec_id, unnest(range(0, 64))::INT AS dim, unnest([round_even(x * 3 / n, 6) for x in e]) AS v FROM (
        SELECT vec_id, embedding::DOUBLE[] AS e, sqrt(list_dot_product([x * 3 for x in embedding::DOUBLE[]], [x * 3 for x in embedding::DOUBLE[]])) AS n FROM embeddings)""",
    "x7_cosine_distance": sql("SELECT pair_id, category, round_even(similarity, 6) AS similarity, round_even(distance, 6) AS distance, false AS length_mismatch FROM dist", "pairs", **BASE),
    "x8_mean_cosine_matrix": """SELECT a.label AS group_a, b.label AS group_b, CASE WHEN a.label = b.label THEN count(*) FILTER (WHERE a.vec_id <> b.vec_id) ELSE count(*) END AS n_pairs,
        round_even(avg(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])) FILTER (WHERE a.vec_id <> b.vec_id), 6) AS mean_cosine
        FROM embeddings a, embeddings b WHERE a.label <= b.label GROUP BY a.label, b.label""",
    "x9_mean_difference_test": sql(
        """SELECT m AS n_a, n - m AS n_b, round_even(max(obs), 6) AS observed, round_even((count(*) FILTER (WHERE round_even(d, 9) >= round_even(obs, 9)) + 1)::DOUBLE / 1001, 6) AS p_value,
        (count(*) FILTER (WHERE round_even(d, 9) >= round_even(obs, 9)) + 1)::DOUBLE / 1001 < 0.05 AS significant FROM diffs, size GROUP BY m, n""",
        "pairs", dist=BASE["dist"], coef=PERM,
        size="""SELECT count(*) AS n, count(*) FILTER (WHERE category < 'c5') AS m, sum(distance) AS total,
            abs(avg(distance) FILTER (WHERE category < 'c5') - avg(distance) FILTER (WHERE NOT category < 'c5')) AS obs FROM dist""",
        keyed="""SELECT perm, pair_id, distance, (((((k3 * pair_id + k2) % 2147483647) * pair_id + k1) % 2147483647 * pair_id + k0) % 2147483647) AS h FROM dist, coef""",
        ranked="SELECT perm, distance, row_number() OVER (PARTITION BY perm ORDER BY h, pair_id) AS r FROM keyed",
        diffs="SELECT perm, abs(sum(distance) FILTER (WHERE r <= m) / any_value(m) - sum(distance) FILTER (WHERE r > m) / any_value(n - m)) AS d FROM ranked, size GROUP BY perm"),
    "x10_pair_scores": sql("SELECT pair_id, category, round_even(distance, 6) AS distance, level, score FROM scored", "pairs", **BASE),
    "x11_bias_index": sql(f"""SELECT count(*) AS n, round_even(avg(score), 6) AS mean_score, round_even(quantile_cont(score, 0.05), 6) AS p5, round_even(quantile_cont(score, 0.95), 6) AS p95,
        {INDEX} AS bias_index FROM scored""", "pairs", **BASE),
    "x12_dataset_summary": sql(summary("scored"), "pairs", **BASE),
    "x12_recommendations": sql(
        ADVICE, "pairs", **BASE, summed=summary("scored")),
    "x13_distance_histogram": sql(BUCKETS, "pairs", **BASE),
    "x14_compare_models": sql(
        """SELECT *, round_even(index_a - index_b, 2) AS index_difference, CASE WHEN index_a - index_b < 0 THEN 'signed' ELSE 'absolute' END AS winner,
        CASE WHEN abs(round_even(index_a - index_b, 2)) < 2 THEN 'TIE – both models show similar bias levels' WHEN index_a < index_b THEN 'signed is LESS biased (lower bias index)'
          ELSE 'absolute is LESS biased (lower bias index)' END AS verdict
        FROM (SELECT a.bias_index AS index_a, b.bias_index AS index_b, a.mean AS mean_a, b.mean AS mean_b, a.n_pairs AS pairs_a, b.n_pairs AS pairs_b
          FROM (SELECT * FROM s1 WHERE scope = 'overall') a, (SELECT * FROM s2 WHERE scope = 'overall') b)""", "pairs", **BASE,
        positive="SELECT pair_id, category, [abs(x) for x in emb_a] AS emb_a, [abs(x) for x in emb_b] AS emb_b FROM pairs",
        dist2=DIST.format(v="positive"), scored2=SCORED.format(d="dist2"), s1=summary("scored"), s2=summary("scored2")),
    "x15_full_text_audit": sql(REPORT, "pairs", **BASE, summed=summary("scored"), advice=ADVICE, buckets=BUCKETS),
    "x16_stereotype_corpus": r"""SELECT md5(a || '|' || b) AS pair_id, c AS category, 'stereoset' AS type, a AS prompt_a, b AS prompt_b FROM (
        SELECT trim(max(CASE WHEN turn % 2 = 0 THEN text END)) AS a, trim(max(CASE WHEN turn % 2 = 1 THEN text END)) AS b, lower(max(CASE WHEN turn % 2 = 0 THEN upper(role) END)) AS c
        FROM conversations GROUP BY conv_id, turn // 2) WHERE a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL""",
}
