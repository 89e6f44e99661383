"""SQL for the graph operators."""

from fairspark.operators.graph import OUTCOME_KEYWORDS, SENSITIVE_KEYWORDS
from oracles.views import sql

V = ("flow_edges",)
CLEAN = "replace(replace(lower(node), '_', ' '), '-', ' ')"


def hit(words) -> str:
    return "(" + " OR ".join(f"contains({CLEAN}, '{w.replace('_', ' ')}')" for w in words) + ")"


NODES = "SELECT DISTINCT node FROM (SELECT src AS node FROM flow_edges UNION ALL SELECT dst FROM flow_edges)"
SENS = f"SELECT node FROM nodes WHERE {hit(SENSITIVE_KEYWORDS)}"
OUTCOME = f"SELECT min(node) AS node FROM nodes WHERE {hit(OUTCOME_KEYWORDS)}"
BACK = "SELECT src, dst FROM flow_edges UNION SELECT 'decision_F', dst FROM flow_edges WHERE dst LIKE 'segment %' AND weight > 0.2"
BASE = {"nodes": NODES, "sens": SENS, "outc": OUTCOME}
PATHS = """SELECT [node] AS path, []::DOUBLE[] AS weights, node AS here FROM sens UNION ALL
    SELECT list_append(path, dst), list_append(weights, weight), dst FROM paths JOIN flow_edges ON src = here WHERE NOT list_contains(path, dst) AND len(weights) < {n} AND here NOT IN (SELECT node FROM outc)"""
CHAINS = f"SELECT path, weights FROM paths WHERE here IN (SELECT node FROM outc) AND len(path) >= 3 AND NOT EXISTS (SELECT 1 FROM sens WHERE list_contains(path[2:len(path) - 1], node))"
RISK = """SELECT path, round_even(least(1.0::DOUBLE, greatest(0.0::DOUBLE, 0.4::DOUBLE * least(list_avg(weights), 1) + 0.3::DOUBLE * least((len(path) - 1) / 5.0::DOUBLE, 1)
    + 0.3::DOUBLE * (1 - least(10 * list_var_pop(weights), 1)))), 4) AS risk FROM chains"""
C = {**BASE, "paths": PATHS.format(n=4), "chains": CHAINS, "risks": RISK}


def recursive(body: str, **ctes: str) -> str:
    return sql(body, *V, recursive=True, **ctes)


def closure(edges: str, starts: str, back: bool = False) -> dict[str, str]:
    a, b = ("dst", "src") if back else ("src", "dst")
    return {"clo": f"SELECT node AS start, node FROM {starts} UNION SELECT start, {b} FROM clo JOIN {edges} ON {a} = node"}


LEVELS = {**BASE, "lv": "SELECT node, 0 AS level FROM nodes UNION SELECT dst, level + 1 FROM lv JOIN flow_edges ON src = node"}
STATS = """SELECT count(*) AS n_nodes, sum(o)::BIGINT AS n_edges, round_even(sum(o)::DOUBLE / (count(*) * (count(*) - 1)), 6) AS density, round_even(sum(o)::DOUBLE / count(*), 4) AS mean_degree,
    max(i) AS max_in_degree, max(o) AS max_out_degree, true AS is_dag FROM (
    SELECT node, (SELECT count(*) FROM flow_edges WHERE src = node) AS o, (SELECT count(*) FROM flow_edges WHERE dst = node) AS i FROM nodes)"""
ADJ = {**BASE, "ranked": "SELECT node, (row_number() OVER (ORDER BY node) - 1)::INT AS col FROM nodes",
       "adj": "SELECT r.node AS src, c.col, c.node AS dst, coalesce(e.weight, 0.0::DOUBLE) AS weight FROM nodes r CROSS JOIN ranked c LEFT JOIN flow_edges e ON e.src = r.node AND e.dst = c.node"}

ORACLES = {
    "g1_adjacency": sql("SELECT src, col, weight FROM adj", *V, **ADJ),
    "g1_edge_list": sql("SELECT src, dst, weight FROM flow_edges WHERE weight <> 0 AND src <> dst", *V),
    "g2_neighbours": sql("""SELECT node, coalesce((SELECT string_agg(src, ',' ORDER BY src) FROM flow_edges WHERE dst = node), '') AS parents,
        coalesce((SELECT string_agg(dst, ',' ORDER BY dst) FROM flow_edges WHERE src = node), '') AS children FROM nodes""", *V, **BASE),
    "g3_descendants": recursive("SELECT start, node FROM clo WHERE start <> node", **BASE, fb=BACK, **closure("fb", "sens")),
    "g3_ancestors": recursive("SELECT start, node FROM clo WHERE start <> node", **BASE, **closure("flow_edges", "outc", True)),
    "g4_simple_paths": recursive("SELECT array_to_string(path, '>') AS path, len(weights)::INT AS n_edges FROM paths WHERE here IN (SELECT node FROM outc)", **BASE, paths=PATHS.format(n=5)),
    "g5_acyclicity": recursive("""SELECT 'flow' AS name, NOT EXISTS (SELECT 1 FROM c1 WHERE start = node) AS is_dag UNION ALL SELECT 'feedback', NOT EXISTS (SELECT 1 FROM c2 WHERE start = node)""", fb=BACK,
        c1="SELECT src AS start, dst AS node FROM flow_edges UNION SELECT start, dst FROM c1 JOIN flow_edges ON src = node",
        c2="SELECT src AS start, dst AS node FROM fb UNION SELECT start, dst FROM c2 JOIN fb ON src = node"),
    "g6_topological_order": recursive("SELECT node, max(level)::BIGINT AS level FROM lv GROUP BY node", **LEVELS),
    "g7_graph_stats": sql(STATS, *V, **BASE),
    "g8_sensitive_nodes": sql("SELECT node FROM sens", *V, **BASE),
    "g9_outcome_node": sql("""SELECT 'keyword' AS rule, node, true AS by_keyword FROM outc UNION ALL
        SELECT 'degree', (SELECT dst FROM flow_edges GROUP BY dst ORDER BY count(*) DESC, dst LIMIT 1), false""", *V, **BASE),
    "g10_proxy_chains": recursive("SELECT array_to_string(path, '>') AS path FROM chains", **C),
    "g11_chain_risk": recursive("SELECT array_to_string(path, '>') AS path, risk FROM risks", **C),
    "g12_chain_summary": recursive("""SELECT n AS total_chains, m AS max_risk, h AS n_high, md AS n_medium, l AS n_low, concat_ws(' | ', CASE WHEN n = 0 THEN 'No proxy chains detected. The causal structure appears fair.' END,
        CASE WHEN h > 0 THEN printf('HIGH RISK: %d proxy chain(s) detected with strong indirect influence from sensitive attributes. Immediate investigation recommended. Consider removing or transforming the proxy variables along these paths.', h) END,
        CASE WHEN md > 0 THEN printf('MEDIUM RISK: %d proxy chain(s) detected. Review the intermediate variables and consider applying fairness constraints during model training.', md) END,
        CASE WHEN l > 0 THEN printf('LOW RISK: %d minor proxy chain(s) detected. Monitor these paths over time and document the potential indirect influence.', l) END,
        CASE WHEN n > 0 THEN 'General recommendation: Apply causal inference techniques (e.g., do-calculus, backdoor adjustment) to block proxy paths before training downstream models.' END) AS recommendations
        FROM (SELECT count(*) AS n, coalesce(max(risk), 0) AS m, count(*) FILTER (WHERE risk >= 0.7) AS h, count(*) FILTER (WHERE risk < 0.7 AND risk >= 0.3) AS md, count(*) FILTER (WHERE risk < 0.3) AS l FROM risks)""", **C),
    "g12_chain_advice": recursive("""SELECT array_to_string(path, ' -> ') AS chain, printf('Consider removing or decorrelating proxy variable(s): %s (risk=%.2f)', array_to_string(path[2:len(path) - 1], ', '), risk) AS recommendation FROM risks WHERE risk >= 0.7""",
        **{**BASE, "scaled": "SELECT src, dst, round_even(weight / max(weight) OVER (PARTITION BY src), 6) AS weight FROM flow_edges", "paths": PATHS.format(n=4).replace("flow_edges", "scaled"), "chains": CHAINS, "risks": RISK}),
}
