"""Graph operators over the decision-flow graph of the order tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from fairspark.operators import graph as gr
from fairspark.plans import views
from fairspark.session import materialise


def _edges(spark, sf):
    """The flow graph, written once: every operator below reads it several times."""
    return materialise(views.flow_edges(spark, sf))


def _feedback(spark, sf):
    """The flow graph with edges back from outcomes to segments for heavy flows."""
    edges = _edges(spark, sf)
    back = edges.where("dst LIKE 'segment %' AND weight > 0.2").select(
        F.lit("decision_F").alias("src"), F.col("dst"), F.lit(1.0).alias("weight")
    ).distinct()
    return edges.unionByName(back)


def g1(spark, sf):
    rows = gr.adjacency(_edges(spark, sf))
    return rows.select("src", F.posexplode("weights").alias("col", "weight"))


def g1_back(spark, sf):
    return gr.edges_from_adjacency(gr.adjacency(_edges(spark, sf)))


def g2(spark, sf):
    out = gr.neighbours(_edges(spark, sf))
    return out.select("node", F.array_join("parents", ",").alias("parents"), F.array_join("children", ",").alias("children"))


def g3_descendants(spark, sf):
    edges = _feedback(spark, sf)
    return gr.reachable(edges, gr.sensitive_nodes(edges))


def g3_ancestors(spark, sf):
    edges = _edges(spark, sf)
    return gr.reachable(edges, gr.outcome_node(edges).select("node"), reverse=True)


def g4(spark, sf):
    edges = _edges(spark, sf)
    paths = gr.simple_paths(edges, gr.sensitive_nodes(edges), gr.outcome_node(edges).select("node"), 5)
    return paths.select(F.array_join("path", ">").alias("path"), F.size("weights").alias("n_edges"))


def g5(spark, sf):
    plain = gr.is_acyclic(_edges(spark, sf)).withColumn("name", F.lit("flow"))
    looped = gr.is_acyclic(_feedback(spark, sf)).withColumn("name", F.lit("feedback"))
    return plain.unionByName(looped).select("name", "is_dag")


def g6(spark, sf):
    return gr.topological_order(_edges(spark, sf))


def g7(spark, sf):
    return gr.graph_stats(_edges(spark, sf))


def g8(spark, sf):
    return gr.sensitive_nodes(_edges(spark, sf))


def g9(spark, sf):
    edges = _edges(spark, sf)
    named = gr.outcome_node(edges).withColumn("rule", F.lit("keyword"))
    by_degree = gr.outcome_node(edges, ["nothing matches"]).withColumn("rule", F.lit("degree"))
    return named.unionByName(by_degree).select("rule", "node", "by_keyword")


def _chains(spark, sf, max_nodes=5):
    edges = _edges(spark, sf)
    return gr.proxy_chains(edges, gr.sensitive_nodes(edges), gr.outcome_node(edges).select("node"), max_nodes)


def g10(spark, sf):
    return _chains(spark, sf).select(F.array_join("path", ">").alias("path"))


def g11(spark, sf):
    return _chains(spark, sf).select(F.array_join("path", ">").alias("path"), "risk")


def g12(spark, sf):
    return gr.chain_summary(_chains(spark, sf)).drop("avg_risk")


def g12_advice(spark, sf):
    """Weights relative to the strongest edge of their source."""
    edges = _edges(spark, sf)
    top = edges.groupBy("src").agg(F.max("weight").alias("top"))
    scaled = materialise(edges.join(top, "src").select("src", "dst", F.bround(F.col("weight") / F.col("top"), 6).alias("weight")))
    chains = gr.proxy_chains(scaled, gr.sensitive_nodes(scaled), gr.outcome_node(scaled).select("node"), 5)
    return gr.chain_advice(chains)


QUERIES = {
    "g1_adjacency": g1,
    "g1_edge_list": g1_back,
    "g2_neighbours": g2,
    "g3_descendants": g3_descendants,
    "g3_ancestors": g3_ancestors,
    "g4_simple_paths": g4,
    "g5_acyclicity": g5,
    "g6_topological_order": g6,
    "g7_graph_stats": g7,
    "g8_sensitive_nodes": g8,
    "g9_outcome_node": g9,
    "g10_proxy_chains": g10,
    "g11_chain_risk": g11,
    "g12_chain_summary": g12,
    "g12_chain_advice": g12_advice,
}
