"""Graph operators on edge tables ``(src, dst, weight)``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairspark.functions.numeric import count_if
from fairspark.functions.ordering import attach_row
from fairspark.session import materialise

# Fixed keyword lists of the name rules.
SENSITIVE_KEYWORDS = [
    "race", "gender", "sex", "age", "ethnicity", "religion", "disability", "national_origin",
    "marital_status", "pregnancy", "color", "creed", "orientation", "protected",
]
OUTCOME_KEYWORDS = [
    "outcome", "target", "label", "prediction", "score", "decision", "result", "output", "hire",
    "admit", "loan", "approval", "risk_score",
]


def nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()


def adjacency(edges: DataFrame) -> DataFrame:
    """Matrix rows: per source an array of weights over all nodes in name order.

    The result is a dense d x d matrix by definition; it is for column graphs.
    """
    names = nodes(edges).agg(F.sort_array(F.collect_list("node")).alias("names"))
    out = edges.groupBy("src").agg(F.map_from_entries(F.collect_list(F.struct("dst", "weight"))).alias("m"))
    every = nodes(edges).select(F.col("node").alias("src")).join(out, "src", "left")
    weights = F.transform("names", lambda n: F.coalesce(F.try_element_at("m", n), F.lit(0.0)))
    return attach_row(every, names).select("src", "names", weights.alias("weights"))


def edges_from_adjacency(matrix: DataFrame) -> DataFrame:
    """Non-zero entries as edges, without self loops."""
    rows = matrix.select("src", F.explode(F.arrays_zip(F.col("names").alias("dst"), F.col("weights").alias("weight"))).alias("e"))
    return rows.select("src", "e.dst", "e.weight").where((F.col("weight") != 0) & (F.col("src") != F.col("dst")))


def neighbours(edges: DataFrame) -> DataFrame:
    """Sorted parents and children of every node."""
    both = edges.select(
        F.inline(
            F.array(
                F.struct(F.col("src").alias("node"), F.col("dst").alias("child"), F.lit(None).cast("string").alias("parent")),
                F.struct(F.col("dst").alias("node"), F.lit(None).cast("string").alias("child"), F.col("src").alias("parent")),
            )
        )
    )
    return both.groupBy("node").agg(
        F.sort_array(F.collect_set("parent")).alias("parents"), F.sort_array(F.collect_set("child")).alias("children")
    )


#: Plain hops before paths are doubled, and plain peeling rounds before levels are.
DIRECT_ROUNDS = 6


def _doubled(pairs: DataFrame) -> DataFrame:
    """Pairs ``at, next`` joined by exactly twice as many edges, written as a table of their own."""
    more = pairs.select(F.col("at").alias("__mid"), F.col("next").alias("__end"))
    joined = pairs.join(more, F.col("next") == F.col("__mid")).select("at", F.col("__end").alias("next"))
    return materialise(joined.distinct())


def reachable(edges: DataFrame, starts: DataFrame, reverse: bool = False) -> DataFrame:
    """All nodes reachable from each start (``node`` column), without the start itself.

    The first hops are plain: a round joins the newest nodes with the edges, and each round's nodes are a
    table of their own. Graphs that are deeper go on from the newest nodes by doubling: round k adds what
    lies 2^k edges behind anything added so far, so a chain of a thousand nodes takes ten more rounds. The
    pairs of nodes 2^k edges apart are few in deep graphs and are not needed in shallow ones.
    """
    step = edges.select(F.col("dst").alias("at"), F.col("src").alias("next")) if reverse else edges.select(
        F.col("src").alias("at"), F.col("dst").alias("next")
    )
    step = materialise(step.distinct())

    def together(parts: list[DataFrame]) -> DataFrame:
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def onward(newest: DataFrame, pairs: DataFrame, known: list[DataFrame]) -> DataFrame:
        found = newest.join(pairs, "at").select("start", F.col("next").alias("at")).distinct()
        return materialise(found.join(together(known), ["start", "at"], "left_anti") if known else found)

    newest = starts.select(F.col("node").alias("start"), F.col("node").alias("at")).distinct()
    known: list[DataFrame] = []
    for _ in range(DIRECT_ROUNDS):
        newest = onward(newest, step, known)
        if newest.isEmpty():
            break
        known.append(newest)
    else:
        grown, pairs = [newest], step
        while True:
            # Everything within 2^k edges behind the newest hop is in ``grown``.
            found = onward(together(grown), pairs, known)
            if found.isEmpty():
                break
            grown.append(found)
            known.append(found)
            pairs = _doubled(pairs)
    out = together(known) if known else newest
    return out.where(F.col("start") != F.col("at")).select("start", F.col("at").alias("node"))


def hop_distance(edges: DataFrame, goals: DataFrame, most: int, reverse: bool = False) -> DataFrame:
    """``node, hops``: least number of edges, up to ``most``, from each node to a goal; from a goal with ``reverse``."""
    step = edges.select(F.col("src").alias("node"), F.col("dst").alias("at")) if not reverse else edges.select(
        F.col("dst").alias("node"), F.col("src").alias("at")
    )
    newest = materialise(goals.select("node").distinct().withColumn("hops", F.lit(0)))
    known = newest
    for k in range(1, most + 1):
        found = step.join(newest.select(F.col("node").alias("at")), "at").select("node").distinct()
        newest = materialise(found.join(known, "node", "left_anti").withColumn("hops", F.lit(k)))
        if newest.isEmpty():
            break
        known = known.unionByName(newest)
    return known


def simple_paths(edges: DataFrame, starts: DataFrame, ends: DataFrame, max_edges: int = 10) -> DataFrame:
    """Every simple path from a start to an end with at most ``max_edges`` edges.

    Paths grow from both sides: up to half of the edges from the starts, the rest from the ends, and the
    halves meet in a node where they share no other one. So rounds and partial paths are those of half the
    length. Nodes are labelled with their hops to an end, and behind that with those from where the first
    halves stopped, never further than a path may go; a partial path goes on only where the steps left suffice.
    """
    half = (max_edges + 1) // 2
    step = materialise(edges.where(F.col("src") != F.col("dst")).select("src", "dst", "weight"))
    to_end = hop_distance(step, ends, max_edges - 1).select(F.col("node").alias("__near"), F.col("hops").alias("to_end"))

    def grow(paths: DataFrame, label: DataFrame, left: Column, forward: bool) -> DataFrame:
        """Partial paths one edge longer; ``at`` is the open end."""
        at, other = ("src", "dst") if forward else ("dst", "src")
        moved = paths.join(step.select(F.col(at).alias("at"), F.col(other).alias("next"), "weight"), "at")
        moved = moved.where(~F.array_contains("path", F.col("next"))).join(label, F.col("next") == F.col("__near")).where(left)
        node, weight = F.array("next"), F.array("weight")
        path, weights = (F.concat("path", node), F.concat("weights", weight)) if forward else (F.concat(node, "path"), F.concat(weight, "weights"))
        return materialise(moved.select(F.col("next").alias("at"), path.alias("path"), weights.alias("weights")))

    def single(points: DataFrame) -> DataFrame:
        return points.select(F.col("node").alias("at"), F.array("node").alias("path"), F.array().cast("array<double>").alias("weights"))

    goal = ends.select(F.col("node").alias("goal")).distinct()
    found: list[DataFrame] = []
    front = single(starts)
    for k in range(1, half + 1):
        front = grow(front, to_end, F.col("to_end") <= max_edges - k, True)
        found.append(front.join(goal, F.col("at") == F.col("goal"), "left_semi").select("path", "weights"))
    rest = max_edges - half
    to_front = hop_distance(step, front.select(F.col("at").alias("node")), rest - 1, reverse=True).select(F.col("node").alias("__near"), F.col("hops").alias("to_front"))
    back = single(ends.select("node").distinct())
    for k in range(1, rest + 1):
        # A longer path has its first ``half`` edges in front and k behind.
        back = grow(back, to_front, F.col("to_front") <= rest - k, False)
        tail = back.select("at", F.col("path").alias("tail"), F.col("weights").alias("tail_weights"))
        met = front.join(tail, "at").select("path", "weights", F.slice("tail", F.lit(2), F.size("tail") - 1).alias("tail"), "tail_weights")
        met = met.where(~F.arrays_overlap("path", "tail"))
        found.append(met.select(F.concat("path", "tail").alias("path"), F.concat("weights", "tail_weights").alias("weights")))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def topological_levels(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Longest-path level of every node, and the nodes on or behind cycles, which have none.

    A few rounds peel nodes without open parents. What is left is deep, and its levels come from doubling:
    the pairs of nodes joined by exactly 2^k edges, for as long as there are any. A walk of more edges than
    there are nodes runs through a cycle. From the greatest k down, each node goes 2^k edges back wherever
    it can; what it has gone in the end is its longest path, one binary digit per round.
    """
    open_edges = materialise(edges.select("src", "dst").distinct())
    rest = materialise(nodes(open_edges))
    levels: list[DataFrame] = []
    for level in range(DIRECT_ROUNDS):
        free = materialise(rest.join(open_edges, rest.node == open_edges.dst, "left_anti").select("node", F.lit(level).cast("bigint").alias("level")))
        if free.isEmpty():
            break
        levels.append(free)
        gone = free.select(F.col("node").alias("peeled"))
        rest = materialise(rest.join(gone, rest.node == gone.peeled, "left_anti"))
        open_edges = materialise(open_edges.join(gone, open_edges.src == gone.peeled, "left_anti"))
    none = rest.where(F.lit(False))
    if not rest.isEmpty():
        n = rest.count()
        powers = [open_edges.select(F.col("dst").alias("at"), F.col("src").alias("next"))]  # edges back
        while 2 ** (len(powers) - 1) < n and not powers[-1].isEmpty():
            powers.append(_doubled(powers[-1]))
        cyclic = materialise(powers[-1].select(F.col("at").alias("node")).distinct())
        sound = rest.join(cyclic, "node", "left_anti")
        # Where each node has got to, one row per place, and the edges it has gone.
        places = sound.select("node", F.col("node").alias("at"), F.lit(0).cast("bigint").alias("gone"))
        for k in range(len(powers) - 2, -1, -1):
            moved = materialise(places.join(powers[k], "at").select("node", F.col("next").alias("at"), (F.col("gone") + 2**k).alias("gone")).distinct())
            places = moved.unionByName(places.join(moved.select("node").distinct(), "node", "left_anti"))
        levels.append(materialise(places.groupBy("node").agg((F.max("gone") + len(levels)).alias("level"))))
        none = cyclic
    out = levels[0] if levels else none.select("node", F.lit(0).cast("bigint").alias("level"))
    for more in levels[1:]:
        out = out.unionByName(more)
    return out, none


def is_acyclic(edges: DataFrame) -> DataFrame:
    """Whether a graph has no cycle, and how many nodes lie on or behind one."""
    _, left = topological_levels(edges)
    return left.agg(F.count("*").alias("n_on_cycles")).withColumn("is_dag", F.col("n_on_cycles") == 0)


def topological_order(edges: DataFrame) -> DataFrame:
    """Node levels of a valid order (level, then name); an error if the graph has a cycle."""
    levels, left = topological_levels(edges)
    if not left.isEmpty():
        raise ValueError("the graph has a cycle; it has no topological order")
    return levels


def graph_stats(edges: DataFrame) -> DataFrame:
    """Size, density, degrees and acyclicity as one row."""
    real = edges.where("weight != 0").select("src", "dst")
    ends = real.select(
        F.inline(
            F.array(
                F.struct(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")),
                F.struct(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")),
            )
        )
    )
    degree = ends.groupBy("node").agg(F.sum("o").alias("out"), F.sum("i").alias("in"))
    one = degree.agg(
        F.count("*").alias("n_nodes"), F.sum("out").alias("n_edges"), F.max("in").alias("max_in_degree"), F.max("out").alias("max_out_degree")
    )
    possible = F.col("n_nodes") * (F.col("n_nodes") - 1)
    return attach_row(one, is_acyclic(real).select("is_dag")).select(
        "n_nodes", "n_edges",
        F.bround(F.when(possible > 0, F.col("n_edges") / possible).otherwise(F.lit(0.0)), 6).alias("density"),
        F.bround(F.col("n_edges") / F.col("n_nodes"), 4).alias("mean_degree"), "max_in_degree", "max_out_degree", "is_dag",
    )


def _clean_name(name: Column) -> Column:
    return F.lower(F.translate(name, "_-", "  "))


def matches(name: Column, keywords: Sequence[str], whole_words: bool = False) -> Column:
    """Name contains a keyword, both with separators as blanks; optionally as whole words."""
    words = F.array(*[F.lit(k.replace("_", " ").replace("-", " ").lower()) for k in keywords])
    padded = F.concat(F.lit(" "), _clean_name(name), F.lit(" ")) if whole_words else _clean_name(name)
    if whole_words:
        return F.exists(words, lambda k: F.contains(padded, F.concat(F.lit(" "), k, F.lit(" "))))
    return F.exists(words, lambda k: F.contains(padded, k))


def sensitive_nodes(edges: DataFrame, keywords: Sequence[str] = SENSITIVE_KEYWORDS, whole_words: bool = False) -> DataFrame:
    return nodes(edges).where(matches(F.col("node"), keywords, whole_words))


def outcome_node(edges: DataFrame, keywords: Sequence[str] = OUTCOME_KEYWORDS) -> DataFrame:
    """First node (by name) matching a keyword, else the one with the largest in-degree."""
    degree = edges.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("in"))
    named = nodes(edges).join(degree, "node", "left").select(
        "node", F.coalesce("in", F.lit(0)).alias("in"), matches(F.col("node"), keywords).alias("hit")
    )
    order = F.struct((~F.col("hit")).alias("a"), F.when(F.col("hit"), 0).otherwise(-F.col("in")).alias("b"), F.col("node").alias("c"))
    return named.agg(F.min_by("node", order).alias("node"), F.min_by("hit", order).alias("by_keyword"))


def proxy_chains(
    edges: DataFrame, sensitive: DataFrame, outcomes: DataFrame, max_nodes: int = 3, keywords: Sequence[str] = SENSITIVE_KEYWORDS
) -> DataFrame:
    """Simple paths from a sensitive node to the outcome with at least one intermediate
    node, none of the intermediates sensitive. Sensitive nodes are no steps at all, so
    such paths are never extended."""
    allowed = edges.where(~matches(F.col("dst"), keywords)).unionByName(
        edges.join(outcomes, F.col("dst") == F.col("node"), "left_semi").where(matches(F.col("dst"), keywords))
    )
    paths = simple_paths(allowed, sensitive, outcomes, max_nodes - 1)
    return paths.where(F.size("path") >= 3).withColumn("risk", chain_risk(F.col("weights"), F.size("path")))


def chain_risk(weights: Column, length: Column) -> Column:
    """Weighted mix of mean edge weight, length and weight stability, in [0, 1]."""
    n = F.size(weights)
    mean = F.aggregate(weights, F.lit(0.0), lambda acc, w: acc + w) / n
    var = F.aggregate(weights, F.lit(0.0), lambda acc, w: acc + w * w) / n - mean * mean
    stable = 1.0 - F.least(F.greatest(var, F.lit(0.0)) * 10.0, F.lit(1.0))
    risk = 0.4 * F.least(mean, F.lit(1.0)) + 0.3 * F.least((length - 1) / 5.0, F.lit(1.0)) + 0.3 * stable
    return F.when(n > 0, F.bround(F.least(F.greatest(risk, F.lit(0.0)), F.lit(1.0)), 4)).otherwise(F.lit(0.0))


def chain_summary(chains: DataFrame) -> DataFrame:
    """Totals, risk classes and advice as one row."""
    high, low = F.col("risk") >= 0.7, F.col("risk") < 0.3
    one = chains.agg(
        F.count("*").alias("total_chains"), F.coalesce(F.max("risk"), F.lit(0.0)).alias("max_risk"),
        F.bround(F.coalesce(F.avg("risk"), F.lit(0.0)), 6).alias("avg_risk"),
        count_if(high).alias("n_high"), count_if(~high & ~low).alias("n_medium"), count_if(low).alias("n_low"),
    )
    advice = F.concat_ws(
        " | ",
        F.when(F.col("total_chains") == 0, "No proxy chains detected. The causal structure appears fair."),
        F.when(F.col("n_high") > 0, F.format_string("HIGH RISK: %d proxy chain(s) detected with strong indirect influence from sensitive attributes. Immediate investigation recommended. Consider removing or transforming the proxy variables along these paths.", F.col("n_high"))),
        F.when(F.col("n_medium") > 0, F.format_string("MEDIUM RISK: %d proxy chain(s) detected. Review the intermediate variables and consider applying fairness constraints during model training.", F.col("n_medium"))),
        F.when(F.col("n_low") > 0, F.format_string("LOW RISK: %d minor proxy chain(s) detected. Monitor these paths over time and document the potential indirect influence.", F.col("n_low"))),
        F.when(F.col("total_chains") > 0, "General recommendation: Apply causal inference techniques (e.g., do-calculus, backdoor adjustment) to block proxy paths before training downstream models."),
    )
    return one.withColumn("recommendations", advice)


def chain_advice(chains: DataFrame) -> DataFrame:
    """One line per high-risk chain naming its proxies."""
    proxies = F.array_join(F.slice("path", F.lit(2), F.size("path") - 2), ", ")
    return chains.where(F.col("risk") >= 0.7).select(
        F.array_join("path", " -> ").alias("chain"),
        F.format_string("Consider removing or decorrelating proxy variable(s): %s (risk=%.2f)", proxies, F.col("risk")).alias("recommendation"),
    )
