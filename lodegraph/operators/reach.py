"""Reachability: bounded walks back and forth, components, strong components, impact and blast radius."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.operators.iterate import KERNEL_EDGES, cut, kernel, small
from lodegraph.operators.model import Graph, prop
from lodegraph.operators.ranking import Adjacency

#: Where no depth is given.
DEPTH = 10
#: Steps of walks from single seeds, with the adjacency in every task; beyond it all seeds walk together by joins.
WALK_STEPS = 1 << 34


def _walked(starts: DataFrame, edges: DataFrame, depth: int | None, backward: bool) -> DataFrame:
    """bfs() with the adjacency in every task, a seed at a time. Only behind few()."""
    a, b = ("dst", "src") if backward else ("src", "dst")
    e = edges.select(F.col(a).alias("src"), F.col(b).alias("dst")).distinct().toPandas().astype("int64")  # KERNEL_EDGES at most
    adj = starts.sparkSession.sparkContext.broadcast(Adjacency(e, np.unique(e.to_numpy())))

    def walk(own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        g = adj.value
        at = np.searchsorted(g.ids, own)
        known = at < len(g.ids)
        known[known] = g.ids[at[known]] == own[known]
        found = np.full(len(g.ids), -1, np.int32)
        at = at[known]
        found[at] = 0
        hits, far, k = [at], [np.zeros(len(at), np.int32)], 0
        while len(at) and (depth is None or k < depth):
            k += 1
            to = np.unique(g.level(at)[1])
            at = to[found[to] < 0]
            found[at] = k
            hits.append(at)
            far.append(np.full(len(at), k, np.int32))
        return np.concatenate([g.ids[np.concatenate(hits)], own[~known]]), np.concatenate([*far, np.zeros((~known).sum(), np.int32)])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for seed, own in zip(part["seed"], part["own"], strict=True):
                ids, far = walk(np.unique(np.asarray(own, "int64")))
                yield pd.DataFrame({"seed": np.full(len(ids), seed), "id": ids, "depth": far})

    seeds = starts.groupBy("seed").agg(F.collect_set("id").alias("own"))
    return seeds.repartition(starts.sparkSession.sparkContext.defaultParallelism).mapInPandas(run, "seed long, id long, depth int")


def few(starts: DataFrame, edges: DataFrame) -> bool:
    """Whether the adjacency may go to every task, and the seeds times the edges, which bound the steps of all walks, are at most WALK_STEPS."""
    if not small(edges):
        return False
    most = min(WALK_STEPS // max(1, edges.count()), KERNEL_EDGES)
    return starts.limit(most + 1).count() <= most


def bfs(starts: DataFrame, edges: DataFrame, depth: int | None = DEPTH, backward: bool = True, force_loop: bool = False) -> DataFrame:
    """(seed, id, depth) of all nodes within depth steps of the seeds, which have depth 0.

    starts has (seed, id); backward follows edges from dst to src. None: until nothing is new.
    """
    if not force_loop and few(starts, edges):
        return _walked(starts, edges, depth, backward)
    a, b = ("dst", "src") if backward else ("src", "dst")
    step = edges.select(F.col(a).alias("id"), F.col(b).alias("next")).distinct()
    seen = cut(starts.select("seed", "id", F.lit(0).alias("depth")).distinct(), "bfs")
    frontier, k = seen, 0
    while depth is None or k < depth:
        k += 1
        new = frontier.join(step, "id").select("seed", F.col("next").alias("id")).distinct().join(seen.select("seed", "id"), ["seed", "id"], "left_anti").withColumn("depth", F.lit(k))
        frontier = cut(new, "frontier")
        if not frontier.limit(1).count():
            break
        seen = seen.unionAll(frontier)
    return seen


def impact_radius(graph: Graph, target: int, depth: int = DEPTH) -> DataFrame:
    """(id, depth): whoever depends on a node over edges of any type."""
    s = graph.nodes.filter(F.col("id") == target).select(F.col("id").alias("seed"), "id")
    return bfs(s, graph.of(), depth).filter("depth > 0").select("id", "depth")


def callers(graph: Graph, name: str) -> DataFrame:
    """(id, name, edge_type) of the sources of all edges into nodes of a name."""
    into = graph.nodes.filter(F.col("name") == name).select(F.col("id").alias("dst"))
    return graph.edges.join(into, "dst", "left_semi").select(F.col("src").alias("id"), "edge_type").join(graph.nodes.select("id", "name"), "id")


def depth_filter(graph: Graph, target: int, depth: int) -> DataFrame:
    """(id) of the callers within depth hops, the target itself left out; depth 0 gives none."""
    s = graph.nodes.filter(F.col("id") == target).select(F.col("id").alias("seed"), "id")
    return bfs(s, graph.of(["Calls"]), depth).filter("depth > 0").select("id").filter(F.col("id") != target).distinct()


def _linked(edges: pd.DataFrame, nodes: pd.DataFrame) -> pd.DataFrame:
    """Smallest labels over edges and pointer jumps until nothing changes."""
    ids = nodes["id"].to_numpy()
    a, b = np.searchsorted(ids, edges["src"]), np.searchsorted(ids, edges["dst"])
    label = np.arange(len(ids))
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        for end in (a, b):
            np.minimum.at(new, end, low)
            np.minimum.at(new, label[end], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return pd.DataFrame({"id": ids, "component": ids[label]})


def connected(nodes: DataFrame, edges: DataFrame, force_loop: bool = False) -> DataFrame:
    """(id, component): the smallest id that edges, in either direction, link to a node."""
    if not force_loop and small(edges):
        return kernel(edges, nodes, _linked, "id long, component long")
    state = cut(nodes.select("id", F.col("id").alias("component")).distinct(), "cc")
    both = cut(edges.select("src", "dst").union(edges.select("dst", "src")).distinct(), "cc-edges")
    while True:
        near = both.join(state.select(F.col("id").alias("dst"), "component"), "dst").groupBy(F.col("src").alias("id")).agg(F.min("component").alias("near"))
        step = state.join(near, "id", "left").select("id", F.least("component", F.coalesce("near", "component")).alias("c"), F.col("component").alias("was"))
        # pointer jumping: take over what the component's own node points at
        jump = step.select(F.col("id").alias("c"), F.col("c").alias("further"))
        new = cut(step.join(jump, "c", "left").select("id", F.least("c", F.coalesce("further", "c")).alias("component"), "was"), "cc")
        state = new.select("id", "component")
        if not new.filter("component <> was").limit(1).count():
            return state


def _tarjan(edges: pd.DataFrame, nodes: pd.DataFrame) -> pd.DataFrame:
    ids = nodes["id"].to_numpy()
    n = len(ids)
    src, dst = np.searchsorted(ids, edges["src"]), np.searchsorted(ids, edges["dst"])
    order = np.argsort(src, kind="stable")
    to = dst[order].tolist()
    start = np.concatenate([[0], np.cumsum(np.bincount(src, minlength=n))]).tolist()
    index, low, on, comp, stack, count = [-1] * n, [0] * n, [False] * n, [-1] * n, [], 0
    for root in range(n):
        if index[root] >= 0:
            continue
        work = [(root, start[root])]
        while work:
            v, i = work.pop()
            if i == start[v]:
                index[v] = low[v] = count
                count += 1
                stack.append(v)
                on[v] = True
            elif on[to[i - 1]]:
                low[v] = min(low[v], low[to[i - 1]])
            while i < start[v + 1]:
                w = to[i]
                i += 1
                if index[w] < 0:
                    work.append((v, i))
                    work.append((w, start[w]))
                    break
                if on[w]:
                    low[v] = min(low[v], low[w])
            else:
                if low[v] == index[v]:
                    members = []
                    while True:
                        w = stack.pop()
                        on[w] = False
                        members.append(w)
                        if w == v:
                            break
                    least = min(members)
                    for w in members:
                        comp[w] = least
    return pd.DataFrame({"id": ids, "scc": ids[np.array(comp, dtype=int)] if n else ids})


def _coloured(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Strong components by colours: nodes take the smallest id that reaches them; what the colour's own node is reached by, within the colour, is its component."""
    left, e, done = cut(nodes.select("id").distinct(), "scc-left"), cut(edges.select("src", "dst").filter("src <> dst").distinct(), "scc-edges"), None
    while left.limit(1).count():
        # trim: nodes without edges in or out among the rest are alone
        alive = e.select(F.col("src").alias("id")).intersect(e.select(F.col("dst").alias("id")))
        alone = left.join(alive, "id", "left_anti").select("id", F.col("id").alias("scc"))
        rest = left.join(alive, "id", "left_semi")
        colour = cut(rest.select("id", F.col("id").alias("c")), "scc-colour")
        while True:
            near = e.join(colour.select(F.col("id").alias("src"), "c"), "src").groupBy(F.col("dst").alias("id")).agg(F.min("c").alias("n"))
            new = cut(colour.join(near, "id", "left").select("id", F.least("c", F.coalesce("n", "c")).alias("c"), (F.coalesce(F.col("n") < F.col("c"), F.lit(False))).alias("more")), "scc-colour")
            colour = new.select("id", "c")
            if not new.filter("more").limit(1).count():
                break
        same = cut(e.join(colour.select(F.col("id").alias("src"), F.col("c").alias("c1")), "src").join(colour.select(F.col("id").alias("dst"), F.col("c").alias("c2")), "dst").filter("c1 = c2").select("src", "dst"), "scc-same")
        roots = colour.filter("id = c").select(F.col("c").alias("seed"), "id")
        found = bfs(roots, same, None).select("id", F.col("seed").alias("scc"))
        got = cut(alone.union(found), "scc-found")
        done = got if done is None else done.unionAll(got)
        left = cut(left.join(got, "id", "left_anti"), "scc-left")
        e = cut(e.join(left.select(F.col("id").alias("src")), "src", "left_semi").join(left.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst"), "scc-edges")
    return done if done is not None else nodes.select("id", F.col("id").alias("scc"))


def strongly_connected(nodes: DataFrame, edges: DataFrame, force_loop: bool = False) -> DataFrame:
    """(id, scc): the smallest id of a node's strong component."""
    e = edges.select("src", "dst").distinct()
    return kernel(e, nodes, _tarjan, "id long, scc long") if not force_loop and small(e) else _coloured(nodes, e)


def condensation(scc: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct edges (src, dst) between different strong components."""
    a, b = scc.select(F.col("id").alias("src"), F.col("scc").alias("a")), scc.select(F.col("id").alias("dst"), F.col("scc").alias("b"))
    return edges.select("src", "dst").join(a, "src").join(b, "dst").filter("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct()


def closure(dag: DataFrame, nodes: DataFrame) -> DataFrame:
    """(scc, reached_by) over a condensation: every component that reaches another, itself included.

    Paths double in length each round, so rounds grow with the logarithm of the longest one.
    """
    state = cut(dag.select(F.col("dst").alias("scc"), F.col("src").alias("reached_by")).union(nodes.select("scc", F.col("scc").alias("reached_by"))).distinct(), "closure")
    size = state.count()
    while True:
        more = state.alias("x").join(state.alias("y"), F.col("x.reached_by") == F.col("y.scc")).select(F.col("x.scc").alias("scc"), F.col("y.reached_by").alias("reached_by")).distinct()
        state = cut(more, "closure")
        new = state.count()
        if new == size:
            return state
        size = new


def _score(direct, impact):
    score = F.least(25.0 * direct, F.lit(40.0)) + F.least(0.05 * impact, F.lit(60.0))
    return F.when((direct == 0) & (impact == 0), 0.0).otherwise(score)


def blast_scc(graph: Graph, types: list[str] | None = None) -> DataFrame:
    """(id, scc_size, direct_callers, direct_callers_scc, impact_zone, reach, score) of every node.

    impact_zone: all nodes that reach this one, without itself; direct_callers: its distinct
    callers; direct_callers_scc: all members of the components that call its component;
    reach: the components that reach it, its own included.
    """
    edges = graph.of(["Calls"] if types is None else types).distinct()
    nodes = graph.nodes.select("id").distinct()
    scc = cut(strongly_connected(nodes, edges), "scc")
    sizes = scc.groupBy("scc").agg(F.count("*").alias("scc_size"))
    dag = cut(condensation(scc, edges), "dag")
    every = closure(dag, sizes.select("scc"))
    zone = every.join(sizes.select(F.col("scc").alias("reached_by"), F.col("scc_size").alias("s")), "reached_by").groupBy("scc").agg(F.sum("s").alias("total"), F.count("*").alias("reach"))
    before = dag.join(sizes.select(F.col("scc").alias("src"), F.col("scc_size").alias("s")), "src").groupBy(F.col("dst").alias("scc")).agg(F.sum("s").alias("direct_callers_scc"))
    direct = edges.filter("src <> dst").groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("direct_callers"))
    rows = scc.join(sizes, "scc").join(zone, "scc").join(before, "scc", "left").join(direct, "id", "left").fillna(0, ["direct_callers_scc", "direct_callers"])
    return rows.select("id", "scc_size", "direct_callers", "direct_callers_scc", (F.col("total") - 1).alias("impact_zone"), "reach", _score(F.col("direct_callers_scc"), F.col("total") - 1).alias("score"))


def blast_bfs(graph: Graph, targets: DataFrame, depth: int = DEPTH, flow: DataFrame | None = None) -> DataFrame:
    """(id, direct_callers, impact_zone, score) of some targets by walking back over function calls.

    The score adds data-flow depth (flow: id, depth) and the zone's mean complexity, 1 where unknown.
    """
    functions = graph.nodes.filter("node_type = 'Function'").select("id", prop("cyclomatic").try_cast("double").alias("cx"))
    calls = graph.of(["Calls"]).join(functions.select(F.col("id").alias("src")), "src", "left_semi")
    seen = bfs(targets.select(F.col("id").alias("seed"), "id"), calls, depth).filter("depth > 0 and seed <> id")
    stats = seen.join(functions, "id").groupBy(F.col("seed").alias("id")).agg(F.count_if(F.col("depth") == 1).alias("direct_callers"), F.count("*").alias("impact_zone"), F.avg("cx").alias("cx"))
    rows = targets.select("id").join(stats, "id", "left").fillna(0, ["direct_callers", "impact_zone"])
    rows = rows.join(flow.select("id", F.col("depth").alias("flow")), "id", "left") if flow is not None else rows.withColumn("flow", F.lit(0))
    parts = F.least(25.0 * F.col("direct_callers"), F.lit(40.0)) + F.least(12.0 * F.col("impact_zone"), F.lit(35.0)) + F.least(8.0 * F.coalesce("flow", F.lit(0)), F.lit(15.0)) + F.least(2.0 * F.coalesce("cx", F.lit(1.0)), F.lit(10.0))
    return rows.select("id", "direct_callers", "impact_zone", F.least(parts, F.lit(100.0)).alias("score"))


def cycles(graph: Graph) -> DataFrame:
    """(scc, size): strong components over all edges with two nodes or more and a call inside."""
    scc = cut(strongly_connected(graph.nodes.select("id"), graph.of()), "scc")
    big = scc.groupBy("scc").agg(F.count("*").alias("size")).filter("size >= 2")
    calls = graph.of(["Calls"])
    inside = calls.join(scc.select(F.col("id").alias("src"), F.col("scc").alias("a")), "src").join(scc.select(F.col("id").alias("dst"), F.col("scc").alias("b")), "dst").filter("a = b").select(F.col("a").alias("scc"))
    return big.join(inside, "scc", "left_semi")


def recursive(graph: Graph) -> DataFrame:
    """(id) of functions in a call cycle, of themselves alone or with others."""
    calls = graph.of(["Calls"])
    scc = cut(strongly_connected(graph.nodes.select("id"), calls), "scc")
    many = scc.groupBy("scc").agg(F.count("*").alias("n")).filter("n > 1")
    return scc.join(many, "scc", "left_semi").select("id").union(calls.filter("src = dst").select(F.col("src").alias("id"))).distinct()


def levels(graph: Graph, types: list[str] | None = None) -> DataFrame:
    """(id, level): callers come after what they call; an error if there is a cycle."""
    e = cut(graph.of(["Calls"] if types is None else types).distinct(), "topo")
    left, done, level = cut(graph.nodes.select("id").distinct(), "topo-left"), None, 0
    while left.limit(1).count():
        ready = cut(left.join(e.select(F.col("src").alias("id")), "id", "left_anti").withColumn("level", F.lit(level)), "topo-ready")
        if not ready.limit(1).count():
            raise ValueError("the calls hold a cycle")
        done = ready if done is None else done.unionAll(ready)
        left = cut(left.join(ready, "id", "left_anti"), "topo-left")
        e = cut(e.join(ready.select(F.col("id").alias("dst")), "dst", "left_anti"), "topo")
        level += 1
    return done


def topology(graph: Graph, types: list[str] | None = None) -> DataFrame:
    """One row: nodes, edges, sccs, mean_scc."""
    scc = strongly_connected(graph.nodes.select("id"), graph.of(types))
    by = scc.groupBy("scc").agg(F.count("*").alias("n"))
    return by.agg(F.sum("n").alias("nodes"), F.count("*").alias("sccs"), F.avg("n").alias("mean_scc")).join(graph.of(types).agg(F.count("*").alias("edges")), F.lit(True)).select("nodes", "edges", "sccs", "mean_scc")
