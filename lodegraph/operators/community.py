"""Communities: label propagation, modularity, roll-ups, labels; packages and the order to migrate them in."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodegraph.operators.iterate import KERNEL_EDGES, cut, kernel, small
from lodegraph.operators.model import COMMUNITY_EDGES, Graph, prop

SWEEPS = 20
#: Hubs: more than so many deviations above the mean degree, at most this share, from so many nodes on.
HUB_DEVIATIONS, HUB_SHARE, HUB_NODES = 2.0, 0.05, 20


def _sequential(sweeps: int):
    """Labels change one node after another in order of id; ties go to the heaviest neighbour's label, then the smaller."""

    def run(edges: pd.DataFrame, nodes: pd.DataFrame) -> pd.DataFrame:
        ids = nodes["id"].to_numpy()
        n = len(ids)
        a, b = np.searchsorted(ids, edges["src"]), np.searchsorted(ids, edges["dst"])
        near: list[set[int]] = [set() for _ in range(n)]
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            if x != y:
                near[x].add(y)
                near[y].add(x)
        # a node's weight in ties: its PageRank over the same edges
        out = np.bincount(a, minlength=n)
        rank = np.full(n, 1 / max(1, n))
        for _ in range(20):
            got = np.bincount(b, rank[a] / out[a], minlength=n) if len(a) else np.zeros(n)
            rank = 0.15 / n + 0.85 * (got + rank[out == 0].sum() / n)
        degree = np.array([len(s) for s in near])
        hubs: set[int] = set()
        part = degree[degree > 0]
        if n >= HUB_NODES and len(part):
            most = part.mean() + HUB_DEVIATIONS * part.std()
            over = np.argsort(-degree, kind="stable")
            hubs = set(over[degree[over] > most][: int(HUB_SHARE * n)].tolist())
        label = list(range(n))
        for _ in range(sweeps):
            changed = False
            for v in range(n):
                if v in hubs:
                    continue
                votes: dict[int, list[float]] = {}
                for u in near[v]:
                    if u not in hubs:
                        w = votes.setdefault(label[u], [0, 0.0])
                        w[0] += 1
                        w[1] = max(w[1], rank[u])
                if votes:
                    best = min(votes, key=lambda c: (-votes[c][0], -votes[c][1], c))
                    if best != label[v]:
                        label[v], changed = best, True
            if not changed:
                break
        hub_label = int(ids.max()) + 1 if n else 0
        return pd.DataFrame({"id": ids, "community_id": [hub_label if v in hubs else int(ids[label[v]]) for v in range(n)], "hub": [v in hubs for v in range(n)]})

    return run


def propagate(graph: Graph, types: list[str] | None = None, sweeps: int = SWEEPS, synchronous: bool = False) -> DataFrame:
    """(id, community_id, hub): one node after another, or all nodes at once in rounds if synchronous.

    The two give different labels, so the caller names the one that is wanted and the size of the
    graph never chooses: the sequential order has no distributed form and is an error beyond
    KERNEL_EDGES edges. The synchronous rounds have no hubs and take the smallest of equal labels.
    """
    edges = graph.of(COMMUNITY_EDGES if types is None else types)
    if not synchronous:
        if not small(edges):
            raise ValueError(f"sequential label propagation takes {KERNEL_EDGES} edges at most; ask for synchronous=True")
        return kernel(edges, graph.nodes.select("id"), _sequential(sweeps), "id long, community_id long, hub boolean")
    return synchronous_labels(graph.nodes.select("id").distinct(), edges, sweeps)


def synchronous_labels(nodes: DataFrame, edges: DataFrame, sweeps: int = SWEEPS) -> DataFrame:
    """All nodes take the most frequent label of their neighbours and themselves at once, the smallest of equals."""
    both = edges.filter("src <> dst").select("src", "dst").union(edges.filter("src <> dst").select("dst", "src")).distinct()
    both = cut(both.union(nodes.select(F.col("id").alias("src"), F.col("id").alias("dst"))), "lpa-edges")
    state = cut(nodes.select("id", F.col("id").alias("community_id")), "lpa")
    for _ in range(sweeps):
        votes = both.join(state.select(F.col("id").alias("dst"), "community_id"), "dst").groupBy(F.col("src").alias("id"), "community_id").agg(F.count("*").alias("n"))
        best = votes.groupBy("id").agg(F.max_by("community_id", F.struct("n", -F.col("community_id"))).alias("c"))
        new = cut(state.join(best, "id").select("id", F.col("c").alias("community_id"), (F.col("c") != F.col("community_id")).alias("more")), "lpa")
        state = new.select("id", "community_id")
        if not new.filter("more").limit(1).count():
            break
    return state.withColumn("hub", F.lit(False))


def modularity(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """One row (modularity): sum over communities of inner / m - (degree / 2m)**2, parallel edges counted."""
    a, b = labels.select(F.col("id").alias("src"), F.col("community_id").alias("a")), labels.select(F.col("id").alias("dst"), F.col("community_id").alias("b"))
    placed = edges.select("src", "dst").join(a, "src").join(b, "dst")
    ends = placed.select(F.col("a").alias("c"), (F.col("a") == F.col("b")).cast("long").alias("inner"), F.lit(1).alias("d")).unionAll(placed.select(F.col("b").alias("c"), F.lit(0).cast("long").alias("inner"), F.lit(1).alias("d")))
    by = ends.groupBy("c").agg(F.sum("inner").alias("inner"), F.sum("d").cast("double").alias("d"))
    m = F.sum("d") / 2
    total = by.agg(m.alias("m"), F.sum("inner").alias("inner"), F.sum(F.col("d") * F.col("d")).alias("dd"))
    return total.select(F.when(F.col("m") > 0, F.col("inner") / F.col("m") - F.col("dd") / (4 * F.col("m") * F.col("m"))).otherwise(0.0).alias("modularity"))


def rollup(nodes: DataFrame, labels: DataFrame, least: int = 2) -> DataFrame:
    """(community_id, size, primary_type, mean_complexity) of communities of at least two; the mean is over members that have one."""
    rows = labels.join(nodes.select("id", "node_type", prop("cyclomatic").try_cast("double").alias("cx")), "id")
    by_type = rows.groupBy("community_id", "node_type").agg(F.count("*").alias("n"), F.sum("cx").alias("cx"), F.count("cx").alias("has"))
    by = by_type.groupBy("community_id").agg(F.sum("n").alias("size"), F.min_by("node_type", F.struct(-F.col("n"), "node_type")).alias("primary_type"), (F.sum("cx") / F.nullif(F.sum("has"), F.lit(0))).alias("mean_complexity"))
    return by.filter(F.col("size") >= least)


def package():
    """A node's package from its path: after /java/ the folders with dots, after /src/ the folders, else the folder, else root."""
    path = F.regexp_replace("file_path", r"\\", "/")
    folder = F.regexp_extract(path, r"^(.*)/[^/]*$", 1)
    java, src = F.regexp_extract(folder, r"(?:^|/)java/(.+)$", 1), F.regexp_extract(folder, r"(?:^|/)src/(.+)$", 1)
    return F.when(path.isNull(), "root").when(java != "", F.replace(java, F.lit("/"), F.lit("."))).when(src != "", src).when(folder != "", F.regexp_extract(folder, r"([^/]+)$", 1)).otherwise("root")


def community_labels(nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """(community_id, label): the package of a third of the members or more, else the folder of most; repeats get a number."""
    rows = labels.join(nodes.select("id", package().alias("p")), "id").groupBy("community_id", "p").agg(F.count("*").alias("n"))
    best = rows.groupBy("community_id").agg(F.min_by("p", F.struct(-F.col("n"), "p")).alias("p"), F.max("n").alias("n"), F.sum("n").alias("size"))
    named = best.select("community_id", F.when(F.col("n") * 3 >= F.col("size"), F.col("p")).otherwise(F.concat(F.lit("mixed "), "p")).alias("base"))
    rank = F.row_number().over(Window.partitionBy(F.lower("base")).orderBy("community_id"))
    return named.withColumn("k", rank).select("community_id", F.when(F.col("k") == 1, F.col("base")).otherwise(F.concat("base", F.lit(" ("), "k", F.lit(")"))).alias("label"))


def packages(nodes: DataFrame, metrics: DataFrame, keep: int = 255) -> DataFrame:
    """(package, members, pagerank_sum, pagerank_mean, blast_max), the smallest packages beyond keep as (other)."""
    rows = nodes.select("id", package().alias("package")).join(metrics, "id", "left")
    by = rows.groupBy("package").agg(F.count("*").alias("members"), F.sum(F.coalesce("pagerank", F.lit(0.0))).alias("pr"), F.max(F.coalesce("blast", F.lit(0.0))).alias("blast"))
    total = by.count()
    if total > keep + 1:
        rank = F.row_number().over(Window.orderBy(F.desc("members"), "package"))
        by = by.withColumn("rank", rank).groupBy(F.when(F.col("rank") <= keep, F.col("package")).otherwise("(other)").alias("package")).agg(F.sum("members").alias("members"), F.sum("pr").alias("pr"), F.max("blast").alias("blast"))
    return by.select("package", "members", F.col("pr").alias("pagerank_sum"), (F.col("pr") / F.col("members")).alias("pagerank_mean"), F.col("blast").alias("blast_max"))


def package_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(source, target, weight): calls between different packages."""
    p = nodes.select("id", package().alias("p"))
    joined = edges.select("src", "dst").join(p.select(F.col("id").alias("src"), F.col("p").alias("source")), "src").join(p.select(F.col("id").alias("dst"), F.col("p").alias("target")), "dst")
    return joined.filter("source <> target").groupBy("source", "target").agg(F.count("*").alias("weight"))


# Weights of PageRank, harmonic centrality and blast by preset.
PRESETS = {"balanced": (0.4, 0.3, 0.3), "foundation": (0.6, 0.3, 0.1), "safe": (0.2, 0.2, 0.6)}


def migration_scores(groups: DataFrame, alpha: float = 0.4, beta: float = 0.3, gamma: float = 0.3) -> DataFrame:
    """groups (community_id, pagerank, harmonic, blast) with score and rank; each figure scaled to 0..1, a constant one is 0.5."""
    figures = ["pagerank", "harmonic", "blast"]
    ends = groups.agg(*(f(c).alias(f"{n}_{c}") for c in figures for n, f in (("lo", F.min), ("hi", F.max))))
    rows = groups.join(F.broadcast(ends), F.lit(True))  # one row
    scaled = {c: F.when(F.col(f"hi_{c}") == F.col(f"lo_{c}"), 0.5).otherwise((F.col(c) - F.col(f"lo_{c}")) / (F.col(f"hi_{c}") - F.col(f"lo_{c}"))) for c in figures}
    rows = rows.withColumn("score", alpha * scaled["pagerank"] + beta * scaled["harmonic"] - gamma * scaled["blast"])
    return rows.select("community_id", *figures, "score", F.row_number().over(Window.orderBy(F.desc("score"), "community_id")).alias("priority_rank"))


#: Packages a schedule may hold: the macro graph keeps 256 at most.
MOST_PACKAGES = 256


def migration_schedule(scored: DataFrame, edges: DataFrame) -> list[tuple[int, int]]:
    """(step, community_id): what others call comes first, the highest score among what is ready; cycles last by score."""
    rows = scored.select("community_id", "score").limit(MOST_PACKAGES + 1).collect()
    if len(rows) > MOST_PACKAGES:
        raise ValueError("roll packages up first")
    score = {r["community_id"]: r["score"] for r in rows}
    pairs = {(r["source"], r["target"]) for r in edges.select("source", "target").distinct().limit(MOST_PACKAGES**2).collect() if r["source"] != r["target"]}
    waits = {c: 0 for c in score}
    for source, target in pairs:
        if source in waits and target in waits:
            waits[source] += 1
    ready = [(-score[c], c) for c, k in waits.items() if not k]
    heapq.heapify(ready)
    order = []
    while ready:
        _, c = heapq.heappop(ready)
        order.append(c)
        for source, target in pairs:
            if target == c and source in waits:
                waits[source] -= 1
                if not waits[source]:
                    heapq.heappush(ready, (-score[source], source))
    order += sorted((c for c in score if c not in set(order)), key=lambda c: (-score[c], c))
    return [(k + 1, c) for k, c in enumerate(order)]


def complexity_level(cx):
    return F.when(cx <= 5, "Low").when(cx <= 10, "Medium").when(cx <= 20, "High").otherwise("Critical")


def complexity(nodes: DataFrame) -> DataFrame:
    """(id, cyclomatic, cognitive, loc, level) of functions; missing: 1, the cyclomatic, 0."""
    cx = F.coalesce(prop("cyclomatic").try_cast("int"), F.lit(1))
    rows = nodes.filter("node_type = 'Function'").select("id", cx.alias("cyclomatic"), F.coalesce(prop("cognitive").try_cast("int"), cx).alias("cognitive"), F.coalesce(prop("loc").try_cast("int"), F.lit(0)).alias("loc"))
    return rows.withColumn("level", complexity_level(F.col("cyclomatic")))


def complexity_report(nodes: DataFrame, above: int | None = None) -> DataFrame:
    """(level, functions, mean, most) by level; above keeps functions of strictly more."""
    rows = complexity(nodes)
    rows = rows.filter(F.col("cyclomatic") > above) if above is not None else rows
    return rows.groupBy("level").agg(F.count("*").alias("functions"), F.avg("cyclomatic").alias("mean"), F.max("cyclomatic").alias("most"))
