"""What a user asks of a whole graph: symbols by name, status, checks of changes, paging, overview tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodegraph.operators import community, policy, ranking, reach
from lodegraph.operators.model import Graph, prop


class NotFound(LookupError):
    """No symbol of that name."""


class Ambiguous(LookupError):
    """Several symbols of that name."""


def symbol(graph: Graph, text: str, of_class: str | None = None, of_file: str | None = None) -> int:
    """The id of one function: by id, path::name, Class::name, a qualified name's end, or its name."""
    n = graph.nodes.filter("node_type = 'Function'")
    if re.fullmatch(r"-?\d+", text):
        n = graph.nodes.filter(F.col("id") == int(text))
    else:
        parts = re.split(r"::", text)
        if len(parts) > 1 and ("/" in parts[0] or re.search(r"\.\w{1,4}$", parts[0])):
            of_file, parts = parts[0], parts[1:]
        q = F.replace(F.coalesce("qualified_name", "name"), F.lit("::"), F.lit("."))
        wanted = ".".join(parts)
        n = n.filter((F.col("name") == wanted) | (q == wanted) | F.endswith(q, F.lit("." + wanted)))
    if of_class:
        n = n.filter(F.contains(F.concat(F.lit("."), F.replace(F.coalesce("qualified_name", "name"), F.lit("::"), F.lit("."))), F.lit(f".{of_class}.")))
    if of_file:
        n = n.filter((F.col("file_path") == of_file) | F.endswith("file_path", F.lit("/" + of_file)))
    got = n.select("id").distinct().limit(2).collect()
    if not got:
        raise NotFound(text)
    if len(got) > 1:
        raise Ambiguous(text)
    return got[0]["id"]


def blast(graph: Graph, text: str, closure: DataFrame | None = None, depth: int | None = None) -> DataFrame:
    """(id) of what a symbol's change may touch: from a stored closure (scc, reached_by, id, scc_of) or by walking back."""
    target = symbol(graph, text)
    if closure is not None and depth is None:
        own = closure.filter(F.col("id") == target).select("scc")
        return closure.join(own, "scc", "left_semi").select(F.col("member").alias("id")).filter(F.col("id") != target).distinct()
    seed = graph.nodes.filter(F.col("id") == target).select(F.col("id").alias("seed"), "id")
    return reach.bfs(seed, graph.of(["Calls"]), depth).filter("depth > 0").select("id").filter(F.col("id") != target).distinct()


def closure_table(graph: Graph) -> DataFrame:
    """(id, scc, member) for blast(): every node's component with the members that reach it."""
    e = graph.of(["Calls"]).distinct()
    scc = reach.strongly_connected(graph.nodes.select("id"), e)
    every = reach.closure(reach.condensation(scc, e), scc.select("scc").distinct())
    members = every.join(scc.select(F.col("scc").alias("reached_by"), F.col("id").alias("member")), "reached_by").select("scc", "member")
    return scc.join(members, "scc").select("id", "scc", "member")


def check(graph: Graph, changed_files: DataFrame | None, forbidden: list[tuple[str, str]] = (), max_impact: int | None = None, max_centrality: float | None = None) -> DataFrame:
    """Violations of functions in changed files (file_path), of all functions without them."""
    fns = graph.nodes.filter("node_type = 'Function'")
    targets = fns.join(changed_files.select("file_path").distinct(), "file_path", "left_semi") if changed_files is not None else fns
    zone = reach.bfs(targets.select(F.col("id").alias("seed"), "id"), graph.of(["Calls"])).filter("depth > 0 and seed <> id").select(F.col("seed").alias("id"), F.col("id").alias("member"))
    central = ranking.betweenness(graph).join(targets.select("id"), "id", "left_semi") if max_centrality is not None else graph.nodes.select("id", F.lit(0.0).alias("betweenness")).limit(0)
    return policy.violations(zone, central, graph.nodes.select("id", prop("domain").alias("domain")), list(forbidden), max_impact, max_centrality)


def status(graph: Graph) -> DataFrame:
    """(kind, type, n): numbers of nodes and edges by type."""
    n = graph.nodes.groupBy(F.lit("node").alias("kind"), F.col("node_type").alias("type")).agg(F.count("*").alias("n"))
    return n.unionAll(graph.edges.groupBy(F.lit("edge").alias("kind"), F.col("edge_type").alias("type")).agg(F.count("*").alias("n")))


def function(graph: Graph, text: str) -> DataFrame:
    """(relation, id, name): a function's callers and callees."""
    t = symbol(graph, text)
    near = graph.edges.filter("edge_type = 'Calls'").filter((F.col("src") == t) | (F.col("dst") == t))
    rows = near.select(F.when(F.col("src") == t, "calls").otherwise("called_by").alias("relation"), F.when(F.col("src") == t, F.col("dst")).otherwise(F.col("src")).alias("id")).distinct()
    return rows.join(graph.nodes.select("id", "name"), "id").select("relation", "id", "name")


#: Rows of one page at most.
PAGE = 500


def page(graph: Graph, types: list[str] | None = None, offset: int = 0, limit: int = PAGE) -> DataFrame:
    """Nodes in order of id, some types only, PAGE at most from an offset on."""
    n = graph.nodes if types is None else graph.nodes.filter(F.col("node_type").isin(types))
    return n.orderBy("id").offset(offset).limit(min(limit, PAGE))


def among(graph: Graph, ids: DataFrame) -> DataFrame:
    """Calls whose both ends are among ids."""
    k = ids.select("id").distinct()
    return graph.edges.filter("edge_type = 'Calls'").join(k.select(F.col("id").alias("src")), "src", "left_semi").join(k.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst")


def batches(df: DataFrame, size: int = 1000):
    """Rows in lists of size, a partition at a time on the driver."""
    held = []
    for r in df.toLocalIterator():
        held.append(r)
        if len(held) == size:
            yield held
            held = []
    if held:
        yield held


def overview(graph: Graph) -> dict[str, DataFrame]:
    """The tables of an overview: packages with a place on a circle, their calls, functions with metrics, communities, complexity."""
    ranks = ranking.pagerank(graph)
    blast_all = reach.blast_scc(graph)
    metrics = ranks.join(blast_all.select("id", F.col("score").alias("blast"), "impact_zone"), "id")
    fns = graph.nodes.filter(F.col("node_type").isin("Function", "Class"))
    packages = community.packages(fns, metrics)
    k = F.row_number().over(Window.orderBy("package")) - 1
    total = packages.agg(F.count("*").alias("total"))
    placed = packages.withColumn("k", k).join(F.broadcast(total), F.lit(True))  # one row
    angle = 2 * F.pi() * F.col("k") / F.col("total")
    placed = placed.select(*packages.columns, F.cos(angle).alias("x"), F.sin(angle).alias("y"))
    labels = community.propagate(graph)
    return {
        "packages": placed, "package_calls": community.package_edges(fns, graph.of(["Calls"])),
        "functions": fns.filter("node_type = 'Function'").select("id", "name", "file_path").join(metrics, "id"),
        "communities": community.rollup(graph.nodes, labels), "complexity": community.complexity_report(graph.nodes),
        "files": graph.nodes.filter("node_type = 'File'").select("id", "file_path", "code_hash"),
    }


def write_overview(graph: Graph, path: str) -> None:
    """Each table as JSON lines in a folder of its name."""
    for name, table in overview(graph).items():
        table.write.json(f"{path}/{name}")
