"""Subgraph selection and text exports: JSON, GraphML, DOT, Mermaid, interface definitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.functions import text as T
from lodegraph.operators import reach
from lodegraph.operators.model import EDGE_SCHEMA, NODE_SCHEMA, Graph, edge_table, node_table, prop
from lodegraph.plans import dsl

EXPORT_EDGES = ["Calls", "Contains", "Uses"]


def subgraph(graph: Graph, query: str, depth: int) -> Graph:
    """Nodes within depth undirected steps of the filter's matches, and all edges among them."""
    seeds = dsl.run(graph.nodes, query).select(F.lit(0).alias("seed"), "id")
    e = graph.of(EXPORT_EDGES)
    near = reach.bfs(seeds, e.union(e.select("dst", "src")), depth, backward=False).select("id").distinct()
    inside = graph.edges.join(near.select(F.col("id").alias("src")), "src", "left_semi").join(near.select(F.col("id").alias("dst")), "dst", "left_semi")
    return Graph(graph.nodes.join(near, "id", "left_semi"), inside.select(*graph.edges.columns))


def write_table(graph: Graph, path: str) -> dict:
    """The graph as Parquet, edges in folders by type; gives counts and an order-free digest."""
    graph.nodes.write.parquet(f"{path}/nodes")
    graph.edges.write.partitionBy("edge_type").parquet(f"{path}/edges")
    return digest(graph)


def read_table(spark: SparkSession, path: str) -> Graph:
    return Graph(spark.read.schema(NODE_SCHEMA).parquet(f"{path}/nodes"), edge_table(spark.read.parquet(f"{path}/edges")))


def digest(graph: Graph) -> dict:
    """Numbers of nodes and edges and a digest: xor and sum of row hashes, so that a row held twice counts; maps enter as sorted entries."""

    def of(df: DataFrame) -> tuple[int, str]:
        cols = [F.to_json(F.array_sort(F.map_entries(c))) if k.startswith("map") else F.to_json(c) if k.startswith(("array", "struct")) else F.col(c) for c, k in df.dtypes]
        r = df.select(F.xxhash64(*cols).alias("h")).agg(F.count("*").alias("n"), F.bit_xor("h").alias("x"), F.sum(F.col("h").cast("decimal(38,0)")).alias("s")).first()
        return r["n"], f"{(r['x'] or 0) & (1 << 64) - 1:016x}{int(r['s'] or 0) & (1 << 64) - 1:016x}"

    (n, a), (m, b) = of(graph.nodes), of(graph.edges)
    return {"nodes": n, "edges": m, "digest": a + b}


def json_lines(graph: Graph) -> DataFrame:
    """(value): one JSON object for each node and edge, with its kind."""
    n = graph.nodes.select(F.to_json(F.struct(F.lit("node").alias("kind"), *graph.nodes.columns)).alias("value"))
    return n.unionAll(graph.edges.select(F.to_json(F.struct(F.lit("edge").alias("kind"), *graph.edges.columns)).alias("value")))


def read_json_lines(spark: SparkSession, path: str) -> Graph:
    raw = spark.read.text(path)
    kind = F.get_json_object("value", "$.kind")
    pick = lambda name, schema: raw.filter(kind == name).select(F.from_json("value", schema).alias("r")).select("r.*")
    return Graph(node_table(pick("node", NODE_SCHEMA)), edge_table(pick("edge", EDGE_SCHEMA)))


def read_json(spark: SparkSession, path: str) -> Graph:
    """One document {version, schema_version, nodes, edges}."""
    doc = spark.read.schema(f"version string, schema_version int, nodes array<struct<{_fields(NODE_SCHEMA)}>>, edges array<struct<{_fields(EDGE_SCHEMA)}>>").json(path, multiLine=True)
    return Graph(node_table(doc.select(F.inline("nodes"))), edge_table(doc.select(F.inline("edges"))))


def _fields(schema: str) -> str:
    from pyspark.sql.types import StructType

    return ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in StructType.fromDDL(schema))


def graphml(graph: Graph) -> DataFrame:
    """(part, value): the lines of a GraphML document; part orders header, nodes, edges and footer."""
    spark = graph.nodes.sparkSession
    head = ['<?xml version="1.0" encoding="UTF-8"?>', '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">'] + [f'<key id="{k}" for="{f}" attr.name="{k}" attr.type="string"/>' for k, f in (("name", "node"), ("type", "node"), ("file", "node"), ("cyclomatic", "node"), ("kind", "edge"))] + ['<graph id="G" edgedefault="directed">']
    data = lambda key, col: F.when(col.isNull(), "").otherwise(F.concat(F.lit(f'<data key="{key}">'), T.xml(col), F.lit("</data>")))
    n = graph.nodes.select(F.lit(1).alias("part"), F.concat(F.lit('<node id="n'), F.col("id").cast("string"), F.lit('">'), data("name", F.col("name")), data("type", F.col("node_type")), data("file", F.col("file_path")), data("cyclomatic", prop("cyclomatic")), F.lit("</node>")).alias("value"))
    e = graph.edges.select(F.lit(2).alias("part"), F.concat(F.lit('<edge source="n'), F.col("src").cast("string"), F.lit('" target="n'), F.col("dst").cast("string"), F.lit('">'), data("kind", F.col("edge_type")), F.lit("</edge>")).alias("value"))
    ends = spark.createDataFrame([(0, "\n".join(head)), (3, "</graph>\n</graphml>")], "part int, value string")
    return ends.unionAll(n).unionAll(e)


# Shapes and colours of the drawn node types, line styles of the edge types.
SHAPES = {"Function": ("ellipse", "lightblue"), "Class": ("box", "lightyellow"), "Struct": ("box", "lightyellow"), "Module": ("folder", "lightgrey"), "File": ("note", "white")}
STYLES = {"Calls": "solid", "Contains": "dashed", "Uses": "dotted"}


def dot(graph: Graph, layout: str = "dot", rankdir: str = "LR") -> DataFrame:
    """(part, value): the lines of a DOT document."""
    spark = graph.nodes.sparkSession
    shape = T.mapped(F.col("node_type"), {k: v[0] for k, v in SHAPES.items()}, "ellipse")
    colour = T.mapped(F.col("node_type"), {k: v[1] for k, v in SHAPES.items()}, "white")
    n = graph.nodes.select(F.lit(1).alias("part"), F.concat(F.lit("  n"), F.col("id").cast("string"), F.lit(' [label="'), T.quoted(F.coalesce("name", F.lit(""))), F.lit('", shape='), shape, F.lit(', style=filled, fillcolor="'), colour, F.lit('"];')).alias("value"))
    e = graph.edges.select(F.lit(2).alias("part"), F.concat(F.lit("  n"), F.col("src").cast("string"), F.lit(" -> n"), F.col("dst").cast("string"), F.lit(' [label="'), "edge_type", F.lit('", style='), T.mapped(F.col("edge_type"), STYLES, "solid"), F.lit("];")).alias("value"))
    ends = spark.createDataFrame([(0, f"digraph G {{\n  layout={layout};\n  rankdir={rankdir};"), (3, "}")], "part int, value string")
    return ends.unionAll(n).unionAll(e)


def mermaid(graph: Graph, kind: str = "flowchart") -> DataFrame:
    """(part, value): a flowchart, class diagram or call graph."""
    spark = graph.nodes.sparkSession
    nodes, edges = graph.nodes, graph.edges
    if kind == "callgraph":
        nodes, edges = nodes.filter("node_type = 'Function'"), edges.filter("edge_type = 'Calls'")
    node_id = lambda c: F.concat(F.lit("n"), F.replace(F.col(c).cast("string"), F.lit("-"), F.lit("m")))
    if kind == "class":
        n = nodes.filter(F.col("node_type").isin("Class", "Struct", "Interface", "Enum")).select(F.lit(1).alias("part"), F.concat(F.lit("  class "), node_id("id"), F.lit('["'), T.quoted(F.coalesce("name", F.lit(""))), F.lit('"]')).alias("value"))
        e = edges.filter(F.col("edge_type").isin("Extends", "Implements")).select(F.lit(2).alias("part"), F.concat(F.lit("  "), node_id("dst"), F.when(F.col("edge_type") == "Extends", " <|-- ").otherwise(" <|.. "), node_id("src")).alias("value"))
        head = "classDiagram"
    else:
        n = nodes.select(F.lit(1).alias("part"), F.concat(F.lit("  "), node_id("id"), F.lit('["'), F.replace(T.quoted(F.coalesce("name", F.lit(""))), F.lit('\\"'), F.lit("#quot;")), F.lit('"]')).alias("value"))
        e = edges.select(F.lit(2).alias("part"), F.concat(F.lit("  "), node_id("src"), F.lit(" -->|"), "edge_type", F.lit("| "), node_id("dst")).alias("value"))
        head = "flowchart LR"
    return spark.createDataFrame([(0, head)], "part int, value string").unionAll(n).unionAll(e)


def write_lines(lines: DataFrame, path: str) -> None:
    """One text document in order of its parts; the parts of a drawing are small by their nature."""
    lines.orderBy("part", "value").select("value").coalesce(1).write.text(path)


def cpg(graph: Graph, data: DataFrame | None = None, writes: DataFrame | None = None, path_filter: str | None = None) -> Graph:
    """The graph with data dependences and field writes as further edges, for paths that contain a text."""
    nodes = graph.nodes.filter(F.contains("file_path", F.lit(path_filter))) if path_filter else graph.nodes
    edges = graph.edges
    if data is not None:
        edges = edges.unionByName(edge_table(data.select(F.col("src"), F.col("dst"), F.lit("DATA_FLOW").alias("edge_type"), F.create_map(F.lit("variable"), "variable").alias("properties"))))
    if writes is not None:
        edges = edges.unionByName(edge_table(writes.select("src", "dst", F.lit("Modifies").alias("edge_type"), F.create_map(F.lit("member"), "member").alias("properties"))))
    keep = nodes.select("id")
    edges = edges.join(keep.select(F.col("id").alias("src")), "src", "left_semi").join(keep.select(F.col("id").alias("dst")), "dst", "left_semi").select(*graph.edges.columns)
    return Graph(nodes, edges)


def interface(nodes: DataFrame, dialect: str) -> DataFrame:
    """(id, value): each function's signature as Proto, Thrift or OpenAPI text."""
    kind = lambda c: T.idl_type(T.common_type(c), dialect)
    params = F.coalesce("parameters", F.array().cast("array<struct<name:string,param_type:string,default_value:string>>"))
    returns = kind(F.coalesce("return_type", F.lit("")))
    if dialect == "proto":
        fields = F.concat_ws(" ", F.transform(params, lambda p, i: F.concat(kind(F.coalesce(p["param_type"], F.lit(""))), F.lit(" "), p["name"], F.lit(" = "), (i + 1).cast("string"), F.lit(";"))))
        value = F.concat(F.lit("message "), "name", F.lit("Request { "), fields, F.lit(" } message "), "name", F.lit("Response { "), returns, F.lit(" result = 1; } rpc "), "name", F.lit("("), "name", F.lit("Request) returns ("), "name", F.lit("Response);"))
    elif dialect == "thrift":
        fields = F.concat_ws(", ", F.transform(params, lambda p, i: F.concat((i + 1).cast("string"), F.lit(": "), kind(F.coalesce(p["param_type"], F.lit(""))), F.lit(" "), p["name"])))
        value = F.concat(returns, F.lit(" "), "name", F.lit("("), fields, F.lit(")"))
    elif dialect == "openapi":
        fields = F.concat_ws(", ", F.transform(params, lambda p: F.concat(F.lit('"'), p["name"], F.lit('": {"type": "'), kind(F.coalesce(p["param_type"], F.lit(""))), F.lit('"}'))))
        value = F.concat(F.lit('{"/'), "name", F.lit('": {"post": {"properties": {'), fields, F.lit('}, "returns": "'), returns, F.lit('"}}}'))
    else:
        raise ValueError(f"unknown dialect {dialect!r}")
    return nodes.filter("node_type = 'Function'").select("id", value.alias("value"))
