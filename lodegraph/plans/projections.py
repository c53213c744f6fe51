"""Graphs that are deterministic functions of the shared tables, in Spark and as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodegraph.operators.model import Graph, edge_table, node_table


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# P1: parts as functions; consecutive large lines of one order as calls -----------------------------------------

P1_NODES_SQL = """
select cast(p_partkey as bigint) as id, 'Function' as node_type, 'part_' || p_partkey as name, p_name as display,
       'app/src/' || p_type || '/' || p_brand || '/m.rs' as file_path, p_brand as return_type,
       'fn part_' || p_partkey || '(x: ' || p_type || ') -> ' || p_brand as signature,
       cast(p_size as integer) as cyclomatic, p_type as repo, p_brand as brand from part"""


def p1_edges_sql(q: int) -> str:
    return f"""
select distinct src, dst from (
  select l_partkey as src, lead(l_partkey) over (partition by l_orderkey order by l_linenumber, l_partkey) as dst
  from lineitem where l_quantity >= {q}) t where dst is not null and src <> dst"""


def p1_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return node_table(p.select(
        F.col("p_partkey").cast("long").alias("id"), F.lit("Function").alias("node_type"), F.concat(F.lit("part_"), "p_partkey").alias("name"), F.col("p_name").alias("qualified_name"),
        F.concat(F.lit("fn part_"), "p_partkey", F.lit("(x: "), "p_type", F.lit(") -> "), "p_brand").alias("signature"), F.col("p_brand").alias("return_type"),
        F.concat(F.lit("app/src/"), "p_type", F.lit("/"), "p_brand", F.lit("/m.rs")).alias("file_path"),
        F.create_map(F.lit("cyclomatic"), F.col("p_size").cast("string"), F.lit("repo"), F.col("p_type"), F.lit("module"), F.col("p_type")).alias("properties"), F.array("p_brand", "p_type").alias("labels"),
    ))


def p1_edges(spark: SparkSession, sf_dir: str, q: int) -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")
    pairs = table(spark, sf_dir, "lineitem").filter(F.col("l_quantity") >= q).select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(w).alias("dst"))
    return edge_table(pairs.filter("dst is not null and src <> dst").distinct().withColumn("edge_type", F.lit("Calls")))


def p1(spark: SparkSession, sf_dir: str, q: int) -> Graph:
    return Graph(p1_nodes(spark, sf_dir), p1_edges(spark, sf_dir, q))


# P2: the schema itself as a typed graph ------------------------------------------------------------------------

# Id offsets of the node kinds.
OFFSET = {"region": 0, "nation": 1000, "supplier": 1_000_000_000, "customer": 2_000_000_000, "part": 3_000_000_000, "orders": 4_000_000_000}
_KINDS = [("region", "r_regionkey", "r_name", "Module"), ("nation", "n_nationkey", "n_name", "File"), ("supplier", "s_suppkey", "s_name", "Struct"), ("customer", "c_custkey", "c_name", "Class"), ("part", "p_partkey", "p_name", "Function")]

P2_NODES_SQL = " union all ".join(f"select {OFFSET[t]} + {k} as id, '{kind}' as node_type, cast({n} as varchar) as name, '{t}' as repo from {t}" for t, k, n, kind in _KINDS) + f" union all select {OFFSET['orders']} + o_orderkey, 'Job', 'order_' || o_orderkey, 'orders' from orders"
P2_EDGES_SQL = f"""
select {OFFSET['region']} + n_regionkey as src, {OFFSET['nation']} + n_nationkey as dst, 'Contains' as edge_type from nation
union all select {OFFSET['nation']} + c_nationkey, {OFFSET['customer']} + c_custkey, 'Contains' from customer
union all select {OFFSET['nation']} + s_nationkey, {OFFSET['supplier']} + s_suppkey, 'Contains' from supplier
union all select {OFFSET['customer']} + o_custkey, {OFFSET['orders']} + o_orderkey, 'Instantiates' from orders
union all select distinct {OFFSET['orders']} + l_orderkey, {OFFSET['part']} + l_partkey, 'Uses' from lineitem
union all select distinct {OFFSET['supplier']} + l_suppkey, {OFFSET['part']} + l_partkey, 'DependsOn' from lineitem"""


def p2(spark: SparkSession, sf_dir: str) -> Graph:
    t = {n: table(spark, sf_dir, n) for n in ("region", "nation", "supplier", "customer", "part", "orders", "lineitem")}
    at = lambda kind, key: (F.lit(OFFSET[kind]).cast("long") + F.col(key).cast("long"))
    parts = [t[n].select(at(n, k).alias("id"), F.lit(kind).alias("node_type"), F.col(name).cast("string").alias("name"), F.create_map(F.lit("repo"), F.lit(n)).alias("properties")) for n, k, name, kind in _KINDS]
    parts.append(t["orders"].select(at("orders", "o_orderkey").alias("id"), F.lit("Job").alias("node_type"), F.concat(F.lit("order_"), "o_orderkey").alias("name"), F.create_map(F.lit("repo"), F.lit("orders")).alias("properties")))
    nodes = parts[0]
    for p in parts[1:]:
        nodes = nodes.unionByName(p)
    link = lambda df, a, b, kind: df.select(a.alias("src"), b.alias("dst"), F.lit(kind).alias("edge_type"))
    edges = link(t["nation"], at("region", "n_regionkey"), at("nation", "n_nationkey"), "Contains")
    for more in (
        link(t["customer"], at("nation", "c_nationkey"), at("customer", "c_custkey"), "Contains"),
        link(t["supplier"], at("nation", "s_nationkey"), at("supplier", "s_suppkey"), "Contains"),
        link(t["orders"], at("customer", "o_custkey"), at("orders", "o_orderkey"), "Instantiates"),
        link(t["lineitem"], at("orders", "l_orderkey"), at("part", "l_partkey"), "Uses").distinct(),
        link(t["lineitem"], at("supplier", "l_suppkey"), at("part", "l_partkey"), "DependsOn").distinct(),
    ):
        edges = edges.unionByName(more)
    return Graph(node_table(nodes), edge_table(edges))


# P3: users as functions; the next user of the same kind of event as a use -----------------------------------------

P3_NODES_SQL = "select distinct user_id as id from events"


def p3_edges_sql(kind: str) -> str:
    return f"""
select src, dst from (select user_id as src, lead(user_id) over (order by ts, event_id) as dst from events where event_type = '{kind}') t
where dst is not null and src <> dst"""


def p3(spark: SparkSession, sf_dir: str, kind: str) -> Graph:
    """Parallel edges stay. The order of all events of one kind has no key to part by, so days are numbered first."""
    e = table(spark, sf_dir, "events")
    rows = e.filter(F.col("event_type") == kind).select("ts", "event_id", "user_id", F.to_date("ts").alias("day"))
    w = Window.partitionBy("day").orderBy("ts", "event_id")
    inner = rows.select("day", "ts", "event_id", F.col("user_id").alias("src"), F.lead(F.struct("user_id")).over(w).alias("next"))  # a struct: a next event without a user is none, but is there
    # the last event of a day is followed by the first of the next day that has any: one row for each day
    first = rows.groupBy("day").agg(F.min_by("user_id", F.struct("ts", "event_id")).alias("first"))
    after = first.select("day", F.lead("first").over(Window.orderBy("day")).alias("next_first"))
    pairs = inner.join(F.broadcast(after), "day").select("src", F.when(F.col("next").isNull(), F.col("next_first")).otherwise(F.col("next.user_id")).alias("dst"))
    nodes = e.select(F.col("user_id").alias("id")).distinct().select("id", F.lit("Function").alias("node_type"), F.concat(F.lit("user_"), "id").alias("name"))
    return Graph(node_table(nodes), edge_table(pairs.filter("dst is not null and src <> dst").withColumn("edge_type", F.lit("Uses"))))


# P5: straight-line programs, a function for each order ---------------------------------------------------------------

P5_SQL = """
select l_orderkey as fn, cast(row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 as integer) as idx,
       'v' || (l_partkey % 7) as def, 'v' || (l_suppkey % 7) as use, l_returnflag as flag, l_linestatus as status from lineitem"""


def p5(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("fn"), (F.row_number().over(w) - 1).alias("idx"), F.concat(F.lit("v"), F.col("l_partkey") % 7).alias("def"), F.concat(F.lit("v"), F.col("l_suppkey") % 7).alias("use"),
        F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"))


def mock(spark: SparkSession, nodes: int, edges: int) -> Graph:
    """The benchmark's repository of functions: edge e goes from e mod n to (13 e + 7) mod n."""
    n = spark.range(nodes).select("id", F.lit("Function").alias("node_type"), F.concat(F.lit("n"), "id").alias("name"))
    e = spark.range(edges).select((F.col("id") % nodes).alias("src"), ((F.col("id") * 13 + 7) % nodes).alias("dst"), F.lit("Calls").alias("edge_type")).filter("src <> dst")
    return Graph(node_table(n), edge_table(e))
