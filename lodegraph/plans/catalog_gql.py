"""Registered pattern queries and filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodegraph.plans import dsl, gql
from lodegraph.plans import projections as P

Q = 42
N = f"n as ({P.P1_NODES_SQL})"
C = f"c as ({P.p1_edges_sql(Q)})"
N2, E2 = f"n as ({P.P2_NODES_SQL})", f"e as ({P.P2_EDGES_SQL})"
QUERIES: dict = {}
ORACLES: dict = {}


def _p1(name: str, text: str, sql: str) -> None:
    """A pattern query over P1: ids and names of the returned variables."""

    def run(spark, sf_dir):
        rows = gql.run(P.p1(spark, sf_dir, Q), text)
        return rows.select(*(c for v in gql.parse(gql.MACROS.get(text, text)).returns for c in (F.col(v).alias(f"{v}_id"), F.col(f"{v}_name"))))

    QUERIES[name], ORACLES[name] = run, sql


def _p2(name: str, text: str, sql: str) -> None:
    def run(spark, sf_dir):
        g = P.p2(spark, sf_dir)
        rows = gql.compile_query(g, gql.parse(text))
        return rows.select(*(F.col(c).alias(f"{c}_id") for c in rows.columns))

    QUERIES[name], ORACLES[name] = run, sql


_one = "select id as a_id, name as a_name from n where "
_p1("gql_node_match", "all_functions", f"with {N} select id as f_id, name as f_name from n where node_type = 'Function'")
_p1("gql_eq", "MATCH (a:Function) WHERE a.name = 'part_17' RETURN a", f"with {N} {_one} name = 'part_17'")
_p1("gql_inline_property", "MATCH (a:Function {cyclomatic: '7'}) RETURN a", f"with {N} {_one} cyclomatic = 7")
_p1("gql_two_conditions", "MATCH (a:Function) WHERE a.name = 'part_17' AND a.name = 'part_18' RETURN a", f"with {N} {_one} name = 'part_17' and name = 'part_18'")
_p1("gql_and", "MATCH (a:Function) WHERE a.name LIKE 'part_1*' AND a.return_type = 'Brand#11' RETURN a", f"with {N} {_one} starts_with(name, 'part_1') and return_type = 'Brand#11'")
_p1("gql_like_prefix", "MATCH (a:Function) WHERE a.name LIKE 'part_1*' RETURN a", f"with {N} {_one} starts_with(name, 'part_1')")
_p1("gql_like_suffix", "MATCH (a:Function) WHERE a.name LIKE '*9' RETURN a", f"with {N} {_one} ends_with(name, '9')")
_p1("gql_like_contains", "MATCH (a:Function) WHERE a.file_path LIKE '*Brand#1*' RETURN a", f"with {N} {_one} contains(file_path, 'Brand#1')")
_p1("gql_like_exact", "MATCH (a:Function) WHERE a.return_type LIKE 'Brand#11' RETURN a", f"with {N} {_one} return_type = 'Brand#11'")
_p1("gql_limit", "MATCH (a:Function) RETURN a LIMIT 7", f"with {N} select id as a_id, name as a_name from n order by id limit 7")
_two = "select a.id as a_id, a.name as a_name, b.id as b_id, b.name as b_name"
_p1("gql_hop1", "direct_calls", f"with {N}, {C} {_two} from c join n a on a.id = src join n b on b.id = dst")
_p1("gql_hop_var", "call_chain", f"with recursive {N}, {C}, w(s, e, d) as (select src, dst, 1 from c union select w.s, c.dst, w.d + 1 from w join c on w.e = c.src where w.d < 3) {_two} from w join n a on a.id = s join n b on b.id = e")
_p1("gql_hop_range", "MATCH (a:Function {cyclomatic: '7'})-[:CALLS*2..4]->(b:Function) RETURN a, b", f"with recursive {N}, {C}, w(s, e, d) as (select src, dst, 1 from c join n on n.id = src where cyclomatic = 7 union select w.s, c.dst, w.d + 1 from w join c on w.e = c.src where w.d < 4) {_two} from w join n a on a.id = s join n b on b.id = e where d >= 2")
_p1("gql_two_hops", "MATCH (a:Function)-[:CALLS]->(b:Function)-[:CALLS]->(d:Function) RETURN a, d", f"with {N}, {C} select a.id as a_id, a.name as a_name, d.id as d_id, d.name as d_name from c x join c y on x.dst = y.src join n a on a.id = x.src join n d on d.id = y.dst")
_p1("gql_cycle_close", "MATCH (a:Function)-[:CALLS]->(b:Function)-[:CALLS]->(d:Function)-[:CALLS]->(a) RETURN a, b", f"with {N}, {C} {_two} from c x join c y on x.dst = y.src join c z on z.src = y.dst and z.dst = x.src join n a on a.id = x.src join n b on b.id = x.dst")
_p2("gql_shared_var", "MATCH (c:Class)-[:INSTANTIATES]->(o:Job) (o:Job)-[:USES]->(p:Function) WHERE c.name LIKE '*7' RETURN c, p", f"with {N2}, {E2} select i.src as c_id, u.dst as p_id from e i join e u on u.src = i.dst and u.edge_type = 'Uses' join n c on c.id = i.src and ends_with(c.name, '7') where i.edge_type = 'Instantiates'")
_p2("gql_cross", "MATCH (r:Module) (f:File {repo: 'nation'}) RETURN r, f", f"with {N2} select r.id as r_id, f.id as f_id from n r, n f where r.node_type = 'Module' and f.node_type = 'File' and f.repo = 'nation'")
_p2("gql_typed_path", "MATCH (r:Module)-[:CONTAINS]->(f:File)-[:CONTAINS]->(s:Struct)-[:DEPENDSON]->(p:Function) WHERE r.name = 'ASIA' RETURN s, p", f"with {N2}, {E2} select x.dst as s_id, y.dst as p_id from n r join e z on z.src = r.id join e x on x.src = z.dst join n s on s.id = x.dst and s.node_type = 'Struct' join e y on y.src = s.id and y.edge_type = 'DependsOn' where r.name = 'ASIA' and z.edge_type = 'Contains' and x.edge_type = 'Contains'")
_p2("gql_contains_any_depth", "MATCH (r:Module)-[:CONTAINS*]->(x) WHERE r.name = 'EUROPE' RETURN x", f"with recursive {N2}, {E2}, w(s, t, d) as (select src, dst, 1 from e join n on n.id = src where edge_type = 'Contains' and n.name = 'EUROPE' and n.node_type = 'Module' union select s, e.dst, d + 1 from w join e on e.src = t and e.edge_type = 'Contains' where d < 10) select t as x_id from w")


def _community(name: str, text: str, sql: str) -> None:
    """Brands as communities: the overlay and the virtual nodes."""

    def run(spark, sf_dir):
        nodes = P.p1_nodes(spark, sf_dir)
        metrics = nodes.select("id", F.regexp_extract("return_type", r"(\d+)", 1).cast("long").alias("community_id"))
        groups = nodes.groupBy(F.regexp_extract("return_type", r"(\d+)", 1).cast("long").alias("community_id"), F.col("return_type").alias("label")).agg(F.count("*").alias("member_count")).withColumn("modularity", F.lit("0.000000"))
        g = P.Graph(nodes, P.p1_edges(spark, sf_dir, Q), metrics, groups)
        rows = gql.run(g, text)
        v = gql.parse(gql.MACROS.get(text, text)).returns[0]
        return rows.select(F.col(v).alias("id"), F.col(f"{v}_name").alias("name"))

    QUERIES[name], ORACLES[name] = run, sql


_k = "cast(regexp_extract(return_type, '([0-9]+)', 1) as bigint)"
_community("gql_community", "all_communities", f"with {N} select {_k} as id, return_type as name from n group by all")
_community("gql_community_filter", "MATCH (c:Community) WHERE c.community_id = '12' RETURN c", f"with {N} select {_k} as id, return_type as name from n where {_k} = 12 group by all")
_community("gql_community_overlay", "MATCH (a:Function) WHERE a.community_id = '12' RETURN a", f"with {N} select id, name from n where {_k} = 12")


def _dsl(name: str, text: str, condition: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: dsl.run(P.p1_nodes(spark, sf_dir), text).select("id", "name")
    ORACLES[name] = f"with {N} select id, name from n where {condition}"


_dsl("dsl_all", "all", "true")
_dsl("dsl_type", "type:function", "node_type = 'Function'")
_dsl("dsl_shortcut", "functions", "node_type = 'Function'")
_dsl("dsl_name", "name:part_5", "name = 'part_5'")
_dsl("dsl_bare_name", "part_6", "name = 'part_6'")
_dsl("dsl_label", "label:Brand#13", "brand = 'Brand#13'")
_dsl("dsl_repo", "repo:PROMO", "repo = 'PROMO'")
_dsl("dsl_suffix", "name_suffix:77", "ends_with(name, '77')")
_dsl("dsl_signature", "signature:fn part_1*Brand#2*", "signature like 'fn part\\_1%Brand#2%' escape '\\'")
_dsl("dsl_signature_contains", "signature:(x: ECONOMY)", "contains(signature, '(x: ECONOMY)')")
_dsl("dsl_return_type", "return_type:Brand#2", "starts_with(return_type, 'Brand#2')")
_dsl("dsl_module", "module:economy", "lower(repo) = 'economy'")
_dsl("dsl_compound", "label:Brand#13|type:Function|name_suffix:3", "brand = 'Brand#13' and ends_with(name, '3')")


def dsl_chunks(spark, sf_dir):
    return dsl.chunks(P.p1_nodes(spark, sf_dir), "label:Brand#13", 10).select("id", "chunk")


QUERIES["dsl_chunks"] = dsl_chunks
ORACLES["dsl_chunks"] = f"with {N} select id, cast(floor((row_number() over (order by id) - 1) / 10) as bigint) as chunk from n where brand = 'Brand#13'"


def index_lookup(spark, sf_dir):
    """Several index scans at once: by type, label, property and suffix, each with its number of rows."""
    n = P.p1_nodes(spark, sf_dir)
    return n.agg(F.count_if(dsl.clause("type:Function")).alias("by_type"), F.count_if(dsl.clause("label:Brand#11")).alias("by_label"), F.count_if(dsl.clause("repo:PROMO")).alias("by_property"), F.count_if(dsl.clause("name_suffix:1")).alias("by_suffix"))


QUERIES["index_lookup"] = index_lookup
ORACLES["index_lookup"] = f"with {N} select count(*) as by_type, count(*) filter (brand = 'Brand#11') as by_label, count(*) filter (repo = 'PROMO') as by_property, count(*) filter (ends_with(name, '1')) as by_suffix from n"


def neighbours(spark, sf_dir):
    """Outgoing and incoming neighbours of one node, with the direction."""
    g = P.p2(spark, sf_dir)
    e = g.edges.filter("src = 1003 or dst = 1003")
    return e.select(F.when(F.col("src") == 1003, F.col("dst")).otherwise(F.col("src")).alias("id"), "edge_type", F.when(F.col("src") == 1003, "out").otherwise("in").alias("direction"))


QUERIES["neighbours"] = neighbours
ORACLES["neighbours"] = f"with {E2} select case when src = 1003 then dst else src end as id, edge_type, case when src = 1003 then 'out' else 'in' end as direction from e where src = 1003 or dst = 1003"
