"""Registered semantic, program-analysis and ingest queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodegraph.functions import text as T
from lodegraph.functions import vectors as V
from lodegraph.operators import flow, policy, taint
from lodegraph.operators.model import Graph
from lodegraph.plans import projections as P
from lodegraph.plans.catalog_graph import rounded
from lodegraph.sources import ingest
from lodegraph.streaming import compaction

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# Semantic --------------------------------------------------------------------------------------------------------------

_tok = "list_distinct(list_filter(string_split_regex(regexp_replace(coalesce(text, ''), '(\\p{Ll})(\\p{Lu})', '\\1 \\2', 'g'), '[^\\p{L}\\p{N}]+'), lambda t: strlen(t) >= 3))"
_low = "list_distinct(list_transform(" + _tok + ", lambda t: translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')))"


@query(f"select doc_id, len({_low}) as n_tokens, list_aggregate(list_sort({_low}), 'string_agg', ' ') as tokens from documents")
def tokens(spark, d):
    t = T.tokens(F.coalesce("text", F.lit("")))
    return P.table(spark, d, "documents").select("doc_id", F.size(t).cast("long").alias("n_tokens"), F.nullif(F.concat_ws(" ", F.array_sort(t)), F.lit("")).alias("tokens"))


@query(f"select doc_id, round((list_contains({_low}, 'the')::int + list_contains({_low}, 'quality')::int + list_contains({_low}, 'password')::int) / 3.0, 6)::double as share from documents")
def keyword_overlap(spark, d):
    return rounded(P.table(spark, d, "documents").select("doc_id", T.overlap(T.tokens(F.coalesce("text", F.lit(""))), ["the", "quality", "password"]).alias("share")), "share")


@query()
def token_bloom(spark, d):
    rows = P.table(spark, d, "documents").select("doc_id", T.bloom()(T.tokens(F.coalesce("text", F.lit("")))).alias("bloom"))
    return rows.select("doc_id", F.aggregate("bloom", F.lit(0), lambda s, x: s + F.bit_count(x)).alias("bits"), T.bloom_has_any(F.col("bloom"), "password").alias("may_have"))


@query()
def sign_hash_embedding(spark, d):
    rows = P.table(spark, d, "documents").select("doc_id", V.embedder(64)(T.hash_tokens(F.coalesce("text", F.lit("")))).alias("v"))
    return rows.select("doc_id", V.sign_bits(F.col("v"), 64).alias("bits"))


_q = "(select embedding from embeddings where vec_id = 7)"
_ham = "cast(list_sum(list_transform(range(1, 65), lambda i: ((embedding[i] >= 0) <> (q.embedding[i] >= 0))::int)) as integer)"


def _bits(spark, d):
    return P.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label", V.sign_bits(F.col("embedding"), 64).alias("bits"))


@query(f"select vec_id as id, {_ham.replace('(embedding[', '(e.embedding[')} as distance from embeddings e, (select embedding from embeddings where vec_id = 7) q order by distance, id limit 10")
def hamming_topk(spark, d):
    rows = _bits(spark, d)
    return V.top_k(rows, list(rows.filter("id = 7").first()["bits"]), 10)


_cent = "select label, i, case when sum(case when embedding[i] >= 0 then 1 else -1 end) >= 0 then 1 else 0 end as b from (select label, embedding, unnest(range(1, 65)) as i from embeddings) group by label, i"


@query(f"with c as ({_cent}), e as (select vec_id, embedding, unnest(range(1, 65)) as i from embeddings), q as (select i, (embedding[i] >= 0)::int as b from e where vec_id = 7) select label, cast(sum((c.b <> q.b)::int) as integer) as distance from c join q using (i) group by label")
def centroid_topk(spark, d):
    q = list(_bits(spark, d).filter("id = 7").first()["bits"])
    groups = V.centroid(P.table(spark, d, "embeddings"), "label", "embedding", 64)
    return groups.select("label", V.hamming(F.col("bits"), F.array(*(F.lit(x) for x in q))).alias("distance"))


@query(f"with r as (select vec_id as id, {_ham.replace('(embedding[', '(e.embedding[')} as distance, (vec_id % 101)::double as blast, (vec_id % 31)::double as pagerank, vec_id % 9 = 0 as name_hit, (vec_id % 5) / 4.0::double as sketch from embeddings e, {_q} q), t as (select max(pagerank) as top from r) select id, distance, round(0.35::double * (1 - distance / 64.0::double) + 0.25::double * (blast / 100) + 0.20::double * (pagerank / top) + 0.05::double * name_hit::int + 0.15::double * sketch, 9) as score from r, t")
def fusion(spark, d):
    rows = _bits(spark, d)
    q = F.array(*(F.lit(x) for x in rows.filter("id = 7").first()["bits"]))
    r = rows.select("id", V.hamming(F.col("bits"), q).alias("distance"), (F.col("id") % 101).cast("double").alias("blast"), (F.col("id") % 31).cast("double").alias("pagerank"), (F.col("id") % 9 == 0).alias("name_hit"), (F.col("id") % 5 / 4).alias("sketch"))
    return rounded(V.fused(r, 64), "score", digits=9)


_e = "e as (select vec_id as src, (vec_id * 13 + 7) % (select count(*) from embeddings) as dst from embeddings), f as (select src, dst from e where src <> dst)"


@query(f"""with {_e}, x0 as (select vec_id as id, unnest(range(64)) as pos, unnest(embedding)::double as x from embeddings),
x1 as (select x0.id, pos, case when m.m is null then x else 0.75 * x + 0.25 * m.m end as x from x0 left join (select f.src as id, pos, avg(x) as m from f join x0 on x0.id = f.dst group by all) m using (id, pos)),
x2 as (select x1.id, pos, case when m.m is null then x else 0.75 * x + 0.25 * m.m end as x from x1 left join (select f.src as id, pos, avg(x) as m from f join x1 on x1.id = f.dst group by all) m using (id, pos)),
n as (select id, sqrt(sum(x * x)) as n from x2 group by id)
select id, round(x / n, 6) as first from x2 join n using (id) where pos = 0""")
def diffuse(spark, d):
    e = P.table(spark, d, "embeddings")
    n = e.count()
    edges = e.select(F.col("vec_id").alias("src"), ((F.col("vec_id") * 13 + 7) % n).alias("dst")).filter("src <> dst")
    out = V.diffuse(e.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector")), edges)
    return rounded(out.select("id", F.get("vector", 0).alias("first")), "first")


# Program analysis over straight-line programs -------------------------------------------------------------------------------


def _program(spark, d):
    s = P.p5(spark, d)
    text = F.concat(F.when(F.col("flag") == "R", "request.GET ").otherwise(""), F.when(F.col("status") == "F", "execute( ").otherwise(""))
    stmts = s.select("fn", F.col("idx").alias("stmt"), F.floor(F.col("idx") / 3).cast("int").alias("block"), (F.col("idx") % 3).alias("idx"), F.lit("Assignment").alias("kind"), (F.col("idx") + 1).alias("line"), text.alias("text"), F.array("def").alias("defs"), F.array("use").alias("uses"))
    edges = stmts.select("fn", "block").distinct().filter("block > 0").select("fn", (F.col("block") - 1).alias("src"), F.col("block").alias("dst"), F.lit("Next").alias("kind"))
    return stmts, edges


_s = f"s as (select *, idx // 3 as block from ({P.P5_SQL}) t)"
#: Definitions that hold at the start of a block: the last one before it.
_in = "i as (select u.fn, u.idx, u.use, max(d.idx) as d from s u join s d on d.fn = u.fn and d.def = u.use and d.block < u.block group by all)"
_flow = "f as (select fn, d as src, idx as dst, use as variable from i union select u.fn, d.idx, u.idx, u.use from s u join s d on d.fn = u.fn and d.block = u.block and d.idx < u.idx and d.def = u.use)"
_dep = f"{_s}, {_in}, {_flow}, p as (select fn, src, dst from f union select u.fn, e.idx, u.idx from s u join s e on e.fn = u.fn and e.block = u.block and e.idx < u.idx and e.use = u.use and e.def <> u.use union select u.fn, e.idx, u.idx from s u join s e on e.fn = u.fn and e.block = u.block and e.idx < u.idx and e.def = u.def)"
#: Without a frontier every edge that post-dominance does not explain controls; in a straight line none does.


@query(f"with {_s} select u.fn, u.idx as stmt, u.use as variable, max(x.idx) as def_stmt from s u join s x on x.fn = u.fn and x.idx < u.idx and x.def = u.use group by all")
def rdefs(spark, d):
    return flow.reaching_definitions(*_program(spark, d))


@query(f"with {_s}, {_in}, {_flow} select fn, src, dst, variable from f")
def pdg_flow(spark, d):
    return flow.data_dependences(*_program(spark, d)).filter("dep_type = 'Flow'").select("fn", "src", "dst", "variable")


@query(f"with {_s} select u.fn, e.idx as src, u.idx as dst, u.use as variable, 'Anti' as dep_type from s u join s e on e.fn = u.fn and e.block = u.block and e.idx < u.idx and e.use = u.use and e.def <> u.use union all select u.fn, e.idx, u.idx, u.def, 'Output' from s u join s e on e.fn = u.fn and e.block = u.block and e.idx < u.idx and e.def = u.def")
def pdg_anti_output(spark, d):
    return flow.data_dependences(*_program(spark, d)).filter("dep_type <> 'Flow'").select("fn", "src", "dst", "variable", "dep_type")


@query(f"with {_s} select distinct fn, block, case when block > 0 then block - 1 end as idom from s")
def dominators(spark, d):
    return flow.dominators(*_program(spark, d)).select("fn", "block", "idom")


@query(f"with recursive {_dep}, l as (select fn, max(idx) as idx from s group by fn), w(fn, idx) as (select fn, idx from l union select w.fn, p.src from w join p on p.fn = w.fn and p.dst = w.idx), k as (select fn, count(*) as n from w group by fn), m as (select fn, count(*) as n from s group by fn) select w.fn, w.idx as stmt, round(100 * (1 - k.n / m.n::double), 6) as reduction from w join k using (fn) join m using (fn)")
def slice_backward(spark, d):
    return rounded(flow.slices(*_program(spark, d), lambda rows: (rows[-1]["line"], rows[-1]["defs"][0])), "reduction")


@query(f"with recursive {_dep}, w(fn, idx) as (select fn, 0 from s where idx = 0 union select w.fn, p.dst from w join p on p.fn = w.fn and p.src = w.idx) select fn, idx as stmt from w")
def slice_forward(spark, d):
    return flow.slices(*_program(spark, d), lambda rows: (rows[0]["line"], rows[0]["defs"][0]), backward=False).select("fn", "stmt")


@query(f"with recursive {_dep}, w(fn, a, idx) as (select fn, idx, idx from s where flag = 'R' union select w.fn, a, p.dst from w join p on p.fn = w.fn and p.src = w.idx) select w.fn, a as source, w.idx as sink, 'HttpParameter' as source_type, 'SqlQuery' as sink_type, 10 as severity, x.def as variable from w join s using (fn, idx) join s x on x.fn = w.fn and x.idx = a where s.status = 'F'")
def taint_flows(spark, d):
    return taint.flows(*_program(spark, d)).select("fn", "source", "sink", "source_type", "sink_type", "severity", "variable")


@query(f"with {_s} select fn, def as variable, 'Unknown' as type, 0.0::double as confidence from s group by all")
def inferred_types(spark, d):
    return taint.inferred_types(_program(spark, d)[0])


# Ingest and change ------------------------------------------------------------------------------------------------------------


def _files(spark, d):
    return P.table(spark, d, "documents").select(F.concat(F.lit("src/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.col("doc_id"), F.col("n_chars"))


_fl = "f as (select 'src/' || source || '/' || doc_id || '.txt' as path, doc_id, n_chars from documents)"


@query(f"with {_fl}, b as (select path, n_chars::varchar as hash from f where doc_id % 13 <> 0), a as (select path, (n_chars + (doc_id % 7 = 0)::int)::varchar as hash from f where doc_id % 11 <> 0) select path, case when b.hash is null then 'added' when a.hash is null then 'deleted' else 'changed' end as change from b full join a using (path) where a.hash is distinct from b.hash")
def change_set(spark, d):
    f = _files(spark, d)
    before = f.filter("doc_id % 13 <> 0").select("path", F.col("n_chars").cast("string").alias("hash"))
    after = f.filter("doc_id % 11 <> 0").select("path", (F.col("n_chars") + F.when(F.col("doc_id") % 7 == 0, 1).otherwise(0)).cast("string").alias("hash"))
    return policy.change_set(before, after)


@query("with k as (select 'c_' || c_custkey as key_path, c_mktsegment as value, c_custkey as id from customer), b as (select * from k where id % 13 <> 0), a as (select key_path, case when id % 7 = 0 then 'X' else value end as value from k where id % 11 <> 0) select key_path, case when b.key_path is null then 'added' when a.key_path is null then 'removed' else 'changed' end as change, b.value as old, a.value as new from b full join a using (key_path) where a.value is distinct from b.value")
def config_drift(spark, d):
    k = P.table(spark, d, "customer").select(F.concat(F.lit("c_"), "c_custkey").alias("key_path"), F.col("c_mktsegment").alias("value"), F.col("c_custkey").alias("id"))
    return policy.drift(k.filter("id % 13 <> 0"), k.filter("id % 11 <> 0").withColumn("value", F.when(F.col("id") % 7 == 0, "X").otherwise(F.col("value"))))


@query("select 3000000000 + p_partkey as id, p_name as name from part where p_partkey not in (select l_partkey from lineitem where l_quantity > 45)")
def unused_config(spark, d):
    g = P.p2(spark, d)
    keys = g.nodes.filter("node_type = 'Function'").withColumn("node_type", F.lit("ConfigKey"))
    uses = P.table(spark, d, "lineitem").filter("l_quantity > 45").select(F.lit(0).cast("long").alias("src"), (F.col("l_partkey") + 3_000_000_000).alias("dst"), F.lit("UsesConfig").alias("edge_type"))
    return policy.unused_keys(Graph(keys, uses))


@query("with s as (select p_type as file_path, p_partkey as id, p_partkey % 1000 as a, p_partkey % 1000 + p_size as b from part), q as (select distinct p_type as file_path, (p_partkey * 7) % 1000 as line from part) select q.file_path, q.line, arg_max(id, (a, -id)) as id from q join s on s.file_path = q.file_path and line between a and b group by all")
def enclosing_symbol(spark, d):
    p = P.table(spark, d, "part")
    symbols = p.select(F.col("p_type").alias("file_path"), F.col("p_partkey").alias("id"), (F.col("p_partkey") % 1000).alias("start_line"), (F.col("p_partkey") % 1000 + F.col("p_size")).alias("end_line"))
    return policy.enclosing(symbols, p.select(F.col("p_type").alias("file_path"), (F.col("p_partkey") * 7 % 1000).alias("line")))


@query("""with n as (select p_partkey as id, 'part_' || p_partkey as name, p_name as q, 'app/' || p_brand as f from part),
r as (select 'app/' || p_brand as file, 'part_' || p_partkey as source, case when p_partkey % 3 = 0 then 'part_' || (p_partkey + 1) else p_name end as target, p_partkey as k from part),
u1 as (select f || '::' || name as k, min(id) as id from n group by 1 having count(distinct id) = 1), u2 as (select replace(q, '::', '.') as k, min(id) as id from n group by 1 having count(distinct id) = 1), u4 as (select name as k, min(id) as id from n group by 1 having count(distinct id) = 1)
select r.k, coalesce(u1.id, u2.id, u4.id) as dst from r left join u1 on u1.k = file || '::' || target left join u2 on u2.k = target left join u4 on u4.k = target""")
def resolve_symbols(spark, d):
    p = P.table(spark, d, "part")
    brand = F.concat(F.lit("app/"), "p_brand")
    nodes = p.select(F.col("p_partkey").alias("id"), F.concat(F.lit("part_"), "p_partkey").alias("name"), F.col("p_name").alias("qualified_name"), brand.alias("file_path"))
    target = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("part_"), F.col("p_partkey") + 1)).otherwise(F.col("p_name"))
    relations = p.select(brand.alias("file"), F.concat(F.lit("part_"), "p_partkey").alias("source"), target.alias("target"), F.lit("Calls").alias("kind"), F.col("p_partkey").alias("line"), target.alias("hint"))
    return ingest.resolve(relations, nodes).select(F.col("line").alias("k"), "dst")


@query("with s as (select 'f' || (p_partkey % 50) as file, p_name as q, p_partkey as pos from part) select file, q as qualified_name, min(pos) as pos from s group by all")
def first_symbol_wins(spark, d):
    p = P.table(spark, d, "part").select(F.concat(F.lit("f"), F.col("p_partkey") % 50).alias("file"), F.col("p_partkey").alias("pos"), F.col("p_name").alias("name"), F.col("p_name").alias("qualified_name"))
    return ingest.first_symbols(p).select("file", "qualified_name", "pos")


@query(f"with n as ({P.P1_NODES_SQL}), c as ({P.p1_edges_sql(42)}), k as (select id, name from n where brand not in ('Brand#11', 'Brand#12')), x as (select id, name from k union all select id, name || '_new' from n where brand = 'Brand#11') select src, dst, a.name as a, b.name as b from c join x a on a.id = src join x b on b.id = dst where src in (select id from k)")
def compact(spark, d):
    g = P.p1(spark, d, 42)
    again = g.nodes.filter("return_type = 'Brand#11'").withColumn("name", F.concat("name", F.lit("_new")))
    gone = g.nodes.filter(F.col("return_type").isin("Brand#11", "Brand#12")).select(F.col("file_path").alias("path")).distinct()
    out = compaction.compact(g, Graph(again, g.edges.limit(0)), gone)
    name = lambda a, b: out.nodes.select(F.col("id").alias(a), F.col("name").alias(b))
    return out.edges.join(name("src", "a"), "src").join(name("dst", "b"), "dst").select("src", "dst", "a", "b")


@query(f"with n as ({P.P1_NODES_SQL}) select id, 'Integer' as t from n where false union all select id, 'Unknown' from n")
def idl_types(spark, d):
    return P.p1_nodes(spark, d).select("id", T.common_type(F.col("return_type")).alias("t"))


@query(f"with n as ({P.P1_NODES_SQL}) select id, '  n' || id || ' [label=\"' || name || '\", shape=ellipse, style=filled, fillcolor=\"lightblue\"];' as value from n")
def export_dot(spark, d):
    from lodegraph.sources import exports

    return exports.dot(P.p1(spark, d, 45)).filter("part = 1").select(F.regexp_extract("value", r"n(\d+)", 1).cast("long").alias("id"), "value")


@query(f"with c as ({P.p1_edges_sql(45)}) select '<edge source=\"n' || src || '\" target=\"n' || dst || '\"><data key=\"kind\">Calls</data></edge>' as value from c")
def export_graphml(spark, d):
    from lodegraph.sources import exports

    return exports.graphml(P.p1(spark, d, 45)).filter("part = 2").select("value")


# Types and signatures ---------------------------------------------------------------------------------------------------------

#: Type names as they stand in sources, with the common type that each must give.
TYPE_NAMES = [("i64", "Integer"), ("Vec<String>", "List"), ("  &str", "String"), ("Boolean", "Boolean"), ("double", "Float"), ("dict[str, int]", "Object"), ("Widget", "Unknown"), ("usize", "Integer"), ("f32", "Float")]


@query(f"select doc_id, case doc_id % {len(TYPE_NAMES)} {' '.join(f"when {k} then '{t}'" for k, (_, t) in enumerate(TYPE_NAMES))} end as t, case doc_id % {len(TYPE_NAMES)} {' '.join(f"when {k} then '{dict(Integer='int64', Float='double', String='string', Boolean='bool', List='repeated string', Object='bytes', Unknown='string')[t]}'" for k, (_, t) in enumerate(TYPE_NAMES))} end as proto from documents")
def common_types(spark, d):
    """Every kind of type name, once for each document, as a common type and in an interface language."""
    name = F.element_at(F.array(*(F.lit(n) for n, _ in TYPE_NAMES)), (F.col("doc_id") % len(TYPE_NAMES) + 1).cast("int"))
    return P.table(spark, d, "documents").select("doc_id", T.common_type(name).alias("t")).select("doc_id", "t", T.idl_type(F.col("t"), "proto").alias("proto"))


@query(f"with n as ({P.P1_NODES_SQL}) select id, name, 1 as arity, lower(brand) as returns from n")
def signatures(spark, d):
    """Name, number of parameters and return type of every function's signature."""
    return P.p1_nodes(spark, d).select("id", T.signature(F.col("signature")).alias("s")).select("id", "s.name", "s.arity", "s.returns")


#: Right sides of assignments, with the type that each must give.
RIGHT_SIDES = [("12", "Int"), ("1.5", "Float"), ('"text"', "String"), ("[1, 2]", "List"), ("compute(1)", "Unknown"), ("True", "Bool"), ("{}", "Dict")]


@query(f"""with s as (select o_custkey as fn, 'v' || (o_orderkey % 4) as variable, case o_orderkey % {len(RIGHT_SIDES)} {' '.join(f"when {k} then '{t}'" for k, (_, t) in enumerate(RIGHT_SIDES))} end as t from orders)
select fn, variable, case count(distinct t) filter (t <> 'Unknown') when 0 then 'Unknown' when 1 then min(t) filter (t <> 'Unknown') else 'Union' end as type, round(avg((t <> 'Unknown')::int), 6)::double as confidence from s group by all""")
def inferred_kinds(spark, d):
    """Types of variables that are assigned once or more, by what stands to the right."""
    right = F.element_at(F.array(*(F.lit(r) for r, _ in RIGHT_SIDES)), (F.col("o_orderkey") % len(RIGHT_SIDES) + 1).cast("int"))
    variable = F.concat(F.lit("v"), (F.col("o_orderkey") % 4).cast("string"))
    stmts = P.table(spark, d, "orders").select(F.col("o_custkey").alias("fn"), F.array(variable).alias("defs"), F.concat(variable, F.lit(" = "), right).alias("text"))
    return taint.inferred_types(stmts).select("fn", "variable", "type", F.round("confidence", 6).alias("confidence"))
