"""Pattern queries: MATCH ... WHERE ... RETURN ... LIMIT, compiled to DataFrame operations.

Only ids travel through the hops; attributes join at the end. Variables that no pattern binds
are an error; LIMIT follows a total order by the returned ids; conditions on one key are all
kept; *x* in LIKE means contains; patterns may be parted by commas or white space.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodegraph.operators.model import EDGE_TYPES, NODE_TYPES, Graph, prop, return_type_text, signature_text

#: Where * stands without bounds.
MAX_HOPS = 10
TOKEN = re.compile(r"""\s*(?:(?P<text>"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*')|(?P<dots>\.\.)|(?P<arrow>->)|(?P<word>[A-Za-z_][A-Za-z0-9_]*)|(?P<number>\d+)|(?P<mark>[-()\[\]{}:,.*=])|(?P<end>$))""")

# The named queries.
MACROS = {
    "all_functions": "MATCH (f:Function) RETURN f",
    "direct_calls": "MATCH (a:Function)-[:CALLS]->(b:Function) RETURN a, b",
    "call_chain": "MATCH (a:Function)-[:CALLS*1..3]->(b:Function) RETURN a, b",
    "all_communities": "MATCH (c:Community) RETURN c",
}


class GqlError(ValueError):
    """A query that cannot be parsed or resolved."""


@dataclass(frozen=True)
class Node:
    var: str
    kind: str | None = None
    props: tuple[tuple[str, str], ...] = ()


@dataclass(frozen=True)
class Hop:
    edge: str
    low: int = 1
    high: int = 1
    many: bool = False


@dataclass
class Query:
    patterns: list[list] = field(default_factory=list)  # node, hop, node, ...
    where: list[tuple[str, str, str, str]] = field(default_factory=list)  # variable, key, operator, value
    returns: list[str] = field(default_factory=list)
    limit: int | None = None


class _Parser:
    def __init__(self, text: str):
        self.tokens: list[tuple[str, str]] = []
        at = 0
        while at < len(text):
            m = TOKEN.match(text, at)
            if not m:
                raise GqlError(f"cannot read the query at {text[at:at + 20]!r}")
            at = m.end()
            if m.lastgroup and m.lastgroup != "end":
                self.tokens.append((m.lastgroup, m.group(m.lastgroup)))
        self.at = 0

    def peek(self, ahead: int = 0) -> tuple[str, str]:
        return self.tokens[self.at + ahead] if self.at + ahead < len(self.tokens) else ("end", "")

    def take(self, value: str | None = None, kind: str | None = None) -> str:
        k, v = self.peek()
        if (value and v.upper() != value) or (kind and k != kind):
            raise GqlError(f"expected {value or kind}, found {v or 'the end'}")
        self.at += 1
        return v

    def text(self) -> str:
        k, v = self.peek()
        if k == "text":
            self.at += 1
            return re.sub(r"\\(.)", r"\1", v[1:-1])
        return self.take(kind="word")

    def word_is(self, value: str) -> bool:
        return self.peek()[0] == "word" and self.peek()[1].upper() == value

    def query(self) -> Query:
        q = Query()
        self.take("MATCH")
        while self.peek()[1] == "(":
            q.patterns.append(self.pattern())
            if self.peek()[1] == ",":
                self.take(",")
        if not q.patterns:
            raise GqlError("MATCH needs a pattern")
        if self.word_is("WHERE"):
            self.take("WHERE")
            while True:
                q.where.append(self.condition())
                if not self.word_is("AND"):
                    break
                self.take("AND")
        self.take("RETURN")
        q.returns.append(self.take(kind="word"))
        while self.peek()[1] == ",":
            self.take(",")
            q.returns.append(self.take(kind="word"))
        if self.word_is("LIMIT"):
            self.take("LIMIT")
            q.limit = int(self.take(kind="number"))
        if self.peek()[0] != "end":
            raise GqlError(f"unexpected {self.peek()[1]!r}")
        return q

    def pattern(self) -> list:
        out = [self.node()]
        while self.peek()[1] == "-":
            self.take("-")
            out += [self.hop(), self.node()]
        return out

    def node(self) -> Node:
        self.take("(")
        var, kind, props = self.take(kind="word"), None, []
        if self.peek()[1] == ":":
            self.take(":")
            name = self.take(kind="word")
            kind = next((t for t in [*NODE_TYPES, "Community"] if t.lower() == name.lower()), None)
            if kind is None:
                raise GqlError(f"unknown node type {name}")
        if self.peek()[1] == "{":
            self.take("{")
            while True:
                key = self.take(kind="word")
                self.take(":")
                props.append((key, self.text()))
                if self.peek()[1] != ",":
                    break
                self.take(",")
            self.take("}")
        self.take(")")
        return Node(var, kind, tuple(props))

    def hop(self) -> Hop:
        self.take("[")
        self.take(":")
        name = self.take(kind="word").replace("_", "")
        edge = next((t for t in EDGE_TYPES if t.lower() == name.lower()), None)
        if edge is None:
            raise GqlError(f"unknown edge type {name}")
        hop = Hop(edge)
        if self.peek()[1] == "*":
            self.take("*")
            hop = Hop(edge, 1, MAX_HOPS, True)
            if self.peek()[0] == "number":
                low = int(self.take(kind="number"))
                self.take("..")
                hop = Hop(edge, low, int(self.take(kind="number")), True)
        self.take("]")
        self.take("->")
        return hop

    def condition(self) -> tuple[str, str, str, str]:
        var = self.take(kind="word")
        self.take(".")
        key = self.take(kind="word")
        if self.word_is("LIKE"):
            self.take("LIKE")
            op = "LIKE"
        else:
            self.take("=")
            op = "="
        k, v = self.peek()
        if k != "text":
            raise GqlError("a value must be quoted")
        return var, key, op, self.text()


def parse(text: str) -> Query:
    return _Parser(text).query()


def resolve(query: Query) -> Query:
    """Check variables and the places of :Community."""
    bound = {x.var for p in query.patterns for x in p if isinstance(x, Node)}
    for var in [*query.returns, *(w[0] for w in query.where)]:
        if var not in bound:
            raise GqlError(f"no pattern binds {var}")
    for p in query.patterns:
        if len(p) > 1 and any(isinstance(x, Node) and x.kind == "Community" for x in p):
            raise GqlError("a Community cannot be an end of a hop")
    return query


#: Columns of the node table that conditions may name besides the properties.
CORE = ("name", "qualified_name", "file_path", "start_line", "end_line", "code_hash")


def attribute(key: str, community: bool) -> Column:
    """A key's value as text."""
    if community:
        return F.col(key).cast("string") if key in ("community_id", "label", "member_count", "modularity", "name") else F.lit(None).cast("string")
    if key == "type":
        return F.col("node_type")
    if key == "signature":
        return signature_text()
    if key == "return_type":
        return return_type_text()
    if key in CORE:
        return F.col(key).cast("string")
    return prop(key)


def glob(column: Column, pattern: str) -> Column:
    """* at an end is open there; at both ends it means contains."""
    if pattern == "*":
        return column.isNotNull()
    if len(pattern) > 1 and pattern[0] == pattern[-1] == "*":
        return F.contains(column, F.lit(pattern[1:-1]))
    if pattern.startswith("*"):
        return F.endswith(column, F.lit(pattern[1:]))
    if pattern.endswith("*"):
        return F.startswith(column, F.lit(pattern[:-1]))
    return column == pattern


def _scan(graph: Graph, node: Node, conditions: list[tuple[str, str, str]]) -> DataFrame | None:
    """Ids that may bind a variable; None if all may."""
    community = node.kind == "Community"
    if community and graph.communities is None:
        return graph.nodes.select("id").limit(0)
    rows = graph.communities.withColumn("id", F.col("community_id")).withColumn("name", F.concat(F.lit("community_"), "community_id")) if community else graph.nodes
    # the overlay of community ids joins only where it is asked for
    if not community and graph.metrics is not None and any(k == "community_id" for k in [*dict(node.props), *(c[0] for c in conditions)]):
        rows = rows.join(graph.metrics.select(F.col("id"), F.col("community_id").cast("string").alias("__community")), "id", "left")
    keep = []
    if node.kind and not community:
        keep.append(F.col("node_type") == node.kind)
    for key, op, value in [*((k, "=", v) for k, v in node.props), *conditions]:
        col = F.col("__community") if "__community" in rows.columns and key == "community_id" else attribute(key, community)
        keep.append(glob(col, value) if op == "LIKE" else col == value)
    if not keep and not community:
        return None
    for k in keep:
        rows = rows.filter(F.coalesce(k, F.lit(False)))
    return rows.select("id")


def hops(starts: DataFrame | None, edges: DataFrame, low: int, high: int) -> DataFrame:
    """(__s, __e) of walks of low to high steps: one row for each end and number of steps."""
    step = edges.select("src", "dst").distinct()
    frontier = step.select(F.col("src").alias("__s"), F.col("dst").alias("__e"))
    if starts is not None:
        frontier = frontier.join(starts.select(F.col("id").alias("__s")).distinct(), "__s", "left_semi")
    out = frontier if low <= 1 else None
    for depth in range(2, high + 1):
        frontier = frontier.join(step, F.col("__e") == F.col("src")).select("__s", F.col("dst").alias("__e")).distinct()
        if depth % 4 == 0:
            from lodegraph.operators.iterate import cut

            frontier = cut(frontier, "hops")
        if depth >= max(1, low):
            out = frontier if out is None else out.unionAll(frontier)
    return out if out is not None else frontier.limit(0)


def compile_query(graph: Graph, query: Query) -> DataFrame:
    """The ids of the returned variables, a column each."""
    resolve(query)
    scans: dict[str, DataFrame | None] = {}
    made: dict[str, list[Node]] = {}
    for p in query.patterns:
        for x in p:
            if isinstance(x, Node):
                made.setdefault(x.var, []).append(x)
    for var, nodes in made.items():
        conditions = [(k, op, v) for w, k, op, v in query.where if w == var]
        parts = [_scan(graph, n, conditions) for n in nodes]
        ids = [p for p in parts if p is not None]
        for extra in ids[1:]:
            ids[0] = ids[0].join(extra, "id", "left_semi")
        scans[var] = ids[0] if ids else None
    done: set[str] = set()
    rows: DataFrame | None = None
    for p in query.patterns:
        part: DataFrame | None = None
        seen: list[str] = []
        for k, x in enumerate(p):
            if k == 0:
                if len(p) == 1:
                    part = (scans[x.var] if scans[x.var] is not None else graph.nodes.select("id")).select(F.col("id").alias(x.var))
                seen = [x.var]
            elif isinstance(x, Hop):
                source, target = p[k - 1].var, p[k + 1].var
                edges = graph.of([x.edge])
                begin = scans[source] if part is None else part.select(F.col(source).alias("id"))
                walk = hops(begin, edges, x.low, x.high) if x.many else edges.distinct().select(F.col("src").alias("__s"), F.col("dst").alias("__e"))
                if not x.many and begin is not None and part is None:
                    walk = walk.join(begin.select(F.col("id").alias("__s")), "__s", "left_semi")
                if scans[target] is not None:
                    walk = walk.join(scans[target].select(F.col("id").alias("__e")), "__e", "left_semi")
                if part is None:
                    part = walk.select(F.col("__s").alias(source), F.col("__e").alias(target)) if source != target else walk.filter("__s = __e").select(F.col("__s").alias(source))
                elif target in seen:  # closes a cycle
                    part = part.join(walk, (F.col(source) == F.col("__s")) & (F.col(target) == F.col("__e"))).drop("__s", "__e")
                else:
                    part = part.join(walk.withColumnRenamed("__e", target), F.col(source) == F.col("__s")).drop("__s")
                if target not in seen:
                    seen.append(target)
        if rows is None:
            rows = part
        else:
            shared = [v for v in seen if v in done]
            rows = rows.join(part, shared) if shared else rows.crossJoin(part)
        done |= set(seen)
    out = rows.select(*dict.fromkeys(query.returns))
    if query.limit is not None:
        out = out.orderBy(*out.columns).limit(query.limit)
    return out


def run(graph: Graph, text: str, explain: bool = False):
    """The rows of a query or macro: for each returned variable v, columns v (id), v_type, v_name, v_file."""
    query = parse(MACROS.get(text, text))
    ids = compile_query(graph, query)
    communities = {x.var for p in query.patterns for x in p if isinstance(x, Node) and x.kind == "Community"}
    for var in list(ids.columns):
        if var in communities:
            known = graph.communities if graph.communities is not None else graph.nodes.select(F.col("id").alias("community_id"), F.col("name").alias("label")).limit(0)
            look = known.select(F.col("community_id").alias(var), F.lit("Module").alias(f"{var}_type"), F.col("label").alias(f"{var}_name"), F.lit(None).cast("string").alias(f"{var}_file"))
        else:
            look = graph.nodes.select(F.col("id").alias(var), F.col("node_type").alias(f"{var}_type"), F.col("name").alias(f"{var}_name"), F.col("file_path").alias(f"{var}_file"))
        ids = ids.join(look, var)
    return (ids, explain_steps(graph, query)) if explain else ids


def explain_steps(graph: Graph, query: Query) -> dict:
    """What the plan scans and joins, pattern by pattern; cost is the sum of each step's rows, one at least."""
    steps = []
    for p in query.patterns:
        names = "".join(f"({x.var}:{x.kind or '*'})" if isinstance(x, Node) else f"-[{x.edge}{f'*{x.low}..{x.high}' if x.many else ''}]->" for x in p)
        steps.append({"step": f"match {names}", "rows_out": compile_query(graph, Query([p], [w for w in query.where if w[0] in {x.var for x in p if isinstance(x, Node)}], [p[0].var])).count()})
    steps.append({"step": f"return {', '.join(query.returns)}" + (f" limit {query.limit}" if query.limit is not None else ""), "rows_out": compile_query(graph, query).count()})
    return {"steps": steps, "cost": sum(max(1, s["rows_out"]) for s in steps)}


def to_json(rows: DataFrame) -> dict:
    """The result as a small document; for interactive use, rows come to the driver."""
    names = [c for c in rows.columns if f"{c}_type" in rows.columns]
    found = rows.collect()
    return {"schema_version": 1, "rows": [[{"binding": v, "node": r[v], "type": r[f"{v}_type"], "name": r[f"{v}_name"], "file": r[f"{v}_file"]} for v in names] for r in found], "count": len(found)}
