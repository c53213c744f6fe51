"""Program analysis on small control-flow graphs."""

import pytest
from pyspark.sql import functions as F

from lodegraph.operators import flow, taint
from lodegraph.operators.flow import Function


def fn(lines, edges):
    """lines: (block, text, defs, uses, kind)."""
    count = {}
    rows = []
    for k, (block, text, defs, uses, *kind) in enumerate(lines):
        count[block] = count.get(block, -1) + 1
        rows.append({"stmt": k, "block": block, "idx": count[block], "kind": kind[0] if kind else "Assignment", "line": k + 1, "text": text, "defs": defs, "uses": uses})
    return Function(1, rows, [(a, b, "Next") for a, b in edges])


#: if: 0 -> 1, 2 -> 3; loop: 3 -> 4 -> 3; 3 -> 5; 6 is dead
DIAMOND = fn([(0, "x = 1", ["x"], []), (0, "if x", [], ["x"], "Branch"), (1, "x = 2", ["x"], []), (2, "y = 3", ["y"], []), (3, "while x", [], ["x"], "Branch"), (4, "x = x - 1", ["x"], ["x"]), (5, "return x", [], ["x"]), (6, "dead", [], [])], [(0, 1), (0, 2), (1, 3), (2, 3), (3, 4), (4, 3), (3, 5)])


def test_reachability_cycles_paths():
    f = DIAMOND
    assert [f.blocks[b] for b in flow.bits(f.reachable)] == [0, 1, 2, 3, 4, 5] and f.has_cycle()
    assert sorted(f.paths()) == [[0, 1, 3, 5], [0, 2, 3, 5]]


def test_dominators_and_frontiers():
    f = DIAMOND
    idom = f.nearest(f.dominators)
    assert idom[:6] == [None, 0, 0, 0, 3, 3]
    assert {b: list(flow.bits(f.frontiers[b])) for b in range(6)} == {0: [], 1: [3], 2: [3], 3: [3], 4: [3], 5: []}
    assert f.dominates(0, 5) and not f.dominates(1, 5)


def test_reaching_definitions_and_dependences():
    f = DIAMOND
    uses = {(k, v, d) for k, v, d in f.use_definitions()}
    assert {d for k, v, d in uses if k == 6} == {0, 2, 5}
    data = {(a, c, t): loop for a, c, v, t, loop in f.data}
    assert data[(5, 4, "Flow")] and not data[(0, 1, "Flow")]
    assert f.control == [(2, 4), (3, 4), (5, 4)]


def test_slices_and_aliases():
    f = fn([(0, "a = 10", ["a"], []), (0, "b = 20", ["b"], []), (0, "x = len(s)", ["x"], ["s"]), (0, "y = x * 2", ["y"], ["x"]), (0, "p.q = y", ["p.q"], ["y"]), (0, "r = p", ["r"], ["p"])], [])
    got, less = f.slice(4, "y")
    assert {2, 3} <= set(got) and 0 not in got and less > 0
    forward, _ = f.slice(3, "x", backward=False)
    assert {2, 3, 4} <= set(forward)
    assert f.aliases("r") >= {"r", "p", "p.q"} and f.depth_of("s") == 2
    with pytest.raises(ValueError):
        f.slice(1, "nothing")


def test_taint_and_sanitizers():
    lines = [(0, "x = request.GET['a']", ["x"], []), (0, "v = x + 1", ["v"], ["x"]), (0, "cursor.execute(v)", [], ["v"])]
    flows = list(taint.flows_of(fn(lines, []), "python"))
    assert [(s, t, k, kt, sev, bad) for s, t, k, kt, _, _, _, sev, bad, _ in flows] == [(0, "HttpParameter", 2, "SqlQuery", 10, True)]
    lines[1] = (0, "v = int(x)", ["v"], ["x"])
    assert not list(taint.flows_of(fn(lines, []), "python"))[0][8]
    branch = [(0, "x = request.GET['a']", ["x"], []), (1, "x = int(x)", ["x"], ["x"]), (2, "cursor.execute(x)", [], ["x"])]
    around = list(taint.flows_of(fn(branch, [(0, 1), (1, 2), (0, 2)]), "python"))
    assert around[0][8] and around[0][9]


@pytest.mark.parametrize(("lang", "source", "sink", "kinds"), [("javascript", "q = req.query.a", "db.query(q)", ("HttpParameter", "SqlQuery")), ("go", "p := os.Getenv(k)", "exec.Command(p)", ("Environment", "ShellCommand")), ("java", "s = getParameter(x)", "st.executeQuery(s)", ("HttpParameter", "SqlQuery")), ("rust", "let a = env::var(x)", "Command::new(a)", ("Environment", "ShellCommand")), ("csharp", "a = Request.Query[x]", "new SqlCommand(a)", ("HttpParameter", "SqlQuery")), ("c", "a = getenv(x)", "system(a)", ("HttpParameter", "ShellCommand")), ("cpp", "std::cin >> a", "std::system(a)", ("HttpParameter", "ShellCommand"))])
def test_rules_of_languages(lang, source, sink, kinds):
    got = list(taint.flows_of(fn([(0, source, ["a"], []), (0, sink, [], ["a"])], []), lang))
    assert (got[0][1], got[0][3]) == kinds


def test_tables(spark):
    rows = [(1, s["stmt"], s["block"], s["idx"], s["kind"], s["line"], s["text"], s["defs"], s["uses"]) for s in DIAMOND.stmts]
    rows += [(2, 0, 0, 0, "Assignment", 1, "x = request.GET['a']", ["x"], []), (2, 1, 0, 1, "Expression", 2, "cursor.execute(x)", [], ["x"])]
    stmts = spark.createDataFrame(rows, flow.STMTS)
    edges = spark.createDataFrame([(1, a, b, "Next") for a, b in [(0, 1), (0, 2), (1, 3), (2, 3), (3, 4), (4, 3), (3, 5)]], flow.EDGES)
    assert flow.dominators(stmts, edges).filter("fn = 1 and block = 4").first().idom == 3
    assert flow.blocks(stmts, edges).filter("not reachable").count() == 1
    assert flow.control_dependences(stmts, edges).count() > 0
    found = taint.flows(stmts, edges)
    assert found.count() == 1
    code = spark.createDataFrame([(2, "x = request.GET['a']\ncursor.execute(x)")], "fn long, text string")
    assert taint.weaknesses(found, code).first().cwe == 89
    assert taint.flows(stmts.limit(0), edges.limit(0)).count() == 0
    seeds = spark.createDataFrame([(2, 1)], "fn long, stmt int")
    params = spark.createDataFrame([(2, "x")], "fn long, name string")
    calls = spark.createDataFrame([(1, 2, 7)], "caller long, callee long, line int")
    assert {(r.fn, r.stmt) for r in flow.interprocedural(stmts, edges, params, calls, seeds).collect()} >= {(2, 1), (2, 0), (1, 6), (1, 0)}


def test_types_and_mutations(spark):
    rows = [(1, 0, 0, 0, "Assignment", 1, "x = 5", ["x"], []), (1, 1, 0, 1, "Assignment", 2, "x = 'a'", ["x"], []), (1, 2, 0, 2, "Assignment", 3, "y = [1]", ["y"], [])]
    got = {r.variable: r.type for r in taint.inferred_types(spark.createDataFrame(rows, flow.STMTS)).collect()}
    assert got == {"x": "Union", "y": "List"}
    writes = spark.createDataFrame([("A.set", "o", "pkg.Order", "status", "f", 3, "DirectField"), ("Order.__init__", "self", "Order", "status", "f", 1, "ThisField"), ("B.g", "z", None, "status", "f", 9, "Unresolved")], "function string, receiver_local string, receiver_type string, member string, file string, line int, kind string")
    assert [r.function for r in taint.mutations(writes, "Order").collect()] == ["A.set"]
    assert taint.mutations(writes, "Order", unresolved=True, constructors=True).count() == 3


CODE = """
def handle(request, n):
    x = request.GET['a']
    for i in range(n):
        if i > 3:
            continue
        x = x + str(i)
    try:
        cursor.execute(x)
    except ValueError:
        return None
    while n:
        break
    match n:
        case 1:
            y = 1
        case _:
            y = 2
    return y
class Order:
    def set(self, other: Order):
        self.status = 1
        other.total = 2
        z.a = 3
"""


def test_python_control_flow(spark):
    from lodegraph.sources import python_flow

    files = spark.createDataFrame([("a.py", CODE), ("bad.py", "def ("), ("empty.py", None)], "path string, text string")
    known, stmts, edges = python_flow.control_flow(files)
    assert {r.name for r in known.collect()} == {"handle", "Order.set"}
    fn_id = known.filter("name = 'handle'").first().fn
    mine = stmts.filter(F.col("fn") == fn_id)
    assert {r.kind for r in mine.collect()} >= {"Branch", "Return", "Jump", "Assignment", "FunctionCall"}
    found = taint.flows(stmts, edges).collect()
    assert [(f.source_type, f.sink_type, f.vulnerable) for f in found] == [("HttpParameter", "SqlQuery", True)]
    live = flow.blocks(stmts, edges).filter(F.col("fn") == fn_id)
    assert live.filter("in_cycle").count() >= 2
    writes = {(r.receiver_local, r.receiver_type, r.member, r.kind) for r in python_flow.field_writes(files).collect()}
    assert writes == {("self", "Order", "status", "ThisField"), ("other", "Order", "total", "DirectField"), ("z", None, "a", "Unresolved")}
    tree = python_flow.skeleton(files, 2)
    assert tree.filter("kind = 'FunctionDef' and file = 'a.py'").count() == 2
