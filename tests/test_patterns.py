"""Pattern queries, filters and their errors, on the fixture graphs."""

import pytest

from lodegraph.operators.model import Graph, edge_table, node_table
from lodegraph.plans import dsl, gql


def graph(spark, nodes, edges):
    n = spark.createDataFrame([(i, k, name) for i, (name, k) in enumerate(nodes)], "id long, node_type string, name string")
    at = {name: i for i, (name, _) in enumerate(nodes)}
    e = spark.createDataFrame([(at[a], at[b], k) for a, b, k in edges], "src long, dst long, edge_type string")
    return Graph(node_table(n), edge_table(e))


@pytest.fixture(scope="module")
def chain(spark):
    return graph(spark, [("main", "Function"), ("authenticate", "Function"), ("execute_query", "Function")], [("main", "authenticate", "Calls"), ("authenticate", "execute_query", "Calls")])


def test_chain(chain):
    assert gql.run(chain, "MATCH (f:Function) WHERE f.name = 'main' RETURN f").count() == 1
    assert gql.run(chain, "MATCH (a:Function)-[:CALLS*1..2]->(b:Function) RETURN a, b").count() == 3
    assert gql.run(chain, "all_functions").count() == 3
    assert [r.f_name for r in gql.run(chain, "MATCH (f:Function) RETURN f LIMIT 2").orderBy("f").collect()] == ["main", "authenticate"]
    rows, steps = gql.run(chain, "direct_calls", explain=True)
    assert rows.count() == 2 and len(steps["steps"]) == 2 and steps["cost"] == 4
    assert gql.to_json(rows)["count"] == 2


def test_communities(chain, spark):
    assert gql.run(chain, "MATCH (c:Community) RETURN c").count() == 0
    overlay = Graph(chain.nodes, chain.edges, spark.createDataFrame([(0, 1), (1, 1), (2, 2)], "id long, community_id long"), spark.createDataFrame([(1, "x", 2, "0.1"), (2, "y", 1, "0.1")], "community_id long, label string, member_count long, modularity string"))
    assert gql.run(overlay, "MATCH (c:Community) RETURN c").count() == 2
    assert gql.run(overlay, "MATCH (a:Function) WHERE a.community_id = '1' RETURN a").count() == 2
    with pytest.raises(gql.GqlError):
        gql.run(overlay, "MATCH (a:Function)-[:CALLS]->(c:Community) RETURN a")


@pytest.mark.parametrize("text", ["MATCH (a:Nothing) RETURN a", "MATCH (a) RETURN b", "MATCH (a) WHERE b.name = 'x' RETURN a", "MATCH (a)-[:CALLS*3]->(b) RETURN a", "MATCH (a)-[:FLIES]->(b) RETURN a", "RETURN a", "MATCH (a) RETURN a LIMIT x", "MATCH (a) RETURN a extra"])
def test_errors(chain, text):
    with pytest.raises(gql.GqlError):
        gql.run(chain, text)


def test_walks_repeat_an_end_for_each_depth(spark):
    g = graph(spark, [("a", "Function"), ("b", "Function")], [("a", "b", "Calls"), ("b", "a", "Calls"), ("a", "b", "Calls")])
    assert gql.run(g, "MATCH (x {name: 'a'})-[:CALLS*1..4]->(y) RETURN x, y").count() == 4
    assert gql.run(g, "MATCH (x)-[:CALLS]->(y)-[:CALLS]->(x) RETURN x, y").count() == 2
    assert gql.run(g, "MATCH (x), (y) RETURN x, y").count() == 4


def test_structure_is_no_call(spark):
    g = graph(spark, [("m", "Module"), ("f", "Function")], [("m", "f", "Contains")])
    assert gql.run(g, "direct_calls").count() == 0
    assert gql.run(g, "MATCH (m)-[:CONTAINS]->(f) RETURN m, f").count() == 1


def test_quotes_and_case(chain):
    assert gql.run(chain, 'match (f:function) where f.name like "*query" return f').count() == 1
    assert gql.parse(r"MATCH (f) WHERE f.name = 'it\'s' RETURN f").where == [("f", "name", "=", "it's")]


def test_clause_order_changes_nothing(spark):
    rows = [(i, "Function", f"handler{i}", "backend") for i in range(450)] + [(450 + i, "Class", f"Service{i}", "backend") for i in range(50)] + [(500 + i, "Function", f"ui{i}", "frontend") for i in range(500)] + [(1000, "Function", "needle", "backend")]
    n = node_table(spark.createDataFrame(rows, "id long, node_type string, name string, repo string").selectExpr("id", "node_type", "name", "map('repo', repo) as properties"))
    from itertools import permutations

    for p in permutations(["name:needle", "type:Function", "repo:backend"]):
        assert [r.name for r in dsl.run(n, "|".join(p)).collect()] == ["needle"]
    assert dsl.run(n, "repo:backend").count() == 501
    assert dsl.run(n, "").count() == 1001
    with pytest.raises(ValueError):
        dsl.run(n, "color:red")
