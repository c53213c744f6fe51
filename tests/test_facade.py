"""Symbols, checks, overview tables and semantic retrieval."""

import pytest

from lodegraph.operators import facade, semantic
from lodegraph.operators.model import Graph, edge_table, node_table


@pytest.fixture(scope="module")
def graph(spark):
    rows = [(1, "Function", "read", "Store.read", "app/java/com/x/Store.java", {"domain": "db"}), (2, "Function", "handle", "Api.handle", "app/src/web/api.rs", {"domain": "web"}), (3, "Function", "handle", "Other.handle", "app/src/web/other.rs", {}), (4, "File", "f", None, "app/src/web/api.rs", {})]
    n = spark.createDataFrame(rows, "id long, node_type string, name string, qualified_name string, file_path string, properties map<string,string>")
    e = spark.createDataFrame([(2, 1, "Calls"), (3, 2, "Calls"), (4, 2, "Contains")], "src long, dst long, edge_type string")
    return Graph(node_table(n), edge_table(e))


def test_symbols(graph):
    assert facade.symbol(graph, "read") == 1 and facade.symbol(graph, "Api::handle") == 2 and facade.symbol(graph, "other.rs::handle") == 3 and facade.symbol(graph, "3") == 3
    assert facade.symbol(graph, "handle", of_class="Other") == 3
    with pytest.raises(facade.Ambiguous):
        facade.symbol(graph, "handle")
    with pytest.raises(facade.NotFound):
        facade.symbol(graph, "nothing")


def test_blast_both_ways(graph):
    want = [2, 3]
    assert sorted(r.id for r in facade.blast(graph, "read").collect()) == want
    assert sorted(r.id for r in facade.blast(graph, "read", closure=facade.closure_table(graph)).collect()) == want
    assert [r.id for r in facade.blast(graph, "read", depth=1).collect()] == [2]


def test_check_status_pages(graph, spark):
    changed = spark.createDataFrame([("app/java/com/x/Store.java",)], "file_path string")
    got = {(r.id, r.kind) for r in facade.check(graph, changed, [("db", "web")], max_impact=1).collect()}
    assert got == {(1, "ScaleFailure"), (1, "DomainIsolation")}
    assert {(r.kind, r.type, r.n) for r in facade.status(graph).collect()} == {("node", "Function", 3), ("node", "File", 1), ("edge", "Calls", 2), ("edge", "Contains", 1)}
    assert {(r.relation, r.id) for r in facade.function(graph, "Api.handle").collect()} == {("calls", 1), ("called_by", 3)}
    assert [r.id for r in facade.page(graph, ["Function"], 1, 1).collect()] == [2]
    assert facade.among(graph, spark.createDataFrame([(1,), (2,)], "id long")).count() == 1
    assert [len(b) for b in facade.batches(graph.nodes, 3)] == [3, 1]


def test_overview(graph, tmp_path):
    tables = facade.overview(graph)
    assert {r.package for r in tables["packages"].collect()} == {"com.x", "web"}
    facade.write_overview(graph, str(tmp_path / "o"))


def test_semantic_index_and_query(graph, spark, tmp_path):
    entries, stats = semantic.index(graph.nodes)
    assert stats.first().embedded == 3
    semantic.write(entries, str(tmp_path / "i"))
    again, stats = semantic.index(graph.nodes.filter("id <> 3"), former=semantic.read(spark, str(tmp_path / "i")))
    assert tuple(stats.first()) == (2, 2, 0, 1) and again.count() == 2
    best = semantic.query(entries, "Store read", k=1).first()
    assert best.id == 1
    assert semantic.query(entries, "handle", keyword_and=True).count() == 2
    labels = spark.createDataFrame([(1, 5)], "id long, community_id long")
    assert [r.id for r in semantic.query(entries, "handle", community=5, labels=labels).collect()] == [1]
    one = spark.createDataFrame([(2,)], "id long")
    assert {(r.id, r.relation) for r in semantic.expand(graph, one).collect()} == {(1, "calls"), (3, "called_by")}
    every = semantic.expand(graph, one, "all", gql_text="direct_calls")
    assert {r.relation for r in every.collect()} == {"calls", "called_by", "blast", "gql"}
