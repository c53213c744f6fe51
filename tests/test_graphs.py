"""Whole-graph operators against plain Python and known facts."""

import itertools
import random
import time

import numpy as np
import pytest

from lodegraph.operators import community, policy, ranking, reach
from lodegraph.operators.model import Graph, edge_table, node_table
from lodegraph.plans import projections


def make(spark, n, pairs, kind="Calls", types=None):
    nodes = spark.createDataFrame([(i, (types or {}).get(i, "Function"), f"f{i}", {"cyclomatic": str(i)}) for i in range(n)], "id long, node_type string, name string, properties map<string,string>")
    rows = [(a, b, kind) if len(p) == 2 else p for p in pairs for a, b in [p[:2]]]
    return Graph(node_table(nodes), edge_table(spark.createDataFrame(rows, "src long, dst long, edge_type string")))


def reached(n, pairs):
    seen = {}
    for v in range(n):
        work, got = [v], {v}
        while work:
            x = work.pop()
            for a, b in pairs:
                if b == x and a not in got:
                    got.add(a)
                    work.append(a)
        seen[v] = got
    return seen


def random_graph(seed):
    rnd = random.Random(seed)
    n = 8 + seed % 12
    return n, sorted({(a, b) for a, b in itertools.product(range(n), repeat=2) if a != b and rnd.random() < 1.3 / n})


@pytest.mark.parametrize("seed", range(4))
def test_strong_components_and_impact(spark, seed):
    n, pairs = random_graph(seed)
    g = make(spark, n, pairs)
    back = reached(n, pairs)
    want = {v: min(u for u in back[v] if v in back[u]) for v in range(n)}
    for loop in (False, True):
        assert {r.id: r.scc for r in reach.strongly_connected(g.nodes.select("id"), g.of(), force_loop=loop).collect()} == want
    blast = {r.id: r for r in reach.blast_scc(g).collect()}
    walk = {r.id: r.impact_zone for r in reach.blast_bfs(g, g.nodes.select("id"), depth=None).collect()}
    assert {v: blast[v].impact_zone for v in range(n)} == {v: len(back[v]) - 1 for v in range(n)} == walk
    starts = g.nodes.filter("id % 3 = 0").selectExpr("id % 2 as seed", "id").unionAll(spark.createDataFrame([(7, 10_000)], "seed long, id long"))
    both = [{tuple(r) for r in reach.bfs(starts, g.of(), d, backward=b, force_loop=loop).collect()} for d, b in ((2, True), (None, False)) for loop in (False, True)]
    assert both[0] == both[1] and both[2] == both[3]
    assert {v: blast[v].direct_callers for v in range(n)} == {v: sum(b == v for _, b in pairs) for v in range(n)}


def test_deep_chain(spark):
    g = make(spark, 15, [(i, i + 1) for i in range(14)])
    one = g.nodes.filter("id = 14").select("id")
    assert reach.blast_bfs(g, one).first().impact_zone == 10
    assert reach.blast_bfs(g, one, depth=None).first().impact_zone == 14
    assert reach.depth_filter(g, 14, 3).count() == 3 and reach.depth_filter(g, 14, 0).count() == 0
    assert {r.id: r.level for r in reach.levels(g).collect()} == {i: 14 - i for i in range(15)}


def test_cycles_and_levels(spark):
    g = make(spark, 5, [(0, 1), (1, 2), (2, 0), (3, 3), (3, 4)])
    assert [(r.scc, r.size) for r in reach.cycles(g).collect()] == [(0, 3)]
    assert {r.id for r in reach.recursive(g).collect()} == {0, 1, 2, 3}
    with pytest.raises(ValueError):
        reach.levels(g)
    for loop in (False, True):
        assert {r.id: r.component for r in reach.connected(g.nodes.select("id"), g.of(), force_loop=loop).collect()} == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3}


def test_pagerank_converges_and_leaves_structure_out(spark):
    g = make(spark, 5, [(0, 1), (1, 2), (2, 0), (0, 3), (1, 3), (2, 3), (3, 4)])
    one = {r.id: r.pagerank for r in ranking.pagerank(g, max_rounds=100).collect()}
    two = {r.id: r.pagerank for r in ranking.pagerank(g, max_rounds=100, tolerance=1e-9, force_loop=True).collect()}
    assert sum(one.values()) == pytest.approx(1) and all(one[k] == pytest.approx(two[k], abs=1e-6) for k in one)
    star = make(spark, 21, [(20, i, "Contains") for i in range(20)] + [(i, i + 1, "Calls") for i in range(19)], types={20: "Module"})
    ranks = {r.id: r.pagerank for r in ranking.pagerank(star, types=["Calls"]).collect()}
    assert ranks[20] == 0 and max(ranks.values()) > 0


def test_bridge_has_the_most_betweenness(spark):
    left, right = [(i, i + 1) for i in range(7)], [(i, i + 1) for i in range(9, 16)]
    g = make(spark, 17, [*left, (7, 8), (8, 9), *right, *right])
    exact = {r.id: r.betweenness for r in ranking.betweenness(g).collect()}
    assert max(exact, key=exact.get) == 8
    # plain Brandes by counting shortest paths on a line: node k lies between all before and all after
    assert exact[8] == pytest.approx(8 * 8 / (16 * 15))
    some = {r.id: r.betweenness for r in ranking.betweenness(g, exact_nodes=3, pivot_count=17).collect()}
    assert some == pytest.approx(exact)
    assert len(set(ranking.pivots(1000, 64))) == 64
    wide = make(spark, 700, [(i, i + 1) for i in range(699) for _ in range(4)])  # 4**699 paths from end to end
    values = [r.betweenness for r in ranking.betweenness(wide, exact_nodes=10, pivot_count=3).collect()]
    assert all(0 <= v < float("inf") for v in values) and max(values) > 0


def test_harmonic_and_its_sketch(spark):
    g = make(spark, 30, [(i, i + 1) for i in range(29)])
    exact = {r.id: r.harmonic for r in ranking.harmonic(g).collect()}
    assert exact[0] == pytest.approx(sum(1 / d for d in range(1, 30)) / 29) and exact[29] == 0
    rough = {r.id: r.harmonic for r in ranking.harmonic_sketch(g, max_rounds=40).collect()}
    assert all(rough[k] == pytest.approx(exact[k], abs=0.05) for k in exact)


def test_harmonic_of_a_long_ring(spark):
    """3,000 nodes with paths of up to 2,999 steps; walks from one node after the other take minutes."""
    n = 3000
    began = time.monotonic()
    ring = {r.id: r.harmonic for r in ranking.harmonic(make(spark, n, [(i, (i + 1) % n) for i in range(n)])).collect()}
    assert time.monotonic() - began < 60
    assert len(ring) == n and all(v == pytest.approx(sum(1 / d for d in range(1, n)) / (n - 1)) for v in ring.values())


def test_harmonic_against_plain_search(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(300)] + [(i, i + 1) for i in range(200, 290)] + [(i, 200) for i in range(150)] + [(7, i) for i in range(150)] + [(3, 9999)]
    out = {v: {t for s, t in edges if s == v and t < 300} for v in range(300)}
    for bound in (None, 0, 1, 40):
        want = {}
        for v in out:
            seen, level, total, d = {v}, {v}, 0.0, 0
            while level and d != bound:
                d += 1
                level = {t for s in level for t in out[s]} - seen
                seen |= level
                total += len(level) / d
            want[v] = total / 299
        got = {r.id: r.harmonic for r in ranking.harmonic(make(spark, 300, edges * 2), max_distance=bound).collect()}
        assert got == pytest.approx(want)
    assert ranking.harmonic(make(spark, 2, [(5, 6)])).count() == 2


@pytest.mark.parametrize("words", [1, 2, 5])
def test_blocks_of_targets_add_up(monkeypatch, words):
    """Sums of all blocks, with edges of a node falling into several steps."""
    monkeypatch.setattr(ranking.Reach, "STEP", 3)
    rng = np.random.default_rng(3)
    src, dst = np.unique(np.concatenate([rng.integers(0, 250, (2, 700)), [range(250), [9] * 250], [[9] * 250, range(250)]], axis=1), axis=1)
    ids = np.arange(250) * 3
    sets, adj = ranking.Reach(src * 3, dst * 3, ids), np.zeros((250, 250), bool)
    adj[src, dst] = True
    seen = np.eye(250, dtype=bool)
    want, d = np.zeros(250), 0
    while (more := (seen.astype(int) @ adj > 0) & ~seen).any():
        d += 1
        want += more.sum(axis=1) / d
        seen |= more
    assert sum(sets.farness(i, words, None) for i in range(0, 250, 64 * words)) == pytest.approx(want)


def test_communities(spark):
    clique = lambda s: [(a, b) for a in range(s, s + 8) for b in range(s, s + 8) if a != b]
    g = make(spark, 16, [*clique(0), *clique(8), (0, 8)])
    runs = [sorted((r.id, r.community_id) for r in community.propagate(g).collect()) for _ in range(2)]
    assert runs[0] == runs[1]
    labels = community.propagate(g)
    assert len({c for _, c in runs[0]}) == 2
    assert community.modularity(g.of(), labels).first().modularity > 0.4
    mesh = make(spark, 10, [(a, b) for a in range(10) for b in range(10) if a < b])
    assert community.modularity(mesh.of(), mesh.nodes.selectExpr("id", "id as community_id")).first().modularity < 0
    sync = {r.id: r.community_id for r in community.propagate(g, synchronous=True).collect()}
    assert len(sync) == 16


def test_migration_order(spark):
    groups = spark.createDataFrame([(i, float(i), 1.0, 0.0) for i in range(4)], "community_id long, pagerank double, harmonic double, blast double")
    scored = community.migration_scores(groups)
    assert [r.community_id for r in scored.orderBy("priority_rank").collect()] == [3, 2, 1, 0]
    edges = spark.createDataFrame([(3, 0), (2, 3), (3, 2)], "source long, target long")
    assert community.migration_schedule(scored, edges) == [(1, 1), (2, 0), (3, 3), (4, 2)]


def test_policy_and_rules(spark):
    g = make(spark, 4, [(0, 1), (1, 2), (2, 3)])
    zone = reach.bfs(g.nodes.selectExpr("id as seed", "id"), g.of(), None).filter("depth > 0").selectExpr("seed as id", "id as member")
    domains = spark.createDataFrame([(0, "web"), (3, "db")], "id long, domain string")
    rank = spark.createDataFrame([(3, 0.9), (1, 0.1)], "id long, betweenness double")
    got = {(r.id, r.kind, r.first) for r in policy.violations(zone, rank, domains, [("db", "web")], 2, 0.5).collect()}
    assert got == {(3, "ScaleFailure", True), (3, "DomainIsolation", False), (3, "CascadeHazard", False)}
    rules = {"rules": [{"name": "r", "match": {"and": [{"type": "calls_any", "names": ["f2"]}, {"not": {"type": "has_property", "key": "absent"}}]}, "actions": [{"type": "add_label", "label": "x"}, {"type": "add_label", "label": "x"}]}]}
    assert {r.id: r.labels for r in policy.apply_rules(g, rules).collect()} == {0: None, 1: ["x"], 2: None, 3: None}


def test_mock_graph(spark):
    g = projections.mock(spark, 50, 250)
    assert g.nodes.count() == 50 and g.edges.filter("src = dst").count() == 0
