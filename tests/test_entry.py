"""The driver contract on small tables."""

import decimal
import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from lodegraph.operators import ranking
from lodegraph.plans import catalog, projections

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SMALL = "/root/testdata/sf0.001"
REPO = Path(__file__).resolve().parents[1]


def _plain(v):
    if isinstance(v, float):
        return round(v, 5)
    if isinstance(v, decimal.Decimal):
        return float(v)
    return tuple(map(_plain, v)) if isinstance(v, (list, tuple)) else v


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_names_match():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and set(catalog.ORACLES) <= set(catalog.QUERIES)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_oracle(spark, name):
    """Every query of the graph engine against its SQL on the smallest tables."""
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    df = catalog.QUERIES[name](spark, SMALL)
    rel = con.sql(catalog.ORACLES[name])
    assert sorted(rel.columns) == sorted(df.columns)
    cols = sorted(df.columns)
    at = [rel.columns.index(c) for c in cols]
    key = lambda r: tuple((x is None, str(x)) for x in r)
    want = sorted((tuple(_plain(r[i]) for i in at) for r in rel.fetchall()), key=key)
    got = sorted((tuple(_plain(r[c]) for c in cols) for r in df.collect()), key=key)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_rows_only(spark, name):
    assert catalog.QUERIES[name](spark, SMALL).count() >= 0


def test_without_the_training_data_folder(tmp_path):
    """A copy without the optional folders still imports and registers the rest."""
    shutil.copytree(REPO, tmp_path / "copy", ignore=shutil.ignore_patterns("llm", "corpus_pipeline.py", ".git", "*.pyc"))
    (tmp_path / "copy/lodegraph/llm/__pycache__").mkdir(parents=True)
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), any(k.startswith('op1_') for k in e.queries()))"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "copy", env=env, capture_output=True, text=True, check=True).stdout
    assert out.split() == [str(len(catalog.QUERIES)), str(len(catalog.ORACLES)), "False"]


def test_the_rest_imports_nothing_of_it():
    for p in (REPO / "lodegraph").rglob("*.py"):
        assert "llm" in p.parts or "lodegraph.llm" not in p.read_text(), p


def test_sampled_betweenness_has_the_operators_pivots(spark):
    """The smallest graph lies below EXACT_NODES, so the result is the exact one; 64 pivots differ from it."""
    whole = ranking.betweenness(projections.p1(spark, SMALL, 45), exact_nodes=10**9)
    rows = lambda df: sorted(tuple(_plain(v) for v in r) for r in df.collect())
    assert rows(catalog.QUERIES["betweenness_sampled"](spark, SMALL)) == rows(whole)


@pytest.mark.parametrize("name", ["pagerank", "pagerank_top"])
def test_pagerank_has_the_rounds_of_its_sql_above_the_gate(spark, monkeypatch, name):
    monkeypatch.setattr(ranking, "MANY_NODES", 10)
    test_oracle(spark, name)


@pytest.mark.parametrize("name", ["pagerank", "pagerank_loop", "pagerank_top"])
@pytest.mark.parametrize("part, line", [
    ("select * replace (p_partkey + i * 199 as p_partkey) from range(3) t(i), part", "select * replace (l_partkey + i * 199 as l_partkey, l_orderkey + i * 100000 as l_orderkey) from range(3) t(i), lineitem"),
    ("select * from part where p_partkey % 7 <> 3", "select * from lineitem"),
    ("select * replace (nullif(p_partkey, p_partkey // 50 * 50 + 1) as p_partkey) from part", "select * replace (nullif(l_partkey, l_partkey // 40 * 40 + 1) as l_partkey) from lineitem"),
], ids=["keys that meet", "parts that are missing", "no keys"])
def test_pagerank_takes_the_rows_of_its_sql(spark, tmp_path, part, line, name):
    con = duckdb.connect()
    for t, sql in (("part", part), ("lineitem", line)):
        con.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
        con.execute(f"copy ({sql}) to '{tmp_path}/{t}.parquet' (format parquet)")
    other = duckdb.connect()
    for t in ("part", "lineitem"):
        other.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet'")
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    want = other.execute(catalog.ORACLES[name]).fetchall()
    got = [tuple(r) for r in catalog.QUERIES[name](spark, str(tmp_path)).select("id", "pagerank").collect()]
    assert sorted(got, key=key) == sorted(want, key=key) and (name != "pagerank_top" or got == want)


def test_harmonic_has_the_distances_of_its_sql(spark, tmp_path):
    """A ring of 100 users: paths of up to 99 steps, of which the SQL takes those of up to 60."""
    con = duckdb.connect()
    con.execute(f"copy (select i as event_id, timestamp '2024-01-01' + to_hours(cast(i as integer)) as ts, i % 100 as user_id, 'purchase' as event_type from range(101) t(i)) to '{tmp_path}/events.parquet'")
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet'")
    got = {r.id: r.harmonic for r in catalog.QUERIES["harmonic"](spark, str(tmp_path)).collect()}
    assert got == dict(con.sql(catalog.ORACLES["harmonic"]).fetchall()) and len(got) == 100


def test_harmonic_with_events_of_no_user(spark, tmp_path):
    con = duckdb.connect()
    con.execute(f"copy (select i as event_id, timestamp '2024-01-01' + to_hours(cast(i as integer)) as ts, case when i % 5 <> 3 then i % 7 end as user_id, 'purchase' as event_type from range(60) t(i)) to '{tmp_path}/events.parquet'")
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet'")
    got = {r.id: r.harmonic for r in catalog.QUERIES["harmonic"](spark, str(tmp_path)).collect()}
    assert got == dict(con.sql(catalog.ORACLES["harmonic"]).fetchall()) and got[None] == 0
