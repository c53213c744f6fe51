"""Semantic retrieval: an index of function texts, built anew or from a former one, and queries with expansion."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodegraph.functions import text as T
from lodegraph.functions import vectors as V
from lodegraph.operators import reach
from lodegraph.operators.model import Graph, prop, return_type_text, signature_text

DIMS = 256
#: Most neighbours that an anchor brings in, and rows that fusion looks at.
PER_ANCHOR, POOL = 20, 256


class Embedder:
    """From an array of tokens to a vector of dims numbers. Others give the same two members."""

    dims = DIMS

    def column(self, tokens: Column) -> Column:
        return V.embedder(self.dims)(tokens)

    def one(self, text: str) -> list[float]:
        import re

        return list(V.embed(pd.Series([re.findall(r"\w+", text)]), self.dims)[0])


def document() -> Column:
    """A node's text: its qualified name, signature, return type, documentation and body tokens."""
    return F.concat_ws(" ", F.coalesce("qualified_name", "name"), signature_text(), F.concat(F.lit("returns "), return_type_text()), prop("doc"), prop("body_tokens"))


def index(nodes: DataFrame, embedder: Embedder | None = None, former: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(id, name, code_hash, tokens, sketch, bits) of functions, and one row of (total, reused, embedded, removed).

    Rows of a former index with the same id and code_hash are taken over.
    """
    e = embedder or Embedder()
    fns = nodes.filter("node_type = 'Function'").select("id", "name", F.coalesce("code_hash", F.sha2(document(), 256)).alias("code_hash"), document().alias("doc"))
    made = lambda rows: rows.withColumn("tokens", T.tokens(F.col("doc"))).withColumn("sketch", T.bloom()(F.col("tokens"))).withColumn("v", e.column(T.hash_tokens(F.col("doc")))).select("id", "name", "code_hash", "tokens", "sketch", V.sign_bits(F.col("v"), e.dims).alias("bits"))
    if former is None:
        out = made(fns)
        return out, fns.agg(F.count("*").alias("total"), F.lit(0).cast("long").alias("reused"), F.count("*").alias("embedded"), F.lit(0).cast("long").alias("removed"))
    keys = ["id", "code_hash"]
    reused = former.join(fns.select(keys), keys, "left_semi").select("id", "name", "code_hash", "tokens", "sketch", "bits")
    new = fns.join(former.select(keys), keys, "left_anti")
    gone = former.select("id").join(fns.select("id"), "id", "left_anti")
    count = lambda df, name: df.agg(F.count("*").alias(name))
    stats = count(fns, "total").crossJoin(count(reused, "reused")).crossJoin(count(new, "embedded")).crossJoin(count(gone, "removed"))  # one row each
    return reused.unionByName(made(new)), stats


def query(entries: DataFrame, text: str, k: int = 10, metrics: DataFrame | None = None, embedder: Embedder | None = None, keyword_and: bool = False, community: int | None = None, labels: DataFrame | None = None) -> DataFrame:
    """(id, distance, score) of the k best of the nearest POOL entries.

    keyword_and drops entries without all words of the query; community keeps members of one.
    metrics: (id, blast, pagerank).
    """
    e = embedder or Embedder()
    spark = entries.sparkSession
    words = [r.t for r in spark.range(1).select(F.explode(T.tokens(F.lit(text))).alias("t")).collect()]
    rows = entries.join(labels.filter(F.col("community_id") == community).select("id"), "id", "left_semi") if community is not None else entries
    if keyword_and:
        for w in words:
            rows = rows.filter(F.array_contains("tokens", w))
    q = spark.range(1).select(V.sign_bits(F.array(*(F.lit(float(x)) for x in e.one(text))), e.dims).alias("b")).first()["b"]
    near = V.top_k(rows, list(q), POOL)
    pool = entries.join(F.broadcast(near), "id")  # POOL rows at most
    share = sum((T.bloom_has_any(F.col("sketch"), w).cast("double") for w in words), F.lit(0.0)) / max(1, len(words))
    name = F.lower("name")
    hit = F.lit(False)
    for w in words:
        hit = hit | F.contains(name, F.lit(w))
    pool = pool.select("id", "distance", hit.alias("name_hit"), share.alias("sketch"))
    known = metrics.select("id", "blast", "pagerank") if metrics is not None else pool.select("id", F.lit(0.0).alias("blast"), F.lit(0.0).alias("pagerank"))
    return V.fused(pool.join(known, "id", "left"), e.dims).limit(k)


def expand(graph: Graph, anchors: DataFrame, how: str = "neighbors", depth: int = 1, gql_text: str | None = None) -> DataFrame:
    """(anchor, id, relation) of rows that anchors (id) bring in: neighbors, blast, gql or all; never an anchor.

    An anchor brings PER_ANCHOR rows at most for each relation, those of the fewest steps and smallest id.
    """
    calls, seeds = graph.of(["Calls"]), anchors.select(F.col("id").alias("seed"), "id").distinct()
    parts = []
    if how in ("neighbors", "all"):
        parts += [reach.bfs(seeds, calls, depth, backward=False).withColumn("relation", F.lit("calls")), reach.bfs(seeds, calls, depth).withColumn("relation", F.lit("called_by"))]
    if how in ("blast", "all"):
        parts.append(reach.bfs(seeds, calls, reach.DEPTH).withColumn("relation", F.lit("blast")))
    if how in ("gql", "all") and gql_text:
        found = graph.gql(gql_text)
        a, b = found.columns[0], next(c for c in found.columns[1:] if f"{c}_type" in found.columns)
        parts.append(found.select(F.col(a).alias("seed"), F.col(b).alias("id"), F.lit(1).alias("depth"), F.lit("gql").alias("relation")).join(seeds.select("seed"), "seed", "left_semi"))
    if not parts:
        return seeds.select(F.col("seed").alias("anchor"), "id", F.lit("").alias("relation")).limit(0)
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    rows = rows.filter("depth > 0").join(seeds.select(F.col("seed").alias("own")), F.col("id") == F.col("own"), "left_anti")
    rank = F.row_number().over(Window.partitionBy("seed", "relation").orderBy("depth", "id"))
    return rows.withColumn("k", rank).filter(F.col("k") <= PER_ANCHOR).select(F.col("seed").alias("anchor"), "id", "relation")


def write(entries: DataFrame, path: str) -> None:
    entries.write.parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("id long, name string, code_hash string, tokens array<string>, sketch array<long>, bits array<long>").parquet(path)
