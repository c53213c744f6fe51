"""Vectors: sign bits, Hamming distance, sign-hash embedding, diffusion and fusion scores."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodegraph.functions.text import fnv1a


def sign_bits(vector: Column, dims: int) -> Column:
    """The signs of a vector packed into array<bigint>, lowest bit first; zero and above give 1."""
    words = []
    for w in range((dims + 63) // 64):
        bits = F.lit(0).cast("long")
        for b in range(min(64, dims - 64 * w)):
            bits = bits.bitwiseOR(F.when(F.get(vector, 64 * w + b) >= 0, F.shiftleft(F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long")))
        words.append(bits)
    return F.array(*words)


def hamming(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def top_k(rows: DataFrame, query_bits: list[int], k: int, id_col: str = "id") -> DataFrame:
    """(id, distance) of the k nearest; ties keep the smaller id."""
    q = F.array(*(F.lit(x).cast("long") for x in query_bits))
    return rows.select(F.col(id_col), hamming(F.col("bits"), q).alias("distance")).orderBy("distance", id_col).limit(k)


def centroid(rows: DataFrame, group: str, vector: str, dims: int) -> DataFrame:
    """(group, bits): each bit by majority of the members, ties 1."""
    votes = rows.select(group, F.posexplode(vector).alias("at", "x")).filter(F.col("at") < dims).groupBy(group, "at").agg(F.sum(F.when(F.col("x") >= 0, 1).otherwise(-1)).alias("v"))
    signs = votes.groupBy(group).agg(F.map_from_entries(F.collect_list(F.struct("at", "v"))).alias("m"))
    return signs.select(group, sign_bits(F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.coalesce(F.element_at("m", i), F.lit(0))), dims).alias("bits"))


def embed(tokens: pd.Series, dims: int = 256) -> pd.Series:
    """Each token adds a whole to one bucket and a half to another, with signs from its hash; then unit length."""
    out = []
    for words in tokens:
        v = np.zeros(dims)
        for t in words if words is not None else []:
            h = fnv1a(t.encode())
            v[h % dims] += 1.0 if (h >> 32) & 1 else -1.0
            v[(h >> 16) % dims] += 0.5 if (h >> 33) & 1 else -0.5
        n = np.linalg.norm(v)
        out.append(v / n if n else v)
    return pd.Series(out)


def embedder(dims: int = 256):
    """A column function from array<string> to a unit vector."""

    @F.pandas_udf("array<double>")
    def run(tokens: pd.Series) -> pd.Series:
        return embed(tokens, dims)

    return run


def diffuse(vectors: DataFrame, edges: DataFrame, alpha: float = 0.25, rounds: int = 2, both: bool = False) -> DataFrame:
    """(id, vector): each round mixes in alpha of the mean of what a node calls; then unit length.

    The mean is taken bucket by bucket, so a node that calls thousands gathers no list of vectors.
    """
    e = edges.select("src", "dst")
    e = (e.union(edges.select("dst", "src")) if both else e).distinct()
    flat = vectors.select("id", F.posexplode("vector").alias("at", "x"))
    for _ in range(rounds):
        near = e.join(flat.select(F.col("id").alias("dst"), "at", "x"), "dst").groupBy(F.col("src").alias("id"), "at").agg(F.avg("x").alias("m"))
        flat = flat.join(near, ["id", "at"], "left").select("id", "at", F.when(F.col("m").isNull(), F.col("x")).otherwise((1 - alpha) * F.col("x") + alpha * F.col("m")).alias("x"))
    norm = flat.groupBy("id").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("n"))
    unit = flat.join(norm, "id").select("id", "at", F.when(F.col("n") > 0, F.col("x") / F.col("n")).otherwise(0.0).alias("x"))
    return unit.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda s: s["x"]).alias("vector"))


# Weights of the parts of a fused score.
FUSION = {"semantic": 0.35, "blast": 0.25, "pagerank": 0.20, "name": 0.05, "sketch": 0.15}


def fused(rows: DataFrame, dims: int, weights: dict[str, float] = FUSION) -> DataFrame:
    """rows (id, distance, blast, pagerank, name_hit, sketch) with score, best first: score, then distance, then id."""
    top = rows.agg(F.max("pagerank").alias("top"))
    r = rows.join(F.broadcast(top), F.lit(True))  # one row
    score = (
        weights["semantic"] * (1 - F.col("distance") / dims) + weights["blast"] * (F.coalesce("blast", F.lit(0.0)) / 100)
        + weights["pagerank"] * F.when(F.col("top") > 0, F.coalesce("pagerank", F.lit(0.0)) / F.col("top")).otherwise(0.0)
        + weights["name"] * F.col("name_hit").cast("double") + weights["sketch"] * F.col("sketch")
    )
    return r.select("id", "distance", score.alias("score")).orderBy(F.desc("score"), "distance", "id")
