"""What loops share: cutting lineage in the shared folder, and small-table kernels."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Edges up to which a whole-graph kernel may run in one task; beyond it the relational loop runs.
KERNEL_EDGES = 2_000_000


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir or the context's checkpoint folder.

    Where both are unset a temporary one is made, on one machine (a local master) only.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = getattr(shared_folder, "base", None) or "file://" + tempfile.mkdtemp(prefix="lodegraph-")
        shared_folder.base = base
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def cut(df: DataFrame, name: str = "step") -> DataFrame:
    """df as a written table: later plans start from its files."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(edges: DataFrame, limit: int = KERNEL_EDGES) -> bool:
    """Whether there are at most limit edges; counts no further."""
    return edges.limit(limit + 1).count() <= limit


def kernel(edges: DataFrame, nodes: DataFrame, fn: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """fn over all edges (src, dst) and node ids in one task. Only behind small()."""
    tagged = edges.select("src", "dst", F.lit(1).alias("one")).unionByName(nodes.select(F.col("id").alias("src"), F.lit(None).cast("long").alias("dst"), F.lit(1).alias("one")))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        is_edge = pdf["dst"].notna()
        e = pdf[is_edge][["src", "dst"]].astype("int64").sort_values(["src", "dst"], ignore_index=True)
        n = pdf[~is_edge][["src"]].rename(columns={"src": "id"}).astype("int64").drop_duplicates().sort_values("id", ignore_index=True)
        return fn(e[e["src"].isin(n["id"]) & e["dst"].isin(n["id"])].reset_index(drop=True), n)  # edges among the nodes

    return tagged.groupBy("one").applyInPandas(run, schema)
