"""Incremental graphs: compaction of a delta, and the same as a streaming sink."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.operators.model import Graph
from lodegraph.sources import exports, ingest


def compact(base: Graph, delta: Graph, invalidated: DataFrame) -> Graph:
    """Nodes of invalidated files (path) go, the delta's come, and edges stay whose both ends are alive.

    A path of the table stands for a file of that path or one that ends in / and it. Edges keep
    their properties.
    """
    paths = base.nodes.select("file_path").distinct().filter("file_path is not null")
    # the ends of a path after each slash meet the invalidated paths by equality
    parts = F.split("file_path", "/")
    ends = paths.select("file_path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat_ws("/", F.slice(parts, i, F.size(parts))))).alias("path"))
    gone = ends.join(invalidated.select("path").distinct(), "path", "left_semi").select("file_path").distinct()
    kept = base.nodes.join(gone, "file_path", "left_anti").select(*base.nodes.columns).join(delta.nodes.select("id"), "id", "left_anti").select(*base.nodes.columns)
    nodes = kept.unionByName(delta.nodes)
    alive = nodes.select("id")
    old = base.edges.join(kept.select(F.col("id").alias("src")), "src", "left_semi").select(*base.edges.columns)
    edges = old.unionByName(delta.edges).join(alive.select(F.col("id").alias("src")), "src", "left_semi").join(alive.select(F.col("id").alias("dst")), "dst", "left_semi")
    return Graph(nodes, edges.select(*base.edges.columns))


def relink(graph: Graph, relations: DataFrame) -> DataFrame:
    """Edges of relations (file, source, target, kind, line, hint) resolved anew over the whole graph."""
    found = ingest.resolve(relations, graph.nodes).filter("dst is not null")
    source = graph.nodes.select(F.col("file_path").alias("file"), F.coalesce("qualified_name", "name").alias("source"), F.col("id").alias("src"))
    return found.join(source, ["file", "source"]).select("src", "dst", F.col("kind").alias("edge_type"))


class Compactor:
    """A foreachBatch sink: each batch of changed files (path, text, language) makes a new version of the graph.

    Versions are folders; the name of the current one is a row of a table written last. A batch
    that is run again gives the version that it gave before.
    """

    def __init__(self, folder: str):
        self.folder = folder.rstrip("/")

    def current(self, spark) -> tuple[str, int] | None:
        try:
            rows = spark.read.schema("version string, batch long").parquet(f"{self.folder}/versions")
        except Exception as e:  # the first batch: no version yet
            if "PATH_NOT_FOUND" in str(e):
                return None
            raise
        r = rows.orderBy(F.desc("batch")).first()
        return (r["version"], r["batch"]) if r else None

    def graph(self, spark) -> Graph | None:
        now = self.current(spark)
        return exports.read_table(spark, f"{self.folder}/{now[0]}") if now else None

    def __call__(self, files: DataFrame, batch: int) -> None:
        spark = files.sparkSession
        now = self.current(spark)
        if now and now[1] >= batch:
            return
        delta = ingest.build(files)
        new = compact(exports.read_table(spark, f"{self.folder}/{now[0]}"), delta, files.select("path")) if now else delta
        version = f"v{batch}-{uuid.uuid4().hex[:8]}"
        exports.write_table(new, f"{self.folder}/{version}")
        spark.createDataFrame([(version, batch)], "version string, batch long").coalesce(1).write.mode("append").parquet(f"{self.folder}/versions")


def stream(changed: DataFrame, folder: str, checkpoint: str):
    """Start compacting a stream of changed files."""
    return changed.writeStream.foreachBatch(Compactor(folder)).option("checkpointLocation", checkpoint).start()
