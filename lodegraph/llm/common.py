"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

REPO = str(Path(__file__).resolve().parents[2])
#: Rows and bytes in an Arrow batch: bound a Python worker's memory when texts are many or long.
BATCH_ROWS, BATCH_BYTES = 512, 1 << 24
#: Folders of the tables that this process has written, for sweep().
WRITTEN: list[str] = []


def prepare(spark: SparkSession) -> None:
    """Let workers import this package, keep Arrow batches small, and have workers return freed memory.

    These are settings of the whole session and stay: a batch of BATCH_ROWS rows or BATCH_BYTES
    bytes is a safe size for other operators too, and Spark reads them only when a plan is run,
    so they cannot be put back when a lazy DataFrame is returned.
    """
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH", "")
    if REPO not in have.split(":"):
        env["PYTHONPATH"] = f"{REPO}:{have}" if have else REPO
    env.setdefault("ARROW_DEFAULT_MEMORY_POOL", "system")
    env.setdefault("MALLOC_ARENA_MAX", "2")
    env.setdefault("MALLOC_TRIM_THRESHOLD_", "131072")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_base(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else the context's checkpoint folder.

    Only on one machine (a local master) may both be unset: a temporary folder is made then.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base:
        return base.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not hasattr(shared_base, "own"):
        shared_base.own = "file://" + tempfile.mkdtemp(prefix="lodegraph-")
    return shared_base.own


def shared_dir(spark: SparkSession, name: str) -> str:
    """The name of a new folder that driver and executors share."""
    path = f"{shared_base(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    WRITTEN.append(path)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write df as Parquet in the shared folder and read it back. drop() removes it."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete stored tables that no later plan reads: those of earlier rounds, once a newer one is written."""
    for table in tables:
        _delete(table.sparkSession, table.stored_path)


def sweep(spark: SparkSession) -> None:
    """Delete all tables and bundles that this process has written. Call it when all results are consumed."""
    for path in list(WRITTEN):
        _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    if path in WRITTEN:
        WRITTEN.remove(path)


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text as UTF-8 bytes), a null text as no bytes; other columns are left behind."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("text"))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def with_carry(schema: str, rows: DataFrame):
    """A schema with the type of the rows' carry column, if they have one, at its end."""
    out = StructType.fromDDL(schema)
    return out.add("carry", rows.schema["carry"].dataType) if "carry" in rows.columns else out
