"""A training-corpus pipeline: stages that each take and return documents.

Each stage is (name, function) with the function taking (spark, docs, sf_dir). What a stage
keeps is all that the next one sees; the columns other than text travel along untouched, whatever
their names.

Defined cases, in every stage: an empty table gives an empty one; a null in any column stays, but
a null text counts as an empty one where text is read (quality rules reject it, as it has fewer
than ten words); very long texts are read whole; repeated rows count each for themselves, but line
dedup takes rows of one doc_id as one document, and null doc_ids as one that comes last. Ties:
of near copies the row of the smallest doc_id stays, a null one last, and of equal doc_ids any
one, but exactly one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.llm import line_dedup, ngram_join, packing, quality, secrets
from lodegraph.llm.common import read, stored


def _carry(docs: DataFrame) -> str:
    """All columns as one value, whatever their names."""
    return "struct(" + ", ".join(f"`{c.replace('`', '``')}`" for c in docs.columns) + ")"


def _back(rows: DataFrame, docs: DataFrame, text=None) -> DataFrame:
    """The columns of docs from carry, with text replaced; n_chars follows the text."""
    out = []
    for c in docs.columns:
        if c == "text" and text is not None:
            out.append(text.alias(c))
        elif c == "n_chars" and text is not None:
            out.append(F.length(text).cast(docs.schema[c].dataType).alias(c))
        else:
            out.append(F.col("carry").getField(c).alias(c))
    return rows.select(*out)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the trees reject go."""
    forest = quality.train(docs, read(spark, sf_dir, "labels"))
    return _back(quality.apply_rules(docs, forest, carry=_carry(docs)).filter("kept"), docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go; a document of which no line is left stays with an empty text."""
    kept = line_dedup.dedup_lines(docs, carry=_carry(docs))
    return _back(kept, docs, F.when(F.col("carry.text").isNotNull(), F.col("kept").cast("string")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays, that of the smallest doc_id; rows count by themselves, whatever their doc_id."""
    keyed = stored(docs.select(F.monotonically_increasing_id().alias("key"), F.expr(_carry(docs)).alias("carry")), "keyed")
    groups = ngram_join.near_groups(keyed.select("key", F.col("carry.text").alias("text")), id_col="key").select(F.col("doc_id").alias("key"), "class_id")
    groups = stored(groups.join(keyed.select("key", F.col("carry.doc_id").cast("long").alias("doc_id")), "key"), "groups")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key"))
    kept = groups.groupBy("class_id").agg(first.alias("first"), F.count("*").alias("n")).filter("n > 1").select("class_id", F.col("first.key").alias("kept"))
    gone = groups.join(kept, "class_id").filter("key <> kept").select("key")
    return _back(keyed.join(gone, "key", "left_anti"), docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret found becomes a mark."""
    scanned = secrets.scan(docs, carry=_carry(docs))
    return _back(scanned, docs, F.when(F.col("carry.text").isNotNull(), secrets.redacted()))


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in windows of 4096 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality rules", quality_rules), ("line dedup", dedup_lines), ("n-gram Jaccard join", near_duplicates), ("secret scans", redact_secrets), ("packing", pack_windows)]

#: The trees and the tokenizer have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs, f"stage{k}")
    return docs
