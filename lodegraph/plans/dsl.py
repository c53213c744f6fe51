"""The one-line filter language: key:value clauses joined by |, all of which must hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodegraph.operators.model import prop, return_type_text, signature_text

# Bare words that stand for a node type.
SHORTCUTS = {
    "functions": "Function", "classes": "Class", "structs": "Struct", "enums": "Enum", "interfaces": "Interface", "modules": "Module",
    "variables": "Variable", "files": "File", "macros": "Macro", "imports": "Import", "tables": "Table",
}


def _escaped(text: str) -> str:
    return "".join("\\" + c if c in r"\.[]{}()*+-?^$|" else c for c in text)


def wildcard(column: Column, pattern: str) -> Column:
    """* matches anything; a pattern without * must be contained."""
    if "*" not in pattern:
        return F.contains(column, F.lit(pattern))
    return column.rlike("^" + ".*".join(_escaped(p) for p in pattern.split("*")) + "$")


def clause(text: str) -> Column:
    """One clause as a predicate; missing values never match."""
    text = text.strip()
    if text in ("", "all", "*"):
        return F.lit(True)
    key, sep, value = text.partition(":")
    key = key.strip().lower()
    value = value.strip()
    if not sep:
        kind = SHORTCUTS.get(text.lower())
        made = F.col("node_type") == kind if kind else F.col("name") == text
    elif key == "type":
        made = F.lower("node_type") == value.lower()
    elif key == "name":
        made = F.col("name") == value
    elif key == "label":
        made = F.array_contains("labels", value)
    elif key == "repo":
        made = prop("repo") == value
    elif key == "name_suffix":
        made = F.endswith("name", F.lit(value))
    elif key == "signature":
        made = wildcard(signature_text(), value)
    elif key == "return_type":
        made = F.startswith(return_type_text(), F.lit(value))
    elif key in ("module", "resource"):
        made = F.lower(prop(key)) == value.lower()  # the same rule alone and in a compound
    else:
        raise ValueError(f"unknown filter key {key!r}")
    return F.coalesce(made, F.lit(False))


def predicate(text: str) -> Column:
    made = F.lit(True)
    for part in text.split("|"):
        made = made & clause(part)
    return made


def run(nodes: DataFrame, text: str) -> DataFrame:
    return nodes.filter(predicate(text))


def chunks(nodes: DataFrame, text: str, size: int) -> DataFrame:
    """The result with a chunk number: size rows in order of id share one."""
    from pyspark.sql import Window

    if size <= 0:
        raise ValueError("a chunk holds one row at least")
    return run(nodes, text).withColumn("chunk", F.floor((F.row_number().over(Window.orderBy("id")) - 1) / size).cast("long"))
