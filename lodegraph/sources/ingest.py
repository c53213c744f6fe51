"""From files to the graph: discovery, symbols, relations, configuration keys and their uses, resolution."""

from __future__ import annotations

import ast
import fnmatch
import json
from collections.abc import Callable, Iterator
from functools import partial

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodegraph.functions.text import language
from lodegraph.operators.model import Graph, edge_table, node_table
from lodegraph.sources import braces

MAX_BYTES, PROBE_BYTES = 1 << 20, 8192
SYMBOLS = "file string, pos int, name string, qualified_name string, kind string, start_line int, end_line int, signature string, return_type string, parameters array<struct<name:string,param_type:string,default_value:string>>, cyclomatic int"
RELATIONS = "file string, source string, target string, kind string, line int, hint string"


def discover(spark: SparkSession, root: str, languages: list[str] | None = None, exclude: tuple[str, ...] = (".git/**", "target/**", "node_modules/**", ".lodegraph/**"), ignore: tuple[str, ...] = ()) -> DataFrame:
    """(path, text, language) of text files up to 1 MiB in order of path.

    exclude and ignore are shell patterns on the path below root, ignore those of an ignore file.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    rel = F.regexp_replace("path", "^.*?" + "".join("\\" + c if not c.isalnum() and c != "/" else c for c in root.rstrip("/").split("://")[-1]) + "/", "")
    rows = files.filter(F.col("length") <= MAX_BYTES).filter(~F.contains(F.substring("content", 1, PROBE_BYTES), F.lit(b"\x00")))
    rows = rows.select(rel.alias("path"), F.col("content").cast("string").alias("text"))
    for pattern in (*exclude, *ignore):
        rows = rows.filter(~F.col("path").rlike(fnmatch.translate(pattern.replace("**", "*")).replace(r"\z", "$").replace(r"\Z", "$")))
    rows = rows.withColumn("language", language(F.col("path")))
    return rows.filter(F.col("language").isin(languages)) if languages else rows


def _python_complexity(node: ast.AST) -> int:
    forks = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.IfExp, ast.Assert, ast.comprehension, ast.match_case)
    return 1 + sum(isinstance(n, forks) for n in ast.walk(node)) + sum(len(n.values) - 1 for n in ast.walk(node) if isinstance(n, ast.BoolOp))


def python_symbols(path: str, text: str) -> tuple[list[tuple], list[tuple]]:
    """Symbols and relations of one Python file; none if it cannot be parsed."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError):
        return [], []
    symbols, relations = [], []

    def dotted(node: ast.AST) -> str | None:
        if isinstance(node, ast.Name):
            return node.id
        if isinstance(node, ast.Attribute):
            base = dotted(node.value)
            return f"{base}.{node.attr}" if base else node.attr
        return None

    def visit(body: list[ast.stmt], owner: str) -> None:
        for node in body:
            if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
                name = f"{owner}.{node.name}" if owner else node.name
                args = node.args.posonlyargs + node.args.args + node.args.kwonlyargs
                params = [{"name": a.arg, "param_type": ast.unparse(a.annotation) if a.annotation else None, "default_value": None} for a in args]
                returns = ast.unparse(node.returns) if node.returns else None
                head = f"def {node.name}({', '.join(ast.unparse(a) for a in args)})" + (f" -> {returns}" if returns else "")
                symbols.append((path, len(symbols), node.name, name, "Function", node.lineno, node.end_lineno, head, returns, params, _python_complexity(node)))
                for n in ast.walk(node):
                    if isinstance(n, ast.Call) and (target := dotted(n.func)):
                        relations.append((path, name, target.split(".")[-1], "Calls", n.lineno, target))
                visit([n for n in node.body if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef))], name)
            elif isinstance(node, ast.ClassDef):
                name = f"{owner}.{node.name}" if owner else node.name
                symbols.append((path, len(symbols), node.name, name, "Class", node.lineno, node.end_lineno, None, None, None, None))
                for b in node.bases:
                    if target := dotted(b):
                        relations.append((path, name, target.split(".")[-1], "Extends", node.lineno, target))
                visit(node.body, name)
            elif isinstance(node, (ast.Import, ast.ImportFrom)):
                for a in node.names:
                    symbols.append((path, len(symbols), a.name, f"import {a.name}", "Import", node.lineno, node.lineno, None, None, None, None))

    visit(tree.body, "")
    return symbols, relations


# What starts a symbol in other languages, by kind.
PATTERNS = {
    "rust": [("Function", r"(?m)^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?fn\s+([A-Za-z_]\w*)"), ("Struct", r"(?m)^\s*(?:pub\s+)?struct\s+([A-Za-z_]\w*)"), ("Enum", r"(?m)^\s*(?:pub\s+)?enum\s+([A-Za-z_]\w*)"), ("Interface", r"(?m)^\s*(?:pub\s+)?trait\s+([A-Za-z_]\w*)")],
    "go": [("Function", r"(?m)^func\s+(?:\([^)]*\)\s*)?([A-Za-z_]\w*)"), ("Struct", r"(?m)^type\s+([A-Za-z_]\w*)\s+struct"), ("Interface", r"(?m)^type\s+([A-Za-z_]\w*)\s+interface")],
    "java": [("Class", r"(?m)\bclass\s+([A-Za-z_]\w*)"), ("Interface", r"(?m)\binterface\s+([A-Za-z_]\w*)"), ("Function", r"(?m)^\s+(?:public|private|protected)\s+(?:static\s+)?[\w<>\[\]]+\s+([A-Za-z_]\w*)\s*\(")],
    "csharp": [("Class", r"(?m)\bclass\s+([A-Za-z_]\w*)"), ("Function", r"(?m)^\s+(?:public|private|protected|internal)\s+(?:static\s+|async\s+)*[\w<>\[\]]+\s+([A-Za-z_]\w*)\s*\(")],
    "javascript": [("Function", r"(?m)\bfunction\s+([A-Za-z_$][\w$]*)"), ("Class", r"(?m)\bclass\s+([A-Za-z_$][\w$]*)")],
    "c": [("Function", r"(?m)^[A-Za-z_][\w\s\*]*?\b([A-Za-z_]\w*)\s*\([^;]*\)\s*\{"), ("Struct", r"(?m)\bstruct\s+([A-Za-z_]\w*)\s*\{")],
}
PATTERNS["typescript"] = [*PATTERNS["javascript"], ("Interface", r"(?m)\binterface\s+([A-Za-z_$][\w$]*)")]
PATTERNS["cpp"] = [*PATTERNS["c"], ("Class", r"(?m)\bclass\s+([A-Za-z_]\w*)")]


def regex_symbols(files: DataFrame, patterns: dict[str, list[tuple[str, str]]] = PATTERNS) -> DataFrame:
    """(file, pos, name, kind, start_line): symbols of other languages by pattern, built-in functions only."""
    found = None
    for lang, rules in patterns.items():
        for n, (kind, pattern) in enumerate(rules):
            own = files.filter(F.col("language") == lang)
            before = F.split("text", pattern, -1)
            names = F.regexp_extract_all("text", F.lit(pattern), F.lit(1))
            whole = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
            rows = own.select(F.col("path").alias("file"), before.alias("b"), whole.alias("w"), F.posexplode(names).alias("k", "name"))
            ends = lambda parts: F.aggregate(parts, F.lit(0), lambda s, x: s + F.length(x) - F.length(F.replace(x, F.lit("\n"), F.lit(""))))
            line = ends(F.slice("b", 1, F.col("k") + 1)) + ends(F.slice("w", 1, F.col("k") + 1)) + 1
            rows = rows.select("file", (F.col("k") + 10_000 * n).alias("pos"), "name", F.lit(kind).alias("kind"), line.cast("int").alias("start_line"))
            found = rows if found is None else found.unionAll(rows)
    return found


#: Extractors by language: (path, text) to symbols and relations. Others can be added; languages without one have the symbols of PATTERNS.
EXTRACTORS: dict[str, Callable[[str, str], tuple[list[tuple], list[tuple]]]] = {"python": python_symbols} | {lang: partial(braces.brace_symbols, lang=lang) for lang in braces.PATTERNS}


def _extracted(part: int, schema: str):
    from pyspark.sql.types import StructType

    names = [f.name for f in StructType.fromDDL(schema)]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = [r for path, text, lang in zip(pdf["path"], pdf["text"], pdf["language"], strict=True) for r in EXTRACTORS[lang](path, text)[part]]
            yield pd.DataFrame(rows, columns=names)

    return run


def extract(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Symbols and relations of all files."""
    parsed = files.filter(F.col("language").isin(list(EXTRACTORS)))
    symbols = parsed.mapInPandas(_extracted(0, SYMBOLS), SYMBOLS)
    others = {lang: rules for lang, rules in PATTERNS.items() if lang not in EXTRACTORS}
    if others:
        symbols = symbols.unionByName(regex_symbols(files, others).withColumn("qualified_name", F.col("name")), allowMissingColumns=True)
    return symbols, parsed.mapInPandas(_extracted(1, RELATIONS), RELATIONS)


def first_symbols(symbols: DataFrame) -> DataFrame:
    """One symbol for each file and qualified name, the first."""
    key = F.concat("file", F.lit("::"), F.coalesce("qualified_name", "name"))
    w = Window.partitionBy("key").orderBy("pos")
    return symbols.withColumn("key", key).withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n")


def resolve(relations: DataFrame, nodes: DataFrame) -> DataFrame:
    """(file, source, target, kind, line, dst): the target by the first step of the ladder with one candidate.

    Same file and name; unique qualified name equal to the hint; unique end of a qualified name
    by the hint; unique Type.method; unique bare name. Several candidates resolve to nothing.
    """
    n = nodes.select("id", "name", F.coalesce("qualified_name", "name").alias("q"), F.col("file_path").alias("f"))

    def unique(key: Column, name: str) -> DataFrame:
        return n.select(key.alias(name), "id").filter(F.col(name).isNotNull()).groupBy(name).agg(F.min("id").alias(f"id_{name}"), F.max("id").alias("most")).filter(F.col(f"id_{name}") == F.col("most")).drop("most")

    hint = F.replace("hint", F.lit("::"), F.lit("."))
    last_two = lambda c: F.regexp_extract(c, r"([^.]+\.[^.]+)$", 1)
    dots = F.replace("q", F.lit("::"), F.lit("."))
    rows = relations.withColumn("k1", F.concat("file", F.lit("::"), "target")).withColumn("k2", hint).withColumn("k3", F.nullif(last_two(hint), F.lit(""))).withColumn("k4", F.col("target"))
    rows = rows.join(unique(F.concat("f", F.lit("::"), "name"), "k1"), "k1", "left").join(unique(dots, "k2"), "k2", "left").join(unique(F.nullif(last_two(dots), F.lit("")), "k3"), "k3", "left").join(unique(F.col("name"), "k4"), "k4", "left")
    return rows.select("file", "source", "target", "kind", "line", F.coalesce("id_k1", "id_k2", "id_k3", "id_k4").alias("dst"))


def build(files: DataFrame) -> Graph:
    """The graph of a source tree: files, symbols, containment both ways, and resolved relations."""
    symbols, relations = extract(files)
    s = first_symbols(symbols)
    named = F.xxhash64("file", F.coalesce("qualified_name", "name"), "kind")
    nodes = s.select(named.alias("id"), F.col("kind").alias("node_type"), "name", "qualified_name", "signature", "return_type", "parameters", F.col("file").alias("file_path"), "start_line", "end_line", F.when(F.col("cyclomatic").isNotNull(), F.create_map(F.lit("cyclomatic"), F.col("cyclomatic").cast("string"))).alias("properties"))
    file_nodes = files.select(F.xxhash64("path", F.lit("File")).alias("id"), F.lit("File").alias("node_type"), F.col("path").alias("name"), F.col("path").alias("file_path"), F.sha2("text", 256).alias("code_hash"))
    every = node_table(nodes).unionByName(node_table(file_nodes))
    inside = s.select(F.xxhash64("file", F.lit("File")).alias("file_id"), named.alias("id"))
    edges = inside.select(F.col("file_id").alias("src"), F.col("id").alias("dst"), F.lit("Contains").alias("edge_type")).unionAll(inside.select(F.col("id"), F.col("file_id"), F.lit("DefinedIn")))
    found = resolve(relations, node_table(nodes).filter("node_type <> 'Import'")).filter("dst is not null")
    source = node_table(nodes).select(F.col("file_path").alias("file"), F.coalesce("qualified_name", "name").alias("source"), F.col("id").alias("src"))
    linked = found.join(source, ["file", "source"]).select("src", "dst", F.col("kind").alias("edge_type"), F.create_map(F.lit("call_site_line"), F.col("line").cast("string")).alias("properties"))
    return Graph(every, edge_table(edges).unionByName(edge_table(linked)))


# Configuration -------------------------------------------------------------------------------------------------------


def _flat(prefix: str, value) -> Iterator[tuple[str, str | None, str]]:
    if isinstance(value, dict):
        yield from ([(prefix, None, "Object")] if prefix else [])
        for k, v in value.items():
            yield from _flat(f"{prefix}.{k}" if prefix else str(k), v)
    elif isinstance(value, list):
        yield prefix, json.dumps(value, default=str), "Array"
    elif isinstance(value, bool):
        yield prefix, str(value).lower(), "Boolean"
    elif isinstance(value, (int, float)):
        yield prefix, str(value), "Number"
    elif value is None:
        yield prefix, None, "Null"
    else:
        yield prefix, str(value), "String"


def _yaml(text: str) -> dict:
    """Nested maps of scalars by indentation, and lists of scalars: the common part of YAML."""
    root: dict = {}
    stack: list[tuple[int, dict]] = [(-1, root)]
    last: tuple[dict, str] | None = None
    for line in text.splitlines():
        bare = line.split(" #")[0].rstrip()
        body = bare.strip()
        if not body or body.startswith("#") or body == "---":
            continue
        indent = len(bare) - len(bare.lstrip())
        if body.startswith("- "):
            if last:
                if not isinstance(last[0].get(last[1]), list):
                    last[0][last[1]] = []
                last[0][last[1]].append(_scalar(body[2:]))
            continue
        key, sep, value = body.partition(":")
        if not sep:
            continue
        while stack[-1][0] >= indent:
            stack.pop()
        at = stack[-1][1]
        key, value = key.strip().strip("'\""), value.strip()
        if value:
            at[key] = _scalar(value)
        else:
            at[key] = {}
            stack.append((indent, at[key]))
            last = (at, key)
    return root


def _scalar(text: str):
    t = text.strip()
    if t[:1] in "'\"" and t[-1:] == t[:1]:
        return t[1:-1]
    if t in ("true", "false"):
        return t == "true"
    if t in ("null", "~"):
        return None
    for kind in (int, float):
        try:
            return kind(t)
        except ValueError:
            pass
    return t


def config_rows(path: str, text: str) -> list[tuple[str, str | None, str]]:
    """(key_path, value, value_type) of one file by its extension; none if it cannot be read."""
    ext = path.rsplit(".", 1)[-1].lower()
    try:
        if ext == "json":
            return list(_flat("", json.loads(text)))
        if ext in ("yaml", "yml"):
            return list(_flat("", _yaml(text)))
        if ext == "toml":
            import tomllib

            return list(_flat("", tomllib.loads(text)))
        if ext in ("properties", "ini"):
            out, section = [], ""
            for line in map(str.strip, text.splitlines()):
                if line.startswith("[") and line.endswith("]"):
                    section = line[1:-1] + "."
                elif line and line[0] not in "#;!":
                    k, _, v = line.partition("=") if "=" in line else line.partition(":")
                    out.append((section + k.strip(), v.strip(), "String"))
            return out
        if ext in ("md", "mdx"):
            heads = [x.strip() for x in text.splitlines() if x.startswith("#")]
            return [(x.lstrip("#").strip(), str(len(x) - len(x.lstrip("#"))), "String") for x in heads]
    except (ValueError, RecursionError):
        pass
    return []


def config_keys(files: DataFrame) -> DataFrame:
    """(file, key_path, value, value_type) of configuration files (path, text)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pd.DataFrame([(p, *r) for p, t in zip(pdf["path"], pdf["text"], strict=True) for r in config_rows(p, t)], columns=["file", "key_path", "value", "value_type"])

    return files.filter(F.col("path").rlike(r"\.(json|ya?ml|toml|properties|ini|mdx?)$")).select("path", "text").mapInPandas(run, "file string, key_path string, value string, value_type string")


# How code reads configuration, with the confidence of each way.
USAGES = [(r"""env::var\(\s*["']([^"']+)["']""", "Extracted"), (r"""os\.environ(?:\.get)?[\[(]\s*["']([^"']+)["']""", "Extracted"), (r"""os\.getenv\(\s*["']([^"']+)["']""", "Extracted"), (r"""process\.env\.([A-Za-z_]\w*)""", "Extracted"), (r"""os\.(?:Getenv|LookupEnv)\(\s*"([^"]+)\"""", "Extracted"), (r"""\.get\(\s*["']([^"']+)["']""", "Inferred")]


def config_usages(files: DataFrame) -> DataFrame:
    """(file, line, key, confidence): reads of configuration keys; one line's keys count once, by the surest way."""
    lines = files.select("path", F.posexplode(F.split("text", "\n")).alias("n", "l"))
    found = None
    for rank, (pattern, confidence) in enumerate(USAGES):
        rows = lines.select(F.col("path").alias("file"), (F.col("n") + 1).alias("line"), F.explode(F.regexp_extract_all("l", F.lit(pattern), F.lit(1))).alias("key"), F.lit(rank).alias("rank"), F.lit(confidence).alias("confidence"))
        found = rows if found is None else found.unionAll(rows)
    return found.groupBy("file", "line", "key").agg(F.min_by("confidence", "rank").alias("confidence"))
