"""Text: identifier tokens, hashes, the token bloom, escapes, signatures and type maps."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the FNV-1a hash, and the multiplier between the bloom's probes.
FNV_BASIS, FNV_PRIME, PROBE = 0xCBF29CE484222325, 0x100000001B3, 0x9E3779B97F4A7C15
U64 = (1 << 64) - 1
BLOOM_BITS, PROBES = 256, 2


def tokens(text: Column) -> Column:
    """Distinct lower-case identifier parts of three bytes or more, split at non-alphanumerics and at lower-to-upper."""
    parted = F.translate(F.regexp_replace(text, r"(\p{Ll})(\p{Lu})", "$1 $2"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    parts = F.filter(F.split(parted, r"[^\p{L}\p{N}]+"), lambda t: F.octet_length(t) >= 3)
    return F.array_distinct(F.coalesce(parts, F.array().cast("array<string>")))


def hash_tokens(text: Column) -> Column:
    """Runs of letters, digits and underscores, case and repeats kept."""
    return F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def fnv1a(data: bytes) -> int:
    h = FNV_BASIS
    for b in data:
        h = ((h ^ b) * FNV_PRIME) & U64
    return h


def bloom_words(words) -> list[int]:
    """Four 64-bit words, signed, with each token's two bits."""
    out = [0] * (BLOOM_BITS // 64)
    for t in words if words is not None else []:
        h = fnv1a(t.encode())
        for p in range(PROBES):
            bit = (h ^ (p * PROBE & U64)) % BLOOM_BITS
            out[bit // 64] |= 1 << (bit % 64)
    return [x - (1 << 64) if x >> 63 else x for x in out]


def bloom():
    """A column function from array<string> to array<bigint>."""

    @F.pandas_udf("array<long>")
    def run(words: pd.Series) -> pd.Series:
        return words.map(bloom_words)

    return run


def bloom_has_any(column: Column, token: str) -> Column:
    """Whether any probe of a token is set, as the graph's sketches are asked."""
    h = fnv1a(token.encode())
    hit = F.lit(False)
    for p in range(PROBES):
        bit = (h ^ (p * PROBE & U64)) % BLOOM_BITS
        hit = hit | (F.shiftrightunsigned(F.get(column, bit // 64), bit % 64).bitwiseAND(F.lit(1)) == 1)
    return F.coalesce(hit, F.lit(False))


def overlap(have: Column, wanted: list[str]) -> Column:
    """The share of wanted tokens that are present."""
    w = F.array(*(F.lit(x) for x in wanted))
    return F.size(F.array_intersect(have, w)) / F.lit(max(1, len(set(wanted))))


def xml(text: Column) -> Column:
    out = text
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def quoted(text: Column) -> Column:
    """For double quotes: backslashes, quotes and line ends."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(out, F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))


# Languages by file extension.
LANGUAGES = {"rs": "rust", "py": "python", "java": "java", "go": "go", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "cs": "csharp", "c": "c", "h": "c", "cc": "cpp", "cpp": "cpp", "hpp": "cpp"}


def language(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z]+)$", 1))
    return F.element_at(F.create_map(*(F.lit(x) for kv in LANGUAGES.items() for x in kv)), ext)


def canonical_name(name: Column) -> Column:
    """A qualified name with dots between its parts and without argument lists."""
    return F.replace(F.replace(F.regexp_replace(name, r"\(.*$", ""), F.lit("::"), F.lit(".")), F.lit("#"), F.lit("."))


def signature(text: Column) -> Column:
    """struct(name, arity, returns) of a `fn` or `def` signature; null if it is none."""
    pattern = r"(?:fn|def)\s+([A-Za-z_][A-Za-z0-9_]*)\s*\(([^)]*)\)\s*(?:->\s*([^:{]+))?"
    args = F.trim(F.regexp_extract(text, pattern, 2))
    arity = F.when(args == "", 0).otherwise(F.size(F.split(args, ",")))
    return F.when(text.rlike(pattern), F.struct(F.regexp_extract(text, pattern, 1).alias("name"), arity.alias("arity"), F.lower(F.trim(F.regexp_extract(text, pattern, 3))).alias("returns")))


def equivalent(a: Column, b: Column) -> Column:
    """Signatures of the same number of parameters and the same return type."""
    x, y = signature(a), signature(b)
    return F.coalesce((x["arity"] == y["arity"]) & (x["returns"] == y["returns"]), F.lit(False))


# Common types by name, and their names in three interface languages.
COMMON_TYPES = {"int": "Integer", "i32": "Integer", "i64": "Integer", "u32": "Integer", "u64": "Integer", "usize": "Integer", "long": "Integer", "float": "Float", "f32": "Float", "f64": "Float", "double": "Float", "str": "String", "string": "String", "&str": "String", "bool": "Boolean", "boolean": "Boolean", "list": "List", "vec": "List", "dict": "Object", "object": "Object"}
IDL_TYPES = {
    "proto": {"Integer": "int64", "Float": "double", "String": "string", "Boolean": "bool", "List": "repeated string", "Object": "bytes", "Unknown": "string"},
    "thrift": {"Integer": "i64", "Float": "double", "String": "string", "Boolean": "bool", "List": "list<string>", "Object": "binary", "Unknown": "string"},
    "openapi": {"Integer": "integer", "Float": "number", "String": "string", "Boolean": "boolean", "List": "array", "Object": "object", "Unknown": "string"},
}


def mapped(column: Column, table: dict[str, str], other: str) -> Column:
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), column), F.lit(other))


def common_type(name: Column) -> Column:
    return mapped(F.lower(F.regexp_extract(name, r"^\s*([&A-Za-z0-9_]+)", 1)), COMMON_TYPES, "Unknown")


def idl_type(common: Column, dialect: str) -> Column:
    return mapped(common, IDL_TYPES[dialect], IDL_TYPES[dialect]["Unknown"])
