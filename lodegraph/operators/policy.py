"""Policies, rules, change risk and change sets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodegraph.operators.model import Graph, prop


def violations(zone: DataFrame, centrality: DataFrame, domains: DataFrame, forbidden: list[tuple[str, str]], max_impact: int | None, max_centrality: float | None) -> DataFrame:
    """(id, kind, detail, first) of all violations of each target; first marks the one that stands first in the order of checks.

    zone (id, member): the impact zone; centrality (id, betweenness); domains (id, domain).
    """
    found = []
    if max_impact is not None:
        found.append(zone.groupBy("id").agg(F.count("*").alias("n")).filter(F.col("n") > max_impact).select("id", F.lit(1).alias("order"), F.lit("ScaleFailure").alias("kind"), F.col("n").cast("string").alias("detail")))
    if forbidden:
        d = domains.select("id", "domain")
        pairs = zone.join(d, "id").join(d.select(F.col("id").alias("member"), F.col("domain").alias("other")), "member")
        bad = reduce(lambda x, y: x | y, (((F.col("domain") == a) & (F.col("other") == b)) | ((F.col("domain") == b) & (F.col("other") == a)) for a, b in forbidden))
        found.append(pairs.filter(bad).groupBy("id").agg(F.min(F.concat_ws("-", "domain", "other")).alias("detail")).select("id", F.lit(2).alias("order"), F.lit("DomainIsolation").alias("kind"), "detail"))
    if max_centrality is not None:
        found.append(centrality.filter(F.col("betweenness") > max_centrality).select("id", F.lit(3).alias("order"), F.lit("CascadeHazard").alias("kind"), F.lit(None).cast("string").alias("detail")))
    if not found:
        return zone.select("id", F.lit("").alias("kind"), F.lit("").alias("detail"), F.lit(True).alias("first")).limit(0)
    rows = reduce(DataFrame.unionByName, found)
    least = rows.groupBy("id").agg(F.min("order").alias("least"))
    return rows.join(least, "id").select("id", "kind", "detail", (F.col("order") == F.col("least")).alias("first"))


def rule_column(match: dict, calls: dict[str, Column] | None = None) -> Column:
    """A rule's match object as a predicate; a missing value is false, also below not."""
    if "and" in match:
        return reduce(lambda a, b: a & b, (rule_column(m, calls) for m in match["and"]), F.lit(True))
    if "or" in match:
        return reduce(lambda a, b: a | b, (rule_column(m, calls) for m in match["or"]), F.lit(False))
    if "not" in match:
        return ~rule_column(match["not"], calls)
    kind, cx = match.get("type"), prop("cyclomatic").try_cast("int")
    if kind == "node_type":
        made = F.col("node_type") == match["value"]
    elif kind == "name":
        made = F.col("name").rlike(match["pattern"])
    elif kind == "has_label":
        made = F.array_contains("labels", match["label"])
    elif kind == "complexity_gt":
        made = cx > int(match["value"])
    elif kind == "complexity_lt":
        made = cx < int(match["value"])
    elif kind == "has_property":
        made = prop(match["key"]) == match["value"] if "value" in match else prop(match["key"]).isNotNull()
    elif kind == "calls_any":
        made = (calls or {})[",".join(match["names"])]
    else:
        raise ValueError(f"unknown rule condition {kind!r}")
    return F.coalesce(made, F.lit(False))


def _calls_any(match: dict) -> list[list[str]]:
    inner = [m for k in ("and", "or") for m in match.get(k, [])] + ([match["not"]] if "not" in match else [])
    return [match["names"]] if match.get("type") == "calls_any" else [n for m in inner for n in _calls_any(m)]


def apply_rules(graph: Graph, ruleset: dict, dry_run: bool = False) -> DataFrame:
    """The nodes after all rules' actions, in order; with dry_run (id, rule) of all matches instead."""
    nodes, reports = graph.nodes, []
    for rule in ruleset["rules"]:
        calls = {}
        for k, names in enumerate(_calls_any(rule["match"])):
            callee = reduce(lambda a, b: a | b, (F.contains("name", F.lit(n)) for n in names))
            hit = graph.of(["Calls"]).join(graph.nodes.filter(callee).select(F.col("id").alias("dst")), "dst", "left_semi").select(F.col("src").alias("id")).distinct().withColumn(f"__calls{k}", F.lit(True))
            nodes = nodes.join(hit, "id", "left")
            calls[",".join(names)] = F.col(f"__calls{k}")
        hit = rule_column(rule["match"], calls)
        if dry_run:
            reports.append(nodes.filter(hit).select("id", F.lit(rule["name"]).alias("rule")))
        else:
            nodes = nodes.withColumn("__hit", hit)
            for action in rule.get("actions", []):
                kind = action["type"]
                if kind == "add_label":
                    nodes = _labelled(nodes, action["label"])
                elif kind == "set_metadata":
                    nodes = _set(nodes, action["key"], action["value"])
                elif kind == "set_complexity_override":
                    nodes = _labelled(_set(nodes, "complexity_override", action["level"]), f"complexity:{action['level']}")
                else:
                    raise ValueError(f"unknown rule action {kind!r}")
        nodes = nodes.select(*graph.nodes.columns)
    return reduce(DataFrame.unionByName, reports) if dry_run else nodes


def _labelled(nodes: DataFrame, label: str) -> DataFrame:
    have = F.coalesce("labels", F.array().cast("array<string>"))
    return nodes.withColumn("labels", F.when(F.col("__hit"), F.array_union(have, F.array(F.lit(label)))).otherwise(F.col("labels")))


def _set(nodes: DataFrame, key: str, value: str) -> DataFrame:
    rest = F.map_filter(F.coalesce("properties", F.create_map().cast("map<string,string>")), lambda k, _: k != key)
    return nodes.withColumn("properties", F.when(F.col("__hit"), F.map_concat(rest, F.create_map(F.lit(key), F.lit(value)))).otherwise(F.col("properties")))


def change_risk(changed: DataFrame, nodes: DataFrame, blast: DataFrame) -> DataFrame:
    """One row (changed, max_score, zone, level) for changed files (file_path)."""
    rows = nodes.join(changed.select("file_path").distinct(), "file_path", "left_semi").select("id").join(blast, "id")
    summed = rows.agg(F.count("*").alias("changed"), F.coalesce(F.max("score"), F.lit(0.0)).alias("max_score"), F.coalesce(F.max("impact_zone"), F.lit(0)).cast("long").alias("zone"))
    level = F.when((F.col("max_score") >= 80) | (F.col("zone") >= 50), "Critical").when(F.col("max_score") >= 60, "High").when(F.col("max_score") >= 40, "Medium").otherwise("Low")
    return summed.withColumn("level", level)


def change_set(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, change) of files (path, hash) that were added, deleted or changed."""
    rows = before.select("path", F.col("hash").alias("old")).join(after.select("path", F.col("hash").alias("new")), "path", "full_outer")
    kind = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "deleted").when(F.col("old") != F.col("new"), "changed")
    return rows.select("path", kind.alias("change")).filter("change is not null")


def drift(before: DataFrame, after: DataFrame) -> DataFrame:
    """(key_path, change, old, new) between two sets of configuration keys (key_path, value)."""
    rows = before.select("key_path", F.col("value").alias("old")).join(after.select("key_path", F.col("value").alias("new")), "key_path", "full_outer")
    kind = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "changed")
    return rows.select("key_path", kind.alias("change"), "old", "new").filter("change is not null")


def unused_keys(graph: Graph) -> DataFrame:
    """(id, name) of configuration keys that no edge uses."""
    return graph.nodes.filter("node_type = 'ConfigKey'").select("id", "name").join(graph.of(["UsesConfig"]).select(F.col("dst").alias("id")), "id", "left_anti")


def enclosing(symbols: DataFrame, places: DataFrame) -> DataFrame:
    """(file_path, line, id): the innermost symbol around a place, that of the latest start, then the smallest id.

    The join is on file and blocks of lines, so only symbols near a line meet it.
    """
    width = 64
    spread = symbols.filter("start_line <= end_line").select("file_path", "id", "start_line", "end_line", F.explode(F.sequence(F.floor(F.col("start_line") / width), F.floor(F.col("end_line") / width))).alias("block"))
    at = places.select("file_path", "line").distinct().withColumn("block", F.floor(F.col("line") / width))
    return at.join(spread, ["file_path", "block"]).filter("line between start_line and end_line").groupBy("file_path", "line").agg(F.max_by("id", F.struct("start_line", -F.col("id"))).alias("id"))
