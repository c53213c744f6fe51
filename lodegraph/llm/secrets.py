"""Secret scans through a trigram inverted index, in SQL functions only.

Planning (on the driver, over the rules alone): each rule's regular expression is parsed and
turned into a Boolean trigram query, an OR of ANDs of three-letter strings that every match
must hold, in lower case. A rule whose expression has no such strings scans every text.

Execution: one pass over the documents makes postings (trigram, document) for the trigrams
of the queries; others are not indexed, as no query asks for them. Postings are intersected by
counting, for each document and AND-clause, the distinct trigrams; complete clauses make
candidates, which are written to the shared folder. A second pass joins them to the documents
and the rule's expression verifies them on the whole text: up to ``BROADCAST_ROWS`` measured
candidates go to the texts, more meet them in a shuffle. Rules that scan fully (hex) need no
candidates and run in that same pass.

Places: text between matches comes from split(), so a match starts after all earlier gaps and
matches. Starts are prefix sums by doubling strides, so a text of n matches takes n log n steps.

Defined cases: a null or empty text has no spans; a very long text is scanned whole, in one row;
spans that start together are in order of their kinds, and equal ones of several kinds all stay;
rows that share a doc_id are each scanned (a candidate of one is a candidate of all); a null
doc_id is a key like any other; an empty table gives no rows. Columns other than the two named
ones are ignored.
"""

from __future__ import annotations

import re
import re._constants as C
import re._parser as regex_parser
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodegraph.llm.common import stored


@dataclass(frozen=True)
class Rule:
    """A kind of secret: its expression, and the fewest code points of a group or of the match.

    regex finds matches leftmost and non-overlapping; a match whose group is too short is dropped.
    """

    kind: str
    regex: str
    group: int = 0
    least: int = 1


# The three base kinds, in the order in which spans of one start are listed.
BASE = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
)
#: Further kinds, which the index makes cheap.
MORE = (
    Rule("github", r"gh[opusr]_[A-Za-z0-9_]+", 0, 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 0, 15),
    Rule("google", r"AIza[A-Za-z0-9_-]+", 0, 39),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 30),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
)
RULES = BASE + MORE

#: An exact set of strings larger than this is given up; so is a longer string of it.
MAX_STRINGS, MAX_LENGTH = 24, 24
#: Candidates (an id and a few kinds each, some 10 MB in all) that may go to every executor.
BROADCAST_ROWS = 100_000

Query = frozenset[frozenset[str]]  # OR of ANDs; the empty AND is true
ANY: Query = frozenset([frozenset()])


def _and(a: Query, b: Query) -> Query:
    return _least(frozenset(x | y for x in a for y in b)) if len(a) * len(b) <= MAX_STRINGS else min(a, b, key=len)


def _least(q: Query) -> Query:
    """Clauses that hold another clause add nothing."""
    return frozenset(x for x in q if not any(y < x for y in q))


def _grams(strings: frozenset[str]) -> Query:
    """Each string's trigrams; a string shorter than three says nothing."""
    return _least(frozenset(frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings))


def _node(op, arg) -> tuple[frozenset[str] | None, Query]:
    """The exact lower-case strings of a part (None if many), and the query for its matches."""
    if op is C.LITERAL:
        return frozenset([chr(arg).lower()]), ANY
    if op is C.IN:
        chars: set[str] = set()
        for kind, value in arg:
            if kind is C.LITERAL:
                chars.add(chr(value).lower())
            elif kind is C.RANGE and value[1] - value[0] < 128:
                chars |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
            else:
                return None, ANY
        return (frozenset(chars), ANY) if len(chars) <= 8 else (None, ANY)
    if op is C.SUBPATTERN:
        return _sequence(arg[3])
    if op is C.ATOMIC_GROUP:
        return _sequence(arg)
    if op is C.BRANCH:
        parts = [_sequence(x) for x in arg[1]]
        query = _least(frozenset().union(*(_and(q, _grams(e)) if e is not None else q for e, q in parts)))
        if all(e is not None for e, _ in parts) and sum(len(e) for e, _ in parts) <= MAX_STRINGS:
            return frozenset().union(*(e for e, _ in parts)), ANY
        return None, query
    if op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
        low, high, part = arg
        exact, query = _sequence(part)
        if low == 0:
            return (exact | {""} if exact is not None and high == 1 else None), ANY
        if low == high == 1:
            return exact, query
        return None, _and(query, _grams(exact)) if exact is not None else query
    if op is C.AT or op in (C.ASSERT, C.ASSERT_NOT):
        return frozenset([""]), ANY
    return None, ANY


def _sequence(parts) -> tuple[frozenset[str] | None, Query]:
    """Runs of exact parts multiply; where a part is not exact, the run's trigrams join the query."""
    run, query, whole = frozenset([""]), ANY, True
    for op, arg in parts:
        exact, own = _node(op, arg)
        query = _and(query, own)
        if exact is not None and len(exact) * len(run) <= MAX_STRINGS and max(map(len, run)) < MAX_LENGTH:
            run = frozenset(a + b for a in run for b in exact)
            continue
        whole = False
        query = _and(query, _grams(run))
        run = exact if exact is not None else frozenset([""])
    return (run, query) if whole else (None, _and(query, _grams(run)))


def trigram_query(rule: Rule) -> Query:
    """The rule's Boolean trigram query; ANY if it must scan fully."""
    exact, query = _sequence(regex_parser.parse(rule.regex))
    return _and(query, _grams(exact)) if exact is not None else query


def postings(docs: DataFrame, trigrams: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The inverted index for some trigrams, which are ASCII: (trigram, doc_id). A text is lower-cased once for all of them."""
    ascii_only = F.regexp_replace(F.col(text_col), r"[^\x00-\x7F]+", "\x00")  # lower() takes five times as long with other letters
    low = docs.select(F.col(id_col).alias("doc_id"), F.lower(ascii_only).alias("low"))
    held = F.array(*(F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in trigrams))
    return low.select("doc_id", F.explode(held).alias("trigram")).filter("trigram is not null")


def candidates(index: DataFrame, queries: dict[str, Query]) -> DataFrame:
    """Intersect postings: (doc_id, kinds) of all documents that satisfy a rule's query."""
    spark = index.sparkSession
    plan = [(kind, f"{kind}/{n}", len(clause), t) for kind, q in queries.items() for n, clause in enumerate(sorted(map(sorted, q))) for t in clause]
    rows = F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip(("kind", "clause", "size", "trigram"), p, strict=True))) for p in plan))
    clauses = spark.range(1).select(F.inline(rows))  # bounded by the rules
    found = index.join(F.broadcast(clauses), "trigram").groupBy("doc_id", "kind", "clause", "size").agg(F.collect_set("trigram").alias("got"))
    return found.filter(F.size("got") == F.col("size")).groupBy("doc_id").agg(F.collect_set("kind").alias("kinds"))


def _dense(rule: Rule) -> str:
    """The expression to run: where a match is one maximal run of a class, short runs are left out at once.

    Only for expressions that are single characters of a class and then the class repeated: every
    start inside a run ends where the run ends, so a dropped match hides no longer one.
    """
    m = re.fullmatch(r"((?:[A-Za-z_-]|\[[a-z]+\])*)(\[[^\]]+\])\+", rule.regex)
    if rule.group or not m or rule.least < 2:
        return rule.regex
    head, klass = m.groups()
    width = len(regex_parser.parse(head)) if head else 0
    start = "" if head else f"(?<!{klass})"
    return f"{start}{head}{klass}{{{rule.least - width},}}+"


def running(values: Column, combine) -> Column:
    """Inclusive prefix combinations of an array by doubling strides: n log n steps, no growing state."""
    strides = F.filter(F.array(*(F.lit(1 << k) for k in range(31))), lambda d: d < F.size(values))
    return F.aggregate(strides, values, lambda have, d: F.transform(have, lambda x, i: F.when(i >= d, combine(x, F.get(have, i - d))).otherwise(x)))


def let(value: Column, use) -> Column:
    """use(value) with the value computed once, however often use needs it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def places(found: Column, gaps: Column, rule: Rule, rank: int, octets: bool = False) -> Column:
    """(start, rank, end) of each match that is long enough, from the matches and the gaps before them, in code points.

    octets: also (first, last), the same place in bytes.
    """
    none = F.array().cast("array<struct<start:int,rank:int,end:int" + (",first:int,last:int>>" if octets else ">>"))

    def starts(length) -> Column:
        before = F.transform(found, lambda x, i: length(F.get(gaps, i)) + F.when(i > 0, length(F.get(found, i - 1))).otherwise(0))
        return running(before, lambda a, b: a + b)

    def made(points: Column, at: Column | None) -> Column:
        def one(x, i) -> Column:
            fields = [F.get(points, i).alias("start"), F.lit(rank).alias("rank"), (F.get(points, i) + F.length(x)).alias("end")]
            if octets:
                fields += [F.get(at, i).alias("first"), (F.get(at, i) + F.octet_length(x)).alias("last")]
            size = F.length(F.regexp_extract(x, rule.regex, rule.group)) if rule.group else F.length(x)
            return F.when(size >= rule.least, F.struct(*fields))

        return F.filter(F.transform(found, one), lambda s: s.isNotNull())

    kept = let(starts(F.length), lambda points: let(starts(F.octet_length), lambda at: made(points, at)) if octets else made(points, None))
    return F.when(F.size(found) > 0, kept).otherwise(none)


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text", carry: str | None = None) -> DataFrame:
    """doc_id and spans, an array of (start, rank, end) in order; rank is the rule's place in rules.

    carry is an SQL expression whose value travels along, with the text; spans have first and last then (see places).
    """
    queries = {r.kind: trigram_query(r) for r in rules}
    indexed = {k: q for k, q in queries.items() if q != ANY}
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), *([F.expr(carry).alias("carry")] if carry else []))
    if indexed:
        trigrams = sorted({t for q in indexed.values() for clause in q for t in clause})
        chosen = stored(candidates(postings(base, trigrams), indexed), "candidates").select(F.col("doc_id").alias("candidate"), "kinds")
        if chosen.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:  # measured: the texts stay where they are
            chosen = F.broadcast(chosen)
        base = base.join(chosen, F.col("doc_id").eqNullSafe(F.col("candidate")), "left").drop("candidate")
    else:
        base = base.withColumn("kinds", F.array().cast("array<string>"))
    text = F.col("text")
    for n, r in enumerate(rules):
        run = F.regexp_extract_all(text, F.lit(_dense(r)), F.lit(0))
        base = base.withColumn(f"m{n}", run if queries[r.kind] == ANY else F.when(F.array_contains("kinds", r.kind), run))
    for n, r in enumerate(rules):
        base = base.withColumn(f"g{n}", F.when(F.size(f"m{n}") > 0, F.split(text, _dense(r), -1)))
    all_spans = [places(F.col(f"m{n}"), F.col(f"g{n}"), r, n, bool(carry)) for n, r in enumerate(rules)]
    return base.select("doc_id", F.array_sort(F.concat(*all_spans)).alias("spans"), *(["text", "carry"] if carry else []))


def _joined(spans_col: Column, rules: tuple[Rule, ...]) -> Column:
    names = F.array(*(F.lit(r.kind) for r in rules))
    return F.concat_ws(",", F.transform(spans_col, lambda s: F.concat_ws(":", F.element_at(names, s["rank"] + 1), s["start"].cast("string"), s["end"].cast("string"))))


def digest(scanned: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, counts of the base kinds, the digest of base spans, and all spans as text."""
    n = len(BASE)
    base = F.filter("spans", lambda s: s["rank"] < n)
    count = lambda k: F.size(F.filter("spans", lambda s: s["rank"] == k)).cast("long")
    return scanned.select(
        "doc_id", *(count(k).alias(f"n_{r.kind}") for k, r in enumerate(rules[:n])),
        F.sha2(_joined(base, rules).cast("binary"), 256).alias("base_sha256"), _joined(F.col("spans"), rules).alias("spans"),
    )


def redacted(mark: str = "[SECRET]") -> Column:
    """The text of a scan with carry, its spans replaced; overlapping spans merge into one.

    The text is cut by byte places, which takes no walk from its start for each span.
    """
    spans = F.col("spans")

    def joined(data: Column, ends: Column) -> Column:
        cuts = F.transform(spans, lambda s, i: F.struct(F.coalesce(F.get(ends, i - 1), F.lit(0)).alias("at"), s["first"].alias("upto")))
        gaps = F.transform(F.filter(cuts, lambda c: c["upto"] >= c["at"]), lambda c: F.substring(data, c["at"] + 1, c["upto"] - c["at"]).cast("string"))
        tail = F.substring(data, F.element_at(ends, -1) + 1, F.octet_length(data)).cast("string")
        return F.array_join(F.concat(gaps, F.array(tail)), mark)

    ends = running(F.transform(spans, lambda s: s["last"]), F.greatest)
    done = let(F.col("text").cast("binary"), lambda data: let(ends, lambda e: joined(data, e)))
    return F.when(F.size("spans") > 0, done).otherwise(F.col("text"))


def brute_force(text: str | None, rules: tuple[Rule, ...] = RULES) -> list[tuple[int, int, int]]:
    """(start, rank, end) by plain regular expressions, for tests."""
    out = []
    for n, r in enumerate(rules):
        for m in re.finditer(r.regex.replace("(?i:", "(?ai:"), text or ""):
            if len(m.group(r.group)) >= r.least:
                out.append((m.start(), n, m.end()))
    return sorted(out)
