"""Program analysis of one function at a time over statement and block-edge tables.

Statements: (fn, stmt, block, idx, kind, line, text, defs, uses). Block edges: (fn, src, dst, kind).
The entry is the smallest block of a function. Sets of blocks or statements are Python integers
used as bit sets, so a round of a fixpoint is a few machine operations for common functions.
Functions are dealt to tasks by fn, and each task walks its functions one after another; a
function is the unit of work and is bounded by the size of a source file's function.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterable, Iterator
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

STMTS = "fn long, stmt int, block int, idx int, kind string, line int, text string, defs array<string>, uses array<string>"
EDGES = "fn long, src int, dst int, kind string"


def bits(mask: int) -> Iterator[int]:
    """The positions of the ones."""
    while mask:
        low = mask & -mask
        yield low.bit_length() - 1
        mask ^= low


class Function:
    """A function's statements and blocks, and what follows from them."""

    def __init__(self, fn, stmts: list[dict], edges: list[tuple[int, int, str]]):
        self.fn = fn
        self.stmts = sorted(stmts, key=lambda s: (s["block"], s["idx"]))
        names = sorted({s["block"] for s in stmts} | {x for a, b, _ in edges for x in (a, b)})
        self.blocks = names
        self.at = {b: i for i, b in enumerate(names)}
        n = len(names)
        self.succ, self.pred = [0] * n, [0] * n
        for a, b, _ in edges:
            self.succ[self.at[a]] |= 1 << self.at[b]
            self.pred[self.at[b]] |= 1 << self.at[a]
        self.of_block: list[list[int]] = [[] for _ in names]
        for k, s in enumerate(self.stmts):
            self.of_block[self.at[s["block"]]].append(k)

    def spread(self, start: int, step: list[int]) -> int:
        """All that start reaches over step, itself included."""
        seen = new = start
        while new:
            out = 0
            for b in bits(new):
                out |= step[b]
            new = out & ~seen
            seen |= new
        return seen

    @cached_property
    def reachable(self) -> int:
        return self.spread(1, self.succ) if self.blocks else 0

    @cached_property
    def after(self) -> list[int]:
        """For each block what it reaches in one step or more."""
        return [self.spread(s, self.succ) if s else 0 for s in self.succ]

    def has_cycle(self) -> bool:
        return any(self.after[b] >> b & 1 for b in bits(self.reachable))

    @staticmethod
    def _dominators(entries: int, step: list[int], back: list[int], n: int) -> list[int]:
        """Each block's dominators as a set: the entries' own, and what all ways into the others share."""
        every = (1 << n) - 1
        dom = [1 << b if entries >> b & 1 else every for b in range(n)]
        work = deque(range(n))
        while work:
            b = work.popleft()
            if entries >> b & 1:
                continue
            new = every
            for p in bits(back[b]):
                new &= dom[p]
            new |= 1 << b
            if new != dom[b]:
                dom[b] = new
                work.extend(bits(step[b]))
        return dom

    @cached_property
    def dominators(self) -> list[int]:
        live = self.reachable
        return self._dominators(1, self.succ, [p & live for p in self.pred], len(self.blocks)) if self.blocks else []

    @cached_property
    def post_dominators(self) -> list[int]:
        exits = sum(1 << b for b, s in enumerate(self.succ) if not s)
        return self._dominators(exits or 1 << max(0, len(self.blocks) - 1), self.pred, self.succ, len(self.blocks))

    @staticmethod
    def nearest(dom: list[int]) -> list[int | None]:
        """The immediate dominator: the strict dominator with the most dominators of its own."""
        return [max(bits(d & ~(1 << b)), key=lambda x: dom[x].bit_count(), default=None) for b, d in enumerate(dom)]

    def dominates(self, a: int, b: int) -> bool:
        return bool(self.dominators[self.at[b]] >> self.at[a] & 1)

    @cached_property
    def frontiers(self) -> list[int]:
        """Where a block's dominance ends: it dominates a predecessor, but not strictly the block."""
        out = [0] * len(self.blocks)
        for b in bits(self.reachable):
            strict = self.dominators[b] & ~(1 << b)
            for p in bits(self.pred[b] & self.reachable):
                for d in bits(self.dominators[p] & ~strict):
                    out[d] |= 1 << b
        return out

    def paths(self, limit: int = 10_000) -> list[list[int]]:
        """Block paths from the entry to blocks without successors, no block twice; an error beyond limit."""
        out, work = [], [[0]] if self.blocks else []
        while work:
            path = work.pop()
            nexts = [b for b in bits(self.succ[path[-1]]) if b not in path]
            if not self.succ[path[-1]]:
                out.append([self.blocks[b] for b in path])
                if len(out) > limit:
                    raise ValueError(f"more than {limit} paths")
            work.extend([*path, b] for b in reversed(nexts))
        return out

    @cached_property
    def definitions(self) -> list[tuple[int, str]]:
        return [(k, v) for k, s in enumerate(self.stmts) for v in sorted(set(s["defs"] or []))]

    @cached_property
    def reaching(self) -> list[int]:
        """For each block the definitions, as positions in definitions, that hold at its start."""
        by_var: dict[str, int] = {}
        for d, (_, v) in enumerate(self.definitions):
            by_var[v] = by_var.get(v, 0) | 1 << d
        gen, kill = [0] * len(self.blocks), [0] * len(self.blocks)
        for d, (k, v) in enumerate(self.definitions):
            b = self.at[self.stmts[k]["block"]]
            gen[b] = gen[b] & ~by_var[v] | 1 << d
            kill[b] |= by_var[v]
        into = [0] * len(self.blocks)
        work = deque(range(len(self.blocks)))
        while work:
            b = work.popleft()
            new = 0
            for p in bits(self.pred[b]):
                new |= gen[p] | into[p] & ~kill[p]
            if new != into[b]:
                into[b] = new
                work.extend(bits(self.succ[b]))
        return into

    def use_definitions(self) -> Iterator[tuple[int, str, int]]:
        """(using statement, variable, defining statement) of the definitions that hold at each use."""
        for b, rows in enumerate(self.of_block):
            held: dict[str, list[int]] = {}
            for d in bits(self.reaching[b]):
                k, v = self.definitions[d]
                held.setdefault(v, []).append(k)
            for k in rows:
                for v in sorted(set(self.stmts[k]["uses"] or [])):
                    for d in held.get(v, ()):
                        yield k, v, d
                for v in self.stmts[k]["defs"] or []:
                    held[v] = [k]

    @cached_property
    def data(self) -> list[tuple[int, int, str, str, bool]]:
        """(from, to, variable, type, loop carried). Within a block every earlier definition flows on, without a kill."""
        out: set[tuple[int, int, str, str]] = set()
        for b, rows in enumerate(self.of_block):
            for n, k in enumerate(rows):
                uses, defs = set(self.stmts[k]["uses"] or []), set(self.stmts[k]["defs"] or [])
                out.update((self.definitions[d][0], k, self.definitions[d][1], "Flow") for d in bits(self.reaching[b]) if self.definitions[d][1] in uses)
                for e in rows[:n]:
                    before_d, before_u = set(self.stmts[e]["defs"] or []), set(self.stmts[e]["uses"] or [])
                    out.update((e, k, v, "Flow") for v in uses & before_d)
                    out.update((e, k, v, "Anti") for v in (uses & before_u) - before_d)
                    out.update((e, k, v, "Output") for v in defs & before_d)
        block = lambda k: self.at[self.stmts[k]["block"]]
        return [(a, c, v, t, bool(self.after[block(c)] >> block(a) & 1)) for a, c, v, t in sorted(out) if a != c]

    @cached_property
    def control(self) -> list[tuple[int, int]]:
        """(controller, dependent): a block's branch, or last statement, controls its frontier; else by post-dominance."""

        def chief(rows: list[int]) -> int | None:
            return next((k for k in rows if self.stmts[k]["kind"] == "Branch"), rows[-1] if rows else None)

        out = {(c, k) for b, f in enumerate(self.frontiers) if (c := chief(self.of_block[b])) is not None for t in bits(f) for k in self.of_block[t] if k != c}
        if not out:
            nearest = self.nearest(self.post_dominators)
            for a, s in enumerate(self.succ):
                c = chief(self.of_block[a])
                if c is not None:
                    out |= {(c, k) for b in bits(s) if nearest[a] != b for k in self.of_block[b] if k != c}
        return sorted(out)

    def closure(self, seeds: Iterable[int], backward: bool = True) -> int:
        """Statements that data and control dependence link to the seeds."""
        step = [0] * len(self.stmts)
        for a, c in [(d[0], d[1]) for d in self.data] + self.control:
            if backward:
                step[c] |= 1 << a
            else:
                step[a] |= 1 << c
        return self.spread(sum(1 << k for k in set(seeds)), step)

    def seeds(self, line: int, variable: str) -> list[int]:
        """Statements of a line that define or use a variable or a field of it; an error if there is none."""
        hit = lambda v: v == variable or v.startswith(variable + ".")
        out = [k for k, s in enumerate(self.stmts) if s["line"] == line and any(hit(v) for v in [*(s["defs"] or []), *(s["uses"] or [])])]
        if not out:
            raise ValueError(f"no statement of line {line} has {variable}")
        return out

    def slice(self, line: int, variable: str, backward: bool = True) -> tuple[list[int], float]:
        """Statement numbers of a slice, and by how many percent of the function's lines it is shorter."""
        got = self.closure(self.seeds(line, variable), backward)
        lines, every = {self.stmts[k]["line"] for k in bits(got)}, {s["line"] for s in self.stmts}
        return [self.stmts[k]["stmt"] for k in bits(got)], 100 * (1 - len(lines) / max(1, len(every)))

    def aliases(self, name: str) -> set[str]:
        """Names that may share a value: plain copies, and fields with their base."""
        near: dict[str, set[str]] = {name: set()}

        def tie(a: str, b: str) -> None:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)

        for s in self.stmts:
            d, u = set(s["defs"] or []), set(s["uses"] or [])
            for v in d | u | {name}:
                near.setdefault(v, set())
                if "." in v:
                    tie(v, v.split(".", 1)[0])
            if len(d) == len(u) == 1 and not any("." in v for v in d | u):
                tie(*d, *u) if d != u else None
        seen, work = {name}, [name]
        while work:
            for v in near[work.pop()] - seen:
                seen.add(v)
                work.append(v)
        return seen

    def depth_of(self, variable: str) -> int:
        """The longest distance that data flows from the uses of a variable."""
        step: dict[int, set[int]] = {}
        for a, c, *_ in self.data:
            step.setdefault(a, set()).add(c)
        seen = {k: 0 for k, s in enumerate(self.stmts) if variable in (s["uses"] or [])}
        work = deque(seen)
        while work:
            k = work.popleft()
            for c in step.get(k, set()) - seen.keys():
                seen[c] = seen[k] + 1
                work.append(c)
        return max(seen.values(), default=0)


def per_function(stmts: DataFrame, edges: DataFrame | None, kernel: Callable[[Function], Iterable[tuple]], schema: str) -> DataFrame:
    """kernel's rows, each led by fn, for every function; schema names fn first."""
    s = stmts.select("fn", F.lit(0).alias("what"), *(F.col(c.split()[0]) for c in STMTS.split(", ")[1:]), F.lit(0).alias("src"), F.lit(0).alias("dst"))
    if edges is not None:
        none = {c.split(" ")[0]: c.split(" ")[1] for c in STMTS.split(", ")[1:]}
        s = s.unionByName(edges.select("fn", F.lit(1).alias("what"), *(F.col("kind") if c == "kind" else F.lit(None).cast(t).alias(c) for c, t in none.items()), "src", "dst"))
    out = StructType.fromDDL(schema)
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: list[tuple] = []
        now, rows, links = None, [], []

        def flush() -> pa.RecordBatch:
            columns = list(zip(*made, strict=True))
            made.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

        def close() -> None:
            if rows:
                made.extend((now, *r) for r in kernel(Function(now, rows, links)))

        for batch in batches:
            for r in batch.to_pylist():
                if r["fn"] != now:
                    close()
                    now, rows, links = r["fn"], [], []
                if r["what"]:
                    links.append((r["src"], r["dst"], r["kind"]))
                else:
                    rows.append(r)
            if len(made) > 4096:
                yield flush()
        close()
        if made:
            yield flush()

    return s.repartition("fn").sortWithinPartitions("fn").mapInArrow(run, out)


def reaching_definitions(stmts, edges):
    """(fn, stmt, variable, def_stmt): definitions that hold at each use."""
    return per_function(stmts, edges, lambda f: ((f.stmts[k]["stmt"], v, f.stmts[d]["stmt"]) for k, v, d in f.use_definitions()), "fn long, stmt int, variable string, def_stmt int")


def data_dependences(stmts, edges):
    """(fn, src, dst, variable, dep_type, loop_carried)."""
    return per_function(stmts, edges, lambda f: ((f.stmts[a]["stmt"], f.stmts[c]["stmt"], v, t, l) for a, c, v, t, l in f.data), "fn long, src int, dst int, variable string, dep_type string, loop_carried boolean")


def control_dependences(stmts, edges):
    """(fn, controller, dependent)."""
    return per_function(stmts, edges, lambda f: ((f.stmts[a]["stmt"], f.stmts[c]["stmt"]) for a, c in f.control), "fn long, controller int, dependent int")


def dominators(stmts, edges):
    """(fn, block, idom, frontier) of reachable blocks; the entry's idom is null."""

    def kernel(f: Function):
        idom = f.nearest(f.dominators)
        for b in bits(f.reachable):
            yield f.blocks[b], None if idom[b] is None else f.blocks[idom[b]], [f.blocks[x] for x in bits(f.frontiers[b])]

    return per_function(stmts, edges, kernel, "fn long, block int, idom int, frontier array<int>")


def blocks(stmts, edges):
    """(fn, block, reachable, in_cycle): what pruning keeps, and the blocks of cycles."""
    return per_function(stmts, edges, lambda f: ((f.blocks[b], bool(f.reachable >> b & 1), bool(f.after[b] >> b & 1)) for b in range(len(f.blocks))), "fn long, block int, reachable boolean, in_cycle boolean")


def slices(stmts, edges, pick: Callable[[list[dict]], tuple[int, str] | None], backward: bool = True):
    """(fn, stmt, reduction) of each function's slice from (line, variable) that pick names; None: no slice."""

    def kernel(f: Function):
        want = pick(f.stmts)
        if want:
            got, less = f.slice(*want, backward)
            yield from ((k, less) for k in got)

    return per_function(stmts, edges, kernel, "fn long, stmt int, reduction double")


def interprocedural(stmts: DataFrame, edges: DataFrame, params: DataFrame, calls: DataFrame, seeds: DataFrame, rounds: int = 20) -> DataFrame:
    """(fn, stmt) of a backward slice over functions.

    params (fn, name); calls (caller, callee, line); seeds (fn, stmt). When a slice uses a parameter
    of its function, the call's statements in its callers join, and their slices follow.
    """
    from lodegraph.operators.iterate import cut

    data = data_dependences(stmts, edges).select("fn", F.col("dst").alias("stmt"), F.col("src").alias("next"))
    control = control_dependences(stmts, edges).select("fn", F.col("dependent").alias("stmt"), F.col("controller").alias("next"))
    step = cut(data.union(control).distinct(), "slice-steps")
    uses = stmts.select("fn", "stmt", F.explode("uses").alias("name")).join(params, ["fn", "name"]).select("fn", "stmt").distinct()
    sites = calls.join(stmts.select(F.col("fn").alias("caller"), "line", F.col("stmt").alias("next")), ["caller", "line"]).select(F.col("callee").alias("fn"), "caller", "next")
    cross = cut(uses.join(sites, "fn").select("fn", "stmt", "caller", "next").distinct(), "slice-cross")
    seen = cut(seeds.select("fn", "stmt").distinct(), "slice")
    new = seen
    for _ in range(rounds):
        near = new.join(step, ["fn", "stmt"]).select("fn", F.col("next").alias("stmt")).union(new.join(cross, ["fn", "stmt"]).select(F.col("caller").alias("fn"), F.col("next").alias("stmt")))
        new = cut(near.distinct().join(seen, ["fn", "stmt"], "left_anti"), "slice-new")
        if not new.limit(1).count():
            break
        seen = seen.unionAll(new)
    return seen


def call_seeds(nodes: DataFrame, edges: DataFrame, zone: DataFrame) -> DataFrame:
    """(fn, line, name): for callers in an impact zone, the line of the call and the callee's parameters to slice from."""
    c = edges.filter("edge_type = 'Calls'").select("src", "dst", F.element_at("properties", "call_site_line").try_cast("int").alias("line")).join(zone.select(F.col("id").alias("src")), "src", "left_semi")
    p = nodes.select(F.col("id").alias("dst"), F.explode("parameters").alias("p")).select("dst", F.col("p.name").alias("name"))
    return c.join(p, "dst").select(F.col("src").alias("fn"), "line", "name").filter("line is not null")
