"""Control flow of Python functions: statements and block edges in the tables of operators.flow."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.operators.flow import EDGES, STMTS


def names(node: ast.AST) -> tuple[list[str], list[str]]:
    """Names that a statement's own expressions define and use, fields with their dots."""
    defs: set[str] = set()
    uses: set[str] = set()

    def dotted(n: ast.AST) -> str | None:
        if isinstance(n, ast.Name):
            return n.id
        base = dotted(n.value) if isinstance(n, ast.Attribute) else None
        return f"{base}.{n.attr}" if base else None

    def walk(n: ast.AST, called: bool = False) -> None:
        if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef, ast.Lambda)):
            return
        if isinstance(n, (ast.Name, ast.Attribute)) and (name := dotted(n)):
            if isinstance(n.ctx, (ast.Store, ast.Del)):
                defs.add(name)
                if "." in name:
                    uses.add(name.split(".", 1)[0])
            elif called and "." in name:
                uses.add(name.rsplit(".", 1)[0])
            elif not called:
                uses.add(name)
            return
        if isinstance(n, ast.Call):
            walk(n.func, True)
            for c in [*n.args, *(k.value for k in n.keywords)]:
                walk(c)
            return
        if isinstance(n, ast.AugAssign) and (name := dotted(n.target)):
            uses.add(name)
        for c in ast.iter_child_nodes(n):
            walk(c)

    walk(node)
    return sorted(defs), sorted(uses)


class Builder:
    """Blocks of one function, made statement by statement; an empty current block is None after a jump."""

    def __init__(self):
        self.rows: list[tuple] = []
        self.edges: list[tuple[int, int, str]] = []
        self.blocks = 0
        self.sizes: dict[int, int] = {}
        self.loops: list[tuple[int, int]] = []  # (where continue goes, where break goes)
        self.handlers: list[int] = []

    def block(self) -> int:
        self.blocks += 1
        return self.blocks - 1

    def add(self, at: int, node: ast.AST, kind: str, text: str, parts: list[ast.AST]) -> None:
        found = [names(p) for p in parts]
        k = self.sizes.get(at, 0)
        self.sizes[at] = k + 1
        self.rows.append((len(self.rows), at, k, kind, node.lineno, text, sorted({d for f in found for d in f[0]}), sorted({u for f in found for u in f[1]})))

    def link(self, a: int | None, b: int, kind: str = "Next") -> None:
        if a is not None:
            self.edges.append((a, b, kind))

    def run(self, body: list[ast.stmt], at: int | None) -> int | None:
        for node in body:
            if at is None:
                at = self.block()  # what follows a jump: a block that nothing reaches
            at = self.one(node, at)
        return at

    def fork(self, test: int, body: list[ast.stmt], other: list[ast.stmt]) -> int | None:
        yes, after = self.block(), None
        self.link(test, yes, "IfTrue")
        ends = [self.run(body, yes)]
        if other:
            no = self.block()
            self.link(test, no, "IfFalse")
            ends.append(self.run(other, no))
        else:
            ends.append(test)
        if any(e is not None for e in ends):
            after = self.block()
            for e in ends:
                self.link(e, after, "IfFalse" if e == test else "Next")
        return after

    def one(self, node: ast.stmt, at: int) -> int | None:
        src = lambda n: ast.unparse(n)
        if isinstance(node, ast.If):
            self.add(at, node, "Branch", f"if {src(node.test)}", [node.test])
            return self.fork(at, node.body, node.orelse)
        if isinstance(node, (ast.While, ast.For, ast.AsyncFor)):
            head = self.block()
            self.link(at, head)
            if isinstance(node, ast.While):
                self.add(head, node, "Branch", f"while {src(node.test)}", [node.test])
            else:
                self.add(head, node, "Branch", f"for {src(node.target)} in {src(node.iter)}", [node.target, node.iter])
            body, after = self.block(), self.block()
            self.link(head, body, "IfTrue")
            self.loops.append((head, after))
            self.link(self.run(node.body, body), head, "Jump")
            self.loops.pop()
            if node.orelse:
                other = self.block()
                self.link(head, other, "IfFalse")
                self.link(self.run(node.orelse, other), after)
            else:
                self.link(head, after, "IfFalse")
            return after
        if isinstance(node, (ast.Try, ast.TryStar)):
            body = self.block()
            self.link(at, body)
            first = self.blocks
            end = self.run(node.body, body)
            inside = [body, *range(first, self.blocks)]
            ends = [self.run(node.orelse, end) if node.orelse else end]
            for h in node.handlers:
                b = self.block()
                for x in inside:
                    self.link(x, b, "Exception")
                if h.type is not None:
                    self.add(b, h, "Expression", f"except {src(h.type)}", [h.type])
                ends.append(self.run(h.body, b))
            last = self.block()
            for e in ends:
                self.link(e, last)
            return self.run(node.finalbody, last) if node.finalbody else last
        if isinstance(node, (ast.With, ast.AsyncWith)):
            self.add(at, node, "Assignment", "with " + ", ".join(map(src, node.items)), list(node.items))
            return self.run(node.body, at)
        if isinstance(node, ast.Match):
            self.add(at, node, "Branch", f"match {src(node.subject)}", [node.subject])
            after, ends, total = self.block(), [], False
            for case in node.cases:
                b = self.block()
                self.link(at, b, "IfTrue")
                total |= isinstance(case.pattern, ast.MatchAs) and case.pattern.pattern is None and case.guard is None
                ends.append(self.run(case.body, b))
            for e in ends:
                self.link(e, after)
            if not total:
                self.link(at, after, "IfFalse")
            return after
        if isinstance(node, (ast.Return, ast.Raise)):
            self.add(at, node, "Return" if isinstance(node, ast.Return) else "Jump", src(node), [node])
            return None
        if isinstance(node, (ast.Break, ast.Continue)) and self.loops:
            self.add(at, node, "Jump", src(node), [])
            self.link(at, self.loops[-1][isinstance(node, ast.Break)], "Jump")
            return None
        kind = "Declaration" if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef, ast.AnnAssign, ast.Import, ast.ImportFrom)) else "Assignment" if isinstance(node, (ast.Assign, ast.AugAssign)) else "FunctionCall" if isinstance(node, ast.Expr) and isinstance(node.value, ast.Call) else "Expression"
        text = f"def {node.name}" if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)) else src(node)
        self.add(at, node, kind, text, [] if kind == "Declaration" and hasattr(node, "body") else [node])
        return at


def functions(text: str) -> Iterator[tuple[str, list[tuple], list[tuple]]]:
    """(qualified name, statement rows, edge rows) of each function of a source text."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError):
        return

    def visit(body: list[ast.stmt], owner: str) -> Iterator:
        for node in body:
            if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                name = f"{owner}.{node.name}" if owner else node.name
                if not isinstance(node, ast.ClassDef):
                    b = Builder()
                    start = b.block()
                    args = [a.arg for a in node.args.posonlyargs + node.args.args + node.args.kwonlyargs]
                    if args:
                        b.sizes[start] = 1
                        b.rows.append((0, start, 0, "Declaration", node.lineno, f"def {node.name}({', '.join(args)})", args, []))
                    b.run(node.body, start)
                    yield name, b.rows, b.edges
                yield from visit(node.body, name)

    yield from visit(tree.body, "")


def control_flow(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(fn, file, name), statements and block edges of all functions of Python files (path, text).

    fn is a hash of file and qualified name.
    """
    rows = files.select("path", "text")

    def parts(which: int):
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            columns = [("name",), ("name", "stmt", "block", "idx", "kind", "line", "text", "defs", "uses"), ("name", "src", "dst", "kind")][which]
            for pdf in frames:
                out = []
                for path, text in zip(pdf["path"], pdf["text"], strict=True):
                    for name, stmts, edges in functions(text or ""):
                        out += [(path, name)] if which == 0 else [(path, name, *r) for r in (stmts if which == 1 else edges)]
                yield pd.DataFrame(out, columns=["file", *columns])

        return run

    key = F.xxhash64("file", "name").alias("fn")
    table = lambda k, schema: rows.mapInPandas(parts(k), "file string, name string" + schema)
    known = table(0, "").select(key, "file", "name")
    stmts = table(1, ", " + STMTS.split(", ", 1)[1]).select(key, *(c.split()[0] for c in STMTS.split(", ")[1:]))
    edges = table(2, ", " + EDGES.split(", ", 1)[1]).select(key, "src", "dst", "kind")
    return known, stmts, edges


def field_writes(files: DataFrame) -> DataFrame:
    """(function, receiver_local, receiver_type, member, file, line, snippet, kind) of attribute assignments."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for path, text in zip(pdf["path"], pdf["text"], strict=True):
                try:
                    tree = ast.parse(text or "")
                except (SyntaxError, ValueError):
                    continue
                for cls, fn in ((c, f) for c in [None, *(n for n in ast.walk(tree) if isinstance(n, ast.ClassDef))] for f in (c.body if c else tree.body) if isinstance(f, (ast.FunctionDef, ast.AsyncFunctionDef))):
                    kinds = {a.arg: ast.unparse(a.annotation) for a in fn.args.args if a.annotation}
                    for n in ast.walk(fn):
                        if isinstance(n, ast.Assign) and isinstance(n.value, ast.Call) and isinstance(n.value.func, ast.Name) and n.value.func.id[:1].isupper():
                            kinds |= {t.id: n.value.func.id for t in n.targets if isinstance(t, ast.Name)}
                    name = f"{cls.name}.{fn.name}" if cls else fn.name
                    for n in ast.walk(fn):
                        if isinstance(n, ast.Attribute) and isinstance(n.ctx, ast.Store) and isinstance(n.value, ast.Name):
                            this = n.value.id == "self" and cls is not None
                            kind = cls.name if this else kinds.get(n.value.id)
                            out.append((name, n.value.id, kind, n.attr, path, n.lineno, ast.unparse(n), "ThisField" if this else "DirectField" if kind else "Unresolved"))
            yield pd.DataFrame(out, columns=["function", "receiver_local", "receiver_type", "member", "file", "line", "snippet", "kind"])

    return files.select("path", "text").mapInPandas(run, "function string, receiver_local string, receiver_type string, member string, file string, line int, snippet string, kind string")


def skeleton(files: DataFrame, depth: int = 4) -> DataFrame:
    """(file, node, parent, kind, start_line, end_line): the syntax tree down to a depth."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for path, text in zip(pdf["path"], pdf["text"], strict=True):
                try:
                    tree = ast.parse(text or "")
                except (SyntaxError, ValueError):
                    continue
                work, k = [(tree, None, 0)], 0
                while work:
                    node, parent, level = work.pop(0)
                    out.append((path, k, parent, type(node).__name__, getattr(node, "lineno", None), getattr(node, "end_lineno", None)))
                    if level < depth:
                        work += [(c, k, level + 1) for c in ast.iter_child_nodes(node) if hasattr(c, "lineno")]
                    k += 1
            yield pd.DataFrame(out, columns=["file", "node", "parent", "kind", "start_line", "end_line"]).astype({"parent": "Int32", "start_line": "Int32", "end_line": "Int32"})

    return files.select("path", "text").mapInPandas(run, "file string, node int, parent int, kind string, start_line int, end_line int")
