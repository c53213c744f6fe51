"""Symbols, relations and complexity of languages with braces, read from masked text.

Comments, literals and directives are blanked first, so that places and lines stay. Declarations
are found by pattern, bodies by matching braces, owners by nesting; a call is a name before an
opening parenthesis and belongs to the innermost function around it. Java, C# and C++ list their
bases; Go's are its embedded types, and the interfaces whose methods a type of the file has.

There is no grammar behind this: what text substitution makes (macros) and code inside template
strings is not seen. Unbalanced braces close at the end of the text; a null or empty text has no rows.
"""

from __future__ import annotations

import bisect
import re
from dataclasses import dataclass, field

_C = r"//[^\n]*|/\*.*?(?:\*/|\Z)"
_QUOTED = r'"(?:\\.|[^"\\\n])*"'
_TICK = r"'(?:\\.|[^'\\\n])*'"
# What is blanked, by language; a group named keep stays.
_BLANK = {
    "rust": rf'{_C}|b?r(?P<h>\#*)".*?"(?P=h)|b?"(?:\\.|[^"\\])*"|b?\'(?:\\[^\n]{{1,10}}?|[^\'\\\n])\'',
    "go": rf"{_C}|`[^`]*`|{_QUOTED}|{_TICK}",
    "java": rf'{_C}|""".*?"""|{_QUOTED}|{_TICK}',
    "csharp": rf'{_C}|\$?@\$?"(?:""|[^"])*"|{_QUOTED}|{_TICK}|^[ \t]*\#[^\n]*',
    "javascript": rf"{_C}|`(?:\\.|[^`\\])*`|{_QUOTED}|{_TICK}|(?P<keep>(?:[=(,:!&|?{{;]|\breturn)[ \t]*)/(?![/*])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*",
    "c": rf"{_C}|{_QUOTED}|{_TICK}|^[ \t]*\#(?:\\\n|[^\n])*",
}
_BLANK["typescript"], _BLANK["cpp"] = _BLANK["javascript"], rf'R"(?P<d>[^(\s]*)\(.*?\)(?P=d)"|{_BLANK["c"]}'
BLANK = {lang: re.compile(p, re.S | re.M) for lang, p in _BLANK.items()}

_PARENS = r"\((?P<params>(?:[^(){};]|\((?:[^(){};]|\([^()]*\))*\))*)\)"
_MEMBER = rf"(?<![.\w$])(?P<name>[A-Za-z_$][\w$]*)\s*(?:<[\w\s,.?]*>)?\s*{_PARENS}"
_TYPES = {"Class": r"\bclass\s+", "Interface": r"\binterface\s+", "Enum": r"\benum\s+(?:class\s+)?", "Struct": r"\bstruct\s+"}


def _types(*kinds: str) -> list[tuple[str, str]]:
    return [(k, _TYPES[k] + r"(?P<name>[A-Za-z_$][\w$]*)") for k in kinds]


# How declarations start, by language: kind and pattern. Owner is no symbol, but names what it holds.
STARTS = {
    "rust": [("Function", r"\bfn\s+(?P<name>[A-Za-z_]\w*)"), *_types("Struct", "Enum"), ("Interface", r"\btrait\s+(?P<name>[A-Za-z_]\w*)"), ("Owner", r"^[ \t]*(?:unsafe\s+)?impl\b(?:\s*<[^{;]*?>(?=\s))?\s+(?:[^{;]*?\bfor\s+)?&?(?:\w+::)*(?P<name>[A-Za-z_]\w*)"), ("Owner", r"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?mod\s+(?P<name>[A-Za-z_]\w*)")],
    "go": [("Function", r"^func\s+(?:\(\s*(?:(?P<recv>\w+)\s+)?\*?\s*(?P<owner>\w+)[^)]*\)\s*)?(?P<name>[A-Za-z_]\w*)"), ("Struct", r"^type\s+(?P<name>[A-Za-z_]\w*)(?:\[[^\]]*\])?\s+struct\b"), ("Interface", r"^type\s+(?P<name>[A-Za-z_]\w*)(?:\[[^\]]*\])?\s+interface\b")],
    "java": [*_types("Class", "Interface", "Enum"), ("Class", r"\brecord\s+(?P<name>[A-Za-z_]\w*)(?=\s*(?:<[^>]*>\s*)?\()"), ("Function", _MEMBER + r"\s*(?:throws\s+[\w.,\s]+?)?(?=\{|;)")],
    "csharp": [*_types("Class", "Interface", "Enum", "Struct"), ("Function", _MEMBER + r"\s*(?::\s*(?:base|this)\s*\([^{};]*\)\s*)?(?:where\s+[^{;]+?)?(?=\{|=>|;)")],
    "javascript": [*_types("Class"), ("Function", r"\bfunction\s*\*?\s*(?P<name>[A-Za-z_$][\w$]*)"), ("Function", r"\b(?:const|let|var)\s+(?P<name>[A-Za-z_$][\w$]*)\s*(?::[^=;\n]+)?=\s*(?:async\s+)?(?:function\b|(?=\([^()]*(?:\([^()]*\)[^()]*)*\)\s*(?::[^={;\n]+)?=>|[A-Za-z_$][\w$]*\s*=>))"), ("Function", _MEMBER + r"\s*(?::[^{};=]+)?(?=\{)")],
    "c": [*_types("Struct", "Enum"), ("Function", rf"(?<![\w~:])(?P<name>(?:[A-Za-z_]\w*+::)*+~?[A-Za-z_]\w*+)\s*+{_PARENS}\s*(?:const\b\s*|noexcept\b\s*|override\b\s*|final\b\s*|->\s*[\w:<>*&\s]+)*(?::[^{{;]*)?(?=\{{)")],
}
STARTS["typescript"] = [*_types("Interface", "Enum"), *STARTS["javascript"]]
STARTS["cpp"] = [*_types("Class"), *STARTS["c"]]
PATTERNS = {lang: [(kind, re.compile(p, re.M)) for kind, p in rules] for lang, rules in STARTS.items()}
# Words that stand before a parenthesis and call nothing.
NO_CALL = frozenset("if for while switch match try catch return sizeof alignof typeof foreach lock using synchronized function fn func new throw else do in of as is await yield case when nameof default checked unchecked fixed super this assert elif defined decltype static_assert union loop move interface struct class enum impl where".split())
# A path starts where no longer one does, and is not given back: time stays linear in its length.
CALL = re.compile(r"(?<![\w$])(?<![\w$]\.)(?<![\w$]::)(?<![\w$]->)(?<![\w$]\?\.)(?P<path>(?:[A-Za-z_$][\w$]*+\s*+(?:\?\.|\.|::|->)\s*+(?=[A-Za-z_$]))*+)(?P<name>[A-Za-z_$][\w$]*+)(?:(?:::\s*+)?<[\w\s,:*&.<>\[\]']{0,200}>(?=\())?\s*+(?P<macro>!\s*+)?(?P<open>[({\[])")
# Decision points by language; the others state no complexity.
FORKS = {"rust": r"\b(?:if|match|while|for|loop)\b(?!\s*<)|=>", "go": r"\b(?:if|for|switch|select|case|default)\b", "javascript": r"\b(?:if|for|while|switch|case|catch)\b(?!\s*:)|\?(?![.?:\])},;])(?<!\?\?)"}
FORKS["typescript"] = FORKS["javascript"]
GUARD = re.compile(r"\bif\b(?=[^{};,]*=>)")


@dataclass(eq=False)
class Declared:
    """A declaration: what it is, where it starts, and the places of its body (equal if it has none)."""

    kind: str
    name: str
    start: int
    open: int
    close: int
    params: str | None = None
    owner: str = ""
    receiver: str | None = None
    inside: Declared | None = field(default=None, repr=False)
    paren: int = -1

    @property
    def path(self) -> str:
        """The qualified name: those of its owners and its own, with dots."""
        above = self.inside.path if self.inside else ""
        return ".".join(x for x in (above, self.owner, self.name) if x)


def masked(text: str, lang: str) -> str:
    """The text with spaces in place of comments, literals and directives."""

    def blank(m: re.Match) -> str:
        keep = (m.groupdict().get("keep") or "") if m.re.groups else ""
        return keep + re.sub(r"[^\n]", " ", m.group()[len(keep):])

    return BLANK[lang].sub(blank, text)


def pairs(text: str, marks: str) -> dict[int, int]:
    """Where each opening mark is closed; the end of the text for those that are not."""
    out, stack = {}, []
    for m in re.finditer(f"[{re.escape(marks)}]", text):
        if m.group() == marks[0]:
            stack.append(m.start())
        elif stack:
            out[stack.pop()] = m.start()
    return out | dict.fromkeys(stack, len(text))


_FIELD = re.compile(r"[:,]\s*[\w:]+(?:<[^;{}()]*>)?\s*(?=[({])")
_SPACE = re.compile(r"\s*")


def _body(text: str, at: int, braces: dict[int, int], parens: dict[int, int]) -> tuple[int, int]:
    """The body that follows a declaration's head: from its brace, or from an arrow, to its end."""
    while at < len(text):
        c = text[at]
        if c == "{":
            return at, braces[at]
        if c in ":," and text[at - 1] != ":" and (m := _FIELD.match(text, at)):
            end = {"{": braces, "(": parens}[text[m.end()]][m.end()]  # a constructor sets a field
            if _SPACE.match(text, end + 1).end() < len(text) and text[_SPACE.match(text, end + 1).end()] in ",{":
                at = end
            elif text[m.end()] == "{":
                return m.end(), end
            else:
                at = end
        elif c == "(":
            at = parens[at]
        elif c in ";}":
            return at, at
        elif text.startswith("=>", at):
            begin = at
            at = end = _SPACE.match(text, at + 2).end()
            if text[at:at + 1] == "{":
                return at, braces[at]
            while end < len(text) and text[end] not in ";})":
                end = {"{": braces, "(": parens}.get(text[end], {}).get(end, end) + 1
            return begin, min(end, len(text))
        at += 1
    return len(text), len(text)


def declarations(code: str, lang: str) -> list[Declared]:
    """All declarations of masked text in order, each with what it lies in."""
    braces, parens = pairs(code, "{}"), pairs(code, "()")
    found: dict[int, Declared] = {}
    for kind, pattern in PATTERNS[lang]:
        for m in pattern.finditer(code):
            at, name = m.start("name"), m.group("name")
            if at in found or name in NO_CALL or (kind == "Function" and re.search(r"\b(?:new|return|throw|await|else|case)\s+$", code[max(0, at - 16):at])):
                continue
            got = m.groupdict()
            paren = m.start("params") - 1 if got.get("params") is not None else code.find("(", m.end()) if kind == "Function" else -1
            params = None
            if kind == "Function" and got.get("params") is None and paren >= 0 and (m2 := re.match(r"([^{};]*?)(=>|[{};])", code[m.end():paren])):
                paren, params = -1, m2.group(1) if m2.group(2) == "=>" else None  # x => ..., or no parameters at all
            open_, close = _body(code, parens[paren] + 1 if paren >= 0 else m.end(), braces, parens)
            params = code[paren + 1:parens[paren]] if paren >= 0 else params
            *above, name = name.split("::")
            found[at] = Declared(kind, name, m.start(), open_, close, params, got.get("owner") or ".".join(above), got.get("recv"), None, paren)
    out, stack = [], []
    for at in sorted(found):
        d = found[at]
        while stack and stack[-1].close <= at:
            stack.pop()
        d.inside = next((s for s in reversed(stack) if s.open < at), None)
        holder = d.inside.kind if d.inside else None
        if d.kind == "Function" and (
            (lang in ("c", "cpp") and (holder == "Function" or holder == "Enum"))
            or (lang in ("java", "csharp") and (holder is None or (code[d.open:d.open + 1] == ";" and holder != "Interface" and not re.search(r"\babstract\b[^;{}]*$", code[max(0, d.start - 200):d.start]))))
            or (lang in ("javascript", "typescript") and holder != "Class" and _plain_call(code, d))
        ):
            continue
        if d.kind in ("Struct", "Class", "Enum") and lang in ("c", "cpp") and d.open == d.close:
            continue  # a use of the type's name
        if lang == "go" and d.owner:
            d.inside = None
        out.append(d)
        if d.close > d.open:
            stack.append(d)
    return out


def _plain_call(code: str, d: Declared) -> bool:
    """Whether a name and parentheses stand without a word that declares a function."""
    return not re.match(r"function\b|const\b|let\b|var\b", code[d.start:d.start + 8])


def _split(params: str) -> list[str]:
    out, depth, last = [], 0, 0
    for i, c in enumerate(params):
        if c in "([{<":
            depth += 1
        elif c in ")]}" or (c == ">" and params[i - 1:i] not in ("-", "=")):
            depth -= 1
        elif c == "," and depth <= 0:
            out.append(params[last:i])
            last = i + 1
    return [p for p in (" ".join(x.split()) for x in [*out, params[last:]]) if p]


def parameters(params: str | None, lang: str) -> list[dict]:
    """Name, type and default of each parameter in the way of the language."""
    out = []
    for part in _split(params or ""):
        bare, _, default = part.partition("=") if lang in ("javascript", "typescript", "csharp", "cpp") else (part, "", "")
        bare, kind = bare.strip(), None
        if lang in ("rust", "javascript", "typescript"):
            name, _, kind = bare.partition(":")
            name = re.sub(r"^(?:&\s*)?(?:'\w+\s+)?(?:(?:mut|public|private|protected|readonly)\s+)*", "", name.strip()).rstrip("?")
        elif lang == "go":
            name, _, kind = bare.partition(" ")
        else:
            m = re.match(r"(?s)(.*?)([A-Za-z_]\w*)\s*((?:\[[^\]]*\])*)$", bare)
            name, kind = (m.group(2), m.group(1).strip() + m.group(3)) if m and m.group(1).strip() else (bare, None)
            if kind is None and lang in ("c", "cpp"):
                if bare == "void":
                    continue
                name, kind = "", bare
        out.append({"name": name, "param_type": kind.strip() or None if kind else None, "default_value": default.strip() or None})
    if lang == "go":  # `a, b int`: the type is told once, by the last name
        later = None
        for p in reversed(out):
            later = p["param_type"] = p["param_type"] or later
    return out


def _returns(code: str, d: Declared, parens: dict[int, int], lang: str) -> str | None:
    after = code[parens[d.paren] + 1:d.open] if d.paren >= 0 else ""
    if lang == "rust":
        found = re.match(r"\s*->\s*(.*?)\s*(?:\bwhere\b.*)?$", after, re.S)
    elif lang in ("javascript", "typescript"):
        found = re.match(r"\s*:\s*(.*?)\s*(?:=>?)?\s*$", after, re.S)
    elif lang == "go":
        found = re.match(r"\s*(.*?)\s*$", after, re.S)
    else:
        found = re.search(r"([A-Za-z_][\w.:]*(?:<[^;{}()]*>)?(?:\[\])*[\s*&]*)$", code[max(0, d.start - 200):d.start])
        if found and found.group(1).strip().rstrip(":") in ("public", "private", "protected", "internal", "static", "virtual", "explicit", "inline"):
            found = None
    return (" ".join(found.group(1).split()) or None) if found else None


def _bases(code: str, d: Declared, lang: str) -> list[tuple[str, str]]:
    """(kind, base) of a type that lists its bases."""
    m = re.compile(r"[\w$]+").match(code, code.index(d.name, d.start))
    head = " ".join(code[m.end():d.open].split())
    while (bare := re.sub(r"<[^<>]*>", "", head)) != head:
        head = bare
    last = lambda x: re.split(r"\.|::", x.split("(")[0].strip())[-1].strip()
    if lang == "java":
        head = re.sub(r"\([^()]*\)|@\w+", "", head)
        out = [(kind, last(b)) for word, kind in (("extends", "Extends"), ("implements", "Implements")) for part in re.findall(rf"\b{word}\s+(.*?)(?=\b(?:extends|implements|permits)\b|$)", head) for b in part.split(",")]
    elif lang in ("csharp", "cpp") and ":" in head:
        listed = re.split(r"\bwhere\b", head.split(":", 1)[1])[0]
        if lang == "csharp":
            out = [("Extends" if d.kind == "Class" and k == 0 else "Implements", last(b)) for k, b in enumerate(listed.split(","))]
        else:
            out = [("Extends" if "public" in b.split() else "Implements", last(b.split()[-1])) for b in listed.split(",") if b.split()]
    else:
        out = []
    return [(kind, b) for kind, b in out if b]


def _go_types(code: str, found: list[Declared]) -> list[tuple[str, str, str, int]]:
    """(source, target, kind, place): embedded types, and interfaces all of whose methods a type has."""
    out, methods, wanted = [], {}, {}
    for d in found:
        body = code[d.open + 1:d.close]
        if d.kind == "Function" and d.owner:
            methods.setdefault(d.owner, set()).add(d.name)
        elif d.kind == "Interface":
            wanted[d] = set(re.findall(r"^[ \t]*([A-Za-z_]\w*)\s*\(", body, re.M))
        elif d.kind == "Struct":
            out += [(d.name, m.group(1), "Extends", d.open + 1 + m.start()) for m in re.finditer(r"^[ \t]*\*?(?:\w+\.)?([A-Za-z_]\w*)[ \t]*$", body, re.M)]
    for kind, have in methods.items():
        out += [(kind, d.name, "Implements", d.start) for d, need in wanted.items() if need and need <= have]
    return out


def brace_symbols(path: str, text: str | None, lang: str) -> tuple[list[tuple], list[tuple]]:
    """Symbols and relations of one file, in the columns of ingest.SYMBOLS and ingest.RELATIONS."""
    if not text:
        return [], []
    code = masked(text, lang)
    found = declarations(code, lang)
    parens = pairs(code, "()")
    lines = [m.start() for m in re.finditer("\n", code)]
    bounds = [-1, *(m.start() for m in re.finditer(r"[\n{};]", code))]
    line = lambda at: bisect.bisect_left(lines, at) + 1
    name_at = lambda d: re.compile(rf"(?<![\w$]){re.escape(d.name)}(?![\w$])").search(code, d.start).start()
    symbols, relations = [], []
    for d in found:
        if d.kind == "Owner":
            continue
        at = name_at(d)
        if d.kind != "Function":
            symbols.append((path, len(symbols), d.name, d.path, d.kind, line(at), line(min(d.close, len(code) - 1)), None, None, None, None))
            relations += [(path, d.path, b, kind, line(at), b) for kind, b in _bases(code, d, lang)]
            continue
        begin = _SPACE.match(code, bounds[bisect.bisect_left(bounds, at) - 1] + 1).end()
        body = code[d.open:d.close]
        forks = (1 + len(re.findall(FORKS[lang], body)) - (len(GUARD.findall(body)) if lang == "rust" else 0)) if lang in FORKS and d.close > d.open else None
        symbols.append((path, len(symbols), d.name, d.path, "Function", line(at), line(min(d.close, len(code) - 1)), " ".join(text[begin:d.open].split()).removesuffix("=>").strip(), _returns(code, d, parens, lang), parameters(text[d.paren + 1:parens[d.paren]] if d.paren >= 0 else d.params, lang), forks))
    if lang == "go":
        relations += [(path, s, t, kind, line(at), t) for s, t, kind, at in _go_types(code, found)]
    functions = [d for d in found if d.kind == "Function" and d.close > d.open]
    heads = {d.paren for d in found if d.kind == "Function"}
    open_now: list[Declared] = []
    waiting = iter(functions)
    nxt = next(waiting, None)
    for m in CALL.finditer(code):
        at, name = m.start("name"), m.group("name")
        while nxt is not None and nxt.open <= at:
            open_now.append(nxt)
            nxt = next(waiting, None)
        while open_now and open_now[-1].close <= at:
            open_now.pop()
        if not open_now or name in NO_CALL or m.start("open") in heads or (m.group("macro") and lang != "rust") or (m.group("open") != "(" and not m.group("macro")):
            continue
        path_ = re.sub(r"\s+", "", m.group("path")).replace("?.", ".").replace("::", ".").replace("->", ".")
        if re.search(r"\bnew\s+$", code[max(0, m.start() - 8):m.start()]):
            continue
        source = open_now[-1]
        first = path_.split(".")[0]
        if path_.count(".") == 1 and first in ("self", "Self", "this", *([source.receiver] if source.receiver else [])):
            above = source.path.rsplit(".", 1)[0] if "." in source.path else ""
            path_ = f"{above}." if above else ""
        relations.append((path, source.path, name, "Calls", line(at), path_ + name))
    return symbols, relations
