"""Taint flows, sanitizer policy, weakness patterns, inferred types and field mutations."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodegraph.operators.flow import Function, per_function

# What marks a source, a sink or a sanitizer, by language. Within a kind the first
# entry that a statement's text contains decides; & joins two texts that must both be there.
RULES = {
    "python": {
        "source": [("HttpParameter", ["request.GET", "request.POST"]), ("FileInput", ["open("]), ("CliArgument", ["sys.argv"]), ("Environment", ["os.environ"])],
        "sink": [("SqlQuery", ["execute(", "executemany("]), ("ShellCommand", ["os.system(", "subprocess."]), ("Eval", ["eval(", "exec("]), ("HtmlOutput", ["render(", ".html"])],
        "sanitizer": [("numeric", ["int(", "float("]), ("HtmlEscape", ["escape(", "html.escape"]), ("ShellEscape", ["shlex.quote"])],
    },
    "javascript": {
        "source": [("HttpParameter", ["req.query", "req.body", "req.params"]), ("FileInput", ["fs.readFile"]), ("CliArgument", ["process.argv"]), ("Environment", ["process.env"])],
        "sink": [("SqlQuery", [".query(", ".execute("]), ("ShellCommand", ["exec(", "spawn("]), ("Eval", ["eval(", "Function("]), ("HtmlOutput", ["innerHTML", "document.write"])],
        "sanitizer": [("numeric", ["parseInt(", "parseFloat("]), ("HtmlEscape", ["escapeHtml(", "sanitize("])],
    },
    "rust": {
        "source": [("HttpParameter", ["Path(", "Query(", "Json(", "Form(", "RawBody(", "TypedHeader(", "axum::extract", "Extension("]), ("Environment", ["env::var"]), ("CliArgument", ["env::args"]), ("FileInput", ["File::open", "read_to_string", "std::fs::read"]), ("NetworkInput", ["reqwest::", "hyper::", "TcpStream::connect"])],
        "sink": [("SqlQuery", ["sqlx::query", "query_as", ".execute(", "fetch_one(", "fetch_all(", "fetch_optional("]), ("ShellCommand", ["Command::new", "std::process::Command"]), ("HtmlOutput", ["format!&Html"]), ("FileWrite", ["std::fs::write", "write_all("])],
        "sanitizer": [("SqlParam", [".bind("]), ("typed", [".parse::<", "FromStr"]), ("HtmlEscape", ["html_escape", "ammonia::"])],
    },
    "go": {
        "source": [("HttpParameter", ["Query(", "Param(", "PostForm(", "ShouldBindJSON", "BindJSON", "FormValue(", "GetHeader(", "Cookie("]), ("Environment", ["os.Getenv", "os.LookupEnv"]), ("CliArgument", ["os.Args"]), ("FileInput", ["ReadFile(", "io.ReadAll", "ioutil.ReadAll", "json.Unmarshal", "io.ReadCloser"]), ("NetworkInput", ["http.Get(", "http.Post("])],
        "sink": [("SqlQuery", [".Exec(", ".Query(", ".QueryRow(", "db.Exec", "sql.Open"]), ("ShellCommand", ["exec.Command", "exec.CommandContext"]), ("HtmlOutput", ["template.HTML(", "c.HTML(", "fmt.Fprintf&ResponseWriter"]), ("FileWrite", ["os.WriteFile", "ioutil.WriteFile"])],
        "sanitizer": [("numeric", ["strconv.Atoi", "strconv.ParseInt", "strconv.ParseFloat"]), ("HtmlEscape", ["html.EscapeString"]), ("SqlParam", ["Prepare(", "PrepareContext("])],
    },
    "java": {
        "source": [("HttpParameter", ["getParameter(", "getHeader(", "getQueryString(", "request.get"]), ("FileInput", ["FileInputStream", "Files.read", "BufferedReader"]), ("Environment", ["System.getenv"]), ("CliArgument", ["args[", "getArgs("]), ("DatabaseRead", ["ResultSet", "executeQuery"])],
        "sink": [("SqlQuery", ["createStatement", "prepareStatement", "executeQuery", "executeUpdate", ".createQuery("]), ("ShellCommand", ["Runtime.getRuntime().exec", "ProcessBuilder", ".exec("]), ("FileWrite", ["FileOutputStream", "FileWriter", "Files.write"]), ("HtmlOutput", ["PrintWriter", "response.getWriter", "innerHTML", "innerText"]), ("LogOutput", ["Logger.", ".log("])],
        "sanitizer": [("numeric", ["Integer.parseInt", "Long.parseLong", "Double.parseDouble"]), ("HtmlEscape", ["StringEscapeUtils", "HtmlUtils.htmlEscape", "ESAPI.encoder"]), ("SqlParam", ["prepareStatement&setString"]), ("Validation", ["Pattern.matches", ".matches(", "Validator."])],
    },
    "csharp": {
        "source": [("HttpParameter", ["Request.Query", "Request.Form", "Request.Headers", "[FromQuery]", "[FromBody]", "HttpContext.Request"]), ("FileInput", ["File.ReadAllText", "File.ReadAllBytes", "StreamReader"]), ("Environment", ["Environment.GetEnvironmentVariable"]), ("CliArgument", ["args[", "Environment.GetCommandLineArgs"]), ("DatabaseRead", ["ExecuteReader", "SqlDataReader"])],
        "sink": [("SqlQuery", ["ExecuteSqlRaw", "ExecuteSqlInterpolated", "FromSqlRaw", "SqlCommand", "ExecuteNonQuery", "ExecuteReader"]), ("ShellCommand", ["Process.Start", "ProcessStartInfo"]), ("FileWrite", ["File.WriteAllText", "File.WriteAllBytes", "StreamWriter"]), ("HtmlOutput", ["Response.Write", "Html.Raw", "InnerHtml"]), ("LogOutput", ["Log.", "Logger.", "Console.WriteLine"])],
        "sanitizer": [("numeric", ["int.Parse", "long.Parse", "double.Parse"]), ("HtmlEscape", ["HtmlEncode", "WebUtility.HtmlEncode", "AntiXss"]), ("SqlParam", ["AddWithValue", "Parameters.Add"])],
    },
    "c": {
        "source": [("HttpParameter", ["getenv(", "getenv_s(", "getchar(", "fgets(", "read(", "recv(", "QUERY_STRING"]), ("FileInput", ["fread(", "fopen("]), ("CliArgument", ["argv["])],
        "sink": [("SqlQuery", ["sqlite3_exec(", "mysql_query(", "PQexec(", "sprintf(&SELECT", "sprintf(&INSERT", "sprintf(&UPDATE", "sprintf(&DELETE"]), ("ShellCommand", ["system(", "popen("]), ("HtmlOutput", ["fprintf("]), ("FileWrite", ["fwrite("])],
        "sanitizer": [("numeric", ["atoi(", "strtol(", "strtoul("]), ("SqlParam", ["snprintf(&%"])],
    },
}
RULES["typescript"] = RULES["javascript"]
RULES["cpp"] = {
    "source": [("HttpParameter", ["std::getline", "std::cin"]), *RULES["c"]["source"]],
    "sink": [("ShellCommand", ["std::system("]), *RULES["c"]["sink"]],
    "sanitizer": [("numeric", ["std::stoi", "std::stol"]), *RULES["c"]["sanitizer"]],
}
# Severity by kind of source and sink; all others have 5.
SEVERITY = {
    ("HttpParameter", "SqlQuery"): 10, ("HttpParameter", "ShellCommand"): 10, ("HttpParameter", "HtmlOutput"): 9, ("HttpParameter", "Eval"): 10,
    ("FileInput", "ShellCommand"): 8, ("FileInput", "SqlQuery"): 7, ("DatabaseRead", "HtmlOutput"): 6, ("Environment", "ShellCommand"): 7,
}


def mark(text: Column, language: str, kind: str) -> Column:
    """The label of the first rule that a statement's text meets, or null."""
    out = None
    for label, needles in RULES[language][kind]:
        hit = None
        for needle in needles:
            both = None
            for part in needle.split("&"):
                c = F.contains(text, F.lit(part))
                both = c if both is None else both & c
            hit = both if hit is None else hit | both
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out


def marked(text: str, language: str, kind: str) -> str | None:
    return next((label for label, needles in RULES[language][kind] if any(all(p in text for p in n.split("&")) for n in needles)), None)


def flows_of(f: Function, language: str, sources=None, sinks=None, sanitizers=None) -> Iterator[tuple]:
    """Each source's way to each sink by the fewest data dependences.

    (source, source type, sink, sink type, variable, path, sanitizers, severity, vulnerable, bypassed).
    """
    pick = lambda kind, own: own if own is not None else {k: m for k, s in enumerate(f.stmts) if (m := marked(s["text"] or "", language, kind))}
    sources, sinks, sanitizers = pick("source", sources), pick("sink", sinks), pick("sanitizer", sanitizers)
    step: dict[int, list[int]] = {}
    for a, c, *_ in f.data:
        step.setdefault(a, []).append(c)
    for start, source_type in sources.items():
        came: dict[int, int | None] = {start: None}
        work = deque([start])
        while work:
            k = work.popleft()
            for c in sorted(set(step.get(k, []))):
                if c not in came:
                    came[c] = k
                    work.append(c)
        variable = min(f.stmts[start]["defs"] or [""])
        for end in came:
            if end not in sinks:
                continue
            path, k = [], end
            while k is not None:
                path.append(k)
                k = came[k]
            path.reverse()
            block = f.stmts[end]["block"]
            good = [sanitizers[k] for k in path if k in sanitizers and f.dominates(f.stmts[k]["block"], block)]
            touching = [k for k in sanitizers if variable in [*(f.stmts[k]["defs"] or []), *(f.stmts[k]["uses"] or [])] or f"int({variable})" in (f.stmts[k]["text"] or "")]
            bypassed = any(k in path and not f.dominates(f.stmts[k]["block"], block) for k in sanitizers) or any((f.stmts[k]["line"] or 0) > (f.stmts[end]["line"] or 0) or not f.dominates(f.stmts[k]["block"], block) for k in touching)
            yield f.stmts[start]["stmt"], source_type, f.stmts[end]["stmt"], sinks[end], variable, [f.stmts[k]["stmt"] for k in path], good, SEVERITY.get((source_type, sinks[end]), 5), not good, bypassed


FLOWS = "fn long, source int, source_type string, sink int, sink_type string, variable string, path array<int>, sanitizers array<string>, severity int, vulnerable boolean, bypassed boolean"


def flows(stmts: DataFrame, edges: DataFrame, language: str = "python") -> DataFrame:
    return per_function(stmts, edges, lambda f: flows_of(f, language), FLOWS)


# Weaknesses in order: number, severity, source patterns, sink patterns, kinds of sink.
WEAKNESSES = [
    (89, 10, [r"request\.(GET|POST|query|body)", r"req\.(query|params|body)"], [r"\.execute\(", r"\.query\(", r"cursor\.(execute|executemany)"], ["SqlQuery"]),
    (79, 9, [r"request\.(GET|POST)", r"req\.(query|body)"], [r"innerHTML", r"document\.write", r"\.html\("], ["HtmlOutput"]),
    (78, 10, [r"request\.GET", r"req\.query", r"sys\.argv"], [r"os\.system\(", r"subprocess\.(call|run|Popen)", r"Command::new"], ["ShellCommand"]),
    (22, 8, [r"request\.(GET|POST)", r"req\.(query|params)"], [r"open\(", r"fs\.readFile", r"File::open"], ["FileWrite"]),
    (798, 9, [r"password\s*=\s*['\"]", r"api_key\s*=\s*['\"]", r"secret\s*=\s*['\"]"], [], []),
    (502, 9, [r"request\.(GET|POST|body)", r"req\.body"], [r"pickle\.loads", r"yaml\.load", r"serde_json::from_str"], ["Eval"]),
    (918, 8, [r"request\.(GET|POST)", r"req\.(query|params)"], [r"requests\.get\(", r"urllib\.request", r"fetch\(", r"http\.get\("], []),
    (352, 7, [r"@app\.route", r"router\.post"], [r"\.post\(", r"POST"], []),
    (287, 9, [r"login", r"authenticate"], [r"bypass", r"skip_auth", r"#\[allow\(unauthenticated\)\]"], []),
    (306, 8, [r"admin", r"delete_user"], [r"\.delete\(", r"drop_table"], []),
]


def weaknesses(found: DataFrame, sources: DataFrame) -> DataFrame:
    """found (flows) and sources (fn, text): each vulnerable flow's first weakness, or null.

    A pattern with kinds of sink asks for the flow's own kind.
    """
    text = F.col("code")
    any_of = lambda patterns: F.lit(True) if not patterns else text.rlike("|".join(f"(?:{p})" for p in patterns))
    cwe, severity = None, None
    for number, level, source, sink, kinds in WEAKNESSES:
        hit = any_of(source) & any_of(sink) & (F.col("sink_type").isin(kinds) if kinds else F.lit(True))
        cwe = F.when(hit, number) if cwe is None else cwe.when(hit, number)
        severity = F.when(hit, level) if severity is None else severity.when(hit, level)
    rows = found.filter("vulnerable").join(sources.select("fn", F.col("text").alias("code")), "fn")
    return rows.select("fn", "source", "sink", "sink_type", cwe.alias("cwe"), severity.alias("cwe_severity"))


def inferred_type(text: Column) -> Column:
    """The type that a statement's right side suggests."""
    right = F.trim(F.regexp_extract(text, r"=\s*(.+?);?\s*$", 1))
    return (
        F.when(right.rlike(r"^[+-]?\d+$"), "Int").when(right.rlike(r"^[+-]?\d+\.\d*$"), "Float").when(right.rlike(r"^(int|len|parseInt)\("), "Int").when(right.rlike(r"^(float|parseFloat)\("), "Float")
        .when(right.rlike(r"^(True|False|true|false)$"), "Bool").when(right.rlike(r"^(None|null|undefined)$"), "None").when(right.rlike(r"^f?['\"`]|^str\(|\.(strip|lower|upper|join|format)\("), "String")
        .when(right.rlike(r"^\[|^list\("), "List").when(right.rlike(r"^\{|^dict\("), "Dict").when(right.rlike(r"^\("), "Tuple").when(right.rlike(r"^(lambda\b|function\b)|=>"), "Function").otherwise("Unknown")
    )


def inferred_types(stmts: DataFrame) -> DataFrame:
    """(fn, variable, type, confidence): one kind of known type decides, several make a Union; confidence is the share of known ones."""
    rows = stmts.select("fn", F.explode("defs").alias("variable"), inferred_type(F.col("text")).alias("t"))
    by = rows.groupBy("fn", "variable").agg(F.collect_set(F.when(F.col("t") != "Unknown", F.col("t"))).alias("kinds"), F.avg((F.col("t") != "Unknown").cast("double")).alias("confidence"))
    return by.select("fn", "variable", F.when(F.size("kinds") == 0, "Unknown").when(F.size("kinds") == 1, F.get("kinds", 0)).otherwise("Union").alias("type"), "confidence")


def mutations(writes: DataFrame, owner: str, member: str | None = None, unresolved: bool = False, constructors: bool = False) -> DataFrame:
    """Field writes to a type: (function, receiver_type, member, file, line, kind), by the type's last part.

    Writes in constructors and unresolved receivers are left out unless asked for.
    """
    last = lambda c: F.regexp_extract(c, r"([^.:]+)$", 1)
    hit = F.coalesce(last(F.col("receiver_type")) == owner.replace("::", ".").split(".")[-1], F.lit(False))
    rows = writes.filter(hit | (F.col("kind") == "Unresolved") if unresolved else hit & (F.col("kind") != "Unresolved"))
    if member:
        rows = rows.filter(F.col("member") == member)
    if not constructors:
        name = last(F.col("function"))
        rows = rows.filter(~name.isin("__init__", "new", "constructor") & ~F.coalesce(name == last(F.col("receiver_type")), F.lit(False)))
    return rows.select("function", "receiver_type", "member", "file", "line", "kind")
