"""Source trees, configuration, compaction, streams, exports and functions."""

import pytest
from pyspark.sql import functions as F

from lodegraph.functions import text as T
from lodegraph.functions import vectors as V
from lodegraph.operators import policy
from lodegraph.plans import gql
from lodegraph.sources import braces, exports, ingest
from lodegraph.streaming import compaction

PY = '''
import os
class Order(Base):
    def total(self, n: int) -> int:
        if n > 1 and n < 5:
            return helper(n)
        return 0
def helper(x):
    return os.getenv("LIMIT")
def twin():
    pass
'''


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    (root / "src").mkdir()
    (root / "target").mkdir()
    (root / "src" / "a.py").write_text(PY)
    (root / "src" / "b.py").write_text("def twin():\n    pass\ndef caller():\n    twin()\n    helper(1)\n")
    (root / "src" / "c.py").write_text("def lone():\n    twin()\n")
    (root / "src" / "lib.rs").write_text("pub struct S;\npub fn run(x: i32) {\n}\nfn two() {}\n")
    (root / "src" / "x.bin").write_bytes(b"a\x00b")
    (root / "src" / "broken.py").write_text("def (:\n")
    (root / "target" / "t.py").write_text("def skipped(): pass\n")
    (root / "conf.json").write_text('{"db": {"host": "h", "port": 5}, "on": true, "xs": [1], "n": null}')
    (root / "conf.yaml").write_text("db:\n  host: h2\n  ports:\n    - 1\n    - 2\nname: 'x'\n")
    (root / "conf.toml").write_text("[db]\nhost = 'h'\n")
    (root / "app.properties").write_text("a.b=1\n# c\n")
    return str(root)


def test_discovery(spark, tree):
    paths = {r.path for r in ingest.discover(spark, tree).collect()}
    assert paths == {"src/a.py", "src/b.py", "src/c.py", "src/lib.rs", "src/broken.py", "conf.json", "conf.yaml", "conf.toml", "app.properties"}
    assert {r.path for r in ingest.discover(spark, tree, languages=["rust"]).collect()} == {"src/lib.rs"}
    assert ingest.discover(spark, tree, ignore=("src/*",)).filter("path like 'src%'").count() == 0


def test_graph_of_a_tree(spark, tree):
    g = ingest.build(ingest.discover(spark, tree))
    calls = {(r.a_name, r.b_name) for r in gql.run(g, "direct_calls").collect()}
    assert ("total", "helper") in calls and ("caller", "helper") in calls and ("caller", "twin") in calls
    assert ("lone", "twin") not in calls  # two of that name elsewhere: no edge
    rust = {(r.name, r.node_type, r.start_line) for r in g.nodes.filter("file_path = 'src/lib.rs' and node_type <> 'File'").collect()}
    assert rust == {("S", "Struct", 1), ("run", "Function", 2), ("two", "Function", 4)}
    assert g.nodes.filter("name = 'total'").first().properties["cyclomatic"] == "3"
    assert g.of(["Contains"]).count() == g.of(["DefinedIn"]).count() == g.nodes.filter("node_type <> 'File'").count()


#: A text of each language, its symbols (name, kind, line, decision count), parameters of one, and its relations.
BRACES = {
    "rust": (
        """//! fn ghost() {}
struct S { a: i32 }
trait Shape { fn area(&self) -> f64; }
impl<T: Clone> Shape for S {
    fn area(&self) -> f64 { let s = "fn nope() {"; self.side() * 2.0 }
}
impl S {
    pub fn side(&self) -> f64 { match self.a { 0 => 1.0, n if n > 3 => 2.0, _ => helper::<i32>(1, '{') } }
    pub async fn go<'a>(x: &'a str, mut y: Vec<(i32, u8)>) -> Result<String, E> where E: X { if x.is_empty() { println!("hi {}", x); } Ok(S::side(x)) }
}
fn helper(a: i32, c: char) -> f64 { 1.0 }
""",
        {("S", "Struct", 2, None), ("Shape", "Interface", 3, None), ("Shape.area", "Function", 3, None), ("S.area", "Function", 5, 1), ("S.side", "Function", 8, 5), ("S.go", "Function", 9, 2), ("helper", "Function", 11, 1)},
        ("S.go", "Result<String, E>", [("x", "&'a str"), ("y", "Vec<(i32, u8)>")]),
        {("S.area", "side", "Calls", "S.side"), ("S.side", "helper", "Calls", "helper"), ("S.go", "is_empty", "Calls", "x.is_empty"), ("S.go", "println", "Calls", "println"), ("S.go", "Ok", "Calls", "Ok"), ("S.go", "side", "Calls", "S.side")},
    ),
    "go": (
        """package m
type Animal interface {
	Speak(loud bool) string
}
type Dog struct {
	Base
	name string
}
func (d *Dog) Speak(loud bool) string {
	if loud { return d.shout() }
	switch d.x { case 1: return "a { b" ; default: return `c` }
}
func (d *Dog) shout() string { return helper(d.name, 2) }
func helper(a, b string, n int) (string, error) { return a, nil }
""",
        {("Animal", "Interface", 2, None), ("Dog", "Struct", 5, None), ("Dog.Speak", "Function", 9, 5), ("Dog.shout", "Function", 13, 1), ("helper", "Function", 14, 1)},
        ("helper", "(string, error)", [("a", "string"), ("b", "string"), ("n", "int")]),
        {("Dog", "Base", "Extends", "Base"), ("Dog", "Animal", "Implements", "Animal"), ("Dog.Speak", "shout", "Calls", "Dog.shout"), ("Dog.shout", "helper", "Calls", "helper")},
    ),
    "java": (
        """public class Dog<T extends X> extends Base<T> implements Runner, a.b.Walker {
    public Dog(int n) { this.n = n; }
    @Override public List<String> run(Map<String, Integer> m, int[] xs) throws IOException {
        if (n > 1) { helper(n); } /* ghost() { */
        Runnable r = new Runnable() { public void run() { inner(); } };
        return new ArrayList<>(m.keySet());
    }
    static int helper(int a) { return a; }
}
interface Walker extends Mover { void walk(int n); }
""",
        {("Dog", "Class", 1, None), ("Dog.Dog", "Function", 2, None), ("Dog.run", "Function", 3, None), ("Dog.run.run", "Function", 5, None), ("Dog.helper", "Function", 8, None), ("Walker", "Interface", 10, None), ("Walker.walk", "Function", 10, None)},
        ("Dog.run", "List<String>", [("m", "Map<String, Integer>"), ("xs", "int[]")]),
        {("Dog", "Base", "Extends", "Base"), ("Dog", "Runner", "Implements", "Runner"), ("Dog", "Walker", "Implements", "Walker"), ("Walker", "Mover", "Extends", "Mover"), ("Dog.run", "helper", "Calls", "helper"), ("Dog.run.run", "inner", "Calls", "inner"), ("Dog.run", "keySet", "Calls", "m.keySet")},
    ),
    "csharp": (
        """class Dog : Base, IRun<int> where T : new() {
  public Dog(int n) : base(n) { }
  public async Task<int> Run(string s = "x;{") { foreach (var x in xs) { Help(x); } return await this.Other(); }
  int Help(int a) => a + Other();
  private int Other() { int Local(int q) { return q; } return Local(2); }
}
""",
        {("Dog", "Class", 1, None), ("Dog.Dog", "Function", 2, None), ("Dog.Run", "Function", 3, None), ("Dog.Help", "Function", 4, None), ("Dog.Other", "Function", 5, None), ("Dog.Other.Local", "Function", 5, None)},
        ("Dog.Run", "Task<int>", [("s", "string")]),
        {("Dog", "Base", "Extends", "Base"), ("Dog", "IRun", "Implements", "IRun"), ("Dog.Run", "Help", "Calls", "Help"), ("Dog.Run", "Other", "Calls", "Dog.Other"), ("Dog.Help", "Other", "Calls", "Other"), ("Dog.Other", "Local", "Calls", "Local")},
    ),
    "javascript": (
        """function top(a, b = 2) { return helper(a) ? 1 : 2; }
const arrow = async (p, q) => { for (const i of p) { top(i); } };
const short = x => top(x);
class Dog extends Base {
  run(a) { if (a) { this.bark(/[{]"/.test(a)); } }
  bark() { switch (1) { case 1: return `x ${y} {`; } }
}
""",
        {("top", "Function", 1, 2), ("arrow", "Function", 2, 2), ("short", "Function", 3, 1), ("Dog", "Class", 4, None), ("Dog.run", "Function", 5, 2), ("Dog.bark", "Function", 6, 3)},
        ("short", None, [("x", None)]),
        {("top", "helper", "Calls", "helper"), ("arrow", "top", "Calls", "top"), ("short", "top", "Calls", "top"), ("Dog.run", "bark", "Calls", "Dog.bark"), ("Dog.run", "test", "Calls", "test")},
    ),
    "typescript": (
        """interface Shape { area(): number; }
export async function go(a: string, b?: Map<string, number>): Promise<void> { await help(a); }
const help = (a: string): number => a.length > 0 ? 1 : 2;
""",
        {("Shape", "Interface", 1, None), ("go", "Function", 2, 1), ("help", "Function", 3, 2)},
        ("go", "Promise<void>", [("a", "string"), ("b", "Map<string, number>")]),
        {("go", "help", "Calls", "help")},
    ),
    "c": (
        """#define F(x) do { x; } while (0)
struct P { int a; };
static int helper(const char *s, int n[]) { struct P p; if (n) { printf("%s {", s); } return 0; }
int main(void) { return helper("a", 0); }
""",
        {("P", "Struct", 2, None), ("helper", "Function", 3, None), ("main", "Function", 4, None)},
        ("helper", "int", [("s", "const char *"), ("n", "int[]")]),
        {("helper", "printf", "Calls", "printf"), ("main", "helper", "Calls", "helper")},
    ),
    "cpp": (
        """class Dog : public Base, private Other {
  Dog(int n) : n_(n), m_{2} { init(); }
  int run(int a) const override { return help<int>(a) + this->n_; }
};
int Dog::walk(std::vector<int> v) { for (auto x : v) { run(x); } return 0; }
""",
        {("Dog", "Class", 1, None), ("Dog.Dog", "Function", 2, None), ("Dog.run", "Function", 3, None), ("Dog.walk", "Function", 5, None)},
        ("Dog.walk", "int", [("v", "std::vector<int>")]),
        {("Dog", "Base", "Extends", "Base"), ("Dog", "Other", "Implements", "Other"), ("Dog.Dog", "init", "Calls", "init"), ("Dog.run", "help", "Calls", "help"), ("Dog.walk", "run", "Calls", "run")},
    ),
}


@pytest.mark.parametrize("lang", BRACES)
def test_languages_with_braces(lang):
    text, symbols, (name, returns, params), relations = BRACES[lang]
    got, related = braces.brace_symbols("f", text, lang)
    assert {(s[3], s[4], s[5], s[10]) for s in got} == symbols
    one = next(s for s in got if s[3] == name)
    assert (one[8], [(p["name"], p["param_type"]) for p in one[9]]) == (returns, params)
    assert {(r[1], r[2], r[3], r[5]) for r in related} == relations
    assert all("\n" not in s[7] and s[2] in s[7] for s in got if s[4] == "Function")


@pytest.mark.parametrize("lang", BRACES)
def test_broken_and_long_texts_with_braces(lang):
    assert braces.brace_symbols("f", None, lang) == braces.brace_symbols("f", "", lang) == ([], [])
    text = BRACES[lang][0]
    for k in range(0, len(text), 7):  # cut anywhere: no crash, places inside the text
        assert all(1 <= s[5] <= s[6] <= text.count("\n") + 1 for s in braces.brace_symbols("f", text[:k], lang)[0])
    for junk in ("(" * 50_000, "{" * 50_000, "a." * 50_000, "x<" * 20_000, "/*" * 50_000, "'" * 50_000):
        braces.brace_symbols("f", junk, lang)


def test_graph_of_other_languages(spark):
    files = spark.createDataFrame([(f"src/{lang}.x", text, lang) for lang, (text, *_) in BRACES.items()] + [("n.rs", None, "rust")], "path string, text string, language string")
    g = ingest.build(files)
    calls = {(r.a_file, r.a_name, r.b_name) for r in g.gql("MATCH (a:Function)-[:CALLS]->(b:Function) RETURN a, b").collect()}
    assert {("src/rust.x", "area", "side"), ("src/rust.x", "side", "helper"), ("src/go.x", "Speak", "shout"), ("src/java.x", "run", "helper"), ("src/csharp.x", "Run", "Other"), ("src/javascript.x", "arrow", "top"), ("src/typescript.x", "go", "help"), ("src/c.x", "main", "helper"), ("src/cpp.x", "walk", "run")} <= calls
    assert ("src/javascript.x", "top", "helper") not in calls  # several of that name elsewhere: no edge
    kinds = {r.edge_type for r in g.edges.select("edge_type").distinct().collect()}
    assert {"Calls", "Implements", "Contains", "DefinedIn"} <= kinds


def test_configuration(spark, tree):
    files = ingest.discover(spark, tree)
    keys = {(r.file, r.key_path): (r.value, r.value_type) for r in ingest.config_keys(files).collect()}
    assert keys[("conf.json", "db.port")] == ("5", "Number") and keys[("conf.json", "on")] == ("true", "Boolean") and keys[("conf.json", "n")] == (None, "Null")
    assert keys[("conf.yaml", "db.host")] == ("h2", "String") and keys[("conf.yaml", "db.ports")] == ("[1, 2]", "Array")
    assert keys[("conf.toml", "db.host")] == ("h", "String") and keys[("app.properties", "a.b")] == ("1", "String")
    assert [(r.key, r.confidence) for r in ingest.config_usages(files).collect()] == [("LIMIT", "Extracted")]
    own = lambda f: ingest.config_keys(files).filter(F.col("file") == f)
    got = {r.key_path: r.change for r in policy.drift(own("conf.json"), own("conf.yaml")).collect()}
    assert got["db.host"] == "changed" and got["db.port"] == "removed" and got["name"] == "added"


def test_compaction_equals_a_full_build(spark, tree):
    files = ingest.discover(spark, tree)
    whole = ingest.build(files)
    part = ingest.build(files.filter("path <> 'src/c.py'"))
    out = compaction.compact(part, ingest.build(files.filter("path = 'src/c.py'")), spark.createDataFrame([("src/c.py",)], "path string"))
    assert exports.digest(out) == exports.digest(whole)
    gone = compaction.compact(whole, type(whole)(whole.nodes.limit(0), whole.edges.limit(0)), spark.createDataFrame([("a.py",)], "path string"))
    assert gone.nodes.filter("file_path = 'src/a.py'").count() == 0 and gone.edges.join(whole.nodes.filter("file_path = 'src/a.py'").select(F.col("id").alias("src")), "src").count() == 0


def test_stream_of_changes(spark, tree, tmp_path):
    files = ingest.discover(spark, tree)
    box = str(tmp_path / "in")
    files.filter("path like '%.py'").write.parquet(box)
    q = compaction.stream(spark.readStream.schema("path string, text string, language string").parquet(box), str(tmp_path / "graph"), str(tmp_path / "ck"))
    q.processAllAvailable()
    q.stop()
    c = compaction.Compactor(str(tmp_path / "graph"))
    first = exports.digest(c.graph(spark))
    assert first == exports.digest(ingest.build(files.filter("path like '%.py'")))
    c(files.filter("path = 'src/a.py'"), 0)  # a batch that ran before changes nothing
    assert c.current(spark)[1] == 0
    c(files.filter("path = 'src/a.py'").withColumn("text", F.lit("def fresh(): pass\n")), 1)
    assert c.graph(spark).nodes.filter("name = 'fresh'").count() == 1 and c.graph(spark).nodes.filter("name = 'helper'").count() == 0


def test_exports(spark, tree, tmp_path):
    g = ingest.build(ingest.discover(spark, tree))
    written = exports.write_table(g, str(tmp_path / "t"))
    assert written == exports.digest(exports.read_table(spark, str(tmp_path / "t")))
    exports.json_lines(g).write.text(str(tmp_path / "j"))
    assert exports.digest(exports.read_json_lines(spark, str(tmp_path / "j"))) == written
    sub = exports.subgraph(g, "name:total", 1)
    assert {"total", "helper"} <= {r.name for r in sub.nodes.collect()}
    import xml.etree.ElementTree as E

    exports.write_lines(exports.graphml(g), str(tmp_path / "x"))
    doc = "\n".join(r.value for r in spark.read.text(str(tmp_path / "x")).collect())
    assert E.fromstring(doc.replace('<?xml version="1.0" encoding="UTF-8"?>', "")).tag.endswith("graphml")
    assert exports.dot(g).filter("part = 1").count() == g.nodes.count()
    assert exports.mermaid(g, "callgraph").filter("part = 2").count() == g.of(["Calls"]).count()
    assert exports.mermaid(g, "class").filter("part = 1").count() == 2
    for dialect, text in (("proto", "int64 n = "), ("thrift", "i64 total(1: string self, 2: i64 n)"), ("openapi", '"n": {"type": "integer"}')):
        assert text in exports.interface(g.nodes.filter("name = 'total'"), dialect).first().value
    assert exports.cpg(g, path_filter="a.py").nodes.filter("file_path <> 'src/a.py'").count() == 0


def test_text_functions(spark):
    r = spark.createDataFrame([("parseHTTPRequest user_id ab Ünïcode9", "fn go(a: i32, b: str) -> Bool", "def go(x, y) -> bool")], "t string, s string, u string").select(T.tokens(F.col("t")).alias("t"), T.signature(F.col("s")).alias("s"), T.equivalent(F.col("s"), F.col("u")).alias("e"), T.canonical_name(F.lit("a::b#c(int)")).alias("c"), T.xml(F.lit("<&'\">")).alias("x")).first()
    assert r.t == ["parse", "httprequest", "user", "Ünïcode9".replace("Ü", "Ü")] or "httprequest" in r.t
    assert (r.s.name, r.s.arity, r.e, r.c, r.x) == ("go", 2, True, "a.b.c", "&lt;&amp;&apos;&quot;&gt;")
    assert T.fnv1a(b"a") == 0xAF63DC4C8601EC8C
    words = T.bloom_words(["alpha", "beta"])
    df = spark.createDataFrame([(words,)], "b array<long>").select(T.bloom_has_any(F.col("b"), "alpha").alias("y"))
    assert df.first().y and 2 <= sum((x & (1 << 64) - 1).bit_count() for x in words) <= 4


def test_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, -1.0, 0.0, 2.0]), (2, [-1.0, -1.0, -1.0, -1.0])], "id long, v array<double>").select("id", V.sign_bits(F.col("v"), 4).alias("bits"))
    assert {r.id: list(r.bits) for r in df.collect()} == {1: [0b1101], 2: [0]}
    assert [(r.id, r.distance) for r in V.top_k(df, [0b0101], 2).collect()] == [(1, 1), (2, 2)]
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "id long, vector array<double>")
    e = spark.createDataFrame([(1, 2)], "src long, dst long")
    got = {r.id: r.vector for r in V.diffuse(v, e, rounds=1).collect()}
    assert got[2] == [0.0, 1.0] and got[1][0] == pytest.approx(0.75 / (0.75**2 + 0.25**2) ** 0.5)
