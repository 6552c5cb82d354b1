"""Extraction on small sources: what is declared, called, composed, and how states change."""

import pytest
from conftest import DATA
from pyspark.sql import functions as F

from evigraph import registry
from evigraph.operators import extract, ingest
from evigraph.sources import files

RUST = '''pub const fn k() -> u8 { 1 }
pub unsafe fn u() { println!("no call inside a string: x()"); } // nor here: y()
struct Lock { inner: Bar, pub name: String, map: HashMap<String, u8> }
pub struct Bar;
trait Keep { fn keep(&self); }
impl<T> Keep for Lock {
    fn keep(&self) { foo(1); self.bar(2).await; let f = |x| x + 1; run::<u8>(f); }
}
async fn go() { fetch().await; k(); }
enum DoorState { Open, Closed { by: u8 } }
impl DoorState {
    fn next(self, key: bool) -> Self {
        match self {
            DoorState::Open => DoorState::Closed { by: 1 },
            DoorState::Closed { .. } if key => { log("Open"); Self::Open }
        }
    }
}
'''
TS = '''export abstract class Door extends Thing implements Lock, Named<string> {
  private lock: Bolt;
  name?: string;
  go(n: number): void { this.run(); help(`x() ${n}`); }
  async later() { await fetchAll(); if (n) { deep(); } }
}
class Bolt {}
interface Lock { open(): void; }
export function main() { const f = async () => helper(); other(1); }
type DoorState = 'open' | 'closed';
function step(s: DoorState): DoorState {
  switch (s) {
    case 'open': return 'closed';
    case 'closed': if (key) { return 'open'; }
  }
}
'''
GO = '''package main
func greet() { fmt.Println("hi()") }
func (s *Server) Save() {}
func (s Server) Name() string { return s.name }
func handler() {
	fn := func() { greet() }
	fn()
}
func main() { s.Save(); handler() }
'''
JAVA = '''public class Server {
    private String name;
    public Server(String name) { this.name = name; }
    public String getName() { return name; }
    void handle(int x) throws Oops {
        if (validate(x)) { process(x); }
        new Thing(x);
    }
    private boolean validate(int x) { return this.check(x); }
    abstract void open();
}
'''
KOTLIN = '''class Server(val name: String) {
    fun getName(): String = name
    fun handle(x: Int) { validate(x); process(x) }
    private fun validate(x: Int) { requireNotNull(x) }
    fun process(x: Int) { println("a(b)") }
}
'''
PYTHON = '''class Door:
    @transition("open", "closed")
    def shut(self): self.log()
    def to_locked(self): pass
class Plain:
    def go(self): pass
async def f():
    await g()
    "x()"
'''


@pytest.fixture(scope="module")
def sources(spark):
    rows = [("a.rs", "rust", RUST), ("a.ts", "typescript", TS), ("a.go", "go", GO), ("A.java", "java", JAVA), ("a.kt", "kotlin", KOTLIN), ("a.py", "python", PYTHON), ("n.rs", "rust", None), ("e.ts", "typescript", ""), ("bad.rs", "rust", 'fn x( { " }}} ((('), ("x.zig", "zig", "fn a() {}")]
    return spark.createDataFrame(rows, "path string, language string, text string")


def test_functions(sources):
    got = {}
    for r in extract.extract(sources, "functions").collect():
        got.setdefault(r["file"], set()).add((r["name"], r["kind"], r["line"], r["parent"]))
    assert got["a.rs"] == {("k", "function", 1, None), ("u", "function", 2, None), ("keep", "method", 5, "Keep"), ("keep", "method", 7, "Lock"), ("closure@7", "closure", 7, None), ("go", "function", 9, None), ("next", "method", 12, "DoorState")}
    assert got["a.ts"] == {("go", "method", 4, "Door"), ("later", "method", 5, "Door"), ("main", "function", 9, None), ("arrow@9", "closure", 9, None), ("step", "function", 11, None)}
    assert {x[:2] for x in got["a.go"]} == {("greet", "function"), ("Save", "method"), ("Name", "method"), ("handler", "function"), ("main", "function")}
    assert {x[:2] for x in got["A.java"]} == {(n, "method") for n in ("Server", "getName", "handle", "validate")}
    assert {x[:2] for x in got["a.kt"]} == {(n, "method") for n in ("getName", "handle", "validate", "process")}
    assert set(got) <= {"a.rs", "a.ts", "a.go", "A.java", "a.kt", "a.py", "bad.rs"}


def test_calls(sources):
    got = {}
    for r in extract.extract(sources, "calls").collect():
        got.setdefault(r["file"], set()).add((r["callee"], r["kind"], r["message_kind"] == "async_call"))
    assert got["a.rs"] == {("foo", "direct", False), ("bar", "method", True), ("run", "direct", False), ("fetch", "direct", True), ("k", "direct", False), ("log", "direct", False)}
    assert got["a.ts"] == {("help", "direct", False), ("fetchAll", "direct", True), ("deep", "direct", False), ("helper", "direct", False), ("other", "direct", False)}
    assert got["a.go"] == {("Println", "method", False), ("greet", "direct", False), ("fn", "direct", False), ("Save", "method", False), ("handler", "direct", False)}
    assert got["A.java"] == {("validate", "direct", False), ("process", "direct", False), ("check", "method", False)}
    assert got["a.kt"] == {("validate", "direct", False), ("process", "direct", False), ("requireNotNull", "direct", False), ("println", "direct", False)}
    assert got["a.py"] == {("transition", "direct", False), ("log", "method", False), ("g", "direct", True)}


def test_types(sources):
    rows = {(r["file"], r["name"]): r for r in extract.extract(sources, "classes").collect()}
    lock, door = rows["a.rs", "Lock"], rows["a.ts", "Door"]
    assert [m["name"] for m in lock["members"]] == ["inner", "name", "map", "keep"] and lock["implements"] == ["Keep"]
    assert [m["name"] for m in rows["a.rs", "DoorState"]["members"]] == ["Open", "Closed", "next"]
    assert (door["bases"], door["implements"]) == (["Thing"], ["Lock", "Named"])
    assert [(m["name"], m["member_kind"]) for m in door["members"]] == [("lock", "field"), ("name", "field"), ("go", "method"), ("later", "method")]
    assert rows["a.py", "Door"]["kind"] == "class"


def test_state_machines_and_their_graph(spark, sources):
    states = extract.state_machines(sources)
    assert {(r["file"], r["machine"], r["state"]) for r in states.collect()} == {("a.rs", "DoorState", "Open"), ("a.rs", "DoorState", "Closed"), ("a.ts", "DoorState", "open"), ("a.ts", "DoorState", "closed"), ("a.py", "Door", "open"), ("a.py", "Door", "closed"), ("a.py", "Door", "locked")}
    moves = extract.state_transitions(sources)
    assert {(r["file"], r["source"], r["target"], r["trigger"], r["guard"]) for r in moves.collect()} == {
        ("a.rs", "Open", "Closed", "next", None), ("a.rs", "Closed", "Open", "next", "key"), ("a.ts", "open", "closed", "step", None), ("a.ts", "closed", "open", "step", "key"),
        ("a.py", "open", "closed", "shut", None), ("a.py", "open", "locked", "to_locked", None), ("a.py", "closed", "locked", "to_locked", None),
    }
    none = spark.createDataFrame([], "canonical_key string, kind_id string, current_name string")
    g = ingest.state_graph(states, moves, none)
    e = g["Element"]
    assert {r["kind_id"]: r["n"] for r in e.groupBy("kind_id").agg(F.count("*").alias("n")).collect()} == {"uml.state_machine": 3, "uml.state": 7, "uml.transition": 7}
    assert g["SEMANTIC_EDGE"].count() == 14
    assert ingest.transitions(g["SEMANTIC_EDGE"]).filter("transition like '%:transition:%'").count() == 7
    assert ingest.state_graph(states, moves, e)["Element"].count() == 0


def test_call_graph_is_applied_once(spark):
    text = "pub fn caller() { helper(); other_helper(); helper(); unknown(); }\npub fn helper() {}\npub fn other_helper() {}\n"
    f = spark.createDataFrame([("src/lib.rs", "rust", text)], "path string, language string, text string")
    none = spark.createDataFrame([], "canonical_key string, kind_id string, current_name string")
    functions, calls = extract.extract(f, "functions"), extract.extract(f, "calls")
    g = ingest.call_graph(functions, calls, none)
    assert {r["current_name"] for r in g["Element"].collect()} == {"caller", "helper", "other_helper"}
    assert {(r["source_id"].split(":")[3], r["target_id"].split(":")[3]) for r in g["SEMANTIC_EDGE"].collect()} == {("caller", "helper"), ("caller", "other_helper")}
    ids = {r["id"] for r in g["Evidence"].collect()}
    assert len(ids) == 6 and {r["dst"] for r in g["SUPPORTED_BY"].collect()} == ids
    assert g["SourceArtifact"].count() == 1
    again = ingest.call_graph(functions, calls, g["Element"])
    assert all(again[t].count() == 0 for t in ("Element", "ElementVersion", "SEMANTIC_EDGE"))


def test_class_diagram_names_what_it_cannot_resolve(spark, sources):
    none = spark.createDataFrame([], "canonical_key string, kind_id string, current_name string")
    g = ingest.class_diagram(extract.extract(sources, "classes"), none)
    got = {(r["predicate_id"], r["source_id"].split(":")[4], r["target_id"]) for r in g["SEMANTIC_EDGE"].collect()}
    assert ("uml.extends", "Door", "cd:typescript:a.ts:class:Thing:0") in got
    assert ("uml.implements", "Door", "cd:typescript:a.ts:interface:Lock:8") in got
    assert ("uml.implements", "Lock", "cd:rust:a.rs:trait:Keep:5") in got
    assert ("uml.composition", "Lock", "cd:rust:a.rs:struct:Bar:4") in got and ("uml.composition", "Door", "cd:typescript:a.ts:class:Bolt:7") in got


def test_pattern_evidence_skips_strings(sources):
    got = {(r["path"], r["start_line"], r["content"]) for r in extract.pattern_evidence(sources, {"calls": r"\bhelp\(|\bx\("}).collect()}
    assert got == {("a.ts", 4, "help("), ("a.py", 9, "x("), ("bad.rs", 1, "x(")}


def test_workspaces_and_dependencies(spark):
    rows = [("package.json", '{"name":"root","workspaces":{"packages":["packages/*"]}}'), ("packages/a/package.json", '{"name":"@x/a"}'), ("other/b/package.json", '{"name":"b"}'),
            ("Cargo.toml", '[workspace.dependencies]\nserde = "1"\n[dependencies.tokio]\nversion = "1"\n[target.\'cfg(unix)\'.dependencies]\nlibc = "0"\n[dev-dependencies]\nquick = "1"\n'), ("b/Cargo.toml", "not toml [")]
    f = spark.createDataFrame(rows, "path string, text string")
    assert {(r["name"], r["strategy"]) for r in files.package_candidates(f).filter("strategy like 'npm%'").collect()} == {("root", "npm-single"), ("@x/a", "npm")}
    assert {(r["name"], r["kind"]) for r in files.dependencies(f).collect()} == {("serde", "dependencies"), ("tokio", "dependencies"), ("libc", "dependencies"), ("quick", "dev-dependencies")}


def test_large_files_take_time_in_proportion():
    import time

    text = "".join(f"pub struct S{i} {{ a: u8, b: Vec<S{i}> }}\nimpl S{i} {{ fn f(&self) -> u8 {{ g({i}); if self.a > 1 {{ h() }} else {{ 2 }} }} }}\nenum E{i} {{ A, B(u8), C }}\n" for i in range(2000))
    began = time.process_time()
    functions, calls, classes = extract._by_blocks("rust", "a.rs", text)
    assert time.process_time() - began < 4
    assert len(classes) == 4000 and len(functions) == 2000 and {f[1] for f in functions} == {"method"}
    members = {c[5]: [m[0] for m in c[8]] for c in classes}
    assert members["S7"] == ["a", "b", "f"] and members["E7"] == ["A", "B", "C"]
    assert len([c for c in calls if c[3] in "gh"]) == 4000


def _brands(spark):
    brands = {}
    for r in spark.read.parquet(f"{DATA}/part.parquet").orderBy("p_partkey").collect():
        brands.setdefault(r["p_brand"], []).append(r["p_partkey"])
    return brands


def test_functions_come_from_one_file_a_brand(spark):
    got = {(r["canonical_key"], r["line"]) for r in registry.g_functions(spark, DATA).collect()}
    assert got == {(f"rust:{b}.rs:f{k}:{i}", i) for b, keys in _brands(spark).items() for i, k in enumerate(keys, 1)}


def test_class_diagram_chains_all_parts_of_a_brand(spark):
    got = {(r["source"], r["target"]) for r in registry.g_class_diagram(spark, DATA).collect()}
    assert got == {(f"T{a}", f"T{b}" if b is not None else "Keep") for keys in _brands(spark).values() for a, b in [*zip(keys, keys[1:]), (keys[0], None)]}


def test_call_graph_makes_what_is_asked_for(spark):
    """Elements need no calls: these were extracted, placed and counted although nobody read their edges (F3)."""
    f = spark.createDataFrame([("a.rs", "rust", "fn a() { b(); }\nfn b() {}")], "path string, language string, text string")
    none = spark.createDataFrame([], "canonical_key string, kind_id string, current_name string")
    broken = extract.extract(f, "calls").withColumn("callee", F.raise_error(F.lit("calls were read")).cast("string"))
    g = ingest.call_graph(extract.extract(f, "functions"), broken, none)
    assert {r["current_name"] for r in g["Element"].collect()} == {"a", "b"}
    assert set(g) == {"Element", "ElementVersion", "SEMANTIC_EDGE", "Evidence", "SUPPORTED_BY", "SourceArtifact"}
    with pytest.raises(Exception, match="calls were read"):
        g["SEMANTIC_EDGE"].collect()


def test_call_graph_joins_no_table_with_itself(spark):
    """Edges and their pairs were joined again to get the first line, calls to get their message kind (F4)."""
    f = spark.createDataFrame([("a.rs", "rust", "async fn a() { b().await; b(); b(); }\nfn b() {}")], "path string, language string, text string")
    none = spark.createDataFrame([], "canonical_key string, kind_id string, current_name string")
    edges = ingest.call_graph(extract.extract(f, "functions"), extract.extract(f, "calls"), none)["SEMANTIC_EDGE"]
    assert [r["props"] for r in edges.collect()] == ['{"file":"a.rs","line":1,"message_kind":"async_call"}']
    assert edges._jdf.queryExecution().optimizedPlan().toString().count("Join") <= 5  # heavy names twice, new keys, names


def test_functions_of_a_large_file_need_no_bracket_index(spark):
    """An index of all brackets took a gigabyte a file, and the rows of a file went on in one piece (F9)."""
    s = extract.Source("rust", "a.rs", "fn a() { b(); }\nfn b() {}")
    assert [x[2] for x in s.functions()] == ["a", "b"] and not {"matched", "close", "opens", "around"} & set(vars(s))
    text = "\n".join(f"fn f{k}() {{ }}" for k in range(extract.ROWS * 2 + 5))
    f = spark.createDataFrame([("a.rs", "rust", text)], "path string, language string, text string")
    sizes = extract.extract(f, "functions").mapInPandas(lambda bs: (b.head(1).assign(n=len(b))[["n"]] for b in bs), "n long").collect()
    assert sum(r["n"] for r in sizes) == extract.ROWS * 2 + 5 and max(r["n"] for r in sizes) <= extract.ROWS
