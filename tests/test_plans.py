import ast
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from evigraph.functions import scalars as s
from evigraph.operators import extract, select
from evigraph.operators.policy import fan_out
from evigraph.plans import cypher, project, selectors
from evigraph.sources import files
from evigraph.streaming.dispatch import dispatch


@pytest.fixture(scope="module")
def graph(spark):
    nodes = spark.createDataFrame([("a", "Ann", 1), ("b", "Bob", 2), ("c", None, 3)], "id string, name string, n int")
    links = spark.createDataFrame([("a", "b", "x"), ("b", "c", "y")], "src string, dst string, kind string")
    return cypher.Graph({"N": nodes}, {"L": links})


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("MATCH (n:N) WHERE n.name = 'Ann' OR n.n >= 3 RETURN n.id AS id", {("a",), ("c",)}),
        ("MATCH (n:N)-[l:L]->(m:N) RETURN n.id, m.id AS m, l.kind", {("a", "b", "x"), ("b", "c", "y")}),
        ("MATCH (n:N)<-[:L]-(m:N) RETURN n.id, m.id AS m", {("b", "a"), ("c", "b")}),
        ("MATCH (n:N) OPTIONAL MATCH (n)-[:L]->(m:N) RETURN n.id, m.id AS m", {("a", "b"), ("b", "c"), ("c", None)}),
        ("MATCH (n:N) OPTIONAL MATCH (n)-[:L]->(m:N) WITH n, m WHERE m.id IS NOT NULL RETURN n.id AS id", {("a",), ("b",)}),
        ("MATCH (n:N {id: 'a'})-[*1..2]-(m:N) RETURN DISTINCT m.id AS id", {("b",), ("c",)}),
        ("MATCH (n:N) RETURN count(*) AS k, max(n.n) AS top", {(3, 3)}),
        ("MATCH (n:N), (m:N) WHERE n.id = 'a' AND m.id = 'c' RETURN n.id, m.id AS m", {("a", "c")}),
        ("MATCH (n:N) WHERE NOT n.name STARTS WITH 'A' RETURN n.id AS id", {("b",)}),
    ],
)
def test_cypher(graph, text, want):
    assert {tuple(r) for r in cypher.query(graph, text).collect()} == want


def test_cypher_refuses_writes_by_parsing(graph):
    assert cypher.is_read_only("MATCH (n:N) WHERE n.offset = 1 AND n.set = 'CREATE' RETURN n.dataset")
    for text in ("CREATE (n:N {id: 'x'})", "MATCH (n:N) SET n.name = 'x' RETURN n.id", "MERGE (n:N {id: 'x'})"):
        with pytest.raises(cypher.CypherError):
            cypher.query(graph, text)


def test_selectors():
    assert selectors.view_selector("container:orders/api") == selectors.Selector("container", "orders/api")
    assert selectors.project_selector("class:*").scope is None
    assert selectors.start_point("file:a/b.rs:12") == {"file": "a/b.rs", "line": 12}
    assert selectors.start_point("rust:a.rs:f:3") == {"key": "rust:a.rs:f:3"} and selectors.start_point("f") == {"name": "f"}
    for bad in ("container", "other:x", "container:", "container:" + "x" * 65, "container:a b"):
        with pytest.raises(selectors.BadSelector):
            selectors.view_selector(bad)


def test_resolve_selector(spark):
    e = spark.createDataFrame([("go:a:f:1", "f"), ("go:b:f:2", "f"), ("go:b:g:9", "g")], "canonical_key string, current_name string")
    assert select.resolve_selector(e, name="g") == "go:b:g:9" == select.resolve_selector(e, file="b", line=9)
    with pytest.raises(select.Ambiguous):
        select.resolve_selector(e, name="f")
    with pytest.raises(select.NotFound):
        select.resolve_selector(e, key="none")


def test_scalars(spark):
    one = spark.range(1)
    value = lambda c: one.select(c).first()[0]
    assert value(s.normal_remote(F.lit("git@host.org:team/repo.git/"))) == "host.org/team/repo.git"
    assert value(s.normal_remote(F.lit("https://user@host.org/team/repo.git"))) == "host.org/team/repo"
    assert [value(s.package_of(F.lit(p))) for p in ("src/a.rs", "crates/x/src/m.rs", "main.rs", None)] == ["src", "crates/x", "main.rs", "(unknown)"]
    assert value(s.field_type(F.lit("pub value: Foo<T>"))) == "Foo"
    assert [value(s.field_type(F.lit(x))) for x in ("n: &Foo", "n: u8", "n", "a: [Foo]")] == [None] * 4
    assert [value(s.glob_match(F.lit(p), F.lit("graph.updated"))) for p in ("*", "*.updated", "*.dated", "graph", "graph.updated")] == [True, True, True, False, True]
    assert value(s.name_similarity(F.lit("OrderService"), F.lit("Order"))) == 1.0
    assert value(s.stereotype(F.lit("uml.trait"))) == "<<trait>>"


@pytest.mark.parametrize("form", sorted(project.FORMATS))
@pytest.mark.parametrize("view", sorted(project.SHAPES))
def test_views_are_ordered_text(spark, form, view):
    rows = [("1", "uml.class", "k1", "A"), ("2", "uml.interface", "k2", "B"), ("3", "uml.state", "k3", "S"), ("4", "behavior.transition", "k4", "T"), ("5", "uml.actor", "k5", "U"), ("6", "uml.use_case", "k6", "V"), ("7", "mt.container", "k7", "C"), ("8", "behavior.participant", "k8", "P")]
    e = spark.createDataFrame(rows, "id string, kind_id string, canonical_key string, current_name string")
    links = [("r1", "uml.implements", "1", "2", "{}"), ("r2", "behavior.source_state", "4", "3", "{}"), ("r3", "behavior.target_state", "4", "3", "{}"), ("r4", "usecase.participates_in", "5", "6", "{}"), ("r5", "core.uses", "7", "8", "{}"), ("r6", "behavior.invokes", "8", "8", '{"label":"hi"}'), ("r7", "core.uses", "7", "missing", "{}")]
    r = spark.createDataFrame(links, "relation_id string, predicate_id string, source_id string, target_id string, props string")
    text = project.as_text(project.FORMATS[form](e, r, view)).first()[0]
    assert text == project.as_text(project.FORMATS[form](e.orderBy(F.desc("id")), r.orderBy(F.desc("relation_id")), view)).first()[0]
    assert "missing" not in text and text.endswith("\n")
    if form == "plantuml":
        expected = {"class": "A ..|> B", "state": "S --> T --> S", "usecase": "U --> V", "sequence": "P -> P : hi"}.get(view, 'rectangle "C" as C')
        assert expected in text and text.startswith("@startuml\n!theme default\n") and text.endswith("\n\n@enduml\n")


PYTHON = "class A:\n    x: B\n\n    def m(self):\n        obj.run()\n\nclass B(A):\n    pass\n\ndef f():\n    A()\n"
RUST = "pub struct Foo {\n    pub bar: Bar,\n}\nstruct Bar {\n}\nenum OrderState { Open, Closed }\nimpl Foo {\n    pub fn go(&self) {\n        self.bar.run();\n        help();\n    }\n}\n"


def test_extraction(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src/a.py").write_text(PYTHON)
    (tmp_path / "src/b.rs").write_text(RUST)
    (tmp_path / "src/.hidden.rs").write_text("fn no() {}")
    (tmp_path / "src/Cargo.toml").write_text('[package]\nname = "thing"\n\n[dependencies]\nserde = "1"\n\n[dev-dependencies]\nproptest = "1"\n')
    (tmp_path / "src/Dockerfile").write_text("FROM x\nLABEL org.title=\"Image\"\n")
    tree = files.tree(spark, str(tmp_path))
    assert {(r["path"], r["language"]) for r in tree.collect()} == {("src/a.py", "python"), ("src/b.rs", "rust"), ("src/Cargo.toml", "toml"), ("src/Dockerfile", "dockerfile")}
    with pytest.raises(ValueError, match="more than"):
        files.tree(spark, str(tmp_path), most=1)
    t = spark.createDataFrame([("a.py", "python", PYTHON), ("b.rs", "rust", RUST), ("bad.py", "python", "def ("), ("n.py", "python", None)], "path string, language string, text string")
    f = {r["canonical_key"] for r in extract.extract(t, "functions").collect()}
    assert f == {"python:a.py:m:4", "python:a.py:f:10", "rust:b.rs:go:8"}
    calls = {(r["file"], r["line"], r["callee"], r["kind"]) for r in extract.extract(t, "calls").collect()}
    assert {("a.py", 5, "run", "method"), ("a.py", 11, "A", "direct"), ("b.rs", 9, "run", "method"), ("b.rs", 10, "help", "direct")} <= calls
    classes = extract.extract(t, "classes")
    assert {(r["name"], r["kind"]) for r in classes.collect()} == {("A", "class"), ("B", "class"), ("Foo", "struct"), ("Bar", "struct"), ("OrderState", "enum")}
    from evigraph.operators.ingest import composes

    assert {(r["source"].split(":")[-2], r["target"].split(":")[-2]) for r in composes(classes).collect()} == {("A", "B"), ("Foo", "Bar")}
    assert {(r["machine"], r["state"]) for r in extract.state_machines(t).collect()} == {("OrderState", "Open"), ("OrderState", "Closed")}
    manifests = spark.createDataFrame([("x/Cargo.toml", (tmp_path / "src/Cargo.toml").read_text()), ("y/Dockerfile", (tmp_path / "src/Dockerfile").read_text()), ("package.json", '{"name":"root"}')], "path string, text string")
    assert {(r["name"], r["strategy"], r["confidence"]) for r in files.package_candidates(manifests).collect()} == {("thing", "cargo", 0.85), ("Image", "dockerfile", 0.6), ("root", "npm-single", 0.7)}
    assert {(r["name"], r["kind"]) for r in files.dependencies(manifests).collect()} == {("serde", "dependencies"), ("proptest", "dev-dependencies")}


def test_stream_equals_batch(spark, tmp_path):
    log, target, mark = (str(tmp_path / x) for x in ("log", "out", "mark"))
    events = spark.createDataFrame([(i, "s", t, "{}", i) for i, t in enumerate(["a.up", "b.down", "c.up", "x"])], "ts long, source string, event_type string, payload string, seq long")
    subs = spark.createDataFrame([(0, "up", ["*.up"]), (1, "x", ["x"])], "nth int, agent string, patterns array<string>")
    files.append_log(events.filter("seq < 2"), log)
    dispatch(spark, log, subs, target, mark).awaitTermination(120)
    files.append_log(events.filter("seq >= 2"), log)
    dispatch(spark, log, subs, target, mark).awaitTermination(120)
    got = {(r["seq"], r["agent"]) for r in spark.read.parquet(target).collect()}
    assert got == {(r["seq"], r["agent"]) for r in fan_out(events, subs).collect()} == {(0, "up"), (2, "up"), (3, "x")}
    assert files.event_log(spark, log).count() == 4


def test_facts_in_both_shapes(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"facts": [{"kind": "k", "claim": "c"}]}')
    (tmp_path / "b.json").write_text('[{"kind": "l", "claim": "d", "semantic": true}]')
    assert files.facts(spark, str(tmp_path / "a.json")).first()["claim"] == "c"
    assert files.facts(spark, str(tmp_path / "b.json")).first()["semantic"] is True


def test_nothing_else_imports_the_corpus_operators():
    root = Path(__file__).resolve().parents[1] / "evigraph"
    for path in root.rglob("*.py"):
        if "llm" in path.relative_to(root).parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any("llm" in n.split(".") for n in names)


def test_unconnected_patterns_need_an_id(spark):
    nodes = spark.createDataFrame([("a", "x"), ("b", "y")], "id string, current_name string")
    links = spark.createDataFrame([("a", "b", True), ("b", "a", False)], "src string, dst string, active boolean")
    g = cypher.Graph({"Element": nodes}, {"SEMANTIC_EDGE": links})
    with pytest.raises(cypher.CypherError, match="nothing connects"):
        cypher.query(g, "MATCH (a:Element), (b:Element) RETURN a.id, b.id")
    assert cypher.query(g, "MATCH (a:Element {id: 'a'}), (b:Element) RETURN a.id AS a, b.id AS b").count() == 2
    text = "MATCH (s:Element {id: 'b'})-[path:SEMANTIC_EDGE* SHORTEST 1..12]->(t:Element {id: 'a'}) %s RETURN path"
    assert cypher.query(g, text % "").first()["path"] == ["b", "a"]
    assert cypher.query(g, text % "WHERE ALL(edge IN path WHERE edge.active = true)").count() == 0
