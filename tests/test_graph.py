"""Golden micro-graphs."""

import pytest
from evigraph.operators import analytics, ingest, select, traverse


def edges(spark, text):
    return spark.createDataFrame([tuple(p.split(">")) for p in text.split()], "src string, dst string")


def pairs(df):
    return {(r["src"], r["dst"]) for r in df.collect()}


def test_sequence_on_a_cycle_and_a_diamond(spark):
    two = traverse.sequence(edges(spark, "A>B B>A"), "A").orderBy("order_key").collect()
    assert [(r.sender, r.receiver, r.revisited) for r in two] == [("A", "B", False), ("B", "A", True)]
    diamond = traverse.sequence(edges(spark, "A>B A>C B>D C>D"), "A").orderBy("order_key").collect()
    assert [(r.sender, r.receiver, r.depth, r.revisited) for r in diamond] == [("A", "B", 1, False), ("A", "C", 1, False), ("B", "D", 2, False), ("C", "D", 2, True)]


def test_sequence_cap_and_depth(spark):
    assert traverse.sequence(edges(spark, "H>a H>b H>c H>d H>e"), "H", cap=3).count() == 3
    chain = edges(spark, " ".join(f"n{i}>n{i + 1}" for i in range(10)))
    assert traverse.sequence(chain, "n0", depth=3).count() == 3
    assert traverse.sequence(chain, "nowhere").count() == 0


def test_cycles_with_tail(spark):
    e = edges(spark, "a>b b>c c>a t>a c>z p>q q>p s>s")
    assert pairs(traverse.on_cycles(e)) == {("a", "b"), ("b", "c"), ("c", "a"), ("p", "q"), ("q", "p"), ("s", "s")}
    assert traverse.on_cycles(edges(spark, "a>b b>c")).count() == 0


def test_cycles_match_brute_force(spark):
    import random

    rng = random.Random(5)
    for n, m in ((12, 14), (20, 30)):
        pairs_ = {(f"v{rng.randrange(n):02d}", f"v{rng.randrange(n):02d}") for _ in range(m)}
        reach = {a: {b for x, b in pairs_ if x == a} for a, _ in pairs_}
        for _ in range(n):
            reach = {a: bs | {c for b in bs for c in reach.get(b, ())} for a, bs in reach.items()}
        want = {(a, b) for a, b in pairs_ if a in reach.get(b, ()) or a == b}
        assert pairs(traverse.on_cycles(spark.createDataFrame(sorted(pairs_), "src string, dst string"))) == want


def test_shortest_path_over_chosen_edges(spark):
    e = spark.createDataFrame([("a", "b", True), ("b", "d", False), ("a", "c", True), ("c", "e", True), ("e", "d", True)], "src string, dst string, active boolean")
    assert [r["path"] for r in traverse.shortest_path(e, "a", "d").collect()] == ["a>b>d"]
    assert [r["path"] for r in traverse.shortest_path(e.filter("active"), "a", "d").collect()] == ["a>c>e>d"]


def test_sequence_keeps_kind_file_and_line(spark):
    e = spark.createDataFrame([("A", "B", "async_call", "x.rs", 9), ("A", "B", "sync_call", "x.rs", 3), ("B", "A", None, "y.rs", 1)], "src string, dst string, message_kind string, file string, line long")
    got = traverse.sequence(e, "A").orderBy("order_key").collect()
    assert [(r["message_kind"], r["file"], r["line"], r["revisited"]) for r in got] == [("sync_call", "x.rs", 3, False), ("sync_call", "y.rs", 1, True)]
    assert [*traverse.sequence_flags(traverse.sequence(e, "A", cap=1), 1).first()] == [1, 2, 1, 0, True]
    assert traverse.sequence(e, "nowhere").columns == ["order_key", "sender", "receiver", "depth", "revisited", "message_kind", "file", "line"]


def test_long_layers_need_a_graph_without_cycles(spark):
    chain = edges(spark, " ".join(f"n{i:03d}>n{i + 1:03d}" for i in range(9)))
    nodes = spark.createDataFrame([(f"n{i:03d}",) for i in range(10)], "id string")
    assert traverse.layers(nodes, chain, patience=3).agg({"layer": "max"}).first()[0] == 9
    with pytest.raises(traverse.Cyclic):
        traverse.layers(nodes, chain.unionAll(edges(spark, "n005>n002")), patience=3)


def test_layers_take_the_longest_path_and_stop_on_cycles(spark):
    nodes = spark.createDataFrame([(x,) for x in "abcd"], "id string")
    got = {r["id"]: r["layer"] for r in traverse.layers(nodes, edges(spark, "a>b b>c c>d a>d")).collect()}
    assert got == {"a": 0, "b": 1, "c": 2, "d": 3}
    assert traverse.layers(nodes, edges(spark, "a>b b>a")).count() == 4


def test_impact_counts_each_direction_on_its_own(spark):
    got = {(r["id"], r["direction"], r["depth"], r["path"]) for r in traverse.impact(edges(spark, "x>f f>y y>x"), "f").collect()}
    assert got == {("x", "upstream", 1, "f>x"), ("y", "upstream", 2, "f>x>y"), ("y", "downstream", 1, "f>y"), ("x", "downstream", 2, "f>y>x")}


def test_parents_are_longest_prefixes_and_scope_is_a_prefix(spark):
    keys = ["ord", "orders", "orders/api", "orders/api/v1", "orders/x/y"]
    nodes = spark.createDataFrame([(k, k) for k in keys], "id string, canonical_key string")
    got = {r["id"]: r["parent_id"] for r in analytics.derive_parents(nodes).collect()}
    assert got == {"ord": None, "orders": None, "orders/api": "orders", "orders/api/v1": "orders/api", "orders/x/y": "orders"}
    e = nodes.selectExpr("id", "'k' kind_id", "'c' category", "canonical_key", "id current_name", "'' current_status", "0D current_confidence", "'' current_version_id")
    assert select.query_elements(e, "c", "ord").count() == 5
    assert select.query_elements(e, "c", "ord", exact=True).count() == 1


def test_calls_before_the_first_function_have_no_caller(spark):
    f = spark.createDataFrame([("go", "a", 5, "k5"), ("go", "a", 9, "k9")], "language string, file string, line long, canonical_key string")
    c = spark.createDataFrame([("go", "a", n, "x") for n in (1, 5, 7, 12)], "language string, file string, line long, callee string")
    assert {r["line"]: r["caller"] for r in ingest.attribute_calls(f, c).collect()} == {1: "<unknown>:0", 5: "k5", 7: "k5", 12: "k9"}


def test_strategy_merge_ties_and_order(spark):
    rows = [(2, "k", "n2", "npm", 0.8, "p.json"), (1, "k", "n1", "cargo", 0.8, "c.toml"), (3, "k", "n3", "helm", 0.7, "c.toml")]
    r = ingest.merge_candidates(spark.createDataFrame(rows, "nth int, canonical_key string, name string, strategy string, confidence double, file string")).first()
    assert (r["name"], r["strategy"], r["merged_from"], r["files"]) == ("n1", "cargo", "cargo,npm,helm", "c.toml,p.json")


def test_connascence_compares_spellings(spark):
    e = spark.createDataFrame([("1", "FooServiceManager"), ("2", "FooService"), ("3", "fooGateway"), ("4", "Bar")], "id string, current_name string")
    got = [tuple(r) for r in analytics.connascence(e).collect()]
    assert got == [("foo", "2", "3", 1 - 1 / 3)]


def test_drift_is_null_safe(spark):
    schema = "id string, label string, kind string, description string, technology string"
    a = spark.createDataFrame([("1", "x", "k", None, "t"), ("2", "x", "k", None, "t"), ("3", "x", "k", "d", "t")], schema)
    b = spark.createDataFrame([("1", "x", "k", None, "t"), ("2", "y", "k", None, "t"), ("4", "x", "k", "d", "t")], schema)
    assert {(r["id"], r["change"]) for r in analytics.drift_elements(a, b).collect()} == {("2", "changed"), ("3", "removed"), ("4", "added")}
