import pytest
from pyspark.sql import functions as F

from evigraph.operators import policy, upsert

MEMBERS = "id string, diagram_id string, element_id string, label string, x long, y long, collapsed boolean"


@pytest.fixture
def view(spark):
    m = spark.createDataFrame([("m1", "d", "e1", "one", 0, 0, False), ("m2", "d", "e2", "two", 1, 1, True)], MEMBERS)
    return m, spark.createDataFrame([("g1", "g", False)], "id string, label string, collapsed boolean")


def test_merge_is_idempotent(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "id string, n int, s string")
    new = spark.createDataFrame([("b", 3), ("c", 4)], "id string, n int")
    once = upsert.merge_nodes(old, new)
    assert sorted(map(tuple, once.collect())) == [("a", 1, "x"), ("b", 3, "y"), ("c", 4, None)]
    assert sorted(map(tuple, upsert.merge_nodes(once, new).collect())) == sorted(map(tuple, once.collect()))
    kept = upsert.merge_nodes(old, new.withColumn("s", F.lit("new")), keep_old=("s",))
    assert {tuple(r) for r in kept.collect()} == {("a", 1, "x"), ("b", 3, "y"), ("c", 4, "new")}


def test_changeset_applies_all_or_nothing(view):
    members, groups = view
    base = upsert.revision(members, groups)
    cs = {"baseRevision": base, "commands": [{"type": "move-member", "memberId": "m2", "x": 7, "y": 8}, {"type": "set-label", "memberId": "m1", "label": "new"}, {"type": "collapse-group", "groupId": "g1"}]}
    m, g, now = upsert.apply_changeset(members, groups, cs)
    assert {tuple(r) for r in m.collect()} == {("m1", "d", "e1", "new", 0, 0, False), ("m2", "d", "e2", "two", 7, 8, True)}
    assert g.first()["collapsed"] and now != base
    with pytest.raises(upsert.StaleRevision):
        upsert.apply_changeset(m, g, cs)
    with pytest.raises(upsert.Rejected):
        upsert.apply_changeset(members, groups, {"baseRevision": base, "commands": [{"type": "set-label", "memberId": "none", "label": "x"}]})
    assert upsert.apply_changeset(members, groups, {"baseRevision": base})[2] == base


def test_revision_ignores_row_order(view):
    members, groups = view
    assert upsert.revision(members, groups) == upsert.revision(members.orderBy(F.desc("id")), groups)
    assert upsert.revision(members, groups) != upsert.revision(members, groups, compat=True)


def test_status_changes(spark):
    e = spark.createDataFrame([("1", '{"status":"drafted","a":"b"}'), ("2", '{"status":"superseded"}'), ("3", "{}"), ("4", None)], "id string, props string")
    r = spark.createDataFrame([("1", "accept"), ("2", "accept"), ("3", "supersede"), ("9", "accept"), ("4", "erase")], "id string, action string")
    after, bad = upsert.change_evidence_status(e, r)
    got = {x["id"]: x["props"] for x in after.collect()}
    assert '"status":"accepted"' in got["1"] and '"a":"b"' in got["1"] and '"superseded"' in got["3"] and got["4"] is None
    assert {(x["id"], x["why"].split()[0]) for x in bad.collect()} == {("2", "superseded"), ("9", "not"), ("4", "unknown")}


def test_policy_edges(spark):
    p = spark.createDataFrame(
        [("a", "run_tests", "Development", "Low", None, 1), ("b", "run_tests", "Development", "Low", 0.6, 1), ("c", "deploy_production", "Production", "Low", 0.1, 1), ("d", "deploy_production", "Production", "Low", 0.9, None), ("e", "other", "Staging", "Critical", 0.9, 1), ("f", "other", "Staging", "Low", 0.9, 1)],
        "id string, command string, environment string, security_impact string, confidence double, tokens long",
    )
    got = {r["id"]: r["decision"] + ":" + (r["level"] or "") for r in policy.evaluate(p, policy.load_rules(spark)).collect()}
    assert got == {"a": "RequireApproval:PeerApproval", "b": "Allow:", "c": "RequireApproval:PeerApproval", "d": "Deny:", "e": "RequireApproval:SecurityApproval", "f": "RequireApproval:PeerApproval"}
    with pytest.raises(ValueError, match="unknown environment"):
        policy.load_rules(spark, '[[policy]]\nname = "x"\nenvironment = "Prod"\ndecision = "Allow"')
    strict = policy.load_rules(spark, '[[policy]]\nname = "dear"\ncost_above_tokens = 10\ndecision = "Deny"')
    assert [r["decision"] for r in policy.evaluate(p.limit(2).withColumn("tokens", F.lit(10)), strict).collect()] == ["RequireApproval"] * 2


def test_status_keeps_all_other_members(spark):
    rows = [("a", '{"n":1,"o":{"x":[1,2]},"b":true,"status":"drafted"}'), ("b", None), ("c", "no json"), ("d", '{"status":"superseded"}'), ("e", '["x"]')]
    e = spark.createDataFrame(rows, "id string, props string")
    asked = spark.createDataFrame([(i, "accept") for i in "abcdez"], "id string, action string")
    after, bad = upsert.change_evidence_status(e, asked)
    got = {r["id"]: r["props"] for r in after.collect()}
    assert got["a"] == '{"n":1,"o":{"x":[1,2]},"b":true,"status":"accepted"}' and got["b"] == '{"status":"accepted"}'
    assert (got["c"], got["d"], got["e"]) == ("no json", '{"status":"superseded"}', '["x"]')
    assert {r["id"]: r["why"] for r in bad.collect()} == {"c": "props are no JSON object", "e": "props are no JSON object", "d": "superseded evidence can't be accepted", "z": "not found"}
    made, links = upsert.evaluations(e, asked)
    assert [r["target_evidence_id"] for r in made.collect()] == ["a"] and [r["dst"] for r in links.collect()] == ["a"]


def test_merge_asks_for_an_order_of_repeated_keys(spark):
    old = spark.createDataFrame([("a", 1)], "id string, n int")
    new = spark.createDataFrame([("b", 2, 1), ("b", 3, 2), ("c", 5, 1), ("c", 5, 1)], "id string, n int, at int")
    assert sorted(map(tuple, upsert.merge_nodes(old, new, order="at").collect())) == [("a", 1), ("b", 3), ("c", 5)]
    with pytest.raises(Exception, match="repeated key needs an order: b"):
        upsert.merge_nodes(old, new.drop("at")).collect()
    assert upsert.merge_nodes(old, new.filter("id = 'c'").drop("at")).count() == 2


def test_links_creates_and_counts(spark):
    nodes, none = spark.createDataFrame([("m",), ("e",)], "id string"), spark.createDataFrame([], "src string, dst string")
    wanted = spark.createDataFrame([("m", "e"), ("m", "e"), ("m", "gone")], "src string, dst string")
    assert upsert.link(none, wanted, nodes, nodes).count() == 1
    with pytest.raises(upsert.NotFound, match="gone"):
        upsert.link(none, wanted, nodes, nodes, required=True)
    assert upsert.create_edges(none, wanted, nodes).count() == 2
    assert upsert.set_where_counted(nodes, F.col("id") == "m", {"id": F.lit("x")})[1] == 1


def test_member_labels_and_puts(spark, view):
    members, _ = view
    assert {r["label"] for r in upsert.update_member_label(members, "m1", "new").collect()} == {"new", "two"}
    with pytest.raises(upsert.NotFound):
        upsert.update_member_label(members, "none", "x")
    old = spark.createDataFrame([("d", "2020-01-01 00:00:00", None)], "id string, created_at string, updated_at string").withColumn("created_at", F.col("created_at").cast("timestamp")).withColumn("updated_at", F.col("updated_at").cast("timestamp"))
    now = F.lit("2025-01-01 00:00:00").cast("timestamp")
    got = {r["id"]: r for r in upsert.put_timed(old, spark.createDataFrame([("d",), ("f",)], "id string"), now).collect()}
    assert got["d"]["created_at"].year == 2020 and got["d"]["updated_at"].year == got["f"]["created_at"].year == 2025


def test_diagrams_and_documented_queries(spark):
    from evigraph.operators import select

    d = spark.createDataFrame([("d1",)], "id string")
    assert select.get_diagram(d, "d1").count() == 1
    with pytest.raises(select.NotFound):
        select.get_diagram(d, "none")
    e = spark.createDataFrame([("s", "k", "2"), ("i1", "k", "2"), ("i2", "k", "1"), ("i3", "other", "0")], "id string, kind_id string, current_order_key string")
    r = spark.createDataFrame([("s", "i1", "behavior.has_interaction", True), ("s", "i2", "behavior.has_interaction", True), ("s", "i3", "behavior.has_interaction", False)], "source_id string, target_id string, predicate_id string, active boolean")
    assert [x["id"] for x in select.ordered_interactions(r, e, "s").collect()] == ["i2", "i1"]
    pair = lambda a, b: spark.createDataFrame([(a, b)], "src string, dst string")
    ev = spark.createDataFrame([("e1", 0.1)], "id string, confidence double")
    assert select.evidence_of_relation("r", pair("r", "v"), pair("v", "e1"), ev).count() == 1
