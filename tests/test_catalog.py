import re

import pytest
from pyspark.sql import functions as F

from evigraph.catalog import Catalog, Conflict, metamodel
from evigraph.functions.scalars import project_id
from evigraph.operators.ingest import scope_violations
from evigraph.sources.files import scope_manifests


def test_publication_and_migrations(spark, tmp_path):
    c = Catalog(spark, f"file://{tmp_path}/graph")
    assert c.table("Snapshot").count() == 0
    one = spark.createDataFrame([("s1", 1)], "id string, sequence long")
    full = c.table("Snapshot").unionByName(one, allowMissingColumns=True)
    assert c.publish({"Snapshot": full}, 0) == 1
    with pytest.raises(Conflict):
        c.publish({"Snapshot": full}, 0)
    state = c.current()
    steps = {10: lambda k: {"Snapshot": k.table("Snapshot").withColumn("kind", F.lit("ten"))}, 2: lambda k: {"Snapshot": k.table("Snapshot").withColumn("kind", F.lit("two"))}}
    assert c.migrate(steps) == [2, 10] and c.migrate(steps) == []
    assert c.table("Snapshot").first()["kind"] == "ten"
    assert c.table("Snapshot", state).first()["kind"] is None  # a reader keeps the state it resolved


def test_project_id_is_shaped_like_a_uuid(spark):
    got = spark.range(2).select(project_id(F.concat(F.lit("repo"), F.col("id").cast("string"))).alias("u")).collect()
    assert all(re.fullmatch(r"[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}", r["u"]) for r in got) and got[0] != got[1]


def test_scope_gates(spark):
    m = scope_manifests(spark, [("scope.toml", 'name = "s"\nfiles = ["a.rs", "gone.rs"]\nsymbols = ["go", "hidden"]\nmust_hold = ["fn go", "absent"]\nmust_not_contain = ["unwrap", "panic"]\ntests = 3\n')])
    f = spark.createDataFrame([("a.rs", "pub fn go() { x.unwrap() }\nfn hidden() {}\n#[cfg(test)]\nmod tests {\n    #[test]\n    fn t() { panic!() }\n}\n")], "path string, text string")
    got = {(r["kind"], r["value"]) for r in scope_violations(m, f).collect()}
    assert got == {("files", "gone.rs"), ("symbols", "hidden"), ("must_hold", "absent"), ("must_not_contain", "unwrap"), ("tests", "3")}


def test_metamodel(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"metatypes": [{"id": "mt.a", "name": "A"}], "predicates": [{"id": "p.b", "directed": true}]}')
    types, predicates = metamodel(spark, str(tmp_path / "m.json"))
    assert types.first()["name"] == "A" and predicates.first()["directed"] is True
