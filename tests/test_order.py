"""Chains, cycles, layers, places and levels against plain versions."""

import random

import pytest
from evigraph.operators import analytics, traverse
from evigraph.operators.adjacency import store
from evigraph.operators.chains import contract
from evigraph.operators.ranking import ranked, ranked_within
from pyspark.sql import functions as F


def frame(spark, pairs):
    return spark.createDataFrame(pairs, "src string, dst string")


def reach(pairs):
    after = {}
    for a, b in pairs:
        after.setdefault(a, set()).add(b)
    out = {}
    for a in after:
        seen, todo = set(), list(after[a])
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += after.get(x, ())
        out[a] = seen
    return out


def test_chains_become_edges(spark):
    pairs = [("a", "b"), ("b", "c"), ("c", "d"), ("d", "e"), ("d", "f"), ("x", "y"), ("y", "z"), ("z", "x"), ("f", "g"), ("g", "f2"), ("f", "f2")]
    e = frame(spark, pairs).select("src", "dst", F.concat("src", "dst").alias("eid"), F.lit(1).cast("long").alias("w"))
    short = contract(e, "0")
    assert {(r["src"], r["dst"], r["w"]) for r in short.edges.collect()} == {("a", "d", 3), ("d", "e", 1), ("d", "f", 1), ("f", "f2", 2), ("f", "f2", 1)}
    assert {r["eid"] for r in short.rings.collect()} == {"xy", "yz", "zx"}
    assert {(r["eid"], r["into"]) for r in short.members.collect()} == {("ab", "0:c"), ("bc", "0:c"), ("cd", "0:c"), ("fg", "0:g"), ("gf2", "0:g")}
    assert {(r["id"], r["tail"], r["hops"]) for r in short.inner.collect()} == {("b", "c", 2), ("c", "c", 1), ("g", "g", 1)}


@pytest.mark.parametrize("seed", range(4))
def test_cycles_of_random_graphs(spark, seed):
    rng = random.Random(seed)
    n = (15, 40, 60, 30)[seed]
    pairs = {(f"v{rng.randrange(n):02d}", f"v{rng.randrange(n):02d}") for _ in range(int(n * 1.2))}
    # chains between them, and some that end
    for k in range(6):
        way = [f"v{rng.randrange(n):02d}", *[f"c{k}{i}" for i in range(rng.randrange(1, 7))], *([f"v{rng.randrange(n):02d}"] if k % 3 else [])]
        pairs |= set(zip(way, way[1:], strict=False))
    near = reach(pairs)
    want = sorted(p for p in pairs if p[0] in near.get(p[1], ()) or p[0] == p[1])
    got = sorted(tuple(r) for r in traverse.on_cycles(frame(spark, sorted(pairs))).collect())
    assert got == want


def test_a_long_ring_takes_few_jobs(spark):
    n = 100_000
    e = spark.range(n).select(F.col("id").alias("src"), ((F.col("id") + 1) % n).alias("dst"))
    tail = spark.range(50_000).select((F.col("id") + n).alias("src"), (F.col("id") + n + 1).alias("dst"))
    spark.sparkContext.setJobGroup("ring", "cycles of a ring")
    got = traverse.on_cycles(e.unionAll(tail))
    assert got.count() == n
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("ring")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    # every stage of an adaptive plan is a job of its own; rounds are a tenth of that
    assert len(jobs) <= 160, len(jobs)


def longest(nodes, pairs):
    layer = dict.fromkeys(nodes, 0)
    for _ in nodes:
        for a, b in pairs:
            layer[b] = max(layer[b], layer[a] + 1)
    return layer


@pytest.mark.parametrize("seed", range(3))
def test_layers_of_random_graphs(spark, seed):
    rng = random.Random(seed)
    names = [f"n{i:02d}" for i in range(30)]
    pairs = {tuple(sorted(rng.sample(names, 2))) for _ in range(45)} | {(a, b) for a, b in zip(names[3:12], names[4:13], strict=True)}
    pairs |= {(f"c{i}", f"c{i + 1}") for i in range(6)} | {("n05", "c0"), ("c6", "n29")}
    nodes = sorted({*names, *[f"c{i}" for i in range(7)]})
    got = traverse.layers(spark.createDataFrame([(x,) for x in nodes], "id string"), frame(spark, sorted(pairs) + [("n01", "unknown")]))
    assert {r["id"]: r["layer"] for r in got.collect()} == longest(nodes, pairs)


def test_layers_meet_every_edge_once(spark, monkeypatch):
    """A ladder of 30 steps: with paths that may meet a node again, the last nodes would be met in every round."""
    pairs = [(f"n{i:02d}", f"n{j:02d}") for i in range(30) for j in (i + 1, i + 2)]
    met = []
    real = traverse.Adjacency.at

    def at(self, key, frontier, rows):
        out = real(self, key, frontier, rows)
        met.append(out.count())
        return out

    monkeypatch.setattr(traverse.Adjacency, "at", at)
    nodes = spark.createDataFrame([(f"n{i:02d}",) for i in range(32)], "id string")
    assert {r["id"]: r["layer"] for r in traverse.layers(nodes, frame(spark, pairs)).collect()} == longest([f"n{i:02d}" for i in range(32)], pairs)
    assert sum(met) <= len(pairs)


def test_a_cycle_has_no_layers(spark):
    nodes = spark.createDataFrame([(f"n{i}",) for i in range(9)], "id string")
    for pairs in ([("n0", "n1"), ("n1", "n2"), ("n2", "n0")], [("n0", "n1"), ("n1", "n2"), ("n2", "n1"), ("n2", "n3")]):
        with pytest.raises(traverse.Cyclic):
            traverse.layers(nodes, frame(spark, pairs), patience=5)
        assert {r["id"]: r["layer"] for r in traverse.layers(nodes, frame(spark, pairs), bound=2).collect()}["n2"] == 2


def test_places(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(4) if rng.random() < 0.2 else 9, rng.randrange(10**6)) for _ in range(2000)] + [(None, 5), (None, 4)]
    df = spark.createDataFrame(rows, "g int, x int").repartition(7)
    got = sorted((r["place"], r["g"], r["x"]) for r in ranked(df, ["x", "g"]).collect())
    assert [p for p, _, _ in got] == list(range(len(rows)))
    assert [(x, g is not None, g) for _, g, x in got] == sorted((x, g is not None, g) for g, x in rows)
    within = sorted((r["g"] is not None, r["g"] or 0, r["place"], r["x"]) for r in ranked_within(df, "g", ["x"]).collect())
    want = []
    for g in {g for g, _ in rows}:
        want += [(g is not None, g or 0, i, x) for i, x in enumerate(sorted(x for h, x in rows if h == g))]
    assert within == sorted(want)
    assert ranked(df.filter("false"), ["x"]).count() == 0


def test_layout_has_no_window_over_a_layer(spark):
    df = spark.createDataFrame([(f"n{i:03d}", 0 if i < 190 else 1) for i in range(200)], "id string, layer int")
    placed = traverse.layout(df)
    assert {r["id"]: (r["x"], r["y"]) for r in placed.collect()} == {f"n{i:03d}": (220 * (i if i < 190 else i - 190), 0 if i < 190 else 120) for i in range(200)}
    plan = placed._jdf.queryExecution().executedPlan().toString()
    assert "Window [row_number" not in plan and "layer#" not in "".join(x for x in plan.splitlines() if "Window" in x)


def test_levels_of_a_tree(spark):
    rng = random.Random(3)
    keys = {"r"}
    for _ in range(120):
        base = rng.choice(sorted(keys))
        if base.count("/") < 4:
            keys.add(f"{base}/{rng.choice('ab')}{rng.randrange(30)}")
    keys |= {"s", "s/a", "s/a/b-c", "s/a/b"}
    names = ["system", "container", "component", "class", "operation"]
    rows = [(k, names[k.count("/")], k) for k in sorted(keys)]
    nodes = spark.createDataFrame(rows, "id string, level string, canonical_key string")
    for width in (3, 1000):
        got = {(r["id"], r["level"]): r["container"] for r in analytics.containers(nodes, names, width).collect()}
        want = {(k, names[d]): "/".join(k.split("/")[: d + 1]) for k in keys for d in range(k.count("/") + 1) if "/".join(k.split("/")[: d + 1]) in keys}
        assert got == want
    at = {r["canonical_key"]: (r["pre"], r["post"]) for r in analytics.intervals(nodes).collect()}
    assert all((a == b or b.startswith(a + "/")) == (at[a][0] <= at[b][0] <= at[a][1]) for a in keys for b in keys)
    pairs = [tuple(rng.sample(sorted(keys), 2)) for _ in range(60)]
    want = {}
    for a, b in pairs:
        for d, level in enumerate(names):
            x, y = ("/".join(k.split("/")[: d + 1]) if k.count("/") >= d else None for k in (a, b))
            if x and y and x != y:
                want[level, x, y] = want.get((level, x, y), 0) + 1
    assert {tuple(r)[:3]: r["weight"] for r in analytics.multi_level(frame(spark, pairs), nodes, names).collect()} == want


def test_focus_many_equals_focus_of_each(spark):
    rng = random.Random(7)
    names = ["ab", "Order 3", "order 33", "é", "", "zzz9", "north sea port", "a", None, "sea\nport", "AB"]
    e = spark.createDataFrame([(f"e{i}", n, f"k/{i}") for i, n in enumerate(names)], "id string, current_name string, canonical_key string")
    texts = ["The North Sea Port takes order 33", "É b", "x" * 61 + "north sea port", "", None, "k/3 and K/10", "y" * 200 + "zzz9", "sea\nport"] + ["".join(rng.choice("abé 3order\n") for _ in range(150)) for _ in range(20)]
    g = spark.createDataFrame(list(enumerate(texts)), "goal_id int, text string")
    got = {(r["goal_id"], r["id"]) for r in analytics.focus_many(e, g).collect()}
    want = {(i, f"e{k}") for i, t in enumerate(texts) if t for k, n in enumerate(names) if (n and n.lower() in t.lower()) or f"k/{k}" in t.lower()}
    assert got == want
    assert {i for g_, i in got if g_ == 0} == {r["id"] for r in analytics.focus_elements(e, texts[0]).collect()}


def test_a_heavy_name_goes_to_many_tasks(spark):
    from evigraph.operators import ingest

    calls = spark.range(30_000).select(F.concat(F.lit("c"), F.col("id").cast("string")).alias("caller"), F.when(F.col("id") % 3 == 0, "init").otherwise(F.concat(F.lit("f"), (F.col("id") % 2000).cast("string"))).alias("callee"), F.col("id").alias("line"))
    functions = spark.range(2000).select(F.concat(F.lit("f"), F.col("id").cast("string")).alias("name"), F.col("id").cast("string").alias("canonical_key")).unionByName(spark.createDataFrame([("init", "k1"), ("init", "k2")], "name string, canonical_key string"))
    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "12"}
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        rows = ingest.resolve_callees(calls, functions)
        sizes = sorted(r["count"] for r in rows.groupBy(F.spark_partition_id().alias("p")).count().collect())
        assert sum(sizes) == 20_000 + 2 * 10_000 and sizes[-1] <= 2 * sizes[len(sizes) // 2]
        assert rows.filter("callee_key in ('k1', 'k2')").select("caller").distinct().count() == 10_000
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_lone_inner_nodes_are_no_chains(spark):
    """A few nodes with one edge in and one out made layers write all edges anew, and these were stored by both ends (F6)."""
    e = spark.createDataFrame([("a", "m"), ("m", "z"), ("a", "x"), ("a", "y"), ("x", "z"), ("y", "x"), ("y", "z")], "src string, dst string")
    assert contract(e.selectExpr("src", "dst", "src || dst as eid", "1L as w"), "0") is None
    nodes = spark.createDataFrame([(x,) for x in "amxyz"], "id string")
    assert dict(traverse.layers(nodes, e).collect()) == {"a": 0, "m": 1, "y": 1, "x": 2, "z": 3}
    graph = store(e, ways=["src"], distinct=7)
    assert graph.by_dst is None and graph.rows == 7 and sorted(map(tuple, graph.table.collect())) == sorted(map(tuple, e.collect()))
    graph.drop()
