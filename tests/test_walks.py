"""Walks over stored adjacency: the same rows as over plain edges, and what their plans read."""

import random
from collections import defaultdict

import pytest
from conftest import DATA
from evigraph.operators import adjacency, traverse
from evigraph.plans import cypher
from evigraph.registry import QUERIES
from evigraph.scratch import shared_folder
from evigraph.sources import star, stored
from pyspark.sql import functions as F


def graph(n, m, seed):
    rng = random.Random(seed)
    return sorted({(f"v{rng.randrange(n):03d}", f"v{rng.randrange(n):03d}") for _ in range(m)})


def frame(spark, pairs):
    return spark.createDataFrame(pairs, "src string, dst string")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(params=["pruned", "broadcast", "buckets", "hot"])
def stores(request, monkeypatch):
    """Every way in which a frontier meets stored edges."""
    if request.param != "pruned":
        monkeypatch.setattr(adjacency, "PRUNED", 0)
    if request.param in ("buckets", "hot"):
        monkeypatch.setattr(adjacency, "SMALL", 0)
    return lambda edges: adjacency.store(edges, rows_a_bucket=7 if request.param == "hot" else 1000, least_buckets=3)


def test_walks_over_stored_edges(spark, stores):
    pairs = graph(40, 70, 3) + [("v001", f"v{k:03d}") for k in range(20, 40)] + [("v005", "v001")]
    plain, e = frame(spark, pairs), stores(frame(spark, pairs + pairs[:5] + [("v001", None), (None, "v002")]))
    assert e.rows == len(set(pairs)) and rows(e.table.select("src", "dst")) == sorted(set(pairs))
    seeds = spark.createDataFrame([("v001",), ("v002",)], "id string")
    for way in ("out", "in", "both"):
        assert rows(traverse.levels(e, seeds, 3, way)) == rows(traverse.levels(plain, seeds, 3, way))
    assert rows(traverse.impact(e, "v001", 3)) == rows(traverse.impact(plain, "v001", 3))
    walk = traverse.levels(e, seeds, 2)
    assert rows(traverse.level_edges(e, walk)) == rows(traverse.level_edges(plain, walk))
    assert rows(traverse.sequence(e, "v001", 3)) == rows(traverse.sequence(plain, "v001", 3))
    even = e.filter(F.col("src") != "v005")
    assert rows(traverse.levels(even, seeds, 2, "in")) == rows(traverse.levels(plain.filter("src <> 'v005'"), seeds, 2, "in"))
    e.drop()


def least_paths(pairs, start, most):
    """Level by level, of each new node the least path."""
    after, found, level = defaultdict(set), {start: (0, start)}, {start: start}
    for a, b in pairs:
        after[a].add(b)
    for k in range(1, most + 1):
        step = {}
        for a, path in level.items():
            for b in after[a]:
                if b not in found and (b not in step or f"{path}>{b}" < step[b]):
                    step[b] = f"{path}>{b}"
        found |= {b: (k, p) for b, p in step.items()}
        level = step
    return found


@pytest.mark.parametrize("seed", [1, 2])
def test_shortest_path_from_both_ends(spark, seed):
    pairs = graph(30, 45, seed)
    plain, e = frame(spark, pairs), adjacency.store(frame(spark, pairs))
    want = least_paths(pairs, "v003", 12)
    for k, end in enumerate(["v003", *sorted(want)[:4], "v029", "nowhere"]):
        found = [(r["depth"], r["path"]) for r in traverse.shortest_path(e if k % 2 else plain, "v003", end, 12).collect()]
        assert found == ([want[end]] if end in want else []), end
    for end in [end for end, (k, _) in want.items() if k >= 3][:2]:
        assert traverse.shortest_path(e, "v003", end, 2).count() == 0
    e.drop()


def test_shortest_path_reads_the_smaller_side(spark, monkeypatch):
    """A fan-out of 400 nodes at the start, a chain at the end: the search comes along the chain."""
    pairs = [("s", f"f{i:03d}") for i in range(400)] + [(f"f{i:03d}", f"g{i:03d}{k}") for i in range(400) for k in range(5)] + [("f007", "c0"), *[(f"c{i}", f"c{i + 1}") for i in range(6)]]
    met = []
    real = traverse.touching
    monkeypatch.setattr(traverse, "touching", lambda edges, frontier, n, way: met.append((way, n)) or real(edges, frontier, n, way))
    got = traverse.shortest_path(frame(spark, pairs), "s", "c6").collect()
    assert [(r["depth"], r["path"]) for r in got] == [(8, "s>f007>c0>c1>c2>c3>c4>c5>c6")]
    assert met.count(("out", 1)) == 1 and max(n for _, n in met) == 1


def test_levels_read_the_stored_edges_only(spark):
    """No step scans or shuffles lineitem; small frontiers prune buckets, large ones are joined bucket to bucket."""
    e = stored.calls(spark, DATA)
    assert stored.calls(spark, DATA) is e
    one = spark.createDataFrame([("part:10",)], "id string")
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")  # else plans don't tell which buckets are read
    try:
        small = plan(e.at("src", one, 1))
    finally:
        spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
    assert "SelectedBucketsCount: 1 out of 8" in small and "Exchange" not in small and "lineitem" not in small
    middle = plan(e.at("src", one, adjacency.PRUNED + 1))
    assert "BroadcastHashJoin" in middle and "lineitem" not in middle
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        large = plan(e.at("dst", one, adjacency.SMALL + 1))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "lineitem" not in large and "SortMergeJoin" in large
    table = large[large.index("SortMergeJoin") :]
    edges_side = table[: table.index("FileScan")]
    assert "Exchange" not in edges_side and "Bucketed: true" in large
    for df in (traverse.levels(e, one, 2, "both"), traverse.impact(e, "part:10", 2)):
        assert "lineitem" not in plan(df)


def folders(spark):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    return {s.getPath().getName() for s in path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)}


def test_walks_delete_what_they_wrote(spark):
    e = stored.calls(spark, DATA)
    one = spark.createDataFrame([("part:10",)], "id string")
    before = folders(spark)
    for make in (lambda: traverse.levels(e, one, 3), lambda: traverse.impact(e, "part:10", 2), lambda: traverse.sequence(e, "part:10", 3), lambda: traverse.shortest_path(e, "part:10", "part:62")):
        make().collect()
        after = folders(spark)
        assert len(after - before) == 1  # the result
        before = after
    graph = cypher.Graph({"Element": stored.nodes(spark, DATA)}, {"SEMANTIC_EDGE": stored.edges(spark, DATA)})
    before = folders(spark)
    cypher.query(graph, "MATCH (a:Element {id: 'region:1'})-[*1..2]-(b:Element) RETURN DISTINCT b.id AS id").collect()
    assert len(folders(spark) - before) == 1


def test_stored_tables_follow_their_source(spark, tmp_path):
    star.table(spark, DATA, "lineitem").limit(50).write.parquet(f"{tmp_path}/lineitem.parquet")
    first = stored.calls(spark, str(tmp_path))
    places = first.places
    star.table(spark, DATA, "lineitem").limit(90).write.mode("overwrite").parquet(f"{tmp_path}/lineitem.parquet")
    second = stored.calls(spark, str(tmp_path))
    assert second is not first and second.rows >= first.rows
    assert not {p.rsplit("/", 1)[1] for p in places} & folders(spark)
    assert rows(second.table.select("src", "dst")) == rows(star.calls(spark, str(tmp_path)))


def test_one_walk_stores_no_edges(spark):
    """Edges stored both ways took 12 times the input's disk; what a walk leaves now is its own levels (F2, F7)."""
    stored.forget(spark)
    before = folders(spark)
    for name in ("g_neighbours", "g_cypher_walk"):
        QUERIES[name](spark, DATA).collect()
    assert not [f for f in folders(spark) - before if "by-src" in f or "by-dst" in f or "nodes" in f]
    ends = {"source_id": "src", "target_id": "dst"}
    assert rows(star.links(spark, DATA).distinct()) == rows(star.edges(spark, DATA).withColumnsRenamed(ends).select("src", "dst"))
