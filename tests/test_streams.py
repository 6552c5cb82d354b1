"""Streams with state: the approval queue and the lineage closure equal their batch forms, whatever happens on the way."""

import random
from datetime import datetime, timedelta

import pytest
from evigraph.operators import analytics, policy
from evigraph.streaming import approvals, lineage
from pyspark.sql import functions as F

NOON = datetime(2024, 1, 1, 12)


def log(spark, rows, folder, mode="append"):
    """Events (seq, proposal, action, minutes after noon) as a file of the log."""
    df = spark.createDataFrame([(s, p, a, NOON + timedelta(minutes=m)) for s, p, a, m in rows], approvals.EVENTS)
    df.coalesce(1).write.mode(mode).parquet(folder)


def stream(spark, folder):
    return spark.readStream.schema(approvals.EVENTS).option("maxFilesPerTrigger", 1).parquet(folder)


def waiting_by_batch(spark, folder, **options):
    return sorted(tuple(r) for r in policy.approval_queue(spark.read.schema(approvals.EVENTS).parquet(folder), **options).select("proposal_id", "seq").collect())


def test_queue_equals_the_batch_after_restarts_and_late_rows(spark, tmp_path):
    rng = random.Random(2)
    rows = [(s, rng.randrange(9), rng.choice(["enqueue", "enqueue", "approve", "reject", "note"]), s) for s in range(160)]
    rng.shuffle(rows)  # events come in any order
    target, checkpoint = f"{tmp_path}/table", f"{tmp_path}/checkpoint"
    for k in range(4):  # a new query each time, from the checkpoint
        for part in (rows[40 * k : 40 * k + 25], rows[40 * k + 25 : 40 * k + 40]):
            log(spark, part, f"{tmp_path}/log")
        approvals.run(stream(spark, f"{tmp_path}/log"), target, checkpoint).awaitTermination()
        got = sorted(tuple(r) for r in approvals.waiting(spark, target).collect())
        assert got == waiting_by_batch(spark, f"{tmp_path}/log")
    assert {r["status"] for r in approvals.queue(spark, target).collect()} <= {"waiting", "approved", "rejected"}


def test_lapsed_enqueues_and_rows_after_the_delay(spark, tmp_path):
    target, checkpoint, folder = f"{tmp_path}/table", f"{tmp_path}/checkpoint", f"{tmp_path}/log"

    def then(*rows):
        log(spark, rows, folder)
        approvals.run(stream(spark, folder), target, checkpoint, delay="10 minutes", lifetime_ms=60 * 60_000).awaitTermination()
        return {r["proposal_id"]: (r["status"], r["seq"]) for r in approvals.queue(spark, target).collect()}

    assert then((1, 1, "enqueue", 0), (2, 2, "enqueue", 0), (3, 2, "enqueue", 50)) == {1: ("waiting", 1), 2: ("waiting", 2)}
    then((4, 3, "enqueue", 90))
    after = then((5, 3, "approve", 91))  # the watermark is at 80 by now: what was made at 0 has lapsed
    assert after == {1: ("lapsed", None), 2: ("waiting", 3), 3: ("approved", None)}
    assert then((6, 2, "reject", 5))[2] == ("waiting", 3)  # it comes after the delay


def test_state_of_a_key_is_bounded():
    passed = {s: s for s in range(100)}
    assert approvals._kept(passed, 10, 50, None) == {s: s for s in [11, *range(51, 100)]}
    assert list(approvals._kept(passed, 10, 50, 20)) == list(range(31, 100))


def test_expiry_in_the_batch_form(spark, tmp_path):
    log(spark, [(1, 1, "enqueue", 0), (2, 2, "enqueue", 0), (3, 2, "enqueue", 50), (4, 3, "enqueue", 90)], f"{tmp_path}/log")
    now = F.lit(NOON + timedelta(minutes=80))
    assert waiting_by_batch(spark, f"{tmp_path}/log", lifetime="60 minutes", now=now) == [(2, 3), (3, 4)]


# lineage --------------------------------------------------------------------------------------------------------
def changes(rng, n, first):
    out = []
    for k in range(n):
        relation = rng.choice(list(lineage.KEYED))
        src, dst = {"extracted_from": ("e", "s"), "supported_by": ("v", "e"), "has_version": ("v", "x")}[relation]
        out.append((first + k, relation, rng.choice(["insert", "insert", "delete"]), f"{src}{rng.randrange(8)}", f"{dst}{rng.randrange(6)}"))
    return out


def by_batch(spark, rows, sources):
    """The batch operator over the facts that all changes leave."""
    facts = {}
    for _, relation, op, src, dst in rows:
        facts[relation, src, dst] = op == "insert"
    frame = lambda r, a, b: spark.createDataFrame([(s, d) for (x, s, d), there in facts.items() if x == r and there], f"{a} string, {b} string")
    versions = frame("has_version", "id", "element_id")
    changed = spark.createDataFrame([(s,) for s in sources], "id string")
    got = analytics.invalidated(changed, frame("extracted_from", "src", "dst"), frame("supported_by", "src", "dst"), versions)
    return sorted(repr(tuple(r)) for r in got.collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_closure_equals_the_batch_after_any_batches(spark, tmp_path, seed):
    rng = random.Random(seed)
    seen, folder, sources = [], f"{tmp_path}/lineage", ["s0", "s3", "s4"]
    for n in (12, 1, 9, 5):
        seen += (batch := changes(rng, n, len(seen)))
        df = spark.createDataFrame(batch, lineage.CHANGES)
        for _ in range(rng.choice([1, 2])):  # a batch may be run again
            lineage.apply(spark, df, folder, buckets=5)
        got = lineage.invalidated(spark, folder, spark.createDataFrame([(s,) for s in sources], "id string"))
        assert sorted(repr(tuple(r)) for r in got.collect()) == by_batch(spark, seen, sources)


def files(folder):
    return {p.parent.name: p.name for p in sorted(folder.glob("closure/bucket=*/*.parquet"))}


def test_only_touched_keys_are_written(spark, tmp_path):
    facts = [(k, "extracted_from", "insert", f"e{k}", "s") for k in range(40)] + [(100 + k, "supported_by", "insert", f"v{k}", f"e{k}") for k in range(40)]
    folder = tmp_path / "lineage"
    lineage.apply(spark, spark.createDataFrame(facts, lineage.CHANGES), str(folder), buckets=16)
    before = files(folder)
    assert len(before) > 10
    lineage.apply(spark, spark.createDataFrame([(200, "has_version", "insert", "v7", "x"), (201, "extracted_from", "delete", "e9", "s")], lineage.CHANGES), str(folder), buckets=16)
    after = files(folder)
    assert 1 <= sum(before[b] != after[b] for b in before) <= 2
    got = {r["evidence"]: r["element"] for r in lineage.invalidated(spark, str(folder), spark.createDataFrame([("s",)], "id string")).collect()}
    assert got == {f"e{k}": "x" if k == 7 else None for k in range(40) if k != 9}


def test_stream_of_changes_goes_on_from_its_checkpoint(spark, tmp_path):
    rng, seen = random.Random(5), []
    for k in range(3):
        seen += (batch := changes(rng, 8, len(seen)))
        spark.createDataFrame(batch, lineage.CHANGES).coalesce(1).write.mode("append").parquet(f"{tmp_path}/log")
        if k != 1:  # two files wait for the last run
            source = spark.readStream.schema(lineage.CHANGES).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/log")
            lineage.keep_up(source, f"{tmp_path}/lineage", f"{tmp_path}/checkpoint", buckets=4).awaitTermination()
    got = lineage.invalidated(spark, f"{tmp_path}/lineage", spark.createDataFrame([("s1",), ("s2",)], "id string"))
    assert sorted(repr(tuple(r)) for r in got.collect()) == by_batch(spark, seen, ["s1", "s2"])
