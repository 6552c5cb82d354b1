"""The approval queue as a stream with state: one proposal a key.

An event enqueues, approves or rejects a proposal.  A proposal waits since its first enqueue after its last decision, by
sequence, however late the events come; an enqueue lapses ``lifetime`` after it was made, and a later one, which found the
proposal queued, then stands for it.

State holds, for each proposal, the sequence of its last decision and the enqueues after it that have not lapsed.  Of those
that the watermark has passed only the first is kept, as no decision can come between them any more; so the state of a
key is bounded by what it received within ``delay``.  Events later than ``delay`` are dropped.

Every micro-batch appends what changed under its own number; one that is run again after a failure replaces what it wrote.
The table is, of every proposal, its last change.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = "seq long, proposal_id long, action string, at timestamp"
CHANGE = "proposal_id long, status string, seq long, decided long"
_STATE = "decided long, seqs array<long>, times array<long>"
DECISIONS = {"approve": "approved", "reject": "rejected"}


def _kept(waiting: dict[int, int], decided: int, watermark: int, lifetime: int | None) -> dict[int, int]:
    """Enqueues (sequence -> time in ms) that may still stand for the proposal."""
    out, passed = {}, False
    for seq in sorted(waiting):
        at = waiting[seq]
        if seq <= decided or lifetime is not None and at + lifetime <= watermark:
            continue
        if at <= watermark and lifetime is None:
            if passed:
                continue
            passed = True
        out[seq] = at
    return out


def _track(lifetime: int | None):
    """The function of one key: its rows and state to its change."""

    def track(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        decided, waiting, status = -1, {}, "decided"
        before = None
        if state.exists:
            decided, seqs, times = state.get
            waiting = dict(zip(seqs, times, strict=True))
            before = min(waiting, default=None), decided
        for f in frames:
            made = f[f["action"] == "enqueue"]
            waiting |= dict(zip(made["seq"].tolist(), made["ms"].tolist(), strict=True))
            done = f[f["action"].isin(list(DECISIONS))]
            if len(done) and int(done["seq"].max()) > decided:
                decided = int(done["seq"].max())
                status = DECISIONS[done.loc[done["seq"].idxmax(), "action"]]
        if state.hasTimedOut:
            status = "lapsed"
        watermark = state.getCurrentWatermarkMs()
        waiting = _kept(waiting, decided, watermark, lifetime)
        state.update((decided, list(waiting), list(waiting.values())))
        if lifetime is not None and waiting:
            state.setTimeoutTimestamp(max(min(waiting.values()) + lifetime, watermark + 1))
        first = min(waiting, default=None)
        if before != (first, decided):
            yield pd.DataFrame({"proposal_id": [key[0]], "status": ["waiting" if waiting else status], "seq": pd.array([first], dtype="Int64"), "decided": pd.array([decided], dtype="Int64")})

    return track


def approvals(events: DataFrame, *, delay: str = "1 day", lifetime_ms: int | None = None) -> DataFrame:
    """Changes (proposal_id, status, seq, decided) of a stream of events (seq, proposal_id, action, at)."""
    e = events.filter(F.col("action").isin("enqueue", *DECISIONS)).withColumn("ms", F.unix_millis("at")).withWatermark("at", delay)
    timeout = GroupStateTimeout.EventTimeTimeout
    return e.groupBy("proposal_id").applyInPandasWithState(_track(lifetime_ms), CHANGE, _STATE, "update", timeout)


def run(events: DataFrame, target: str, checkpoint: str, **options) -> StreamingQuery:
    """Keeps the queue's changes under ``target`` up to date, going on from the checkpoint."""

    def batch(changes: DataFrame, number: int) -> None:
        changes.write.mode("overwrite").parquet(f"{target}/batch={number}")

    stream = approvals(events, **options).writeStream.outputMode("update").foreachBatch(batch)
    return stream.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def queue(spark: SparkSession, target: str) -> DataFrame:
    """Every proposal's last change: (proposal_id, status, seq, decided)."""
    kept = spark.read.schema(CHANGE + ", batch int").parquet(target)
    last = kept.groupBy("proposal_id").agg(F.max_by(F.struct("status", "seq", "decided"), "batch").alias("last"))
    return last.select("proposal_id", "last.*")


def waiting(spark: SparkSession, target: str) -> DataFrame:
    """(proposal_id, seq) of proposals that wait."""
    return queue(spark, target).filter("status = 'waiting'").select("proposal_id", "seq")
