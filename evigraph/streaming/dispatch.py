"""Event dispatch and invalidation as streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.policy import fan_out
from ..sources.files import event_log


def dispatch(spark: SparkSession, log: str, subscriptions: DataFrame, target: str, checkpoint: str, answer: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Sends new events of a log to the agents that subscribe to them and appends what they answer to ``target``.

    The stream's checkpoint is the marker of what is done; each batch is written under its number, so a batch that is
    run again after a failure replaces what it wrote.  ``answer`` maps (seq, event_type, agent, nth) to rows with an
    answer; NoAction is dropped.
    """

    def batch(events: DataFrame, number: int) -> None:
        out = fan_out(events.select("seq", "event_type"), subscriptions)
        out = answer(out) if answer else out.withColumn("answer", F.lit("Notify"))
        out.filter("answer <> 'NoAction'").select("seq", "event_type", "agent", "nth", "answer").write.mode("overwrite").parquet(f"{target}/batch={number}")

    events = event_log(spark, log, stream=True)
    return events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def unprocessed(events: DataFrame, marker: int) -> DataFrame:
    """Events after a sequence marker."""
    return events.filter(F.col("seq") > marker)


def merge_deltas(*deltas: DataFrame) -> DataFrame:
    """Deltas (id, change) as a bag: repeats stay."""
    out = deltas[0]
    for d in deltas[1:]:
        out = out.unionByName(d)
    return out
