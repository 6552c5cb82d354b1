"""Mixing sources to target weights by capped water-filling.

Every source has a weight and a cap (``max_epochs`` times its size).  The budget is poured over the sources in
proportion to their weights; sources that reach their cap are clamped there and what they leave is dealt again by
weight, until none is above.  The level at which this ends is found in closed form: sources ordered by cap over
weight are clamped one after another until the level that the rest would get no longer passes the next cap.

A source's target is met with whole repetitions of all its documents and one fractional repetition: documents in
the order of a seeded hash get one more copy until the words are used up; the document at the boundary gives only
its first words.

Defined results: a null text has size 0; a null source is a source of its own, ordered last; documents without
words take 0 words; repeated rows are separate documents (their order is that of their sizes); an empty table gives
an empty result.  Other columns of the input are not read, so their names may clash.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_WITH_LEAD, boxed, materialize, unboxed, word_count

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_EPOCHS = 2
SEED = "mix-1"
#: Hash buckets of a source, in two steps: the words of all coarse ones are added up, then those of the fine ones in the
#: coarse one at the boundary; only the fine one at the boundary is sorted by document (1 / 16**6 of a source).
COARSE_DIGITS, BUCKET_DIGITS = 3, 6
#: Up to so many sources, their table (under 100 bytes a row) is broadcast; beyond, it is joined by shuffle.
BROADCAST_SOURCES = 50_000


def water_fill(sources: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``sources`` (source, source_size) with ``target`` as double.  One row a source, so windows over all are small."""
    by_name, cap_order = Window.orderBy(F.col("source").asc_nulls_last()), ("ratio", F.col("source").asc_nulls_last())
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = Window.orderBy(*cap_order).rowsBetween(Window.unboundedPreceding, -1)
    onward = Window.orderBy(*cap_order).rowsBetween(0, Window.unboundedFollowing)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    s = sources.withColumn("weight", weight).withColumn("cap", F.col("source_size") * max_epochs)
    s = s.withColumn("ratio", F.col("cap") / F.col("weight")).withColumn("budget", F.sum("source_size").over(everything) * F.lit(float(share)))
    level = (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(onward)
    s = s.withColumn("level", level).withColumn("open", F.col("level") * F.col("weight") <= F.col("cap"))
    # the first open source, in the order of the caps, fixes the level for all after it
    s = s.withColumn("clamped", ~F.coalesce(F.bool_or("open").over(Window.orderBy(*cap_order).rowsBetween(Window.unboundedPreceding, 0)), F.lit(False)))
    first = F.first(F.when(~F.col("clamped"), F.col("level")), ignorenulls=True).over(Window.orderBy(*cap_order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    s = s.withColumn("final", first)
    target = F.when(F.col("clamped"), F.col("cap").cast("double")).otherwise(F.col("weight") * F.col("final"))
    return s.select("source", "source_size", target.alias("target"))


def _digest(docs: DataFrame, seed: str) -> DataFrame:
    """``docs`` with __size, __key and __bucket."""
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    return docs.withColumns({"__size": word_count(F.col("text")), "__key": key, "__bucket": F.substring(key, 1, BUCKET_DIGITS)})


def source_plan(digest: DataFrame, **filling) -> DataFrame:
    """A row a source: s, source_size, target, whole (full copies), quota (words more), and the hash bucket in which
    the quota ends with the words before that bucket (null where all of the source's documents fit)."""
    coarse = F.substring("__bucket", 1, COARSE_DIGITS)
    buckets = digest.groupBy("source", coarse.alias("bucket")).agg(F.sum("__size").alias("words"))
    sources = water_fill(buckets.groupBy("source").agg(F.sum("words").alias("source_size")), **filling)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    sources = sources.withColumn("whole", whole).withColumn("quota", F.floor("target") - F.col("whole") * F.col("source_size"))
    sources = sources.withColumnRenamed("source", "s")
    reached = sources.select("s", F.col("quota").alias("room"), F.lit(0).cast("long").alias("gone"))
    first = _edge(buckets, reached)
    inside = digest.join(_sent(first.select(F.col("s").alias("e"), F.col("edge").alias("near"))), F.col("source").eqNullSafe(F.col("e")) & (coarse == F.col("near")))
    fine = inside.groupBy("source", F.col("__bucket").alias("bucket")).agg(F.sum("__size").alias("words"))
    second = _edge(fine, first.join(reached.withColumnRenamed("s", "r"), F.col("s").eqNullSafe(F.col("r"))).select("s", "room", F.col("edge_from").alias("gone")))
    second = second.withColumnRenamed("s", "e")
    return sources.join(second, F.col("s").eqNullSafe(F.col("e")), "left").drop("e")


def _edge(buckets: DataFrame, reached: DataFrame) -> DataFrame:
    """``buckets`` (source, bucket, words), ``reached`` (s, room, gone: words before the first bucket) -> s, edge: the first
    bucket that goes beyond the room, edge_from: the words before it."""
    so_far = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    upto = buckets.withColumn("upto", F.sum("words").over(so_far)).join(reached, F.col("source").eqNullSafe(F.col("s"))).withColumn("upto", F.col("upto") + F.col("gone"))
    return upto.filter(F.col("upto") > F.col("room")).groupBy("s").agg(F.min("bucket").alias("edge"), F.min_by(F.col("upto") - F.col("words"), F.col("bucket")).alias("edge_from"))


def _sent(sources: DataFrame) -> DataFrame:
    """A table of a row a source, broadcast while it is small."""
    sources = materialize(sources, "mix-edges")
    return F.broadcast(sources) if sources.count() <= BROADCAST_SOURCES else sources


def _decide(digest: DataFrame, sources: DataFrame) -> DataFrame:
    """``digest`` with source_size, target, __whole and __extra.  Only documents in a boundary bucket are shuffled."""
    plan = sources.select("s", F.col("source_size").alias("__source_size"), F.col("target").alias("__target"), F.col("whole").alias("__whole"), F.col("quota").alias("__quota"), F.col("edge").alias("__edge"), F.col("edge_from").alias("__from")).withColumnRenamed("s", "__s")
    d = digest.join(F.broadcast(plan) if sources.count() <= BROADCAST_SOURCES else plan, F.col("source").eqNullSafe(F.col("__s"))).drop("__s")
    inside = F.col("__edge").isNull() | (F.col("__bucket") < F.col("__edge"))
    sure = d.filter(F.col("__edge").isNull() | (F.col("__bucket") != F.col("__edge"))).withColumn("__extra", F.when(inside & (F.col("__quota") > 0), F.col("__size")).otherwise(F.lit(0)))
    ties = ["text", F.col("box").cast("string")] if "box" in digest.columns else []  # rows that repeat an id and a size
    in_order = Window.partitionBy("source").orderBy("__key", "doc_id", "__size", *ties).rowsBetween(Window.unboundedPreceding, 0)
    left = F.col("__quota") - F.col("__from") - (F.sum("__size").over(in_order) - F.col("__size"))
    at_edge = d.filter(F.col("__bucket") == F.col("__edge")).withColumn("__extra", F.greatest(F.lit(0), F.least(F.col("__size"), left)))
    return sure.unionByName(at_edge)


def mix(docs: DataFrame, *, seed: str = SEED, **filling) -> DataFrame:
    """The op8 result: doc_id, size, source_size, target, taken."""
    digest = materialize(_digest(docs.select("doc_id", "source", "text"), seed).drop("text"), "mix-digest")
    d = _decide(digest, materialize(source_plan(digest, **filling), "mix-sources"))
    taken = F.col("__whole") * F.col("__size") + F.col("__extra")
    return d.select("doc_id", F.col("__size").alias("size"), F.col("__source_size").cast("long").alias("source_size"), F.col("__target").alias("target"), taken.cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, *, seed: str = SEED, **filling) -> DataFrame:
    """The mix itself, with the columns of ``docs``: a row for each repetition of a document, whole or cut after its
    first words.  Texts stay where they are, but for those in a source's boundary bucket; n_chars, where present, follows
    a cut text."""
    used = ["doc_id", "text", "source", "n_chars"]
    digest = _digest(boxed(docs, used), seed)
    sources = materialize(source_plan(materialize(digest.select("source", "__size", "__bucket"), "mix-digest"), **filling), "mix-sources")
    d = _decide(digest, sources)
    part = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(WORD_WITH_LEAD), F.lit(0)), F.lit(1), F.col("__extra").cast("int")), "")
    some = F.when(F.col("__extra") <= 0, F.array().cast("array<string>")).when(F.col("__extra") >= F.col("__size"), F.array("text")).otherwise(F.array(part))
    d = d.withColumn("text", F.explode(F.concat(F.array_repeat("text", F.col("__whole").cast("int")), some)))
    if "n_chars" in docs.columns:
        d = d.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return unboxed(d, docs, used)
