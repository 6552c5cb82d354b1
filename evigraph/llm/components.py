"""Connected components of an edge table by alternating large-star and small-star steps.

Minima are partial aggregates and the joins may be split by the optimiser, so a hub does not land in one task; the
number of rounds grows with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("m", "u").alias("m"))
    return both.join(least, both.u == least.k).filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))


def _small_star(e: DataFrame) -> DataFrame:
    least = e.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), "m")
    moved = e.join(least, e.a == least.k).filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionAll(least.select(F.col("k").alias("a"), F.col("m").alias("b")))


def components(edges: DataFrame, tag: str = "cc") -> DataFrame:
    """``edges`` (a, b), any order, repeats allowed -> (node, component) for every node with an edge; component is
    the smallest node that it reaches.  No edges: no rows."""
    e = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = materialize(e, tag)
    seen = None
    while True:
        state = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(e.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
        seen = state
        following = materialize(_small_star(_large_star(e).distinct()).distinct(), tag)
        discard(e)
        e = following
