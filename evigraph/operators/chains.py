"""Chains contracted to single edges, by pointer doubling.

An inner node has one edge in and one out.  What lies between two other nodes over inner nodes becomes one edge, as long
as the chain.  Pointers of inner nodes reach four times as far in each round, so a chain of n nodes takes log4(n) rounds.
A ring of inner nodes has no end; its pointers are still open after these rounds.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import counted, release, settle
from .adjacency import sized

TRIPS = 3  # joins with the pointers in a round


@dataclass(frozen=True)
class Contracted:
    """edges: src, dst, eid, w (original edges it stands for).  members: eid of an edge that went into a chain, into.  inner:
    id, tail (the chain's last inner node), hops (edges to its end).  heads: tail, start, total (edges of the chain).
    rings: eid of edges on rings of inner nodes.  found: inner nodes."""

    edges: DataFrame
    members: DataFrame
    inner: DataFrame
    heads: DataFrame
    rings: DataFrame
    found: int


def contract(edges: DataFrame, name: str = "") -> Contracted | None:
    """Of edges (src, dst, eid, w); None where no inner node leads to another, so that nothing is longer than two edges and
    writing all edges anew gains little.  ``name`` keeps ids of this round's edges apart."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(1).alias("out")), F.struct(F.col("dst").alias("id"), F.lit(0).alias("out")))).alias("e")).select("e.*")
    degree = ends.groupBy("id").agg(F.sum("out").alias("outs"), F.count("*").alias("all"))
    inner, n = counted(degree.filter("outs = 1 and all = 2").select("id"), "inner")
    between = sized(inner.select(F.col("id").alias("inner_id")), n)
    out_of = edges.join(between, F.col("src") == F.col("inner_id"), "left_semi") if n else None
    if out_of is None or out_of.join(between, F.col("dst") == F.col("inner_id"), "left_semi").isEmpty():
        release(inner)
        return None
    mark = lambda c: inner.select(F.col("id").alias(c), F.lit(True).alias(f"{c}_inner"))
    told = settle(edges.join(mark("src"), "src", "left").join(mark("dst"), "dst", "left").withColumns({"src_inner": F.col("src_inner").isNotNull(), "dst_inner": F.col("dst_inner").isNotNull()}), "told")
    going = F.count_if("open")
    p, left = counted(told.filter("src_inner").select(F.col("src").alias("id"), F.col("dst").alias("to"), F.col("src").alias("tail"), F.col("w").alias("hops"), F.col("dst_inner").alias("open")), "pointers", going)
    reach = 1
    while left and reach < 2 * n:
        far = p
        for k in range(TRIPS):
            q = p.select(F.col("id").alias("at"), F.col("to").alias("to2"), F.col("tail").alias("tail2"), F.col("hops").alias("hops2"), F.col("open").alias("open2"))
            far = far.join(q, F.col("open") & (F.col("to") == F.col("at")), "left")
            on = F.col("at").isNotNull()
            far = far.select("id", *[F.when(on, F.col(f"{c}2")).otherwise(F.col(c)).alias(c) for c in ("to", "tail", "open")], (F.col("hops") + F.when(on, F.col("hops2")).otherwise(F.lit(0))).alias("hops"))
        after, left = counted(far.select("id", "to", "tail", "hops", "open"), "pointers", going)
        release(p)
        p, reach = after, reach * (TRIPS + 1)
    closed = p.filter("not open")
    # an edge belongs to the chain of its inner end; on a ring nothing is closed
    of = closed.select(F.col("id").alias("inner_id"), "tail", "to", "hops")
    touched = told.filter("src_inner or dst_inner").withColumn("inner_id", F.when(F.col("dst_inner"), F.col("dst")).otherwise(F.col("src"))).join(of, "inner_id", "left")
    into = F.concat(F.lit(f"{name}:"), F.col("tail").cast("string"))
    touched = settle(touched.select("src", "dst", "eid", "w", "src_inner", "tail", "to", "hops", into.alias("into")), "chained")
    first = touched.filter("not src_inner and tail is not null")
    made = first.select("src", F.col("to").alias("dst"), F.col("into").alias("eid"), (F.col("w") + F.col("hops")).alias("w"))
    plain = told.filter("not src_inner and not dst_inner").select("src", "dst", "eid", "w")
    out = settle(plain.unionByName(made), "contracted")
    kept = settle(closed.select("id", "tail", "hops"), "inner")
    heads = first.select("tail", F.col("src").alias("start"), (F.col("w") + F.col("hops")).alias("total"))
    release(inner, p, told)
    return Contracted(out, touched.filter("tail is not null").select("eid", "into"), kept, heads, touched.filter("tail is null").select("eid"), n)
