"""Edges stored for walks: once by their source and once by their target.

Each copy is a table of the session's catalog in the shared folder, bucketed and sorted by its key.  A step of a walk then
reads one of them, and never what the edges were derived from:

* a frontier of at most ``PRUNED`` nodes is a literal list, so whole buckets are pruned before the scan and row groups in it;
* one of at most ``SMALL`` nodes is broadcast, and the edges are filtered where they are read;
* a larger one is dealt into the same buckets and joined bucket to bucket; the edges are not shuffled.

A node with more than ``ROWS_A_BUCKET`` edges would make one bucket as large as it likes.  There are at most as many of
these as buckets; their edges are kept apart, spread evenly, and meet a frontier by a broadcast of these few nodes.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import counted, delete, release, settle, shared_folder

SMALL = 1_000_000
PRUNED = 256
ROWS_A_BUCKET, LEAST_BUCKETS = 1_000_000, 8


def sized(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= SMALL else df


@dataclass(frozen=True)
class Side:
    """The edges by one key: ``table`` in buckets, ``hot`` (edges of the nodes in ``heavy``) in none."""

    table: DataFrame
    hot: DataFrame | None
    heavy: DataFrame | None

    def whole(self) -> DataFrame:
        return self.table if self.hot is None else self.table.unionByName(self.hot)


@dataclass(frozen=True)
class Adjacency:
    """Stored edges (src, dst and what else they have)."""

    by_src: Side
    by_dst: Side | None
    rows: int
    places: tuple[str, ...] = ()

    @property
    def table(self) -> DataFrame:
        """All edges."""
        return self.by_src.whole()

    @property
    def sparkSession(self) -> SparkSession:  # noqa: N802 - as DataFrame has it
        return self.by_src.table.sparkSession

    @property
    def columns(self) -> list[str]:
        return self.by_src.table.columns

    def filter(self, condition: Column) -> Adjacency:
        """Only edges that meet a condition; still stored."""
        some = lambda s: Side(s.table.filter(condition), None if s.hot is None else s.hot.filter(condition), s.heavy)
        return replace(self, by_src=some(self.by_src), by_dst=None if self.by_dst is None else some(self.by_dst))

    def at(self, key: str, frontier: DataFrame, rows: int) -> DataFrame:
        """The edges whose ``key`` (src or dst) is in the frontier (id), which has so many rows or fewer."""
        side = self.by_src if key == "src" else self.by_dst
        if rows <= PRUNED:
            ids = [r[0] for r in frontier.select("id").distinct().collect()]  # at most PRUNED
            return side.whole().filter(F.col(key).isin(ids))
        if rows <= SMALL:
            return side.whole().join(F.broadcast(frontier.select(F.col("id").alias("at"))), F.col(key) == F.col("at"), "left_semi")
        found = side.table.join(frontier.select(F.col("id").alias("at")), F.col(key) == F.col("at"), "left_semi")
        if side.hot is None:
            return found
        few = F.broadcast(side.heavy.join(frontier.select(F.col("id").alias("at")), F.col("node") == F.col("at"), "left_semi"))
        return found.unionByName(side.hot.join(few, F.col(key) == F.col("node"), "left_semi"))

    def drop(self) -> None:
        """Deletes the tables, once no later plan reads them."""
        for place in self.places:
            name = place.rsplit("/", 1)[1].replace("-", "_")
            self.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")
            delete(self.sparkSession, place)


def bucketed(df: DataFrame, key: str, buckets: int, order: Sequence[str] = (), tag: str = "table") -> tuple[DataFrame, str]:
    """``df`` as a table of the catalog in the shared folder, one file a bucket, sorted by the key; and its folder."""
    spark = df.sparkSession
    place = f"{shared_folder(spark)}/evigraph-{tag}-{uuid.uuid4().hex}"
    name = place.rsplit("/", 1)[1].replace("-", "_")
    dealt = df.repartition(buckets, key)
    dealt.write.format("parquet").option("path", place).bucketBy(buckets, key).sortBy(key, *order).saveAsTable(name)
    return spark.table(name), place


def store(edges: DataFrame, *, rows_a_bucket: int = ROWS_A_BUCKET, least_buckets: int = LEAST_BUCKETS, ways: Sequence[str] = ("src", "dst"), distinct: int | None = None) -> Adjacency:
    """Writes distinct ``edges`` (src, dst, more) both ways, or by their source alone where walks only go out (``ways``).
    Edges with a null end lead nowhere and are left out.  ``distinct``: how many there are, of a settled table of distinct
    edges without nulls, which is read as it is."""
    every, rows = counted(edges.filter("src is not null and dst is not null").distinct(), "edges") if distinct is None else (edges, distinct)
    buckets = max(least_buckets, -(-rows // rows_a_bucket))
    sides, places = {}, []
    for key, other in [(k, o) for k, o in (("src", "dst"), ("dst", "src")) if k in ways]:
        heavy, n = counted(every.groupBy(F.col(key).alias("node")).agg(F.count("*").alias("n")).filter(F.col("n") > rows_a_bucket).select("node"), "heavy")
        light, hot = every, None
        if n:
            is_heavy = F.col(key) == F.col("node")
            light, hot = every.join(F.broadcast(heavy), is_heavy, "left_anti"), settle(every.join(F.broadcast(heavy), is_heavy, "left_semi"), "hot-edges")
            places.append(hot.inputFiles()[0].rsplit("/", 1)[0])
        else:
            release(heavy)
        table, place = bucketed(light, key, buckets, [other], f"by-{key}")
        sides[key] = Side(table, hot, heavy if n else None)
        places.append(place)
    if distinct is None:
        release(every)
    return Adjacency(sides["src"], sides.get("dst"), rows, tuple(places))
