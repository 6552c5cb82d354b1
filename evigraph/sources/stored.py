"""Graphs that are stored once a session and then walked: adjacency and node tables in the shared folder.

What is stored is known by the tables that it was derived from, as they are: place, time of change, bytes and files.  A table
that changed is stored anew, and what was stored of it before is deleted.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import adjacency
from ..operators.adjacency import Adjacency
from ..scratch import delete
from . import star

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")


@dataclass(frozen=True)
class Nodes:
    """Nodes in buckets by id."""

    table: DataFrame
    places: tuple[str, ...]

    def drop(self) -> None:
        for place in self.places:
            self.table.sparkSession.sql("DROP TABLE IF EXISTS " + place.rsplit("/", 1)[1].replace("-", "_"))
            delete(self.table.sparkSession, place)


_KEPT: dict[tuple, tuple[tuple, Adjacency | Nodes]] = {}


def _file_system(spark: SparkSession, folder: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def state(spark: SparkSession, folder: str, names: Sequence[str]) -> tuple:
    """Time of change, bytes and files of each table."""
    out = []
    for name in names:
        path, fs = _file_system(spark, f"{folder}/{name}.parquet")
        size = fs.getContentSummary(path)
        out.append((name, fs.getFileStatus(path).getModificationTime(), size.getLength(), size.getFileCount()))
    return tuple(out)


def kept(spark: SparkSession, folder: str, what: str, names: Sequence[str], make: Callable[[], Adjacency | Nodes]) -> Adjacency | Nodes:
    """What ``make`` stores, made once for the tables ``names`` as they are now."""
    key, now = (spark.sparkContext.applicationId, what, folder), state(spark, folder, names)
    if key in _KEPT:
        before, made = _KEPT[key]
        if before == now and all(fs.exists(path) for path, fs in (_file_system(spark, p) for p in made.places)):
            return made
        del _KEPT[key]
        made.drop()
    made = make()
    _KEPT[key] = now, made
    return made


def calls(spark: SparkSession, folder: str) -> Adjacency:
    """The calls of star.calls()."""
    return kept(spark, folder, "calls", ["lineitem"], lambda: adjacency.store(star.calls(spark, folder)))


def edges(spark: SparkSession, folder: str) -> Adjacency:
    """All relations of star.edges(), with src and dst."""
    ends = {"source_id": "src", "target_id": "dst"}
    return kept(spark, folder, "edges", TABLES, lambda: adjacency.store(star.edges(spark, folder).withColumnsRenamed(ends).select("src", "dst", "relation_id", "predicate_id", "active")))


def nodes(spark: SparkSession, folder: str) -> DataFrame:
    """All elements of star.elements(): id and label (their kind)."""

    def make() -> Nodes:
        rows = star.elements(spark, folder).select("id", F.col("kind_id").alias("label"))
        table, place = adjacency.bucketed(rows, "id", adjacency.LEAST_BUCKETS, tag="nodes")
        return Nodes(table, (place,))

    return kept(spark, folder, "nodes", [t for t in TABLES if t != "lineitem"], make).table


def forget(spark: SparkSession) -> None:
    """Deletes all that this session stored."""
    for key in [k for k in _KEPT if k[0] == spark.sparkContext.applicationId]:
        _KEPT.pop(key)[1].drop()
