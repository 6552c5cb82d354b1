"""Graphs as folders of Parquet tables: versions, atomic publication, migrations.

A new state is written in full beside the old one; then a small pointer file is replaced.  Readers resolve the pointer
once, so they see one state.  A publisher names the version it started from; if another one was published meanwhile, it
is refused: each version has a mark that only one publisher can create.  A publisher that dies between its mark and the
pointer leaves the version claimed; deleting the mark frees it.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .schema import NODES, RELS, rel_schema

POINTER = "CURRENT"


class Conflict(RuntimeError):
    pass


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _read_small(spark: SparkSession, path: str) -> dict | None:
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def _replace_small(spark: SparkSession, path: str, value: dict) -> None:
    fs, p = _fs(spark, path)
    _, fresh = _fs(spark, f"{path}.{uuid.uuid4().hex}")
    out = fs.create(fresh, True)
    try:
        out.write(bytearray(json.dumps(value, sort_keys=True).encode()))
    finally:
        out.close()
    options = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    spark.sparkContext._jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(fresh, p, options)


class Catalog:
    """The tables of one graph under a root folder."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def current(self) -> dict:
        """Version, schema version and table folders of the published state; version 0 if there is none."""
        return _read_small(self.spark, f"{self.root}/{POINTER}") or {"version": 0, "schema": 0, "tables": {}}

    def table(self, label: str, state: dict | None = None) -> DataFrame:
        """A node or relationship table with its declared schema; empty if it was never written."""
        state = state or self.current()
        ddl = NODES.get(label) or rel_schema(label)
        folder = state["tables"].get(label)
        if folder is None:
            return self.spark.createDataFrame([], ddl)
        return self.spark.read.schema(ddl).parquet(f"{self.root}/{folder}")

    def publish(self, tables: dict[str, DataFrame], based_on: int, schema: int | None = None) -> int:
        """Writes new states of some tables and makes them current together; the others stay."""
        state = self.current()
        if state["version"] != based_on:
            raise Conflict(f"based on version {based_on}, current is {state['version']}")
        number = based_on + 1
        folders = dict(state["tables"])
        for label, df in tables.items():
            if label not in NODES and label not in RELS:
                raise KeyError(label)
            folders[label] = f"v{number}-{uuid.uuid4().hex[:8]}/{label}"
            writer = df.write.partitionBy("predicate_id") if label == "SEMANTIC_EDGE" else df.write
            writer.parquet(f"{self.root}/{folders[label]}")
        # who creates the mark of a version publishes it; the file system lets only one do so
        fs, mark = _fs(self.spark, f"{self.root}/v{number}.claimed")
        try:
            fs.create(mark, False).close()
        except Exception as e:  # Py4JJavaError of a file that exists
            raise Conflict("another state was published meanwhile") from e
        if self.current()["version"] != based_on:
            raise Conflict("another state was published meanwhile")
        _replace_small(self.spark, f"{self.root}/{POINTER}", {"version": number, "schema": state["schema"] if schema is None else schema, "tables": folders})
        return number

    def migrate(self, steps: dict[int, Callable[[Catalog], dict[str, DataFrame]]]) -> list[int]:
        """Applies the steps above the schema version in the order of their numbers; applied ones are skipped, so a
        repeat does nothing.  A step gives the tables it changes and is published whole."""
        done = []
        for number in sorted(steps):
            state = self.current()
            if number > state["schema"]:
                self.publish(steps[number](self), state["version"], schema=number)
                done.append(number)
        return done


def metamodel(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """MetaType and Predicate rows of a metamodel file in JSON ({"metatypes": […], "predicates": […]})."""
    from pyspark.sql import functions as F

    one = spark.read.text(path, wholetext=True)
    kinds = F.from_json("value", "metatypes array<struct<id:string,namespace:string,name:string,category:string,description:string>>, predicates array<struct<id:string,namespace:string,name:string,category:string,directed:boolean,transitive:boolean,symmetric:boolean,description:string>>")
    both = one.select(kinds.alias("m"))
    return both.select(F.explode("m.metatypes").alias("t")).select("t.*"), both.select(F.explode("m.predicates").alias("p")).select("p.*")
