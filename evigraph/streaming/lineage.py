"""Incremental invalidation: what rests on each source, kept up as facts come and go.

Facts are relations (a version is supported by evidence, evidence was extracted from a source, a version is of an element);
a change inserts or deletes one.  The closure has a row for every source, evidence, version and element that hang
together.  A batch of changes finds the evidence that it touches, directly or through a version, and computes the
closure of that evidence anew; all else is neither read nor written.

Tables are Parquet in ``BUCKETS`` folders by key, and a batch overwrites only the folders it touches.  A change
sets a fact, it counts nothing, so a batch that is run again after a failure, whether or not it got through, leaves the same
tables.  In a folder that is rewritten, rows of other keys are copied as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..scratch import release, settle

CHANGES = "seq long, relation string, op string, src string, dst string"
CLOSURE = "evidence string, source string, version string, element string"
#: Files of a folder, at most.
BUCKETS, FILES = 64, 8
#: Relation -> the tables that hold its facts, each by one end: what is looked up from which.
KEYED = {
    "extracted_from": {"source_of_evidence": "src"},  # evidence -> source
    "supported_by": {"versions_of_evidence": "dst", "evidence_of_version": "src"},  # version -> evidence
    "has_version": {"elements_of_version": "src"},  # version -> element
}
FACT = "key string, value string"


def _bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _read(spark: SparkSession, folder: str, columns: str, buckets: list[int] | None) -> DataFrame:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], f"{columns}, bucket int")
    df = spark.read.schema(f"{columns}, bucket int").parquet(folder)
    return df if buckets is None else df.filter(F.col("bucket").isin(buckets))  # whole folders


def _touched(keys: DataFrame, buckets: int) -> list[int]:
    return [r[0] for r in keys.select(_bucket(F.col("key"), buckets)).distinct().collect()]  # at most ``buckets``


def _replace(spark: SparkSession, folder: str, columns: str, keys: DataFrame, name: str, fresh: DataFrame, buckets: int) -> None:
    """In the folders of ``keys`` (key), rows whose ``name`` is one of them give way to ``fresh``."""
    touched = _touched(keys, buckets)
    if not touched:
        return
    old = _read(spark, folder, columns, touched).join(keys.select(F.col("key").alias("gone")), F.col(name) == F.col("gone"), "left_anti").drop("bucket")
    rows = settle(old.unionByName(fresh).withColumn("bucket", _bucket(F.col(name), buckets)), "lineage")
    # a folder that is left without rows keeps an empty file: a row of no key stands for it until it is read
    marks = spark.createDataFrame([(b,) for b in touched], "bucket int")
    for c in reversed([c.split() for c in columns.split(", ")]):
        marks = marks.select(F.lit(None).cast(c[1]).alias(c[0]), *marks.columns)
    out = rows.filter(F.col(name).isNotNull()).unionByName(marks)
    spread = F.pmod(F.xxhash64(*[c.split()[0] for c in columns.split(", ")]), F.lit(FILES))  # one key may hold most rows
    out.repartition("bucket", spread).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(folder)
    release(rows)


def apply(spark: SparkSession, changes: DataFrame, folder: str, buckets: int = BUCKETS) -> None:
    """Brings facts and closure up to date with changes (seq, relation, op, src, dst); the last one of a fact wins."""
    last = changes.groupBy("relation", "src", "dst").agg(F.max_by("op", "seq").alias("op"))
    last = settle(last.filter("src is not null and dst is not null"), "changes")
    for relation, tables in KEYED.items():
        facts = last.filter(F.col("relation") == relation)
        for table, key in tables.items():
            mine = facts.select(F.col(key).alias("key"), F.col("dst" if key == "src" else "src").alias("value"), "op")
            touched = _touched(mine, buckets)
            there = _read(spark, f"{folder}/{table}", FACT, touched).select("key", "value").filter("key is not null")
            pairs = mine.select("key", "value")
            kept = there.join(mine.select("key").distinct(), "key", "left_semi").join(pairs, ["key", "value"], "left_anti")
            fresh = kept.unionByName(mine.filter("op = 'insert'").select("key", "value"))
            _replace(spark, f"{folder}/{table}", FACT, mine.select("key").distinct(), "key", fresh, buckets)
    of = lambda table, keys: _read(spark, f"{folder}/{table}", FACT, _touched(keys, buckets)).select("key", "value").join(keys.select("key"), "key", "left_semi")
    versions = last.filter("relation = 'has_version'").select(F.col("src").alias("key")).distinct()
    direct = last.filter("relation = 'extracted_from'").select(F.col("src").alias("key")).unionByName(last.filter("relation = 'supported_by'").select(F.col("dst").alias("key")))
    evidence = settle(direct.unionByName(of("evidence_of_version", versions).select(F.col("value").alias("key"))).distinct(), "touched")
    supports = settle(of("versions_of_evidence", evidence).select(F.col("key").alias("evidence"), F.col("value").alias("version")), "supports")
    elements = of("elements_of_version", supports.select(F.col("version").alias("key")).distinct())
    sources = of("source_of_evidence", evidence).select(F.col("key").alias("evidence"), F.col("value").alias("source"))
    fresh = sources.join(supports, "evidence", "left").join(elements.select(F.col("key").alias("version"), F.col("value").alias("element")), "version", "left")
    _replace(spark, f"{folder}/closure", CLOSURE, evidence, "evidence", fresh.select("evidence", "source", "version", "element"), buckets)
    release(last, evidence, supports)


def keep_up(changes: DataFrame, folder: str, checkpoint: str, buckets: int = BUCKETS) -> StreamingQuery:
    """Applies a stream of changes batch by batch, going on from the checkpoint.  Within a batch the last change of a fact wins
    by seq; over batches the later batch."""
    stream = changes.writeStream.foreachBatch(lambda batch, _: apply(batch.sparkSession, batch, folder, buckets))
    return stream.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def invalidated(spark: SparkSession, folder: str, changed: DataFrame) -> DataFrame:
    """(source, evidence, version, element): what rests on changed sources (id)."""
    closure = _read(spark, f"{folder}/closure", CLOSURE, None).filter("evidence is not null")
    return closure.join(changed.select(F.col("id").alias("source")), "source", "left_semi").select("source", "evidence", "version", "element")
