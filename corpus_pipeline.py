"""A corpus pipeline of five stages, each one operator applied to all that its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next
one's ``docs``.  All but the last return the columns of ``documents``, whatever others there are and however they are
called; these never clash with names of a stage.  Every stage reads texts whole, and an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evigraph.llm import common, langid, mixing, nearcopies, packing, pii


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters and those between two languages.  Dictionaries come from the same training
    third of ids as in op7.  Null and empty texts have no letter and go; a tie is a margin of nothing and goes; repeated
    rows are judged alike, rows with a null id like any other."""
    common.small_batches(spark)
    train = docs.filter(common.crc_of_id(F.col("doc_id"), 3) != 1)
    return langid.accepted_documents(docs, langid.learn(train))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies: texts whose sets of five-word shingles have a Jaccard
    similarity of 0.8 or more are linked.  It is that of the smallest doc_id; of rows that
    repeat this id, the first by text.  Rows with a null doc_id cannot be named by a group and stay; empty texts are copies
    of one another."""
    common.small_batches(spark)
    return nearcopies.keep_one(docs)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind.  Null texts stay null, no row is dropped, repeated rows are changed alike."""
    return pii.redacted_documents(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and cuts documents so that the sources' words meet their targets.  Documents without words (null, empty)
    follow their source's whole repetitions; a null source is one of its own; of repeated rows at a source's boundary the
    first by text are taken."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the mix into sequences: a row a piece.  A null or empty text is the end id alone; repeated rows and rows with a
    null doc_id are documents of their own."""
    common.small_batches(spark)
    return packing.pack(docs)


STAGES = [("language ID", identify_language), ("SimHash near-dedup", near_dedup), ("PII", redact), ("mixing", mix), ("packing", pack)]

#: Compression and fingerprints have no SQL form here; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = common.settled(lambda docs=docs, stage=stage: stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
