"""Filter interaction audit: what five filters remove, alone and in every order.

A relational pipeline counts the words: texts are exploded into words, these are counted by (row, word), then by row for
totals and distinct words.  Words of one row are dealt once, by the row's number, and both counts are taken where they lie.
The other flags come from the text as it is read, from the smallest id of equal texts, and from the labels; an outer join
brings them together with the words, and one aggregate counts the 32 combinations of failures by part.  All 120 orders follow
from these counts: a filter removes, at its step, the combinations that hold it and none of those before it.

Filters, as failures: A under 200 words; B 100 * distinct words < 50 * words; C 100 * capital letters > 2 * code points;
D one of #$%&*|; E a text equal to that of a smaller doc_id.

Equal texts meet by their SHA-256.  Those in more than a thousandth of all rows are fewer than a thousand and are broadcast;
all others are joined by shuffle, so no text is too common for a task.

Defined results: a null text is empty, and equal to empty ones; a row with a null doc_id is no copy of another and no
original; rows that repeat a doc_id are rows of their own, and copies only of smaller ids; a document has a label if any of
its label rows has it, unlabelled ones have none; a null source is the part '' like an empty one; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, materialize

FILTERS = "ABCDE"
#: Texts in more than this share of all rows are joined by broadcast: at most its inverse in number.
COMMON = 0.001


def flagged(docs: DataFrame) -> DataFrame:
    """A row a document, numbered: row, doc_id, part, text, c, d, digest of the text."""
    text = F.coalesce("text", F.lit(""))
    base = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), text.alias("text"))
    capitals = F.regexp_count("text", F.lit("[A-Z]"))
    return base.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", "part", "text", (100 * capitals.cast("long") > 2 * F.length("text")).alias("c"),
        F.col("text").rlike(r"[#$%&*|]").alias("d"), F.unhex(F.sha2("text", 256)).alias("digest"),
    )


def words_of(base: DataFrame) -> DataFrame:
    """(row, a, b) of rows with words."""
    words = base.select("row", "text").repartition("row").select("row", F.explode(F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).alias("word"))
    totals = words.groupBy("row", "word").agg(F.count("*").alias("times")).groupBy("row").agg(F.sum("times").alias("words"), F.count("*").alias("different"))
    return totals.select("row", (F.col("words") < 200).alias("a"), (100 * F.col("different") < 50 * F.col("words")).alias("b"))


def with_originals(rows: DataFrame) -> DataFrame:
    """``rows`` with e: whether a smaller doc_id has the text."""
    groups = rows.groupBy("digest").agg(F.count("*").alias("n"), F.min("doc_id").alias("least")).filter("n > 1")
    groups = materialize(groups, "audit-copies")
    most = int(COMMON * rows.count())
    common = groups.filter(F.col("n") > most).select(F.col("digest").alias("common"), F.col("least").alias("least_common"))
    rest = groups.filter(F.col("n") <= most).select(F.col("digest").alias("other"), F.col("least").alias("least_other"))
    met = rows.join(F.broadcast(common), F.col("digest") == F.col("common"), "left")
    # rows that have met a common text look for none; their own number keeps them apart
    key = F.when(F.col("common").isNull(), F.col("digest")).otherwise(F.encode(F.col("row").cast("string"), "utf-8"))
    met = met.withColumn("key", key).join(rest, F.col("key") == F.col("other"), "left")
    return met.withColumn("e", F.coalesce(F.col("doc_id") > F.coalesce("least_common", "least_other"), F.lit(False)))


def with_labels(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """``rows`` with good and toxic."""
    has = lambda c: F.coalesce(F.max(F.col(c) == 1), F.lit(False)).alias(c)
    known = labels.filter("doc_id is not null").groupBy(F.col("doc_id").alias("labelled")).agg(has("quality"), has("toxic")).filter("quality or toxic")
    # a null id has no labels; the row's number keeps such rows apart
    number = F.coalesce(F.col("doc_id"), F.col("row").cast(rows.schema["doc_id"].dataType))
    met = rows.withColumn("number", number).withColumn("named", F.col("doc_id").isNotNull()).join(known.withColumn("one", F.lit(True)), (F.col("number") == F.col("labelled")) & (F.col("named") == F.col("one")), "left")
    return met.withColumns({"good": F.coalesce("quality", F.lit(False)), "toxic": F.coalesce("toxic", F.lit(False))})


def combinations(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row a part: all, good and toxic are arrays of the 32 counts, by the bits of the failures (A is 1, E is 16)."""
    base = materialize(flagged(docs), "audit-rows")
    rows = with_labels(with_originals(base.drop("text")), labels).select("row", "part", "c", "d", "e", "good", "toxic")
    joined = rows.join(words_of(base), "row", "left").withColumns({"a": F.coalesce("a", F.lit(True)), "b": F.coalesce("b", F.lit(False))})
    bits = sum((F.col(f).cast("int") * (1 << i) for i, f in enumerate("abcde")), F.lit(0))
    counts = {"all": F.lit(True), "good": F.col("good"), "toxic": F.col("toxic")}
    each = [F.count_if((F.col("bits") == m) & kind).alias(f"{name}_{m}") for name, kind in counts.items() for m in range(32)]
    grouped = joined.select("part", bits.alias("bits"), "good", "toxic").groupBy("part").agg(*each)
    return grouped.select("part", *[F.array(*[f"{name}_{m}" for m in range(32)]).alias(name) for name in counts])


def _steps() -> list[tuple]:
    """(filter_order, step, bit of the step's filter, bits of those before it)."""
    out = []
    for order in permutations(FILTERS):
        bits = [1 << FILTERS.index(f) for f in order]
        out += [("".join(order), k + 1, bits[k], sum(bits[:k])) for k in range(len(FILTERS))]
    return out


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for each part, order and step: part, filter_order, step, kept, removed, redundant, unique_fails, good_lost,
    toxic_lost, shapley (removals of the step's filter, summed over all orders)."""
    steps = ", ".join(f"struct('{o}' AS filter_order, {k} AS step, {bit} AS bit, {before} AS before)" for o, k, bit, before in _steps())
    rows = combinations(docs, labels).withColumn("at", F.explode(F.expr(f"array({steps})"))).select("part", "all", "good", "toxic", "at.*")
    every = F.sequence(F.lit(0), F.lit(31))

    def total(counts: str, chosen) -> Column:
        pick = lambda m: F.when(chosen(m), F.col(counts)[m]).otherwise(F.lit(0))
        return F.aggregate(F.transform(every, pick), F.lit(0).cast("long"), lambda a, x: a + x)

    has = lambda m, bits: m.bitwiseAND(F.col(bits)) != 0
    removed = lambda m: has(m, "bit") & ~has(m, "before")
    # of 120 orders, a filter comes first among m failures in 120 / m
    share = F.aggregate(
        F.transform(every, lambda m: F.when(has(m, "bit"), F.col("all")[m] * F.floor(F.lit(120) / F.bit_count(m))).otherwise(F.lit(0))), F.lit(0).cast("long"), lambda a, x: a + x
    )
    return rows.select(
        "part", "filter_order", "step", total("all", lambda m: ~has(m, "before") & ~has(m, "bit")).alias("kept"), total("all", removed).alias("removed"),
        total("all", lambda m: has(m, "bit") & has(m, "before")).alias("redundant"), F.col("all")[F.col("bit")].alias("unique_fails"),
        total("good", removed).alias("good_lost"), total("toxic", removed).alias("toxic_lost"), share.alias("shapley"),
    )
