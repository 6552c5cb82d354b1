"""Near copies by the Jaccard similarity of their word shingles: SimHash and MinHash candidates, exact verification.

Texts of equal shingle sets are one node.  Candidates are nodes whose SimHash fingerprints differ in at most two bits,
and nodes that agree in a band of ``ROWS`` of their MinHash values: of a pair at similarity 0.8, whose fingerprints
differ in some ten bits, ``BANDS`` bands miss 3 in 100,000, and fewer of a closer pair.  Candidates make components, and
only their members' shingles are read again.  All pairs of a component are verified on the whole sets, in blocks of
about ``MASS`` shingles; a search from node to node counts common shingles with those not yet reached only, so a dense
group costs little more than reading it.

Shingles are told apart by 64-bit hashes.  Defined results: rows with a null doc_id link with nothing; word-less texts
are copies of one another; fewer words than a shingle are one shingle; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import materialize, sorted_groups
from .components import components

WORDS = 5
#: Similarity of a link, as a fraction.
LEAST = (4, 5)
BANDS, ROWS = 20, 4
#: Shingles of one block of a component, about.
MASS = 1 << 21
#: Shingles that are hashed to MinHash values at a time.
STRETCH = 2048

_random = np.random.default_rng(11)
_FACTOR = _random.integers(0, 1 << 63, (BANDS * ROWS, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADDEND = _random.integers(0, 1 << 63, (BANDS * ROWS, 1), dtype=np.uint64)


def bands(shingles: np.ndarray) -> list[int]:
    """A signed 64-bit value for each band of MinHash values."""
    least = np.full(BANDS * ROWS, (1 << 64) - 1, dtype=np.uint64)
    for i in range(0, len(shingles), STRETCH):
        mixed = shingles[i : i + STRETCH] * _FACTOR + _ADDEND
        least = np.minimum(least, mixed.min(axis=1))
    raw = least.astype("<u8").tobytes()
    width = 8 * ROWS
    return [xxhash.xxh64_intdigest(raw[k * width : (k + 1) * width], k) - (1 << 63) for k in range(BANDS)]


def _key(shingles: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(shingles.tobytes()) - (1 << 63)


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, node (of the shingle set), fp, bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node, fp, band = [], [], []
            for t in b.column(1):
                h = simhash.shingle_hashes(t.as_py(), WORDS)
                s = np.unique(h)
                node.append(_key(s))
                fp.append(simhash.fold(h))
                band.append(bands(s))
            prints = np.array(fp, dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(node, pa.int64()), pa.array(prints, pa.int64()), pa.array(band, pa.list_(pa.int64()))], names=["doc_id", "node", "fp", "bands"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("binary")).mapInArrow(run, f"doc_id {kind}, node long, fp long, bands array<long>")


def sets(docs: DataFrame) -> DataFrame:
    """node, shingles (sorted, as little-endian 64-bit numbers) and their number n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = [np.unique(simhash.shingle_hashes(t.as_py(), WORDS)) for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([_key(x) for x in s], pa.int64()), pa.array([x.tobytes() for x in s], pa.binary()), pa.array([len(x) for x in s], pa.int64())], names=["node", "shingles", "n"])

    return docs.select(F.col("text").cast("binary")).mapInArrow(run, "node long, shingles binary, n long")


def candidates(nodes: DataFrame) -> DataFrame:
    """nodes (node, fp, bands) -> (a, b): each band's nodes with their least one, and so for fingerprints."""
    routed = nodes.select("node", F.explode("bands").alias("band"))
    heads = routed.groupBy("band").agg(F.min("node").alias("head"), F.count("*").alias("n")).filter("n > 1").select(F.col("band").alias("k"), "head")
    by_band = routed.join(heads, F.col("band") == F.col("k")).filter("node <> head").select(F.col("node").alias("a"), F.col("head").alias("b"))
    prints = materialize(nodes.groupBy("fp").agg(F.min("node").alias("head")), "near-prints")
    same = nodes.select("node", "fp").join(prints.withColumnRenamed("fp", "k"), F.col("fp") == F.col("k")).filter("node <> head").select(F.col("node").alias("a"), F.col("head").alias("b"))
    close = simhash.links(prints.select("fp"), spanning=True)
    of_a, of_b = (prints.select(F.col("fp").alias(f"fp_{x}"), F.col("head").alias(f"head_{x}")) for x in "ab")
    close = close.join(of_a, F.col("a") == F.col("fp_a")).join(of_b, F.col("b") == F.col("fp_b")).select(F.col("head_a").alias("a"), F.col("head_b").alias("b"))
    return by_band.distinct().unionAll(same).unionAll(close)


def linked(shingles: list[np.ndarray]) -> tuple[list[int], list[int]]:
    """A spanning forest of the pairs of sets whose similarity is at least ``LEAST``."""
    n = len(shingles)
    size = np.array([len(s) for s in shingles], dtype=np.int64)
    up, down = LEAST
    term = np.unique(np.concatenate(shingles), return_inverse=True)[1] if n else np.zeros(0, dtype=np.int64)
    at = np.concatenate([[0], np.cumsum(size)])
    doc = np.repeat(np.arange(n), size)
    order = np.argsort(term, kind="stable")
    post_term, post = term[order], doc[order]
    starts = np.searchsorted(post_term, np.arange(len(term) + 1))
    waiting = np.ones(n, dtype=bool)
    indexed, left = n, n
    out_a, out_b, reached = [], [], []
    for seed in range(n):
        if not waiting[seed]:
            continue
        waiting[seed] = False
        left -= 1
        reached.append(seed)
        while reached and left:
            if 2 * left < indexed:  # only those not yet reached stay in the index
                stay = waiting[post]
                post_term, post, indexed = post_term[stay], post[stay], left
                starts = np.searchsorted(post_term, np.arange(len(term) + 1))
            x = reached.pop()
            t = term[at[x] : at[x + 1]]
            many = starts[t + 1] - starts[t]
            where = np.repeat(starts[t] - np.cumsum(many) + many, many) + np.arange(many.sum())
            common = np.bincount(post[where], minlength=n)
            near = np.flatnonzero(waiting & ((up + down) * common >= up * (size + size[x])))
            waiting[near] = False
            left -= len(near)
            reached += near.tolist()
            out_a += [x] * len(near)
            out_b += near.tolist()
        reached.clear()
    return out_a, out_b


def verified(members: DataFrame) -> DataFrame:
    """members (comp, node, shingles, n) -> (a, b): links with the components of all links inside each comp."""
    blocks = members.groupBy("comp").agg(F.greatest(F.ceil(F.sum("n") / MASS), F.lit(1)).cast("int").alias("blocks")).withColumnRenamed("comp", "k")
    m = members.join(blocks, F.col("comp") == F.col("k")).drop("k")
    m = m.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    m = m.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).filter("own <> other OR blocks = 1")
    m = m.select("comp", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node", "shingles")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in sorted_groups(batches, ["comp", "i", "j"]):
            keys = [t.column(c).to_numpy() for c in ("comp", "i", "j")]
            node, raw = t.column("node").to_numpy(), t.column("shingles").to_pylist()
            cuts = np.flatnonzero(np.logical_or.reduce([np.diff(k) != 0 for k in keys])) + 1
            a, b = [], []
            for lo, hi in zip([0, *cuts], [*cuts, len(node)], strict=True):
                x, y = linked([np.frombuffer(s, dtype="<u8") for s in raw[lo:hi]])
                a.append(node[lo + np.array(x, dtype=np.int64)])
                b.append(node[lo + np.array(y, dtype=np.int64)])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    return m.repartition("comp", "i", "j").sortWithinPartitions("comp", "i", "j").mapInArrow(run, "a long, b long")


def near_copies(docs: DataFrame) -> DataFrame:
    """doc_id and component_id (smallest doc_id reachable) for every row with a doc_id."""
    docs = docs.filter("doc_id is not null").select("doc_id", "text")
    rows = materialize(signatures(docs), "near-rows")
    nodes = rows.groupBy("node").agg(F.min("doc_id").alias("least"), F.first("fp").alias("fp"), F.first("bands").alias("bands"))
    nodes = materialize(nodes, "near-nodes")
    found = materialize(components(candidates(nodes), "near-candidates"), "near-found")
    named = found.join(nodes.select(F.col("node").alias("k"), "least"), F.col("node") == F.col("k"))
    texts = docs.join(named.select(F.col("least").alias("first_id")).distinct(), F.col("doc_id") == F.col("first_id"), "left_semi")
    whole = sets(texts).dropDuplicates(["node"]).withColumnRenamed("node", "k")
    members = materialize(found.join(whole, F.col("node") == F.col("k")).select(F.col("component").alias("comp"), "node", "shingles", "n"), "near-members")
    joined = components(verified(members), "near-links").withColumnRenamed("node", "k")
    of_node = nodes.select("node", "least").join(joined, F.col("node") == F.col("k"), "left").select("node", "least", F.coalesce("component", "node").alias("component"))
    heads = of_node.groupBy("component").agg(F.min("least").alias("component_id")).withColumnRenamed("component", "c")
    names = materialize(of_node.join(heads, F.col("component") == F.col("c")).select(F.col("node").alias("k"), "component_id"), "near-names")
    return rows.select("doc_id", "node").join(names, F.col("node") == F.col("k")).select("doc_id", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs``, all columns, with one document of each group of near copies: that of the smallest doc_id; of rows that
    repeat this id, the first by text.  Rows with a null doc_id cannot be named by a group and stay."""
    return simhash.heads_only(docs, near_copies(docs))
