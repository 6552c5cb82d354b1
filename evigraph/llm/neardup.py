"""Embedding near-duplicates by NN-descent.

Equal vectors (of equal label) are one node.  A first neighbour graph comes from sorted random projections; then
rounds of neighbours-of-neighbours joins refine it: the nodes around a centre are compared with each other, and each
keeps its nearest ``NEAREST``.  Vectors travel as 8-bit numbers there.  A list that is full of edges above the threshold
is saturated and hides others, so every edge that was met near the threshold is kept besides the lists, and each
further round doubles the lists.  All these edges give candidate components, whose members are compared in blocks,
exactly and in double precision.  So what is reported is right for every pair inside a candidate component, and only a
pair in no path of edges can be missed.

A round descends until less than a tenth of the lists' entries is new, and compares new entries with all, never old ones
with old ones again; centres without a new entry rest.  The codes' bits grow with the rows.

An audit compares nodes with all rows exactly and counts nodes, not links: a node with links is whole if all of them
were found.  It draws from two parts: nodes that are in a candidate component, and all others, of which any with a link was
missed; each part's findings stand for its size.  While fewer than ``RECALL`` of the nodes with links are whole,
another round with new projections follows, up to ``AUDITS`` times; after that all pairs are compared, in blocks, of those
labels in which the audit found a node that is not whole.  The share is reported.

Defined results: labels of any type are compared as they are; null labels, null, empty, zero and non-finite vectors link with nothing; vectors of different length
neither; repeated rows are vectors of their own (their ids make one component); an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, materialize, sorted_groups
from .components import components
from .topk import usable

log = logging.getLogger(__name__)
THRESHOLD = 0.98
NEAREST = 12
#: Descents go on while more than this share of the list entries is new.
CHANGED = 0.1
TABLES, BITS, STRETCH = 8, 12, 4
#: What 8-bit numbers may take from a cosine, with room.
BLUR = 0.008
BLOCK = 1024
#: Nodes that are compared at a time, and of each part at most; nodes with links to be seen in a part; rounds.
AUDITED, MOST, SEEN, RECALL, AUDITS = 512, 4096, 200, 0.99, 2
#: Partners of a node that a centre passes on, besides a spanning forest of all pairs near the threshold.
OFFERS = 4


def unit(values: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, in double precision."""
    v = values.astype(np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _matrix(t, name: str = "e") -> np.ndarray:
    column = t.column(name).combine_chunks() if isinstance(t, pa.Table) else t.column(t.schema.get_field_index(name))
    return column.flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1)


def _small(u: np.ndarray) -> list[bytes]:
    top = np.abs(u).max(axis=1, keepdims=True)
    q = np.rint(u / top * 127).astype(np.int8)
    scale = (top[:, 0] / 127).astype("<f4")
    return [s.tobytes() + r.tobytes() for s, r in zip(scale, q, strict=True)]


def _large(small: list[bytes]) -> np.ndarray:
    raw = np.frombuffer(b"".join(small), dtype=np.uint8).reshape(len(small), -1)
    return raw[:, 4:].view(np.int8).astype(np.float32) * raw[:, :4].copy().view("<f4")


def _edges(a: np.ndarray, b: np.ndarray, sim: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(sim, pa.float32())], names=["a", "b", "sim"])


def first_graph(nodes: DataFrame, seed: int, bits: int = BITS) -> DataFrame:
    """Both directions of edges between neighbours in sorted projections, with codes of ``bits`` bits."""

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lengths = np.array([len(x) for x in b.column(2)], dtype=np.int64)
            for d in np.unique(lengths):
                own = b.filter(pa.array(lengths == d))
                u = unit(_matrix(own))
                small = pa.array(_small(u), pa.binary())
                for t in range(TABLES):
                    planes = np.random.default_rng([seed, t, int(d)]).normal(size=(d, bits + 1))
                    p = u @ planes
                    code = ((p[:, :bits] > 0) << np.arange(bits)).sum(axis=1)
                    n = own.num_rows
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, t, dtype=np.int32)), own.column(1), pa.array(np.full(n, d, dtype=np.int32)), pa.array(code, pa.int64()), pa.array(p[:, bits]), own.column(0), small], names=["t", "label", "dims", "code", "along", "node", "small"])

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail = None
        for b in batches:
            table = pa.Table.from_batches([b] if tail is None else [*tail.to_batches(), b]).combine_chunks()
            fresh = 0 if tail is None else tail.num_rows
            keys = [table.column(k).to_numpy() for k in ("t", "label", "dims")]
            node, small = table.column("node").to_numpy(), table.column("small").to_pylist()
            for lo in range(0, table.num_rows, 8192):  # with the few rows before, which earlier stretches end in
                hi = min(table.num_rows, lo + 8192)
                base = max(0, lo - STRETCH)
                wide = {len(x) for x in small[base:hi]}
                for w in wide:
                    at = np.array([i for i in range(base, hi) if len(small[i]) == w])
                    v = _large([small[i] for i in at])
                    for s in range(1, min(STRETCH, len(at) - 1) + 1):
                        i, j = at[:-s], at[s:]
                        keep = (j >= max(lo, fresh)) & np.logical_and.reduce([k[i] == k[j] for k in keys]) & (node[i] != node[j])
                        sim = np.einsum("ij,ij->i", v[:-s][keep], v[s:][keep])
                        yield _edges(np.concatenate([node[i[keep]], node[j[keep]]]), np.concatenate([node[j[keep]], node[i[keep]]]), np.concatenate([sim, sim]))
            tail = table.slice(max(0, table.num_rows - STRETCH)).combine_chunks()

    spread = nodes.select("node", "label", "e").mapInArrow(project, "t int, label long, dims int, code long, along double, node long, small binary")
    order = ["t", "label", "dims", "code", "along"]
    return spread.repartitionByRange(*order).sortWithinPartitions(*order, "node").mapInArrow(link, "a long, b long, sim float")


def nearest(edges: DataFrame, k: int = NEAREST) -> DataFrame:
    """Of each a, its k nearest b; of repeated edges the one that is least fresh."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in sorted_groups(batches, ["a"], 1 << 16):
            a, b, sim, fresh = (t.column(c).to_numpy() for c in ("a", "b", "sim", "fresh"))
            new = np.ones(len(a), dtype=bool)
            new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
            a, b, sim, fresh = a[new], b[new], sim[new], fresh[new]
            start = np.ones(len(a), dtype=bool)
            start[1:] = a[1:] != a[:-1]
            first = np.flatnonzero(start)
            place = np.arange(len(a)) - np.repeat(first, np.diff(np.append(first, len(a))))
            near = place < k
            yield pa.RecordBatch.from_arrays([pa.array(a[near], pa.int64()), pa.array(b[near], pa.int64()), pa.array(sim[near], pa.float32()), pa.array(fresh[near], pa.int32())], names=["a", "b", "sim", "fresh"])

    # equal pairs have equal similarities, so they stand side by side
    return edges.repartition("a").sortWithinPartitions("a", F.col("sim").desc(), "b", "fresh").mapInArrow(run, "a long, b long, sim float, fresh int")


def descend(lists: DataFrame, small: DataFrame, k: int, near: float) -> DataFrame:
    """One round: members of every centre's neighbourhood are compared with each other, if one of the two is new there.
    Edges that enter a list of k, and of all from ``near`` up at least a spanning forest."""
    from .simhash import forest

    popular = lists.groupBy("b").agg(F.count("*").alias("n")).select(F.col("b").alias("k"), "n")
    back = lists.join(popular, F.col("b") == F.col("k")).filter(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 20)) * F.col("n") < k << 20).select(F.col("b").alias("c"), F.col("a").alias("x"), "fresh")
    own = lists.select(F.col("a").alias("c"), F.col("a").alias("x")).distinct().withColumn("fresh", F.lit(0))
    around = lists.select(F.col("a").alias("c"), F.col("b").alias("x"), "fresh").unionAll(back).unionAll(own).groupBy("c", "x").agg(F.max("fresh").alias("fresh"))
    around = materialize(around, "nn-around")
    awake = around.filter("fresh = 1").select(F.col("c").alias("k")).distinct()
    around = around.join(awake, F.col("c") == F.col("k"), "left_semi")
    worst = lists.groupBy("a").agg(F.when(F.count("*") >= k, F.min("sim")).otherwise(F.lit(-2.0)).cast("float").alias("worst"))
    known = small.join(worst, small.node == worst.a, "left").select("node", "small", F.coalesce("worst", F.lit(-2.0)).cast("float").alias("worst"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in sorted_groups(batches, ["c"], 1 << 14):
            c, x, worst, fresh = (t.column(n).to_numpy() for n in ("c", "x", "worst", "fresh"))
            v = t.column("small").to_pylist()
            cuts = np.flatnonzero(np.diff(c)) + 1
            out_a, out_b, out_s = [], [], []
            for lo, hi in zip([0, *cuts], [*cuts, len(c)], strict=True):
                if hi - lo < 2 or len({len(y) for y in v[lo:hi]}) > 1:
                    continue
                m, new = _large(v[lo:hi]), fresh[lo:hi] > 0
                sim = m @ m.T
                sim[~(new[:, None] | new)] = -3
                np.fill_diagonal(sim, -3)
                top = np.argpartition(-sim, min(OFFERS, hi - lo - 1) - 1, axis=1)[:, : min(OFFERS, hi - lo - 1)]
                row, col = np.repeat(np.arange(hi - lo), top.shape[1]), top.ravel()
                close = sim >= near
                if (close.sum(axis=1) > OFFERS).any():
                    i, j = (np.array(e, dtype=np.int64) for e in forest(hi - lo, [np.nonzero(np.triu(close))]))
                    row, col = np.concatenate([row, i, j]), np.concatenate([col, j, i])
                s = sim[row, col]
                keep = (s > worst[lo + row]) | (s >= near)
                keep &= s > -3
                out_a.append(x[lo + row[keep]])
                out_b.append(x[lo + col[keep]])
                out_s.append(s[keep])
            if out_a:
                yield _edges(np.concatenate(out_a), np.concatenate(out_b), np.concatenate(out_s))

    met = around.join(known, F.col("x") == F.col("node")).select("c", "x", "small", "worst", "fresh")
    return met.repartition("c").sortWithinPartitions("c").mapInArrow(run, "c long, x long, sim float").toDF("a", "b", "sim")


def strong(edges: DataFrame, near: float) -> DataFrame:
    """Pairs a < b of the edges from ``near`` up; some repeat."""
    return edges.filter(F.col("sim") >= near).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def compare(members: DataFrame, threshold: float) -> DataFrame:
    """``members`` (comp, node, label, e, copies) -> rows (kind, a, b): kind 0: node a is linked with b vectors of other
    nodes; kind 1: a link, of those in a block a spanning forest.  All pairs of a component, in blocks."""
    from .simhash import forest

    size = members.groupBy("comp").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).withColumnRenamed("comp", "k")
    m = members.join(size, F.col("comp") == F.col("k")).drop("k")
    m = m.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    m = m.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    m = m.select("comp", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "label", "e", "copies")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in sorted_groups(batches, ["comp", "i", "j"], 1 << 10):
            comp, bi, bj, own, node, label, copies = (t.column(c).to_numpy() for c in ("comp", "i", "j", "own", "node", "label", "copies"))
            lengths = np.array([len(x) for x in t.column("e")])
            flat, at = t.column("e").combine_chunks().flatten().to_numpy(zero_copy_only=False), np.cumsum(lengths) - lengths
            cuts = np.flatnonzero((np.diff(comp) != 0) | (np.diff(bi) != 0) | (np.diff(bj) != 0)) + 1
            kind, a, b = [], [], []
            for lo, hi in zip([0, *cuts], [*cuts, len(comp)], strict=True):
                here = np.arange(lo, hi)
                for d in np.unique(lengths[lo:hi]):
                    rows = here[lengths[lo:hi] == d]
                    u = unit(flat[(at[rows][:, None] + np.arange(d)).ravel()].reshape(len(rows), d))
                    linked = (u @ u.T >= threshold) & (label[rows][:, None] == label[rows])
                    if bi[lo] != bj[lo]:
                        linked &= own[rows][:, None] != own[rows]
                    np.fill_diagonal(linked, False)
                    count = linked @ copies[rows]
                    some = count > 0
                    kind += [0] * int(some.sum())
                    a += node[rows][some].tolist()
                    b += count[some].tolist()
                    x, y = forest(len(rows), [np.nonzero(np.triu(linked))])
                    kind += [1] * len(x)
                    a += node[rows[x]].tolist() if x else []
                    b += node[rows[y]].tolist() if y else []
            yield pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["kind", "a", "b"])

    return m.repartition("comp", "i", "j").sortWithinPartitions("comp", "i", "j").mapInArrow(run, "kind int, a long, b long")


def audit(nodes: DataFrame, candidates: DataFrame, counts: DataFrame, threshold: float, seed: int) -> tuple[float, list[int]]:
    """Share of the nodes with links whose links were all found, as estimated, and the labels of those that were not.

    ``candidates`` (node): those in a candidate component.  Of them and of the others, each on its own, nodes are drawn by a
    hash until ``SEEN`` with links are known, or ``MOST`` were drawn, or all.
    """
    inside = nodes.join(candidates.select(F.col("node").alias("k")), F.col("node") == F.col("k"), "left_semi")
    outside = nodes.join(candidates.select(F.col("node").alias("k")), F.col("node") == F.col("k"), "left_anti")
    whole = short = 0.0
    labels: set[int] = set()
    for part in (inside, outside):
        part = materialize(part.select("node", "label", "e"), "nn-audit")
        n, drawn, good, bad = part.count(), 0, 0, 0
        while drawn < min(n, MOST) and good + bad < SEEN:
            found, missed, where = audit_some(part, nodes, counts, threshold, seed, drawn)
            good, bad, drawn = good + found, bad + missed, min(n, drawn + AUDITED)
            labels |= where
        whole, short = whole + good * n / max(drawn, 1), short + bad * n / max(drawn, 1)
        discard(part)
    return whole / (whole + short) if short else 1.0, sorted(labels)


def audit_some(part: DataFrame, nodes: DataFrame, counts: DataFrame, threshold: float, seed: int, skip: int) -> tuple[int, int, set[int]]:
    """Of AUDITED nodes of ``part`` after the first ``skip``, those with links: how many are whole, how many are not, and
    the labels of these."""
    some = part.orderBy(F.xxhash64("node", F.lit(seed)), "node").offset(skip).limit(AUDITED).collect()
    held = nodes.sparkSession.sparkContext.broadcast([(r["node"], r["label"], np.array(r["e"], dtype=np.float64)) for r in some])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(held.value), dtype=np.int64)
        for b in batches:
            lengths = np.array([len(x) for x in b.column(2)], dtype=np.int64)
            for d in np.unique(lengths):
                own = b.filter(pa.array(lengths == d))
                u, node, label, copies = unit(_matrix(own)), own.column(0).to_numpy(), own.column(1).to_numpy(), own.column(3).to_numpy()
                at = [i for i, q in enumerate(held.value) if len(q[2]) == d]
                if at:
                    near = u @ unit(np.array([held.value[i][2] for i in at])).T >= threshold
                    near &= (label[:, None] == np.array([held.value[i][1] for i in at])) & (node[:, None] != np.array([held.value[i][0] for i in at]))
                    total[at] += copies @ near
        yield pa.RecordBatch.from_arrays([pa.array([q[0] for q in held.value], pa.int64()), pa.array(total)], names=["node", "n"])

    truth = nodes.select("node", "label", "e", "copies").mapInArrow(run, "node long, n long").groupBy("node").agg(F.sum("n").alias("n"))
    met = truth.filter("n > 0").join(counts.select(F.col("node").alias("k"), "links"), F.col("node") == F.col("k"), "left").select("node", (F.coalesce("links", F.lit(0)) >= F.col("n")).alias("whole")).collect()
    label = {r["node"]: r["label"] for r in some}
    bad = [r["node"] for r in met if not r["whole"]]
    return len(met) - len(bad), len(bad), {label[x] for x in bad}


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, report: dict | None = None) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row.  ``report`` gets recall (the audit's share after the last round)
    and compared (the number of labels of which all pairs were compared then)."""
    # whole numbers are their own keys, labels of other kinds get hashed ones; 0.0 and -0.0 are one label
    kind = vectors.schema["label"].dataType
    label = F.col("label").cast("long") if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)) else F.xxhash64(F.col("label") + F.lit(0.0) if isinstance(kind, (T.FloatType, T.DoubleType)) else F.col("label"))
    label = F.when(F.col("label").isNotNull(), label)
    v = vectors.select("vec_id", label.alias("label"), F.col("embedding").cast("array<double>").alias("e"))
    good = F.col("label").isNotNull() & usable(F.col("e")) & F.coalesce(F.exists("e", lambda x: x != 0), F.lit(False))
    v = materialize(v.withColumn("good", F.coalesce(good, F.lit(False))), "nn-rows")
    nodes = v.filter("good").groupBy("label", "e").agg(F.count("*").alias("copies"), F.min("vec_id").alias("least"))
    nodes = materialize(nodes.withColumn("node", F.monotonically_increasing_id()), "nn-nodes")

    def shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lengths = np.array([len(x) for x in b.column(1)], dtype=np.int64)
            for d in np.unique(lengths):
                own = b.filter(pa.array(lengths == d))
                yield pa.RecordBatch.from_arrays([own.column(0), pa.array(_small(unit(_matrix(own))), pa.binary())], names=["node", "small"])

    def compared(members: DataFrame) -> tuple[DataFrame, DataFrame]:
        links = materialize(compare(members, threshold), "nn-links")
        return links, materialize(links.filter("kind = 0").groupBy(F.col("a").alias("node")).agg(F.sum("b").alias("links")), "nn-counts")

    n = nodes.count()
    share, short = 1.0, []
    bits = min(62, max(BITS, (n // 16).bit_length()))  # some 16 vectors a code
    small = materialize(nodes.select("node", "e").mapInArrow(shrink, "node long, small binary"), "nn-small")
    lists, kept, near = None, [], threshold - BLUR
    for turn in range(AUDITS + 1):
        k = NEAREST << turn
        more = materialize(first_graph(nodes, turn, bits), "nn-first")
        kept.append(materialize(strong(more, near), "nn-strong"))
        old, met = F.lit(0).alias("fresh"), F.lit(1).alias("fresh")
        more_edges = more.select("a", "b", "sim", met)
        lists = materialize(nearest(more_edges if lists is None else lists.select("a", "b", "sim", old).unionAll(more_edges), k), "nn-lists")
        discard(more)
        while True:
            offers = materialize(descend(lists, small, k, near), "nn-offers")
            kept.append(materialize(strong(offers, near), "nn-strong"))
            following = materialize(nearest(lists.select("a", "b", "sim", old).unionAll(offers.select("a", "b", "sim", met)), k), "nn-lists")
            entries, new = following.agg(F.count("*"), F.coalesce(F.sum("fresh"), F.lit(0))).first()
            discard(lists)
            discard(offers)
            lists = following
            if new <= CHANGED * entries:
                break
        found = components(reduce(DataFrame.unionAll, kept), "nn-near")
        members = found.join(nodes, "node").select(F.col("component").alias("comp"), "node", "label", "e", "copies")
        links, counts = compared(members)
        share, short = audit(nodes, members, counts, threshold, turn)
        if share >= RECALL:
            short = []
            break
    if report is not None:
        report |= {"recall": share, "compared": len(short)}
    log.info("nodes with links whose links were all found: %.4f; labels compared whole: %d", share, len(short))
    if short:
        # labels are few where nodes are many; their nodes give up what was found of them for the comparison of all pairs
        of = nodes.select("node", "label").filter(F.col("label").isin(short)).select(F.col("node").alias("k"))
        other, other_counts = links.join(of, F.col("a") == F.col("k"), "left_anti"), counts.join(of, F.col("node") == F.col("k"), "left_anti")
        links, counts = compared(nodes.filter(F.col("label").isin(short)).select(F.col("label").alias("comp"), "node", "label", "e", "copies"))
        links, counts = links.unionByName(other), counts.unionByName(other_counts)
    joined = components(links.filter("kind = 1").select("a", "b"), "nn-joined").withColumnRenamed("node", "k")
    of_node = nodes.join(joined, F.col("node") == F.col("k"), "left").withColumn("component", F.coalesce("component", "node")).drop("k")
    heads = of_node.groupBy("component").agg(F.min("least").alias("head")).withColumnRenamed("component", "c")
    of_node = of_node.join(heads, F.col("component") == F.col("c")).join(counts.withColumnRenamed("node", "k"), F.col("node") == F.col("k"), "left")
    of_node = of_node.select(F.col("label").alias("l"), F.col("e").alias("ee"), F.col("head"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n"))
    linked = v.filter("good").join(of_node, (F.col("label") == F.col("l")) & (F.col("e") == F.col("ee"))).select("vec_id", F.col("n").alias("n_links"), F.col("head").alias("component_id"))
    alone = v.filter("not good").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
