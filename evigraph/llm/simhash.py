"""SimHash near-duplicates through a Gray-ordered hierarchical index.

A text's fingerprint has 64 bits from the XXH64 values of its word shingles.  Two fingerprints that differ in at
most ``2`` of 64 bits agree in at least two of four 16-bit blocks, so every pair meets under one of six masks; the
masked pattern is the top node of the index and the shuffle key.  Below it, fingerprints lie in the order of their
Gray rank, in which equal prefixes are neighbours: each further level factors eight more bits that a run shares into
one node.  A search walks pairs of nodes, adds up the differences of their patterns, and drops a pair of whole groups
as soon as the sum passes the limit, so what is expanded follows the links that exist and not the size of a group.

Equal fingerprints are one entry of the index, and there are at most 2,080 others within two bits of one; hot groups
of copies therefore stay small.  Of the links under one node a task passes on a spanning forest, which keeps
components whole.

Defined results: null, empty and word-less texts have fingerprint zero and are linked like others; fewer words than a
shingle give one shingle; repeated rows are copies; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import boxed, materialize, sorted_groups, unboxed
from .components import components

SEED = 42
MAX_DIFF = 2
BLOCKS = tuple(combinations(range(4), 2))
#: Node pairs that are expanded at a time, for memory.
EXPAND = 1 << 20


def shingle_hashes(text: bytes | None, words: int, seed: int = SEED) -> np.ndarray:
    """XXH64 values of a UTF-8 text's word shingles, in order and with repeats; none without words.  A-Z are
    lower-cased; fewer than ``words`` words are one shingle."""
    w = (text or b"").lower().split()
    if not w:
        return np.zeros(0, dtype="<u8")
    grams = [b" ".join(w)] if len(w) <= words else list(map(b" ".join, zip(*[w[i:] for i in range(words)], strict=False)))
    return np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(seed)), dtype="<u8", count=len(grams))


def fold(hashes: np.ndarray) -> int:
    """The fingerprint of shingles: each bit as most of them have it; 0 without any."""
    n = len(hashes)
    if not n:
        return 0
    h = np.zeros(-(-n // 255) * 255, dtype="<u8")  # added zeros set no bit
    h[:n] = hashes
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").reshape(-1, 255, 64)
    ones = bits.sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n, bitorder="little").tobytes(), "little")


def fingerprint(text: bytes | None, words: int, seed: int = SEED) -> int:
    """Of a UTF-8 text; A-Z are lower-cased, shingles have ``words`` words and count as often as they occur."""
    return fold(shingle_hashes(text, words, seed))


def fingerprints(docs: DataFrame, words: int) -> DataFrame:
    """doc_id and its fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints = np.array([fingerprint(t.as_py(), words) for t in b.column(1)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(prints, pa.int64())], names=["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("binary")).mapInArrow(run, f"doc_id {kind}, fp long")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of each 32-bit pattern in the reflected Gray order."""
    x = x.astype(np.uint32)
    for shift in (1, 2, 4, 8, 16):
        x = x ^ (x >> np.uint32(shift))
    return x


def _expand(starts_a: np.ndarray, n_a: np.ndarray, starts_b: np.ndarray, n_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All (i, j) with i from the a-range and j from the b-range of each row; also the row."""
    count = n_a * n_b
    row = np.repeat(np.arange(len(count)), count)
    k = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    return starts_a[row] + k // n_b[row], starts_b[row] + k % n_b[row], row


def linked_pairs(group: np.ndarray, tail: np.ndarray, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs i < j of equal ``group`` whose 32-bit ``tail`` differ in at most ``limit`` bits.

    Rows must be sorted by (group, Gray rank of tail), without repeats.
    """
    n = len(group)
    if not n:
        return
    levels, key = [], [group]
    for k in range(5):  # nodes of level k: runs of equal group and equal first 8k bits
        pattern = tail >> np.uint32(32 - 8 * k) if k else np.zeros(n, dtype=np.uint32)
        new = np.ones(n, dtype=bool)
        new[1:] = (group[1:] != group[:-1]) | (pattern[1:] != pattern[:-1])
        levels.append((np.flatnonzero(new), pattern[new] & np.uint32(255)))
    del key
    child = []  # first child and number of children of each node
    for k in range(4):
        first = np.searchsorted(levels[k + 1][0], levels[k][0])
        child.append((first, np.diff(np.append(first, len(levels[k + 1][0])))))
    top = np.arange(len(levels[0][0]))
    top = top[child[0][1] > 0]
    stack = [(0, top, top, np.zeros(len(top), dtype=np.int64))]
    while stack:
        k, a, b, acc = stack.pop()
        if k == 4:
            other = a != b
            if other.any():
                yield levels[4][0][a[other]], levels[4][0][b[other]]
            continue
        first, many = child[k]
        count = np.cumsum(many[a] * many[b])
        if len(a) > 1 and count[-1] > EXPAND:
            cut = min(max(1, int(np.searchsorted(count, EXPAND))), len(a) - 1)
            stack += [(k, a[cut:], b[cut:], acc[cut:]), (k, a[:cut], b[:cut], acc[:cut])]
            continue
        i, j, row = _expand(first[a], many[a], first[b], many[b])
        pattern = levels[k + 1][1]
        diff = acc[row] + np.bitwise_count(pattern[i] ^ pattern[j])
        keep = (diff <= limit) & ((a[row] != b[row]) | (i <= j))
        stack.append((k + 1, i[keep], j[keep], diff[keep]))


def forest(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> tuple[list[int], list[int]]:
    """Of the pairs, those that join two trees of n nodes."""
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out_a, out_b = [], []
    for a, b in pairs:
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            rx, ry = find(x), find(y)
            if rx != ry:
                root[max(rx, ry)] = min(rx, ry)
                out_a.append(x)
                out_b.append(y)
    return out_a, out_b


def links(prints: DataFrame, limit: int = MAX_DIFF, spanning: bool = False) -> DataFrame:
    """Distinct fingerprints (fp) -> pairs a < b that differ in 1 to ``limit`` bits (``limit`` at most 2).

    ``spanning``: only a forest of the pairs under each node, with the same components.
    """
    if limit > 2:
        raise ValueError("two of four blocks are sure to agree only up to two differing bits")
    block = [F.shiftrightunsigned("fp", 48 - 16 * i).bitwiseAND(F.lit(65535)) for i in range(4)]
    routes = []
    for c, (x, y) in enumerate(BLOCKS):
        rest = [i for i in range(4) if i not in (x, y)]
        pack = lambda p, q: F.shiftleft(p, 16).bitwiseOR(q)
        routes.append(F.struct((F.shiftleft(pack(block[x], block[y]), 3).bitwiseOR(F.lit(c))).alias("node"), pack(block[rest[0]], block[rest[1]]).alias("tail")))
    routed = prints.select("fp", F.explode(F.array(*routes)).alias("r")).select("r.node", "r.tail", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in sorted_groups(batches, ["node"], 1 << 17):
            node, tail, fp = (t.column(k).to_numpy() for k in ("node", "tail", "fp"))
            order = np.lexsort((gray_rank(tail), node))
            node, tail, fp = node[order], tail[order].astype(np.uint32), fp[order]

            def pairs() -> Iterator[tuple[np.ndarray, np.ndarray]]:
                for i, j in linked_pairs(node, tail, limit):
                    # a pair that agrees in more than two blocks belongs to the first mask it agrees under
                    differ = (fp[i] ^ fp[j]).view(np.uint64)
                    same = [(differ >> np.uint64(48 - 16 * k)) & np.uint64(65535) == 0 for k in range(4)]
                    first = np.argmax([same[x] & same[y] for x, y in BLOCKS], axis=0)
                    keep = first == (node[i] & 7)
                    yield i[keep], j[keep]

            found = [forest(len(fp), pairs())] if spanning else pairs()
            for i, j in found:
                a, b = fp[np.asarray(i, dtype=np.int64)], fp[np.asarray(j, dtype=np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    return routed.repartition("node").sortWithinPartitions("node").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, *, words: int = 3, limit: int = MAX_DIFF) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable) for every row."""
    prints = materialize(fingerprints(docs, words), "simhash")
    entries = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-entries")
    joined = components(links(entries.select("fp"), limit, spanning=True), "simhash-links")
    member = entries.join(joined, entries.fp == joined.node)
    head = member.groupBy("component").agg(F.min("least").alias("head"))
    member = member.join(head, "component").select(F.col("fp").alias("k"), "head")
    names = entries.join(member, entries.fp == member.k, "left").select(F.col("fp").alias("k"), F.coalesce("head", "least").alias("component_id"))
    names = materialize(names, "simhash-names")
    return prints.join(names, prints.fp == names.k).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def heads_only(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of ``docs`` that name their component in ``found`` (doc_id, component_id), one a doc_id, and those
    without a doc_id."""
    used = ["doc_id", "text"]
    box = boxed(docs, used)
    heads = found.filter("doc_id = component_id").select(F.col("doc_id").alias("head")).distinct()
    some = box.filter("doc_id is not null").join(heads, F.col("doc_id") == F.col("head"), "left_semi")
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("text", F.col("box").cast("string")))
    some = some.withColumn("nth", nth).filter("nth = 1").drop("nth")
    return unboxed(some.unionByName(box.filter("doc_id is null")), docs, used)


def keep_one(docs: DataFrame, *, words: int = 3, limit: int = MAX_DIFF) -> DataFrame:
    """``docs``, all columns, with one document of each near-duplicate group: that of the smallest doc_id; of rows
    that repeat this id, the first by text.  Rows with a null doc_id cannot be named by a group and stay."""
    found = near_duplicates(docs, words=words, limit=limit)
    return heads_only(docs, found)
