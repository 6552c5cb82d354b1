"""Exact top-k inner products over an impact-ordered index, score at a time.

Vectors are quantised to integers and dealt by a hash of the id into index blocks.  In a block every dimension has its
postings in falling order of impact (the absolute value), cut into segments of equal quantised impact.  A query takes
segments of all dimensions in falling order of query weight times impact and adds them to accumulators; what is left
of each dimension bounds what any score can still change.  A block is left early only when that bound proves that few
vectors can still reach the k-th score; those are scored again exactly.  A task carries each query's k-th score from
one of its blocks to the next.

Queries go out in rounds of about ``QUERIES`` (a bounded broadcast), each over the whole index.

Defined results: null vectors and vectors with null or non-finite components take no part; vectors are compared only
with vectors of equal length; a query's own row and rows that repeat its id are no candidates; repeated candidates
count each; ties go to the smaller id; fewer than k candidates give fewer rows; scores are 64-bit integers, and a
vector with a component so large that a score could wrap is an error; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

K, SCALE = 10, 1024
BLOCK, QUERIES = 4096, 8192
IMPACT_BITS = 5
#: A block is left when at most this share of it can still be in the result; accumulators are looked at so often.
FEW, LOOKS = 1 / 16, 4


def usable(vector: Column) -> Column:
    """Whether an array is there and all its components are finite numbers."""
    inf = F.lit(float("inf"))
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) != inf)), F.lit(False))


class Block:
    """An index over the rows of an integer matrix."""

    def __init__(self, ids: np.ndarray, values: np.ndarray) -> None:
        self.ids, self.values = ids, values
        n, dims = values.shape
        impact = np.abs(values)
        self.order = np.argsort(-impact, axis=0, kind="stable").T.astype(np.int32).copy()  # postings of each dimension
        self.posted = np.take_along_axis(values, self.order.T.astype(np.int64), axis=0).T.astype(np.float64).copy()
        level = np.abs(self.posted).astype(np.int64) >> IMPACT_BITS
        new = np.ones((dims, n), dtype=bool)
        new[:, 1:] = level[:, 1:] != level[:, :-1]
        self.segment_dim, self.segment_start = np.nonzero(new)
        self.segment_impact = np.abs(self.posted[self.segment_dim, self.segment_start])
        ends = np.append(self.segment_start[1:], n)
        self.segment_end = np.where(np.append(self.segment_dim[1:], dims) != self.segment_dim, n, ends)
        # sums stay exact in doubles below this
        self.safe = not n or dims * float(impact.max(initial=0)) < 2**26

    def search(self, query_id: int, query: np.ndarray, k: int, floor: float) -> tuple[np.ndarray, np.ndarray]:
        """Ids and exact scores of all rows that can be among the k best and reach ``floor``."""
        n, dims = self.values.shape
        possible = np.flatnonzero(self.ids != query_id)
        if self.safe and dims and n and float(np.abs(query).max(initial=0)) < 2**26:
            possible = self._possible(possible, query.astype(np.float64), k, floor)
        return self.ids[possible], self.values[possible] @ query

    def _possible(self, rows: np.ndarray, query: np.ndarray, k: int, floor: float) -> np.ndarray:
        n, dims = self.values.shape
        weight = np.abs(query)
        gain = weight[self.segment_dim] * self.segment_impact
        order = np.argsort(-gain, kind="stable")
        size = np.cumsum((self.segment_end - self.segment_start)[order])
        cuts = np.unique(np.searchsorted(size, n * dims * np.arange(1, LOOKS + 1) / LOOKS) + 1)
        acc, done, at = np.zeros(n), np.zeros(dims, dtype=np.int64), 0
        few = max(4 * k, int(n * FEW))
        for cut in cuts:
            part = order[at : cut]
            at = cut
            reach = done.copy()
            np.maximum.at(reach, self.segment_dim[part], self.segment_end[part])
            moved = np.flatnonzero(reach > done)  # segments of a dimension come in order, so each adds one stretch
            which = np.concatenate([self.order[d, done[d] : reach[d]] for d in moved])
            acc += np.bincount(which, weights=np.concatenate([query[d] * self.posted[d, done[d] : reach[d]] for d in moved]), minlength=n)
            done = reach
            left = done < n
            rest = float((weight[left] * np.abs(self.posted[left, done[left]])).sum())
            now = acc[rows]
            least = max(floor, float(np.partition(now, len(now) - k)[len(now) - k]) - rest if len(now) > k else -np.inf)
            rows = rows[now + rest >= least]
            if len(rows) <= few or not rest:
                break
        return rows


def search(vectors: DataFrame, is_query: Column, k: int = K) -> DataFrame:
    """``vectors`` (vec_id, embedding) -> query_id, rank, vec_id, score for the rows where ``is_query`` holds."""
    spark = vectors.sparkSession
    v = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("e"), is_query.alias("q")).filter(usable(F.col("e")) & F.col("vec_id").isNotNull())
    most = F.sqrt(F.lit(float(1 << 62)) / F.greatest(F.size("e"), F.lit(1)))  # products of two such vectors stay below 2**62
    large = F.exists("e", lambda x: F.abs(x * SCALE) > most)
    whole = F.when(large, F.raise_error(F.lit("a component is too large for scores of 64 bits"))).otherwise(F.transform("e", lambda x: F.floor(x * SCALE)))
    v = materialize(v.select("vec_id", whole.alias("e"), F.coalesce("q", F.lit(False)).alias("q")), "topk-vectors")
    total, asked = v.agg(F.count("*"), F.coalesce(F.sum(F.col("q").cast("long")), F.lit(0))).first()
    rounds = max(1, -(-asked // QUERIES))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            lengths = np.array([len(x) for x in rows.column(1)], dtype=np.int64)
            for d in np.unique(lengths):
                own = rows.filter(pa.array(lengths == d))
                values = own.column(1).flatten().to_numpy().reshape(own.num_rows, d).astype("<i8")
                yield pa.RecordBatch.from_arrays([pa.array([int(d)], pa.int32()), pa.array([own.column(0).to_numpy().astype("<i8").tobytes()], pa.binary()), pa.array([values.tobytes()], pa.binary())], names=["dims", "ids", "matrix"])

    blocks = v.select("vec_id", "e").repartition(max(1, -(-total // BLOCK)), "vec_id").mapInArrow(build, "dims int, ids binary, matrix binary")
    blocks = materialize(blocks, "topk-blocks")
    out = None
    for r in range(rounds):
        asked_now = v.filter(F.col("q") & (F.pmod(F.xxhash64("vec_id"), F.lit(rounds)) == r)).select("vec_id", "e").distinct().collect()  # about QUERIES rows
        held = spark.sparkContext.broadcast({d: ([q["vec_id"] for q in asked_now if len(q["e"]) == d], np.array([q["e"] for q in asked_now if len(q["e"]) == d], dtype=np.int64).reshape(-1, d)) for d in {len(q["e"]) for q in asked_now}})

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            best: dict[tuple[int, int], list[tuple[int, int]]] = {}
            for b in batches:
                for dims, ids, matrix in zip(*[b.column(i).to_pylist() for i in range(3)], strict=True):
                    if dims not in held.value:
                        continue
                    ids = np.frombuffer(ids, dtype="<i8")
                    block = Block(ids, np.frombuffer(matrix, dtype="<i8").reshape(len(ids), dims))
                    names, queries = held.value[dims]
                    for i, name in enumerate(names):
                        have = best.get((dims, i), [])
                        found, score = block.search(name, queries[i], k, -have[-1][0] if len(have) == k else -np.inf)
                        top = np.lexsort((found, -score))[:k]
                        best[dims, i] = sorted(have + list(zip((-score[top]).tolist(), found[top].tolist(), strict=True)))[:k]
            rows = [(held.value[d][0][i], i, x, -s) for (d, i), top in best.items() for s, x in top]
            yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in rows], pa.int64()) for j in range(4)], names=["query_id", "nth", "vec_id", "score"])

        part = blocks.mapInArrow(run, "query_id long, nth long, vec_id long, score long").withColumn("round", F.lit(r))
        out = part if out is None else out.unionByName(part)
    rank = F.row_number().over(Window.partitionBy("round", "query_id", "nth").orderBy(F.col("score").desc(), "vec_id"))
    return out.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
