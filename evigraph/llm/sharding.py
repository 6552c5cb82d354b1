"""Sharding by vector bin packing: bytes, tokens and rows are balanced jointly.

Rows of equal text form a group, and each group is placed on the shard whose residual capacity has the highest dot
product with the group's (bytes, tokens, rows), largest first.  Groups with more than 1 / ``UNITS`` of the bytes, tokens
or rows are placed one by one (at most 3 * UNITS of them); smaller ones are gathered by a hash into ``UNITS`` units of
whole groups, so what the driver packs does not grow with the data.  A group is dealt to several shards only if the
shards' bytes would differ by more than ``UNEVEN`` otherwise: the groups above a share are split row by row, and the share
is halved, from one shard's on, until the shards are even or it is ``FINEST``.

Defined results: a null text has no bytes (size 1, crc32 0) and is a group of its own; repeated rows get slots of
their own; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, word_count

SHARDS = 8
UNITS = 4096
UNEVEN, FINEST = 0.02, 1 / 1024
#: A split group has this many parts for each share at which groups are split.
PARTS = 8


def place(vectors: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each row of ``vectors`` (items x dimensions) by the dot-product rule; the same input gives the same result."""
    total = vectors.sum(axis=0)
    share = vectors / np.where(total > 0, total, 1)
    residual = np.full((shards, vectors.shape[1]), 1 / shards)
    out = np.zeros(len(vectors), dtype=np.int64)
    for i in np.argsort(-share.max(axis=1), kind="stable"):
        score = residual @ share[i]
        fits = (residual >= share[i] - 1e-12).all(axis=1)
        k = int(np.argmax(np.where(fits, score, -np.inf) if fits.any() else score))
        out[i] = k
        residual[k] -= share[i]
    return out


def parts_of(units: np.ndarray, groups: np.ndarray, shards: int) -> np.ndarray:
    """How many parts each group is split into: the fewest groups that leave the shards' bytes even.  Rows of ``units``
    and ``groups``: bytes, tokens, rows."""
    parts = np.ones(len(groups), dtype=np.int64)
    total = units.sum(axis=0) + groups.sum(axis=0)
    share = (groups / np.where(total > 0, total, 1)).max(axis=1) if len(groups) else np.zeros(0)
    least = 1 / shards
    while True:
        items = np.concatenate([units, np.repeat(groups / parts[:, None], parts, axis=0)])
        of_shard = np.bincount(place(items, shards), weights=items[:, 0], minlength=shards)
        if of_shard.max(initial=0) <= (1 + UNEVEN) * total[0] / shards or least < FINEST:
            return parts
        parts = np.where(share > least, np.clip(np.ceil(share / least * PARTS), 1, np.maximum(groups[:, 2], 1)), 1).astype(np.int64)
        least /= 2


def shard(docs: DataFrame, shards: int = SHARDS, units: int = UNITS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, tokens for every row."""
    spark = docs.sparkSession
    text = F.col("text")
    digest = materialize(
        docs.select(
            "doc_id", (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1).alias("size"), F.crc32(F.coalesce(text, F.lit(""))).alias("text_crc32"), word_count(text).alias("tokens"),
            F.xxhash64(text).alias("key"), F.monotonically_increasing_id().alias("row"),
        ),
        "shard-digest",
    )
    sums = [F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows")]
    total = digest.agg(*sums).first()
    share = F.greatest(*[F.col(k) / F.lit(max(total[k] or 0, 1)) for k in ("bytes", "tokens", "rows")])
    groups = materialize(digest.groupBy("key").agg(*sums), "shard-groups")
    large = groups.filter(share > 1 / units).orderBy("key").collect()  # at most 3 * units
    small = groups.filter(share <= 1 / units).groupBy(F.pmod("key", F.lit(units)).cast("int").alias("unit")).agg(*[F.sum(k).alias(k) for k in ("bytes", "tokens", "rows")]).orderBy("unit").collect()
    vector = lambda rows: np.array([[r["bytes"], r["tokens"], r["rows"]] for r in rows], dtype=float).reshape(-1, 3)
    parts = parts_of(vector(small), vector(large), shards)
    known = spark.createDataFrame([(r["key"], units + i, int(p)) for i, (r, p) in enumerate(zip(large, parts, strict=True))], "k long, item int, parts int")
    d = digest.join(F.broadcast(known), F.col("key") == F.col("k"), "left").withColumn("unit", F.coalesce("item", F.pmod("key", F.lit(units)).cast("int")))
    d = d.withColumn("part", F.coalesce(F.pmod(F.xxhash64("doc_id", "row"), F.col("parts")), F.lit(0)).cast("int"))
    whole = [(r["unit"], 0, r) for r in small] + [(units + i, 0, r) for i, (r, p) in enumerate(zip(large, parts, strict=True)) if p == 1]
    split = [] if (parts == 1).all() else [(r["unit"], r["part"], r) for r in d.filter("parts > 1").groupBy("unit", "part").agg(*sums).orderBy("unit", "part").collect()]
    items = whole + split
    used, rows = [0] * shards, []
    for (unit, part, r), k in zip(items, place(vector([r for _, _, r in items]), shards), strict=True):
        rows.append((unit, part, int(k), used[k]))
        used[k] += r["rows"]
    placed = spark.createDataFrame(rows, "unit int, part int, shard int, base long")
    within = Window.partitionBy("unit", "part").orderBy("doc_id", "text_crc32", "size", "row")
    d = d.withColumn("nth", F.row_number().over(within).cast("long")).join(F.broadcast(placed), ["unit", "part"])
    return d.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("base") + F.col("nth") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "tokens")
