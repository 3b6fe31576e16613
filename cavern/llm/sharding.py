"""Operator 2: shards of near-equal bytes by Karmarkar-Karp differencing over indivisible groups.

Equal texts form a group that stays together. Groups are hashed into buckets of bounded size; each bucket is
differenced into a fixed number of parts, and the parts are groups of the next level, until one bucket is left,
which is differenced into the shards. The number of levels follows the logarithm of the number of groups, and no
level holds more than a bucket in one task. Some groups of each bucket stay apart for the next level's use. A group that outweighs a shard's share stays a part of its own on
every level, and the other groups fill the remaining shards.

Defined cases: a null text has no bytes and is grouped with the empty text; rows that repeat a doc_id or are
null there are rows like any other; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, n_parts, unsigned_crc32

#: Groups that one task differences.
BUCKET_ITEMS = 20_000
#: Parts that a bucket leaves to the next level.
BUCKET_PARTS = 256
#: Groups of a bucket, over all sizes, that go to the next level as they are, to even out parts that are equal.
BUCKET_SINGLES = 64
#: Rows of a shard that one task numbers.
SLOT_ROWS = 100_000


def karmarkar_karp(sizes: np.ndarray, n: int) -> np.ndarray:
    """The part, 0 to n-1, of each size: the two partial partitions of largest spread are combined, in opposite order."""
    if not len(sizes):
        return np.empty(0, np.int32)
    sums = []
    for s in sizes.tolist():
        own = np.zeros(n, np.int64)
        own[0] = s
        sums.append(own)
    heap = [(-s, k) for k, s in enumerate(sizes.tolist())] if n > 1 else [(0, k) for k in range(len(sizes))]
    heapq.heapify(heap)
    merges: list[tuple[int, int, np.ndarray]] = []
    while len(heap) > 1:
        (_, a), (_, b) = heapq.heappop(heap), heapq.heappop(heap)
        both = sums[a] + sums[b][::-1]
        order = np.argsort(-both, kind="stable")
        both = both[order]
        sums[a] = sums[b] = None
        merges.append((a, b, order.astype(np.int16)))
        sums.append(both)
        heapq.heappush(heap, (int(both[-1] - both[0]), len(sums) - 1))
    slots: dict[int, np.ndarray] = {len(sums) - 1: np.arange(n)}
    for k in range(len(merges) - 1, -1, -1):
        (a, b, order), final = merges[k], slots.pop(len(sizes) + k)
        of_a = np.empty(n, np.int64)
        of_a[order] = final
        slots[a], slots[b] = of_a, of_a[::-1]
    return np.array([slots[k][0] for k in range(len(sizes))], np.int32)


def level(items: DataFrame, buckets: int, parts: int, singles: int = 0) -> DataFrame:
    """(item, size) to (item, size, parent): each bucket's items differenced into parts, but for singles kept apart."""

    def difference(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "item"], ascending=[False, True], ignore_index=True)
        apart = min(singles, len(pdf) // 8)
        single = np.zeros(len(pdf), bool)
        single[np.linspace(0, len(pdf) - 1, apart).astype(np.int64)] = True
        part = np.empty(len(pdf), np.int64)
        part[~single] = karmarkar_karp(pdf["size"].to_numpy()[~single], parts)
        part[single] = parts + np.arange(single.sum())
        return pd.DataFrame({"item": pdf["item"], "size": pdf["size"], "parent": int(key[0]) * (parts + singles) + part})

    kind = items.schema["item"].dataType.simpleString()
    return items.groupBy(F.pmod(F.xxhash64("item"), F.lit(buckets)).alias("bucket")).applyInPandas(difference, f"item {kind}, size long, parent long")


def shard_groups(groups: DataFrame, n_shards: int, bucket_items: int = BUCKET_ITEMS) -> DataFrame:
    """(item, size) to (item, shard)."""
    rows, own = groups.count(), groups
    parts = max(1, min(BUCKET_PARTS, bucket_items // 8))  # so that each level has at most a quarter of the items below
    levels = []
    while rows > bucket_items:
        own = checkpointed(level(own, n_parts(rows, bucket_items // 2), parts, BUCKET_SINGLES))
        levels.append(own)
        own = own.groupBy(F.col("parent").alias("item")).agg(F.sum("size").alias("size"))
        rows = own.count()
    found = level(own, 1, n_shards).select("item", F.col("parent").cast("int").alias("shard"))
    for below in reversed(levels):
        found = below.select("item", "parent").join(found.select(F.col("item").alias("parent"), "shard"), "parent").select("item", "shard")
    return found


def numbered(rows: DataFrame, part: str, order: list[str], each: int = SLOT_ROWS) -> DataFrame:
    """rows with `slot`, gapless from 0 within each `part`: counted in hashed buckets, then numbered within them."""
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64(*order), F.lit(n_parts(rows.count(), each))))
    counts = rows.groupBy(part, "bucket").count()
    before = Window.partitionBy(part).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(part, "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    own = rows.withColumn("at", F.row_number().over(Window.partitionBy(part, "bucket").orderBy(*order)))
    return own.join(starts, [part, "bucket"]).withColumn("slot", F.col("start") + F.col("at") - 1).drop("bucket", "start", "at")


def shard(docs: DataFrame, n_shards: int = 16, bucket_items: int = BUCKET_ITEMS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every document."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), unsigned_crc32(F.col("text")).alias("text_crc32"), F.unhex(F.md5(text)).alias("item"))
    groups = rows.groupBy("item").agg(F.sum("size").alias("size"))
    placed = checkpointed(rows.join(shard_groups(groups, n_shards, bucket_items), "item").drop("item"))
    return numbered(placed, "shard", ["doc_id", "text_crc32", "size"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
