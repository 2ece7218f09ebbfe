"""Sharding by longest-processing-time scheduling.

Documents with the same text stay together. Groups are sorted by their size in
bytes, the largest first, and each goes to the least loaded shard (of equally
loaded ones the first), which a heap gives; no shard ends up with more than 4/3 of the
best possible load (Graham 1969).

Groups of one size are interchangeable, so the heap runs over the table of
sizes and how many groups have each; it gives every shard its number of groups
of each size. Where many groups share a size the same numbers follow from a water
level instead of so many pops. Groups of a size, in the order of their keys,
then fill the shards' numbers in shard order; their ranks are found in 256 parts of each
size. Only that table, whose length is the number of different sizes, is handled in one task.

Defined for every input: a null text is a group of its own; an empty text has
size 0; repeated rows are of one group and both count; ties go as said; rows with
a null id are placed with their text's group; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import runtime

SHARDS = 64


def spread(loads: np.ndarray, size: int, count: int) -> np.ndarray:
    """How many of ``count`` groups of ``size`` each shard gets; ``loads`` is brought up to date."""
    shards = len(loads)
    got = np.zeros(shards, np.int64)
    if size == 0:
        got[int(loads.argmin())] = count
    elif count <= 4 * shards:
        heap = [(int(x), k) for k, x in enumerate(loads)]
        heapq.heapify(heap)
        for _ in range(count):
            load, k = heap[0]
            got[k] += 1
            heapq.heapreplace(heap, (load + size, k))
    else:
        # the pops are the smallest of all load + i * size; find the level up to which they reach
        under = lambda t: np.where(loads <= t, (t - loads) // size + 1, 0)
        low, high = int(loads.min()), int(loads.max()) + size * count
        while low < high:
            mid = (low + high) // 2
            low, high = (low, mid) if under(mid).sum() >= count else (mid + 1, high)
        got = under(low - 1)
        left = count - int(got.sum())
        at = np.flatnonzero((loads <= low) & ((low - loads) % size == 0))
        got[at[:left]] += 1
    loads += got * size
    return got


def _schedule(shards: int):
    def run(batches):
        loads = np.zeros(shards, np.int64)
        for b in batches:
            sizes, ends, homes = [], [], []
            for size, count in zip(b.column("size").to_pylist(), b.column("count").to_pylist()):
                got = spread(loads, size, count)
                at = np.flatnonzero(got)
                sizes.append(size)
                ends.append(np.cumsum(got[at]).tolist())
                homes.append(at.tolist())
            yield pa.RecordBatch.from_arrays([pa.array(sizes, pa.int64()), pa.array(ends, pa.list_(pa.int64())), pa.array(homes, pa.list_(pa.int32()))], ["size", "ends", "homes"])

    return run


def assign(groups: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(key, size, shard) of ``groups(key, size)``, one row for each group."""
    table = groups.groupBy("size").count()
    plan = table.repartition(1).sortWithinPartitions(F.desc("size")).mapInArrow(_schedule(shards), "size long, ends array<long>, homes array<int>")
    # a popular size is cut by the leading byte of its keys: ranked part by part, after what the parts before it hold
    parted = groups.withColumn("part", F.shiftright("key", 56).cast("int"))
    before = Window.partitionBy("size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parted.groupBy("size", "part").count().withColumn("before", F.coalesce(F.sum("count").over(before), F.lit(0)))
    cuts = parts.select("size", "part", "before").join(plan, "size")
    ranked = parted.withColumn("own", F.row_number().over(Window.partitionBy("size", "part").orderBy("key")))
    at = F.size(F.filter("ends", lambda e: e < F.col("own") + F.col("before"))) + 1
    return ranked.join(cuts, ["size", "part"]).select("key", "size", F.element_at("homes", at).alias("shard"))


def shard(spark: SparkSession, docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, shard) of every document; ``size`` is its own."""
    base = runtime.shared_dir(spark)
    text = F.col("text").cast("string")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.when(text.isNotNull(), F.xxhash64(text)).otherwise(F.xxhash64(F.lit("null"), "doc_id")).alias("key"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("bytes"))
    own = runtime.stored(own, f"{base}/own")
    groups = runtime.stored(own.groupBy("key").agg(F.sum("bytes").alias("size")), f"{base}/groups")
    homes = assign(groups, shards).select("key", "shard")
    return runtime.handed_over(own.join(homes, "key").select("doc_id", F.col("bytes").alias("size"), "shard"), base)
