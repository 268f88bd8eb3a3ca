"""Longest-processing-time sharding: groups by size, largest first, to the least-loaded shard.

Groups of one total size are interchangeable, so the schedule runs over sizes with their counts, not
over groups.  Distinct sizes sum to no more than the corpus, so there are at most sqrt(2 * bytes) of
them (14 million at 100 TB); one task streams them through the heap and writes one row a size: how
many groups of it go to each shard.  Groups then find their place by their rank within their size.
Ranks and slots are numbered in buckets with offsets, so no shard, size or group is one task's work.

The law is `bytes`: a shard is at most one group above the mean, as LPT promises; a group larger than
the mean shard fills a shard of its own.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from busnet.session import keep

_BUCKETS = 4096
_RANK_BUCKETS = 256


class LeastLoaded:
    """Heap of shards by (load, shard)."""

    def __init__(self, shards: int):
        self.heap = [(0, s) for s in range(shards)]

    def place(self, size: int, count: int) -> list[int]:
        """How many of `count` groups of `size` each shard gets, as if placed one after the other.

        Shard s offers itself at load, load + size, ...; the `count` least offers win.  All offers
        below a level are taken at once, the last few (fewer than shards) one by one from the heap.
        """
        given = [0] * len(self.heap)

        def below(level: int) -> int:
            return sum(max(0, -(-(level - load) // size)) for load, _ in self.heap)

        low, high = self.heap[0][0], self.heap[0][0] + size * (count + 1)
        while low < high:  # the highest level with at most `count` offers below it
            middle = (low + high + 1) // 2
            low, high = (middle, high) if below(middle) <= count else (low, middle - 1)
        filled = []
        for load, s in self.heap:
            given[s] = max(0, -(-(low - load) // size))
            filled.append((load + size * given[s], s))
        heapq.heapify(filled)
        self.heap = filled
        for _ in range(count - sum(given)):
            load, s = self.heap[0]
            heapq.heapreplace(self.heap, (load + size, s))
            given[s] += 1
        return given


def _schedule(sizes: DataFrame, shards: int) -> DataFrame:
    """(bytes, n) -> (bytes, ends): ranks below ends[0] go to shard 0, then below ends[1] to shard 1, ..."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        queue = LeastLoaded(shards)
        for batch in batches:
            ends = []
            for size, count in zip(batch["bytes"].tolist(), batch["n"].tolist()):
                total, row = 0, []
                for given in queue.place(size, count):
                    total += given
                    row.append(total)
                ends.append(row)
            yield pd.DataFrame({"bytes": batch["bytes"], "ends": ends})

    ordered = sizes.repartition(1).sortWithinPartitions(F.desc("bytes"))
    return ordered.mapInPandas(run, "bytes long, ends array<long>")


def _numbered(df: DataFrame, name: str, key: list[str], order: list[str], bucket: Column, bounded: bool) -> DataFrame:
    """df with a gapless number from 0 within key, counted in buckets; bounded: few keys, whatever the input."""
    df = df.withColumn("_bucket", bucket)
    counts = df.groupBy(*key, "_bucket").count()
    before = W.partitionBy(*key).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(*key, "_bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    inner = W.partitionBy(*key, "_bucket").orderBy(*order)
    numbered = df.withColumn("_at", F.row_number().over(inner) - 1)
    joined = numbered.join(F.broadcast(offsets) if bounded else offsets, [*key, "_bucket"])
    return joined.withColumn(name, F.col("_before") + F.col("_at")).drop("_bucket", "_before", "_at")


def assign(items: DataFrame, shards: int) -> DataFrame:
    """items (id, size, grp and others) with shard and slot; items of a grp stay together.

    size is 1 at least.  Rows with equal ids are placed each; a null grp is one group like any other.  Columns
    of items must not begin with an underscore.
    """
    groups = keep(items.groupBy("grp").agg(F.sum("size").alias("bytes")), "shard-groups")
    plan = keep(_schedule(groups.groupBy("bytes").agg(F.count("*").alias("n")), shards), "shard-plan")
    ranked = _numbered(groups, "rank", ["bytes"], ["grp"], F.pmod(F.xxhash64("grp"), F.lit(_RANK_BUCKETS)), bounded=False)
    placed = ranked.join(plan, "bytes").select(
        "grp", F.size(F.filter("ends", lambda e: e <= F.col("rank"))).alias("shard")
    )
    joined = items.join(placed.withColumnRenamed("grp", "_grp"), F.col("grp").eqNullSafe(F.col("_grp"))).drop("_grp")
    # shards * _BUCKETS offsets: 65,536 rows for 16 shards, however many items
    return _numbered(joined, "slot", ["shard"], ["id", "grp"], F.pmod(F.xxhash64("id"), F.lit(_BUCKETS)), bounded=True)


def documents_to_shards(docs: DataFrame, shards: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard; equal texts (null counts as empty) share a shard."""
    text = F.coalesce("text", F.lit(""))
    items = keep(
        docs.select(
            F.col("doc_id").alias("id"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"),
            F.unhex(F.sha2(text, 256)).alias("grp"),
        ),
        "shard-items",
    )
    return assign(items, shards).select(
        F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"),
        F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
