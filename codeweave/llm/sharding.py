"""Sharding by longest-processing-time scheduling.

Rows of equal text stay together.  Groups, sorted by size, go to the least
loaded shard through a heap.  So that the schedule stays small at any scale,
groups below a share of all bytes are first bundled by a hash of their text;
the bundles and the large groups, a bounded number, are what is scheduled (a
group is never cut, and a bundle is a small part of a shard).  Rows get their
slot by counts of partitions, never by sorting a shard.

Defined cases: the size is the text's UTF-8 bytes plus 8; a null text has none,
and all null texts are one group; an empty table gives no rows.  One group may
be larger than a shard's even share: it then is alone, as near equal as whole
groups allow.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import numbered, store

#: Bundles of small groups, and how many of the groups are scheduled by themselves at most.
BUNDLES, LARGE = 4096, 2048


def longest_first(sizes: list[tuple[object, int]], shards: int) -> dict[object, int]:
    """Longest processing time first: item -> shard.  Ties by the item's name."""
    heap = [(0, s) for s in range(shards)]
    out = {}
    for item, size in sorted(sizes, key=lambda x: (-x[1], str(x[0]))):
        load, s = heapq.heappop(heap)
        out[item] = s
        heapq.heappush(heap, (load + size, s))
    return out


def assign_shards(docs: DataFrame, shards: int, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """One row per input row: ``row`` (the columns ``keep``, all by default),
    ``size``, ``text_crc32``, ``shard``, ``slot`` (0, 1, ... in each shard)."""
    spark = docs.sparkSession
    t = F.col(f"`{text}`")
    # null and empty texts are groups of their own
    group = F.when(t.isNull(), F.lit(b"")).otherwise(F.unhex(F.sha2(t, 256)))
    rows = store(docs.select(F.struct(*(keep if keep is not None else ["*"])).alias("row"),
                             (F.coalesce(F.octet_length(t), F.lit(0)) + F.lit(8)).cast("long").alias("size"),
                             F.crc32(F.coalesce(t, F.lit(""))).alias("text_crc32"), group.alias("g")), "sized")
    groups = store(rows.groupBy("g").agg(F.sum("size").alias("size")), "groups")
    total = groups.agg(F.sum("size")).first()[0] or 0
    # fewer than LARGE groups can have more than total / LARGE bytes
    large = groups.where(F.col("size") * LARGE > F.lit(total))
    bundle = F.pmod(F.xxhash64("g"), F.lit(BUNDLES)).cast("string")
    named = groups.join(F.broadcast(large.select("g")), "g", "left_anti").groupBy(bundle.alias("item")) \
        .agg(F.sum("size").alias("size")).unionByName(large.select(F.hex("g").alias("item"), "size"))
    sizes = [(r["item"], r["size"]) for r in named.collect()]  # at most BUNDLES + LARGE
    chosen = spark.createDataFrame([*longest_first(sizes, shards).items()], "item string, shard int")
    own = F.broadcast(large.select("g", F.hex("g").alias("own")))
    placed = rows.join(own, "g", "left").withColumn("item", F.coalesce("own", bundle)) \
        .join(F.broadcast(chosen), "item").select("row", "size", "text_crc32", F.col("shard").cast("long").alias("shard"))
    return numbered(placed, "shard").withColumn("shard", F.col("shard").cast("int"))
