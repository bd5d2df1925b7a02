"""Shards of near-equal bytes by longest-processing-time scheduling; equal texts stay together."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import columns_of, stored

SHARDS = 24
OVERHEAD = 8          # bytes a row costs beside its text
PER_SHARD = 1024      # bundles of small groups per shard; also bounds how many groups can be large
PARTS = 256           # parts in which the rows of a large group are numbered


def longest_first(items: list[tuple[int, int]], shards: int) -> dict[int, int]:
    """Item to shard: items by falling size, each to the shard that is least loaded so far. Ties go by number."""
    heap = [(0, s) for s in range(shards)]
    where = {}
    for item, size in sorted(items, key=lambda x: (-x[1], x[0])):
        load, shard = heapq.heappop(heap)
        where[item] = shard
        heapq.heappush(heap, (load + size, shard))
    return where


def shards(docs: DataFrame, count: int = SHARDS) -> DataFrame:
    """Per row of `docs`: doc_id, size, text_crc32, law ('bytes'), shard, slot, grown_shard (null).

    Groups are rows of equal text; a null text is an empty one. A group is large when it has more than one part in
    `count * PER_SHARD` of all bytes, so at most that many are. Small groups are bundled by a hash into as many
    bundles. Only these two bounded lists of sizes reach the driver, where the heap deals them out; no group is split.
    Slots count from 0 without gaps in each shard, in two steps, so no shard is numbered by one task.
    """
    text = F.coalesce("text", F.lit(""))
    binary = text.cast("binary")
    rows = stored(columns_of(docs, "doc_id", "text").select(
        F.col("doc_id").cast("bigint"), (F.octet_length(text) + OVERHEAD).cast("bigint").alias("size"), F.crc32(binary).alias("text_crc32"),
        F.unhex(F.md5(binary)).alias("key")), "sizes")
    bundles = count * PER_SHARD
    groups = rows.groupBy("key").agg(F.sum("size").alias("bytes"))
    groups = stored(groups.withColumn("item", F.pmod(F.xxhash64("key"), F.lit(bundles))), "groups")
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    is_large = F.col("bytes") * bundles > F.lit(total)
    large = groups.where(is_large).select("key", "bytes").orderBy("key").toPandas()
    small = groups.where(~is_large).groupBy("item").agg(F.sum("bytes").alias("bytes")).toPandas()
    large["item"] = range(bundles, bundles + len(large))
    sizes = pd.concat([large[["item", "bytes"]], small[["item", "bytes"]]])
    where = longest_first(list(zip(sizes["item"].tolist(), sizes["bytes"].tolist(), strict=True)), count)

    spark = docs.sparkSession
    dealt = spark.createDataFrame(pd.DataFrame({"item": pd.Series(list(where), dtype="int64"), "shard": pd.Series(list(where.values()), dtype="int32")}),
                                  "item bigint, shard int")
    alone = spark.createDataFrame(pd.DataFrame({"key": pd.Series([bytes(k) for k in large["key"]], dtype="object"),
                                                "own": large["item"].astype("int64")}), "key binary, own bigint")
    # Both lists have at most `count * PER_SHARD` entries of a few bytes, at any size of the input.
    placed = rows.join(F.broadcast(alone), "key", "left").withColumn("item", F.coalesce("own", F.pmod(F.xxhash64("key"), F.lit(bundles))))
    placed = placed.join(F.broadcast(dealt), "item").withColumn("part", F.when(F.col("own").isNotNull(), F.pmod(F.xxhash64("doc_id"), F.lit(PARTS))).otherwise(F.lit(0)))
    chunk = ["shard", "item", "part"]
    counts = placed.groupBy(*chunk).agg(F.count("*").alias("n"))
    before = counts.select(*chunk, (F.sum("n").over(Window.partitionBy("shard").orderBy("item", "part")) - F.col("n")).alias("before"))
    here = F.row_number().over(Window.partitionBy(*chunk).orderBy("doc_id", "text_crc32")) - 1
    numbered = placed.withColumn("here", here).join(before, chunk)
    return numbered.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("here")).alias("slot"),
                           F.lit(None).cast("int").alias("grown_shard"))
