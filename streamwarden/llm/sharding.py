"""Shards of near-equal size by longest-processing-time scheduling.

Equal texts stay together. Groups above 1/``ITEMS`` of all bytes are scheduled one by
one; the others are first bundled by hash into ``ITEMS`` bundles. So whatever the
input, at most 2 x ``ITEMS`` (key, size) pairs reach the driver, where a heap hands
them out, largest first, to the least-loaded shard. Shards then differ by about one
bundle, 1/65536 of the bytes, unless a single group is larger than a shard.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window, functions as F

from ..session import cut
from .common import picked, text_key

ITEMS = 1 << 16
BUCKET_ROWS = 50_000


def longest_first(sizes: list[tuple[str, int]], shards: int) -> dict[str, int]:
    """The shard of each (key, size): largest first, equal sizes by key, to the least-loaded shard."""
    loads = [(0, s) for s in range(shards)]
    out = {}
    for key, size in sorted(sizes, key=lambda x: (-x[1], x[0])):
        load, shard = heapq.heappop(loads)
        out[key] = shard
        heapq.heappush(loads, (load + size, shard))
    return out


def shard_by_size(docs: DataFrame, shards: int = 8, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` of every row.

    A null text has size 1 and goes with the empty texts. Repeated rows are kept and
    stay together; null ids are allowed. Slots run from 0 without gaps in each shard, by
    hash bucket, then text, then id. An empty table gives no rows.
    """
    if shards < 1:
        raise ValueError("at least one shard")
    spark = docs.sparkSession
    whole = F.coalesce("text", F.lit(""))
    rows = cut(picked(docs, doc_id=id, text=text).select(
        "doc_id", text_key(F.col("text")).alias("key"), (F.octet_length(whole) + 1).cast("long").alias("size"),
        F.crc32(whole).alias("text_crc32")))
    total, count = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    heavy = (rows.groupBy("key").agg(F.sum("size").alias("bytes"))
             .where(F.col("bytes") * ITEMS > total)).select("key", F.hex("key").alias("own"))  # fewer than ITEMS
    bundle = F.concat(F.lit("bundle "), F.pmod(F.xxhash64("key"), F.lit(ITEMS)).cast("string"))
    placed = cut(rows.join(F.broadcast(heavy), "key", "left")
                 .select(*rows.columns, F.coalesce("own", bundle).alias("item")))
    sizes = [tuple(r) for r in placed.groupBy("item").agg(F.sum("size")).collect()]  # at most 2 x ITEMS
    shard_of = spark.createDataFrame(list(longest_first(sizes, shards).items()), "item string, shard int")
    buckets = max(32, count // BUCKET_ROWS)
    placed = placed.join(F.broadcast(shard_of), "item").withColumn(
        "bucket", F.pmod(F.xxhash64("key", "doc_id"), F.lit(buckets)))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (placed.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
              .select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")))
    inside = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("key", "doc_id")) - 1
    return (placed.withColumn("inside", inside).join(starts, ["shard", "bucket"])
            .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
                    (F.col("start") + F.col("inside")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")))
