"""A store of rebalanced buckets that takes batches without being rewritten as a whole.

Members lie in partitions (day, slot), a slot being a hash of the stream. A batch reads the partitions that it has
members for, rebalances their buckets and writes them anew under its own version; no file is ever changed. A manifest
lists the version of every partition. It is written last, so a batch counts wholly or not at all, and one that runs
again replaces its own version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import times, urls
from ..operators import buckets, skew

SLOTS = 16
PLACE = ["day", "slot"]
MANIFEST = "day date, slot int, version long"


def manifest(spark: SparkSession, root: str, batch_id: int) -> DataFrame:
    """``day, slot, version`` after a batch; none before the first."""
    if batch_id < 0:
        return spark.createDataFrame([], MANIFEST)
    return spark.read.schema(MANIFEST).parquet(f"{root}/manifest/batch={batch_id}")


def _held(spark: SparkSession, root: str, places: DataFrame, schema) -> DataFrame:
    """Rows of the partitions in ``places``. Their paths, one for each partition, go through the driver as in any file listing."""
    paths = [f"{root}/data/version={r.version}/day={r.day}/slot={r.slot}" for r in places.collect()]
    if not paths:
        return spark.createDataFrame([], schema)
    return spark.read.option("basePath", f"{root}/data").schema(schema).parquet(*paths)


def append(members: DataFrame, root: str, batch_id: int, ts: str = "event_time", tie: str = "id", size: int = buckets.SIZE,
           slots: int = SLOTS) -> None:
    """Add ``members`` (with ``stream``, ``ts``, ``tie``) as batch ``batch_id``; batches are numbered from 0 without gaps.

    A stream's members of a day fill one bucket, named by the day, up to ``size``; further ones open buckets as in
    ``buckets.rebalance``. That rests on the members alone, so the store is the same in whatever batches they came.
    Rows with a null time or stream are not stored.
    """
    spark, columns = members.sparkSession, members.columns
    fresh = members.where(F.col(ts).isNotNull() & F.col("stream").isNotNull()).withColumns(
        {"day": F.to_date(ts), "slot": F.pmod(F.xxhash64("stream"), F.lit(slots)).cast("int")})
    fresh.persist()
    try:
        before = manifest(spark, root, batch_id - 1)
        touched = fresh.select(*PLACE).distinct()
        kept = before.join(skew.sized(touched, keep=True), PLACE, "left_semi")
        schema = fresh.schema
        rows = _held(spark, root, kept, f"{', '.join(f'`{c}` {t}' for c, t in members.dtypes)}, version long, day date, slot int").select(
            *[F.col(f"`{f.name}`") for f in schema.fields]).unionByName(fresh)
        named = rows.withColumn("bucket", urls.child_bucket_url("stream", times.ts_ms("day")))
        placed = buckets.rebalance(named, size, ts, tie).select(*columns, *PLACE, "bucket", "new_bucket")
        (placed.repartition(*PLACE, F.pmod(F.xxhash64("stream"), F.lit(64))).sortWithinPartitions(*PLACE, "stream", ts)
         .write.mode("overwrite").partitionBy(*PLACE).parquet(f"{root}/data/version={batch_id}"))
        new = touched.withColumn("version", F.lit(batch_id).cast("long"))
        before.join(new, PLACE, "left_anti").unionByName(new).write.mode("overwrite").parquet(f"{root}/manifest/batch={batch_id}")
    finally:
        fresh.unpersist()


def current(spark: SparkSession, root: str, batch_id: int, columns: str) -> DataFrame:
    """All members after a batch, with ``day``, ``slot`` and ``new_bucket``; ``columns`` is the members' schema."""
    schema = f"{columns}, bucket string, new_bucket string, version long, day date, slot int"
    return _held(spark, root, manifest(spark, root, batch_id), schema).drop("version")
