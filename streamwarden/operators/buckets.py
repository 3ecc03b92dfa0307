"""Time buckets: assignment, rebalancing, batching."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import times, urls
from ..session import cut
from . import skew

NONE = "none"
SIZE = 20


def assign(members: DataFrame, buckets: DataFrame, ts: str = "event_time", tie: str = "id",
           limit: int = skew.GROUP_LIMIT) -> DataFrame:
    """Adds ``bucket`` and ``lower_ts``: the greatest bound at or before the member's time.

    Members older than every bound get 'none'. Bounds at or before the epoch do not
    count; of equal bounds the first listed (by ``seq``, else by name) wins. Bounds
    and members are merged in time order, so cost is linear whatever their spread.
    """
    order = F.min_by("bucket", "seq") if "seq" in buckets.columns else F.min("bucket")
    bounds = (
        buckets.where(F.col("lower_ts").cast("timestamp") > F.timestamp_millis(F.lit(0)))
        .groupBy("stream", "lower_ts").agg(order.alias("bucket"))
    )
    columns = [c for c in members.columns if c not in ("bucket", "lower_ts")]
    kept = members.select(*columns)
    marks = bounds.select(
        *[F.col("stream") if c == "stream" else F.col("lower_ts").cast(kept.schema[ts].dataType).alias(ts)
          if c == ts else F.lit(None).cast(kept.schema[c].dataType).alias(c) for c in columns],
        F.lit(0).alias("_member"), F.struct("bucket", "lower_ts").alias("_bound"))
    rows = kept.withColumn("_member", F.lit(1)).withColumn(
        "_bound", F.lit(None).cast(marks.schema["_bound"].dataType)).unionByName(marks)
    filled = skew.fill_forward(rows, ["stream"], [ts, "_member", tie], "_bound", "_found", limit)
    return filled.where(F.col("_member") == 1).select(
        *columns, F.coalesce(F.col("_found.bucket"), F.lit(NONE)).alias("bucket"),
        F.col("_found.lower_ts").alias("lower_ts"))


def counts(members: DataFrame, keys: list[str] = ("stream", "bucket")) -> DataFrame:
    """Members per bucket."""
    return members.groupBy(*keys).agg(F.count(F.lit(1)).alias("members"))


def earliest(members: DataFrame, ts: str = "event_time", by: list[str] = ("stream",)) -> DataFrame:
    return members.groupBy(*by).agg(F.min(ts).alias("earliest_ts"))


def exists(candidates: DataFrame, buckets: DataFrame) -> DataFrame:
    """Candidates that are a known bucket of their stream."""
    return candidates.join(buckets.select("stream", "bucket").distinct(), ["stream", "bucket"], "left_semi")


def rebalance(members: DataFrame, size: int = SIZE, ts: str = "event_time", tie: str = "id",
              limit: int = skew.GROUP_LIMIT) -> DataFrame:
    """Split buckets of more than ``size`` members; adds ``new_bucket`` and ``new_lower_ts``.

    In time order, the members at 0-based positions size, 2*size, ... open new
    buckets. A member goes to the latest opening at or before its time, so members
    that share an opening's time all move to it, and openings of one time are one
    bucket. Members before the first opening stay (``new_lower_ts`` is null).
    """
    keys = ["stream", "bucket"]
    normal, hot = skew.split_hot(members, keys, limit)
    parts = []
    if normal is not None:
        group = Window.partitionBy(*keys)
        ranked = normal.withColumn("_p", F.row_number().over(group.orderBy(ts, tie)) - 1)
        # The last position of a run of equal times decides for the whole run. All
        # frames below are refinements of (stream, bucket): still one shuffle.
        run = Window.partitionBy(*keys, ts)
        opened = ranked.withColumn("_last", F.max("_p").over(run)).withColumn("_k", F.expr(f"div(_last, {size})"))
        parts.append(opened.withColumn("new_lower_ts", F.when(
            F.col("_k") > 0, F.min(ts).over(Window.partitionBy(*keys, "_k")))).drop("_p", "_last", "_k"))
    if hot is not None:
        ranked = skew.positions(hot, keys, [ts, tie], "_p", limit=limit)
        openings = ranked.where((F.col("_p") > 1) & ((F.col("_p") - 1) % size == 0)).select(
            F.struct(*keys).alias("stream"), F.col(ts).cast("timestamp").alias("lower_ts"),
            F.lit("new").alias("bucket")).distinct()
        packed = hot.select(F.struct(*keys).alias("stream"), F.col(ts), F.col(tie).alias(tie),
                            F.struct(*hot.columns).alias("_row"))
        placed = assign(packed, openings, ts, tie, limit)
        parts.append(placed.select("_row.*", F.col("lower_ts").cast(members.schema[ts].dataType).alias("new_lower_ts")))
    out = reduce(DataFrame.unionByName, parts)
    return out.withColumn("new_bucket", F.when(
        F.col("new_lower_ts").isNotNull(), urls.sibling_bucket_url("bucket", times.ts_ms("new_lower_ts"))
    ).otherwise(F.col("bucket")))


def store_and_rebalance(members: DataFrame, buckets: DataFrame, size: int = SIZE, ts: str = "event_time",
                        tie: str = "id", limit: int = skew.GROUP_LIMIT) -> DataFrame:
    """Assign, open a bucket for members older than all bounds, rebalance.

    That bucket is named by the earliest time of the stream's whole batch. ``stream``
    is the container URL, ending in a slash.
    """
    placed = assign(members, buckets, ts, tie, limit)
    first = earliest(members, ts)
    named = placed.join(skew.sized(first, keep=True), "stream").withColumn("bucket", F.when(
        F.col("bucket") == NONE, urls.child_bucket_url("stream", times.ts_ms("earliest_ts"))
    ).otherwise(F.col("bucket"))).withColumn("lower_ts", F.coalesce("lower_ts", "earliest_ts")).drop("earliest_ts")
    # Stored once, as the buckets themselves would be, then read again to rebalance.
    return rebalance(cut(named), size, ts, tie, limit)


def mark_batches(rows: DataFrame, keys: list[str], order: list[str], n: int = SIZE,
                 limit: int = skew.GROUP_LIMIT) -> DataFrame:
    """Adds ``batch``, consecutive groups of ``n`` in arrival order, and whether it is ``complete``."""
    numbered = skew.positions(rows, keys, order, "_pos", "_total", limit)
    return numbered.withColumn("batch", F.expr(f"div(_pos - 1, {n})")).withColumn(
        "complete", F.col("batch") < F.expr(f"div(_total, {n})")).drop("_pos", "_total")


def batches(rows: DataFrame, keys: list[str], order: list[str], n: int = SIZE,
            limit: int = skew.GROUP_LIMIT) -> DataFrame:
    """Complete batches only; an incomplete last one is held back."""
    return mark_batches(rows, keys, order, n, limit).where("complete").drop("complete")


def batch_buckets(batched: DataFrame, keys: list[str], container: str, ts: str, order: list[str]) -> DataFrame:
    """Bucket of each batch: named by the time of its last row (a batch has at most n rows)."""
    group = Window.partitionBy(*keys, "batch").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing)
    return batched.withColumn("bucket_ts", F.last(ts).over(group)).withColumn(
        "bucket", urls.child_bucket_url(container, times.ts_ms("bucket_ts")))
