"""Results to subscribers, and status messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import skew


def subscribe(subscriptions: DataFrame, query_hash: str, subscriber: str) -> DataFrame:
    """The subscriptions plus one; append the new row to the stored table."""
    new = subscriptions.sparkSession.createDataFrame([(query_hash, subscriber)], "query_hash string, subscriber string")
    return subscriptions.unionByName(new)


def subscriber_lists(subscriptions: DataFrame, per_row: int = 1000) -> DataFrame:
    """List view for inspection, a long list in several parts; delivery joins the rows instead."""
    placed = skew.positions(subscriptions, ["query_hash"], ["subscriber"], "_pos")
    return placed.groupBy("query_hash", F.expr(f"div(_pos - 1, {per_row})").alias("part")).agg(
        F.array_sort(F.collect_list("subscriber")).alias("subscribers"))


def fan_out(results: DataFrame, subscriptions: DataFrame, limit: int = skew.GROUP_LIMIT) -> DataFrame:
    """Each result once per subscriber of its query."""
    if results.isStreaming:
        return results.join(subscriptions, "query_hash")
    return skew.salted_join(results, subscriptions, ["query_hash"], limit=limit)


def unmatched(results: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Results nobody subscribed to: reported, not failed."""
    return results.join(subscriptions.select("query_hash").distinct(), "query_hash", "left_anti")


def write_deliveries(deliveries: DataFrame, path: str, mode: str = "append") -> None:
    """One ordered file set for all subscribers; readers filter on ``subscriber``.

    The hash of the row lets the range shuffle split a busy subscriber.
    """
    whole = F.xxhash64(*[F.col(c) for c in deliveries.columns])
    deliveries.repartitionByRange(F.col("subscriber"), F.col("query_hash"), whole) \
        .sortWithinPartitions("subscriber", "query_hash").write.mode(mode).parquet(path)


def reader_ended(observations: DataFrame) -> DataFrame:
    """Completion row per stream once its history has been read."""
    return observations.groupBy("stream").agg(F.count(F.lit(1)).alias("members")).withColumn(
        "status", F.lit("stream_reader_ended"))


def duplicate_status(registrations: DataFrame) -> DataFrame:
    """Status row for each repeated registration."""
    return registrations.where(~F.col("is_unique")).select("*", F.lit("duplicate_query").alias("status"))
