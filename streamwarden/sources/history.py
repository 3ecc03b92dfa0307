"""Reading stored members of a stream over a time range."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from .. import vocab
from ..functions import times
from ..operators import skew


def historical_scan(members: DataFrame, streams: list[str] | None, start: datetime | None,
                    end: datetime | None, tie: str = "resource_id") -> DataFrame:
    """Members in the closed range, oldest first; the filters reach the file scan."""
    df = members.where(times.in_range(members, "event_time", start, end))
    if streams is not None:
        df = df.where(F.col("stream").isin(streams))
    return df.orderBy("event_time", tie)


def fragment_intervals(buckets: DataFrame) -> DataFrame:
    """Buckets with the end of what they can hold: the next lower bound of the stream."""
    return skew.next_value(buckets, ["stream"], ["lower_ts", "bucket"], "lower_ts", "upper_ts")


def prune_fragments(buckets: DataFrame, start: datetime | None, end: datetime | None) -> DataFrame:
    """Buckets that can hold a member of the closed range."""
    low, high = times.bounds(start, end, buckets.schema["lower_ts"].dataType)
    return fragment_intervals(buckets).where(
        (F.col("lower_ts") <= high) & (F.col("upper_ts").isNull() | (F.col("upper_ts") > low)))


def member_range_read(members: DataFrame, buckets: DataFrame, start: datetime | None = None,
                      end: datetime | None = None, tie: str = "resource_id") -> DataFrame:
    """Prune fragments first, then filter, then sort inside each fragment.

    A range shuffle keeps a fragment's rows in sequence even when it spans tasks.
    """
    wanted = prune_fragments(buckets, start, end).select("stream", "bucket").distinct()
    kept = members.where(times.in_range(members, "event_time", start, end)).join(
        skew.sized(wanted, keep=True), ["stream", "bucket"], "left_semi")
    order = ["stream", "bucket", "event_time", tie]
    return kept.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order)


def strip_membership(triples: DataFrame) -> DataFrame:
    """Drop ``stream tree:member x`` triples."""
    return triples.where(~((F.col("s") == F.col("stream")) & (F.col("p") == vocab.TREE_MEMBER)))


def fragment_members(triples: DataFrame) -> DataFrame:
    """Records of the documents: one per listed member, else the whole document.

    Adds ``member_id``; membership triples themselves are dropped.
    """
    is_link = (F.col("s") == F.col("stream")) & (F.col("p") == vocab.TREE_MEMBER)
    links = triples.where(is_link).select("resource_id", F.col("o").alias("member_id")).distinct()
    body = triples.where(~is_link)
    listed = body.join(links.withColumn("s", F.col("member_id")), ["resource_id", "s"])
    whole = body.join(links.select("resource_id").distinct(), "resource_id", "left_anti").withColumn(
        "member_id", F.col("resource_id"))
    return listed.select(*triples.columns, "member_id").unionByName(whole.select(*triples.columns, "member_id"))


def stored_results(events: DataFrame, start: datetime | None = None, end: datetime | None = None,
                   query_hash: str | Column | None = None, time: str = "generated_at") -> DataFrame:
    """Materialised results of the closed range, in time order inside each bucket."""
    df = events.where(times.in_range(events, time, start, end))
    if query_hash is not None:
        df = df.where(F.col("query_hash") == query_hash)
    order = [c for c in ("bucket", time, "event_id") if c in df.columns]
    return df.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order)
