"""Time order, first and last matches, and queue views. Ties go by ``seq``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import vocab


def chronological(df: DataFrame, ts: str = "event_time", tie: str = "resource_id") -> DataFrame:
    return df.orderBy(ts, tie)


def drain(queue: DataFrame, k: int, ts: str = "timestamp", seq: str = "seq") -> DataFrame:
    """The k earliest events: Spark keeps k per task, so nothing is sorted whole."""
    return queue.orderBy(ts, seq).limit(k)


def peek(queue: DataFrame, event: str = "event", ts: str = "timestamp", seq: str = "seq",
         by: list[str] = ()) -> DataFrame:
    """Earliest event (of each group); no row for an empty queue."""
    return queue.groupBy(*by).agg(
        F.min_by(event, F.struct(ts, seq)).alias(event), F.min(ts).alias(ts),
        F.count(F.lit(1)).alias("_n")).where("_n > 0").drop("_n")


def stable_sort(queue: DataFrame, ts: str = "timestamp", seq: str = "seq") -> DataFrame:
    return queue.orderBy(ts, seq)


def string_sort(df: DataFrame, text: str) -> DataFrame:
    """Byte order of UTF-8."""
    return df.orderBy(text)


def sorted_strings(array) -> Column:
    """The same inside an array column."""
    return F.array_sort(array)


def first_match(triples: DataFrame, by: list[str], value: str = "o", seq: str = "seq") -> DataFrame:
    return triples.groupBy(*by).agg(F.min_by(value, seq).alias(value))


def latest_name(df: DataFrame, by: list[str], name: str) -> DataFrame:
    """Greatest by text order."""
    return df.groupBy(*by).agg(F.max(name).alias(name))


def queue_state(queue: DataFrame, by: list[str] = ()) -> DataFrame:
    return queue.groupBy(*by).agg(F.count(F.lit(1)).alias("size")).withColumn("is_empty", F.col("size") == 0)


def inbox_of(streams: DataFrame, triples: DataFrame) -> DataFrame:
    """Stream with its inbox URL (stream + first inbox object); null if it has none."""
    inboxes = triples.where(F.col("p") == vocab.LDP_INBOX).groupBy("stream").agg(
        F.min_by("o", "seq").alias("_inbox") if "seq" in triples.columns else F.min("o").alias("_inbox"))
    return streams.join(inboxes, "stream", "left").withColumn(
        "inbox", F.concat("stream", "_inbox")).drop("_inbox")
