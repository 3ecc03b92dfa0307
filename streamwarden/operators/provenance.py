"""From a result back to the observations behind it."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import vocab
from ..functions import times
from . import skew


def trace(results: DataFrame, observations: DataFrame, keys: list[str] = ("stream",),
          ts: str = "event_time") -> DataFrame:
    """Observations of a result's stream within its closed window [start, end]."""
    return skew.interval_join(observations, results, list(keys), ts, "window_start", "window_end")


def windows_of_results(triples: DataFrame) -> DataFrame:
    """(event, window_start, window_end, stream) of stored result documents."""
    def first(p: str):
        return F.min(F.when(F.col("p") == p, F.col("o")))

    bounds = triples.where(F.col("p").isin(vocab.RSP_STARTED, vocab.RSP_ENDED)).groupBy("s").agg(
        times.event_time(first(vocab.RSP_STARTED)).alias("window_start"),
        times.event_time(first(vocab.RSP_ENDED)).alias("window_end"))
    streams = triples.where(F.col("p") == vocab.PROV_GENERATED_BY).select("s", F.col("o").alias("stream")).distinct()
    return bounds.join(streams, "s").withColumnRenamed("s", "event")


def container_streams(meta: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(container, registered stream) and the containers that name none."""
    found = meta.where(F.col("p") == vocab.RSP_STREAMS).groupBy("resource_id").agg(F.min("o").alias("stream"))
    missing = meta.select("resource_id").distinct().join(found, "resource_id", "left_anti").withColumn(
        "error", F.lit("no registered stream"))
    return found, missing
