"""Finding streams through the owners' type indexes."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import vocab
from . import skew

TYPE_INDEX = "http://www.w3.org/ns/solid/terms#publicTypeIndex"  # fixed value


def relevant_streams(index: DataFrame, metrics: DataFrame, owner: str = "owner") -> DataFrame:
    """All views of every owner that has at least one stream on a metric of interest."""
    related = index.where(F.col("p") == vocab.RELATES_TO).join(
        skew.sized(metrics.select(F.col("metric").alias("o"))), "o", "left_semi").select(owner).distinct()
    return index.where(F.col("p") == vocab.TREE_VIEW).join(related, owner, "left_semi").select(
        owner, F.col("o").alias("stream"))


def lookup(index: DataFrame, wanted: DataFrame, owner: str = "owner", order: str = "seq") -> DataFrame:
    """Per (owner, metric): the stream on that metric, else the owner's first view, else null."""
    exact = index.where(F.col("p") == vocab.RELATES_TO).groupBy(owner, F.col("o").alias("metric")).agg(
        F.min_by("s", order).alias("_exact"))
    view = index.where(F.col("p") == vocab.TREE_VIEW).groupBy(owner).agg(F.min_by("o", order).alias("_view"))
    return wanted.join(exact, [owner, "metric"], "left").join(view, owner, "left").select(
        *wanted.columns, F.coalesce("_exact", "_view").alias("stream"))


def type_index_of(profiles: DataFrame, owner: str = "owner") -> DataFrame:
    """Owner's public type index; '' if the profile names none."""
    return profiles.groupBy(owner).agg(F.coalesce(
        F.min(F.when(F.col("p") == TYPE_INDEX, F.col("o"))), F.lit("")).alias("type_index"))


def query_focus(patterns: DataFrame) -> DataFrame:
    """Objects of patterns on a focus predicate."""
    return patterns.where(F.col("p").isin(list(vocab.FOCUS_PREDICATES))).select("query_hash", F.col("o").alias("focus"))
