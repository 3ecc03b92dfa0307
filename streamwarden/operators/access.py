"""Grants, policies and per-stream settings."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from . import skew


def granted(notifications: DataFrame, grants: DataFrame, target: str = "derived") -> DataFrame:
    """Notifications whose derived target has a grant."""
    allowed = grants.select(F.col("resource").alias(target))
    return notifications.join(allowed if notifications.isStreaming else skew.sized(allowed), target, "left_semi")


def rejected(notifications: DataFrame, grants: DataFrame, target: str = "derived") -> DataFrame:
    """The others, for the audit."""
    allowed = grants.select(F.col("resource").alias(target))
    return notifications.join(allowed if notifications.isStreaming else skew.sized(allowed), target, "left_anti")


def decide(requests: DataFrame, policies: DataFrame, id_: str = "request_id") -> DataFrame:
    """``granted`` per request.

    A policy has to agree on target, assigner, assignee and action, and every one
    of its constraints (operator ``eq``) has to equal the request's claim. An
    unknown operator or a missing claim fails.
    """
    keys = ["target", "assigner", "assignee", "action"]
    met = F.forall("constraints", lambda c: F.coalesce(
        (c["op"] == "eq") & (F.try_element_at("claims", c["left"]) == c["right"]), F.lit(False)))
    passed = requests.join(policies.select(*keys, "constraints"), keys).where(met).select(id_).distinct()
    return requests.join(passed.withColumn("_ok", F.lit(True)), id_, "left").withColumn(
        "granted", F.coalesce("_ok", F.lit(False))).drop("_ok")


def with_config(streams: DataFrame, config: DataFrame) -> DataFrame:
    """Left join of a stream's settings, which may be absent."""
    return streams.join(config if streams.isStreaming else skew.sized(config), "stream", "left")
