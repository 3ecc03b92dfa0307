"""Audit log of registrations and accesses, as appended tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import query_text
from ..operators import skew


def registration_entries(registrations: DataFrame, text: str, start: Column, end: Column, by: Column,
                         at: str) -> DataFrame:
    """One log entry per unique registration."""
    return registrations.where("is_unique").select(
        query_text.registration_id(F.col(text), start, end).alias("query_id"), F.col(text).alias("query"),
        by.alias("registered_by"), F.col(at).alias("registered_at"),
        F.array().cast("array<string>").alias("similar_queries_id"))


def access_entries(accesses: DataFrame, audit: DataFrame) -> DataFrame:
    """Accesses to known queries; others are no-ops."""
    return accesses.join(audit.select("query_id").distinct(), "query_id", "left_semi")


def with_access(audit: DataFrame, access: DataFrame) -> DataFrame:
    """Access counts and bounds per entry, without collecting anyone's whole log."""
    summary = access.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("accesses"), F.min("accessed_at").alias("first_access"),
        F.max("accessed_at").alias("last_access"))
    return audit.join(summary, "query_id", "left").withColumn("accesses", F.coalesce("accesses", F.lit(0)))


def nested_log(audit: DataFrame, access: DataFrame, per_row: int = 1000) -> DataFrame:
    """Nested ``access_log`` view; a long log continues in rows with a higher ``part``."""
    placed = skew.positions(access, ["query_id"], ["accessed_at", "user", "data_accessed"], "_pos")
    logs = placed.groupBy("query_id", F.expr(f"div(_pos - 1, {per_row})").alias("part")).agg(
        F.array_sort(F.collect_list(F.struct("accessed_at", "user", "data_accessed"))).alias("access_log"))
    return audit.join(logs, "query_id", "left").withColumn("part", F.coalesce("part", F.lit(0)))


def append(entries: DataFrame, path: str) -> None:
    entries.write.mode("append").parquet(path)
