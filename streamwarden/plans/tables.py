"""The driver's tables in the roles the operators expect."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import vocab
from ..operators import rules

BASE = vocab.STREAM_BASE
PROPERTY = "http://example.org/property/"
RESOURCE = "http://example.org/event/"

# Activity classes over (lower, upper] bounds.
ACTIVITY = [
    (None, 6.0, "sitting"),
    (6.0, 14.0, "standing"),
    (14.0, 30.0, "lightActivity"),
    (30.0, 45.0, "slowWalking"),
    (45.0, 55.0, "briskWalking"),
    (55.0, None, "fastWalkingOrJogging"),
]


def activity_rules() -> list[rules.Threshold]:
    return rules.threshold_rules([(a, b, vocab.EX + name) for a, b, name in ACTIVITY])


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stream_url(user: str = "user_id", kind: str = "event_type") -> Column:
    return F.concat(F.lit(BASE), F.col(user).cast("string"), F.lit("/"), F.col(kind), F.lit("/"))


def user_url(user: str = "user_id") -> Column:
    return F.concat(F.lit(BASE), F.col(user).cast("string"), F.lit("/"))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as observations; ``cents`` is the value as an exact integer."""
    return load(spark, sf_dir, "events").select(
        F.concat(F.lit(RESOURCE), F.col("event_id").cast("string")).alias("resource_id"),
        user_url().alias("stream"), F.concat(F.lit(PROPERTY), F.col("event_type")).alias("property"),
        "value", F.col("ts").cast("timestamp").alias("event_time"),
        "event_id", "user_id", "event_type", F.round(F.col("value") * 100).cast("long").alias("cents"))


def ms(c: str) -> Column:
    return F.unix_millis(F.col(c).cast("timestamp"))
