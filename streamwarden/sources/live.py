"""Live notifications and the choice between history and live input."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from .. import schemas
from ..functions import times, urls

MODES = ("historical+live", "live")


def notification_stream(spark: SparkSession, path: str, schema: str = schemas.NOTIFICATIONS,
                        max_files: int | None = None) -> DataFrame:
    """JSON notifications as they land in a folder; ``max_files`` is the rate limit."""
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.json(path)


def kafka_notifications(spark: SparkSession, servers: str, topic: str, schema: str = schemas.NOTIFICATIONS,
                        max_offsets: int | None = None) -> DataFrame:
    """JSON notifications from a topic (needs Spark's Kafka package on the cluster)."""
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic)
    if max_offsets:
        reader = reader.option("maxOffsetsPerTrigger", max_offsets)
    return reader.load().select(F.from_json(F.col("value").cast("string"), schema).alias("n")).select("n.*")


def added(notifications: DataFrame) -> DataFrame:
    """Only additions, with the stream and the derived target of each."""
    return notifications.where(F.col("type") == "Add").select(
        "*", urls.stream_of_target("target").alias("stream"), urls.derived_target("target").alias("derived"))


def observation_stream(spark: SparkSession, path: str, schema: StructType | str, mode: str,
                       start: datetime | None = None, file_format: str = "parquet",
                       glob: str | None = None, max_files: int | None = None) -> DataFrame:
    """Stored observations and the files that follow, as one stream.

    ``historical+live`` reads the backlog and then new files, so nothing between
    the two is missed or read twice. ``live`` keeps rows from ``start`` on.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}, expected one of {MODES}")
    if mode == "live" and start is None:
        raise ValueError("live mode needs a start time")
    reader = spark.readStream.format(file_format).schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    df = reader.load(path)
    for field in df.schema.fields:
        # A watermark needs TIMESTAMP; stored times may be without zone.
        if field.dataType.typeName() == "timestamp_ntz":
            df = df.withColumn(field.name, F.col(field.name).cast("timestamp"))
    return df.where(F.col("event_time") >= times.moment(start)) if mode == "live" and "event_time" in df.columns else df


def lookback_stream(spark: SparkSession, path: str, schema: StructType | str, width_ms: int,
                    now: datetime | None = None, **options) -> DataFrame:
    """Input of a new registration: the last ``width_ms`` of history, then what follows."""
    now = now or datetime.now(timezone.utc).replace(tzinfo=None)
    return observation_stream(spark, path, schema, "live", now - timedelta(milliseconds=width_ms), **options)
