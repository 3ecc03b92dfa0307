"""Streaming jobs that hand tables from one micro-batch to the next.

Every batch writes its results and what the next one needs under its own number, with mode overwrite, and reads
only what the batch before wrote. A batch that runs again so gives the same rows in the same place. The tables are
ordinary Spark tables: nothing is kept on the driver but the watermark, one time.
"""

from __future__ import annotations

from collections.abc import Callable
from math import gcd

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import registry, skew, windows
from ..sinks import incremental


class Carried:
    """Tables ``<out>/<name>/batch=<number>``."""

    def __init__(self, spark: SparkSession, out: str, batch_id: int):
        self.spark, self.out, self.batch_id = spark, out, batch_id

    def before(self, name: str, schema) -> DataFrame:
        """What the batch before wrote; empty in the first."""
        if self.batch_id == 0:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.out}/{name}/batch={self.batch_id - 1}")

    def write(self, name: str, df: DataFrame) -> None:
        df.write.mode("overwrite").parquet(f"{self.out}/{name}/batch={self.batch_id}")

    def watermark(self, batch: DataFrame, ts: str, delay_ms: int) -> tuple[int | None, int | None]:
        """(watermark this batch is held against, watermark behind it) in microseconds: the latest time seen less the
        delay, never falling."""
        kept = self.before("watermark", "upto long").first()
        before = kept["upto"] if kept else None
        latest = batch.agg(_micros(F.max(ts))).first()[0]
        seen = None if latest is None else latest - delay_ms * 1000
        after = max((t for t in (before, seen) if t is not None), default=None)
        self.write("watermark", self.spark.createDataFrame([(after,)], "upto long"))
        return before, after


def _start(df: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool, every: str | None) -> StreamingQuery:
    writer = df.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
    if available_now:
        writer = writer.trigger(availableNow=True)
    elif every:
        writer = writer.trigger(processingTime=every)
    return writer.start()


def _micros(time: Column) -> Column:
    return F.unix_micros(time.cast("timestamp"))


def _behind(ts: str, mark: int | None) -> Column:
    """Whether a time is before the watermark."""
    return F.lit(False) if mark is None else _micros(F.col(ts)) < mark


def sliding_with_late(df: DataFrame, ts: str, range_ms: int, step_ms: int, aggs: list[windows.Agg], by: list[str], out: str,
                      checkpoint: str, *, delay_ms: int, available_now: bool = False, every: str | None = None) -> StreamingQuery:
    """Sliding windows whose late rows are kept: ``results``, ``late`` and the state ``open`` under ``out``.

    A row behind the watermark of its batch goes to ``late``, unchanged; any other counts in all of its windows, so
    results and late rows together hold every row once. Rows with a null time are late. A window comes out in the batch whose watermark
    passes its end. State is one row for each group and pane (the common divisor of range and step) that an open
    window covers.
    """
    if any(a.fn not in ("avg", "sum", "count", "min", "max") for a in aggs):
        raise ValueError("late rows are kept for aggregates that panes can merge")
    parts, columns = windows._parts(aggs), df.columns
    pane_us = gcd(range_ms, step_ms) * 1000

    def write(batch: DataFrame, batch_id: int) -> None:
        tables = Carried(batch.sparkSession, out, batch_id)
        batch.persist()
        try:
            before, after = tables.watermark(batch, ts, delay_ms)
            late = _behind(ts, before) | F.col(ts).isNull()
            tables.write("late", batch.where(late).select(*columns))
            at = _micros(F.col(ts))
            panes = batch.where(~late).withColumn("_at", F.timestamp_micros(at - F.pmod(at, F.lit(pane_us)))).groupBy(*by, "_at").agg(
                *[c.alias(n) for n, (c, _) in parts.items()])
            merge = [getattr(F, how)(n).alias(n) for n, (_, how) in parts.items()]
            merged = tables.before("open", panes.schema).unionByName(panes).groupBy(*by, "_at").agg(*merge)
            merged.persist()
            held = windows.assign(merged, "_at", range_ms, step_ms)
            end = _micros(F.col("window_end"))
            held = held.where(F.lit(False) if after is None else end <= after)
            if before is not None:
                held = held.where(end > before)
            found = held.groupBy("window_start", "window_end", *by).agg(*merge)
            tables.write("results", found.select("window_start", "window_end", *by, *[windows._final(a, F.col) for a in aggs]))
            tables.write("open", merged if after is None else merged.where(F.unix_micros("_at") + range_ms * 1000 > after))
            merged.unpersist()
        finally:
            batch.unpersist()

    return _start(df, write, checkpoint, available_now, every)


def earliest_first(df: DataFrame, ts: str, seq: str, keys: list[str], out: str, checkpoint: str, *, delay_ms: int,
                   available_now: bool = False, every: str | None = None) -> StreamingQuery:
    """A queue that gives its events in time order: ``released`` (with ``position``), ``late`` and the queue ``waiting`` under ``out``.

    Events of history, gap and live input wait until the watermark has passed them; then those of a batch are released
    in (time, seq) order, numbered on from the ones before, in each group of ``keys`` (all in one if there are
    none). As the watermark never falls, later batches only release later events. Events behind it when they arrive are late.
    """
    columns = df.columns

    def write(batch: DataFrame, batch_id: int) -> None:
        tables = Carried(batch.sparkSession, out, batch_id)
        batch.persist()
        try:
            before, after = tables.watermark(batch, ts, delay_ms)
            late = _behind(ts, before) | F.col(ts).isNull()
            tables.write("late", batch.where(late).select(*columns))
            queue = tables.before("waiting", df.schema).unionByName(batch.where(~late).select(*columns))
            queue.persist()
            due = _behind(ts, after)
            tables.write("waiting", queue.where(~due))
            group = F.struct(*[F.col(k) for k in keys]) if keys else F.struct(F.lit(0).alias("all"))
            placed = skew.positions(queue.where(due).withColumn("_g", group), ["_g"] if keys else [], [ts, seq], "_pos")
            counts = tables.before("counts", placed.select("_g", F.lit(0).cast("long").alias("_n")).schema)
            numbered = skew.null_safe_join(placed, counts, ["_g"], "left", small=True)
            tables.write("released", numbered.select(*columns, (F.col("_pos") + F.coalesce("_n", F.lit(0))).alias("position")))
            more = placed.groupBy("_g").agg(F.count(F.lit(1)).alias("_n"))
            tables.write("counts", counts.unionByName(more).groupBy("_g").agg(F.sum("_n").alias("_n")))
            queue.unpersist()
        finally:
            batch.unpersist()

    return _start(df, write, checkpoint, available_now, every)


def check_registrations(df: DataFrame, out: str, checkpoint: str, text: str = "query_text", id_: str = "registration_id",
                        at: str = "registered_at", available_now: bool = False, every: str | None = None) -> StreamingQuery:
    """Registrations checked as they arrive: ``checked`` and the ``registry`` of first equal queries under ``out``.

    A registration is compared with all of earlier batches and with those before it in its own. Only new keys are
    appended to the registry; a batch reads what batches before it appended, so one that runs again checks alike.
    """
    id_type = df.schema[id_].dataType.simpleString()

    def write(batch: DataFrame, batch_id: int) -> None:
        spark, folder = batch.sparkSession, f"{out}/registry"
        known = spark.createDataFrame([], f"query_key string, {id_} {id_type}")
        if batch_id:
            known = spark.read.schema(f"query_key string, {id_} {id_type}, batch long").parquet(folder).where(
                F.col("batch") < batch_id).drop("batch")
        found = registry.detect_duplicates(batch, text, id_, at, known)
        found.write.mode("overwrite").parquet(f"{out}/checked/batch={batch_id}")
        checked = spark.read.parquet(f"{out}/checked/batch={batch_id}")
        checked.where("is_unique").select("query_key", id_).write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")

    return _start(df, write, checkpoint, available_now, every)


def store(df: DataFrame, out: str, checkpoint: str, ts: str = "event_time", tie: str = "id", available_now: bool = False,
          every: str | None = None, **options) -> StreamingQuery:
    """Members stored and rebalanced as they arrive; see ``incremental.append``."""
    def write(batch: DataFrame, batch_id: int) -> None:
        incremental.append(batch, out, batch_id, ts, tie, **options)

    return _start(df, write, checkpoint, available_now, every)
