"""Monitoring plans as Structured Streaming queries.

Output is written per batch under the batch's own folder with mode overwrite, so a
batch that runs again replaces itself. State and progress live in the checkpoint.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from ..operators import access, buckets, rules, windows
from ..session import scratch_path
from ..sinks import delivery
from ..sources import live, triples


def start(df: DataFrame, path: str, checkpoint: str, mode: str = "append", available_now: bool = False,
          every: str | None = None) -> StreamingQuery:
    """Write a streaming result as parquet files."""
    writer = df.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    elif every:
        writer = writer.trigger(processingTime=every)
    return writer.start()


def run_available(df: DataFrame, label: str = "stream", at_end: Callable[[], None] | None = None) -> DataFrame:
    """Process all input there is, then give the written rows as a batch.

    Windows still open at the end only come out if ``at_end`` adds rows far ahead (see
    ``EndMarker``): it is called after the input, and the run goes on from its checkpoint.
    State partitions are fixed when a query starts; more of them than cores would
    only add small state files to every batch.
    """
    spark = df.sparkSession
    path, checkpoint = scratch_path(spark, label), scratch_path(spark, label + "-checkpoint")
    setting = "spark.sql.shuffle.partitions"
    before = spark.conf.get(setting)
    spark.conf.set(setting, str(min(int(before), max(1, spark.sparkContext.defaultParallelism))))
    try:
        start(df, path, checkpoint, available_now=True).awaitTermination()
        if at_end is not None:
            at_end()
            start(df, path, checkpoint, available_now=True).awaitTermination()
    finally:
        spark.conf.set(setting, before)
    return spark.read.schema(df.schema).parquet(path)


class LateRows(StreamingQueryListener):
    """Counts rows dropped behind the watermark over the whole run; add it with ``spark.streams.addListener``."""

    def __init__(self):
        self.counts: dict[str, int] = {}

    def onQueryStarted(self, event) -> None:
        self.counts.setdefault(str(event.id), 0)

    def onQueryProgress(self, event) -> None:
        late = sum(op.numRowsDroppedByWatermark for op in event.progress.stateOperators)
        self.counts[str(event.progress.id)] = self.counts.get(str(event.progress.id), 0) + late

    def onQueryIdle(self, event) -> None:
        """Nothing was dropped."""

    def onQueryTerminated(self, event) -> None:
        """The count stays."""


def late_rows(query: StreamingQuery) -> int:
    """Rows dropped behind the watermark in the progress that Spark keeps (100 batches); see ``LateRows``."""
    return sum(op.get("numRowsDroppedByWatermark", 0) for p in query.recentProgress for op in p["stateOperators"])


def without_repeats(df: DataFrame, ts: str = "event_time", key: str = "resource_id",
                    *, delay: str) -> DataFrame:
    """Each resource once, though history, gap and live input may overlap.

    Repeats are found within ``delay`` of each other, which bounds the state.
    """
    return df.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def sliding(df: DataFrame, ts: str, range_ms: int, step_ms: int, aggs: list[windows.Agg], by: list[str] = (),
            *, delay: str | None) -> DataFrame:
    """RStream of a sliding window: closed windows only. ``delay`` None keeps an earlier watermark.

    Rows later than ``delay`` behind the newest are dropped, so the caller has to say how late rows may come.
    """
    marked = df.withWatermark(ts, delay) if delay is not None else df
    return windows.sliding_stream(marked, ts, range_ms, step_ms, aggs, by)


def deltas(df: DataFrame, ts: str, range_ms: int, step_ms: int, row: list[str], mode: str,
           *, delay_ms: int) -> DataFrame:
    """IStream or DStream of the distinct rows of a window.

    Rows are also entered one step later, so the watermark waits a step longer.
    """
    entered = windows.delta_input(df, ts, step_ms, row, f"{delay_ms + step_ms} milliseconds")
    return (windows.istream if mode == "IStream" else windows.dstream)(entered, ts, range_ms, step_ms, row)


def joined_windows(left: DataFrame, right: DataFrame, shared: list[str], ts: str, range_ms: int, step_ms: int,
                   *, delay: str) -> DataFrame:
    """Two named windows of one shape, joined on the window and all shared variables.

    Each side is first reduced to its distinct solutions per window.
    """
    def side(df: DataFrame) -> DataFrame:
        return df.withWatermark(ts, delay).groupBy(
            windows.window_of(ts, range_ms, step_ms).alias("window"), *shared).agg(F.count(F.lit(1)).alias("_n")).drop("_n")

    return side(left).join(side(right), ["window", *shared]).select(
        F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *shared)


def observations_of(notifications: DataFrame, grants: DataFrame) -> DataFrame:
    """Additions with a grant, their documents read into observations; faulty ones drop out."""
    allowed = access.granted(live.added(notifications), grants)
    read = triples.observations_from_documents(allowed.withColumnRenamed("target", "resource_id"))
    good, _ = triples.usable(read)
    return good


def alerts(observations: DataFrame, range_ms: int, step_ms: int, rule_list: list, by: list[str],
           *, delay: str) -> DataFrame:
    """Window averages of the observations and what the rules derive from them."""
    averages = sliding(observations, "event_time", range_ms, step_ms, [windows.Agg("avg", "value", "value")], by, delay=delay)
    return rules.apply_thresholds(averages, rule_list)


def deliver(results: DataFrame, subscriptions_path: str, out: str, checkpoint: str,
            available_now: bool = False, every: str | None = None, grants_path: str | None = None,
            resource: str = "stream") -> StreamingQuery:
    """Fan out each batch to its subscribers; results nobody wants are kept aside.

    Subscriptions are read anew in each batch, so new ones take effect. So are the grants of
    ``grants_path``: a result goes out only while the ``resource`` it comes from is granted.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        subscriptions = spark.read.parquet(subscriptions_path)
        if grants_path is not None:
            batch = access.granted(batch, spark.read.parquet(grants_path), resource)
        # The batch is used twice; running its aggregate twice would cost more.
        batch.persist()
        try:
            delivery.write_deliveries(delivery.fan_out(batch, subscriptions), f"{out}/delivered/batch={batch_id}", "overwrite")
            delivery.unmatched(batch, subscriptions).write.mode("overwrite").parquet(f"{out}/unmatched/batch={batch_id}")
        finally:
            batch.unpersist()

    writer = results.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(write)
    if available_now:
        writer = writer.trigger(availableNow=True)
    elif every:
        writer = writer.trigger(processingTime=every)
    return writer.start()


def publish_batches(results: DataFrame, keys: list[str], container: str, ts: str, order: list[str], out: str,
                    checkpoint: str, n: int = buckets.SIZE, available_now: bool = False) -> StreamingQuery:
    """Buffer results and write them in batches of ``n`` to the bucket of each batch's last row.

    Rows of an incomplete batch wait in ``waiting/batch=<id>`` for the next one.
    """
    columns = results.columns
    schema = results.schema

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch.select(*columns)
        if batch_id > 0:
            rows = rows.unionByName(spark.read.schema(schema).parquet(f"{out}/waiting/batch={batch_id - 1}"))
        rows.persist()
        try:
            marked = buckets.mark_batches(rows, keys, order, n)
            full = marked.where("complete").drop("complete")
            buckets.batch_buckets(full, keys, container, ts, order).drop("batch").write.mode("overwrite").parquet(
                f"{out}/stored/batch={batch_id}")
            marked.where("not complete").select(*columns).write.mode("overwrite").parquet(
                f"{out}/waiting/batch={batch_id}")
        finally:
            rows.unpersist()

    writer = results.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(write)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def union_of(streams: list[DataFrame]) -> DataFrame:
    """Several source streams of one query as one."""
    return reduce(DataFrame.unionByName, streams)


class EndMarker:
    """A stream of its own that stays empty until the end of the input, then holds rows of a far later time.

    They move the watermark past every window of the real rows and are in no window that closes.
    """

    def __init__(self, rows: DataFrame, label: str = "end"):
        self.rows, self.path = rows, scratch_path(rows.sparkSession, label)
        rows.limit(0).write.parquet(self.path)

    def stream(self) -> DataFrame:
        return self.rows.sparkSession.readStream.schema(self.rows.schema).parquet(self.path)

    def __call__(self) -> None:
        self.rows.write.mode("append").parquet(self.path)


def table_stream(spark: SparkSession, folder: str, table: str, max_files: int | None = None) -> DataFrame:
    """A stored table as a stream.

    The path is written as a glob, which the file source takes for a single file
    as well as for a folder of part files.
    """
    reader = spark.readStream.schema(spark.read.parquet(f"{folder}/{table}").schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(f"{folder}/{table[:-1]}[{table[-1]}]")
