"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Micro-batch state must survive an executor, so it lives in RocksDB, not the heap.
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def build_session(app: str = "streamwarden", master: str | None = None,
                  shuffle_partitions: int | None = None,
                  extra: dict[str, str] | None = None) -> SparkSession:
    """Session with the settings above.

    ``shuffle_partitions`` is left to the cluster unless given: AQE only merges
    partitions, so a cluster wants a high number and a laptop about its cores.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in {**SETTINGS, **(extra or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, from ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder.
    """
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(configured)
        return configured
    current = sc.getCheckpointDir()
    if current:
        return current
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="streamwarden-"))
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame, **options: str) -> DataFrame:
    """Write the rows as a table in the shared folder and go on from there.

    Like a checkpoint this survives lost executors and shortens the plan; unlike one
    it is columnar and tells Spark its real size. Old tables can be deleted with the
    folder once the application has ended. ``options`` are those of the Parquet writer.
    """
    path = scratch_path(df.sparkSession, "cut")
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Give every core a part of a scan too small to be split.

    For costly per-row work such as reading texts. A scan with splits for a quarter
    of the cores or more is left as it is: a shuffle would cost more than it brings.
    """
    spark = df.sparkSession
    if df.isStreaming:
        return df
    cores = spark.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    number, unit = re.match(r"(\d+)\s*([kmgt]?)", spark.conf.get("spark.sql.files.maxPartitionBytes").lower()).groups()
    split = int(number) * 1024 ** " kmgt".index(unit or " ")
    return df.repartition(cores) if 4 * size < cores * split else df
