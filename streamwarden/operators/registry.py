"""Query registry: duplicates, stored results, list operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import query_text
from ..session import cut
from . import skew


def detect_duplicates(registrations: DataFrame, text: str = "query_text", id_: str = "registration_id",
                      at: str = "registered_at", registry: DataFrame | None = None,
                      limit: int = skew.GROUP_LIMIT) -> DataFrame:
    """Adds ``query_key``, ``is_unique`` and ``equivalent_to`` (the first equal registration).

    Every registration is compared with all earlier ones, and with those of
    ``registry`` (``query_key``, id) if given. The first of each key is found by a
    partial aggregate, so one popular query is no hot window.
    """
    # Reading a text is the costly part, so keys are computed once.
    keyed = cut(query_text.with_equivalence_key(registrations, text))
    firsts = keyed.groupBy("query_key").agg(F.min_by(id_, F.struct(at, id_)).alias("_first"))
    if registry is not None:
        earlier = registry.groupBy("query_key").agg(F.min(id_).alias("_stored"))
        firsts = firsts.join(earlier, "query_key", "left").select(
            "query_key", F.coalesce("_stored", "_first").alias("_first"))
    joined = skew.salted_join(keyed, firsts, ["query_key"], limit=limit)
    return joined.select(
        *registrations.columns, "query_key", (F.col(id_) == F.col("_first")).alias("is_unique"),
        F.when(F.col(id_) != F.col("_first"), F.col("_first")).alias("equivalent_to"))


def executing(registrations: DataFrame) -> DataFrame:
    """Only unique registrations are started."""
    return registrations.where("is_unique")


def results_exist(queries: DataFrame, annotations: DataFrame, key: str = "query_hash") -> DataFrame:
    """Queries with at least one stored result."""
    return queries.join(annotations.select(key).distinct(), key, "left_semi")


def item(registrations: DataFrame, i: int, order: list[str]) -> DataFrame:
    """The i-th registration (from 0) in arrival order."""
    return skew.positions(registrations, [], order, "_pos").where(F.col("_pos") == i + 1).drop("_pos")


def size(registrations: DataFrame) -> DataFrame:
    return registrations.agg(F.count(F.lit(1)).alias("size"))


def remove_first(items: DataFrame, gone: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Drop the first row equal to each row of ``gone`` (one per item listed there)."""
    first = items.groupBy(*keys).agg(F.min(F.struct(*order)).alias("_at")).join(
        gone.select(*keys).distinct(), keys, "left_semi")
    marked = items.withColumn("_at", F.struct(*order))
    return marked.join(first, [*keys, "_at"], "left_anti").drop("_at")


def cleared(items: DataFrame) -> DataFrame:
    """The registry after removing everything; write it with mode overwrite, or use ``clear``."""
    return items.limit(0)


def clear(spark: SparkSession, path: str) -> DataFrame:
    """Empties the registry stored at ``path``, keeping its columns; gives what is there afterwards."""
    schema = spark.read.parquet(path).schema
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)
    return spark.read.schema(schema).parquet(path)


def answered(checked: DataFrame, results: DataFrame, id_: str = "registration_id", limit: int = skew.GROUP_LIMIT) -> DataFrame:
    """Stored results for every registration: its own, or those of the equal query that ran before.

    ``checked`` is what ``detect_duplicates`` gives; ``results`` has ``id_`` and the result columns. A
    registration whose query has no result yet gives no row.
    """
    wanted = checked.select(F.col(id_).alias("asked_by"), F.coalesce("equivalent_to", id_).alias(id_))
    return skew.salted_join(wanted, results, [id_], limit=limit)
