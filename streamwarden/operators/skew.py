"""Building blocks that stay exact when one key holds a large share of the rows.

A group of bounded size goes through an ordinary window. A larger one is split by
a range shuffle on (key, order) into chunks, handled per chunk, and joined back
with one small summary row per (key, chunk). No group is ever one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import cut

GROUP_LIMIT = 2_000_000
BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 128 << 20
_OFFSET_BITS = 33


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner",
                   small: bool = False) -> DataFrame:
    """Join on ``keys`` where null equals null. ``small`` broadcasts a right side that counts small."""
    other = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys])
    return left.join(sized(other, keep=True) if small else other, on, how).drop(*[f"_r_{k}" for k in keys])


def sized(df: DataFrame, max_rows: int = BROADCAST_ROWS, keep: bool = False) -> DataFrame:
    """Broadcast hint only when counts of rows and bytes prove the side small; else unchanged.

    The row count stops at ``max_rows + 1``; only a side within it is measured in bytes. ``keep`` writes
    the side out first, for one that is costly to compute twice. Streaming frames are never hinted.
    """
    if df.isStreaming:
        return df
    if keep:
        df = cut(df)
    return F.broadcast(df) if counted_small(df, max_rows) else df


def counted_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> bool:
    """Whether a table has at most ``max_rows`` rows and ``BROADCAST_BYTES`` bytes."""
    if df.limit(max_rows + 1).count() > max_rows:
        return False
    whole = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))
    return (df.agg(F.sum(F.octet_length(whole).cast("long"))).first()[0] or 0) <= BROADCAST_BYTES


def hot_keys(df: DataFrame, keys: list[str], limit: int) -> DataFrame | None:
    """Keys with more than ``limit`` rows (at most rows/limit of them), or None."""
    if not keys:
        return df.limit(0) if df.limit(limit + 1).count() > limit else None
    hot = df.groupBy(*keys).count().where(F.col("count") > limit).select(*keys)
    return None if hot.isEmpty() else cut(hot)


def split_hot(df: DataFrame, keys: list[str], limit: int) -> tuple[DataFrame | None, DataFrame | None]:
    """(rows of ordinary groups, rows of hot groups); either may be None."""
    hot = hot_keys(df, keys, limit)
    if hot is None:
        return df, None
    if not keys:
        return None, df
    return null_safe_join(df, hot, keys, "left_anti", True), null_safe_join(df, hot, keys, "left_semi", True)


def chunked(df: DataFrame, keys: list[str], order: list[str], limit: int) -> DataFrame:
    """Rows in (keys, order) sequence with ``_chunk`` and the offset ``_off`` in it.

    ``order`` has to end in something unique, so that ties split as well. The
    result is written out: chunk numbers must not change if a task runs again.
    """
    spark = df.sparkSession
    shuffle = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = max(shuffle, -(-df.count() // limit))
    cols = [F.col(c) for c in [*keys, *order]]
    numbered = (
        df.repartitionByRange(parts, *cols)
        .sortWithinPartitions(*cols)
        .withColumn("_mid", F.monotonically_increasing_id())
        .withColumn("_chunk", F.shiftright("_mid", _OFFSET_BITS))
        .withColumn("_off", F.col("_mid").bitwiseAND(F.lit((1 << _OFFSET_BITS) - 1)))
        .drop("_mid")
    )
    return cut(numbered)


def _before(keys: list[str]):
    return Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)


def positions(df: DataFrame, keys: list[str], order: list[str], pos: str = "pos",
              total: str | None = None, limit: int = GROUP_LIMIT) -> DataFrame:
    """1-based position of each row in its group, and the group size if asked for."""
    normal, hot = split_hot(df, keys, limit)
    parts = []
    if normal is not None:
        group = Window.partitionBy(*keys)
        out = normal.withColumn(pos, F.row_number().over(group.orderBy(*order)).cast("long"))
        if total:
            out = out.withColumn(total, F.count(F.lit(1)).over(group))
        parts.append(out)
    if hot is not None:
        rows = chunked(hot, keys, order, limit)
        summary = (
            rows.groupBy(*keys, "_chunk").agg(F.min("_off").alias("_first"), F.count(F.lit(1)).alias("_n"))
            .withColumn("_prior", F.coalesce(F.sum("_n").over(_before(keys)), F.lit(0)))
            .withColumn("_total", F.sum("_n").over(Window.partitionBy(*keys)))
        )
        out = null_safe_join(rows, summary, [*keys, "_chunk"], small=True).select(
            *df.columns,
            (F.col("_off") - F.col("_first") + F.col("_prior") + 1).alias(pos),
            *([F.col("_total").alias(total)] if total else []),
        )
        parts.append(out)
    return reduce(DataFrame.unionByName, parts)


def fill_forward(df: DataFrame, keys: list[str], order: list[str], value: str, out: str,
                 limit: int = GROUP_LIMIT) -> DataFrame:
    """Latest non-null ``value`` at or before each row of its group."""
    normal, hot = split_hot(df, keys, limit)
    parts = []
    running = (Window.unboundedPreceding, Window.currentRow)
    if normal is not None:
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(*running)
        parts.append(normal.withColumn(out, F.last(value, ignorenulls=True).over(w)))
    if hot is not None:
        rows = chunked(hot, keys, order, limit)
        inner = Window.partitionBy(*keys, "_chunk").orderBy("_off").rowsBetween(*running)
        local = rows.withColumn("_local", F.last(value, ignorenulls=True).over(inner))
        summary = (
            rows.groupBy(*keys, "_chunk")
            .agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.col("_off"))).alias("_last"))
            .withColumn("_carry", F.last("_last", ignorenulls=True).over(_before(keys)))
        )
        parts.append(
            null_safe_join(local, summary, [*keys, "_chunk"], small=True).select(
                *df.columns,
                F.coalesce(F.col("_local"), F.col("_carry")).alias(out),
            )
        )
    return reduce(DataFrame.unionByName, parts)


def next_value(df: DataFrame, keys: list[str], order: list[str], value: str, out: str,
               limit: int = GROUP_LIMIT) -> DataFrame:
    """``value`` of the row that follows in the group; null at the end."""
    normal, hot = split_hot(df, keys, limit)
    parts = []
    if normal is not None:
        w = Window.partitionBy(*keys).orderBy(*order)
        parts.append(normal.withColumn(out, F.lead(value).over(w)))
    if hot is not None:
        rows = chunked(hot, keys, order, limit)
        inner = rows.withColumn(
            "_next", F.lead(value).over(Window.partitionBy(*keys, "_chunk").orderBy("_off")))
        summary = (
            rows.groupBy(*keys, "_chunk")
            .agg(F.max("_off").alias("_end"), F.min_by(value, "_off").alias("_head"))
            .withColumn("_after", F.lead("_head").over(Window.partitionBy(*keys).orderBy("_chunk")))
        )
        parts.append(
            null_safe_join(inner, summary, [*keys, "_chunk"], small=True).select(
                *df.columns,
                F.when(F.col("_off") == F.col("_end"), F.col("_after")).otherwise(F.col("_next")).alias(out),
            )
        )
    return reduce(DataFrame.unionByName, parts)


def salted_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner",
                limit: int = GROUP_LIMIT) -> DataFrame:
    """Equi join whose left side may have hot keys.

    Left rows of a hot key are spread over one sub-key for each ``limit`` of them (0 counts every key as hot and
    each row as a sub-key's worth); the right rows of just those keys are repeated once per sub-key. Exact for inner, left, left_semi and
    left_anti, where each left row meets all its partners exactly once.
    """
    hot = left.groupBy(*on).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > limit)
    hot = cut(hot.select(*on, F.ceil(F.col("_n") / max(limit, 1)).cast("int").alias("_salts")))
    if hot.isEmpty():
        return left.join(right, on, how)
    flag = sized(hot)
    spread = F.pmod(F.xxhash64(*[F.col(c) for c in left.columns]), F.col("_salts")).cast("int")
    salted_left = left.join(flag, on, "left").withColumn("_salt", F.coalesce(spread, F.lit(0))).drop("_salts")
    salted_right = right.join(flag, on, "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))).drop("_salts")
    return salted_left.join(salted_right, [*on, "_salt"], how).drop("_salt")


def interval_join(points: DataFrame, intervals: DataFrame, keys: list[str], ts: str,
                  lo: str, hi: str) -> DataFrame:
    """Pairs with equal ``keys`` and ``lo <= ts <= hi`` as an equi join.

    Every interval belongs to the power-of-two level of its own length and so to
    at most two cells of that level; a point looks once into each level in use
    (at most 63). A hot key is spread over its cells. Times are microseconds.
    """
    def micros(c: str) -> Column:
        return F.unix_micros(F.col(c).cast("timestamp"))

    length = F.greatest(micros(hi) - micros(lo), F.lit(1))
    levelled = intervals.where(F.col(lo) <= F.col(hi)).withColumn(
        "_level", F.ceil(F.log2(length.cast("double"))).cast("int") + 1)
    # One int per power of two: at most 64 values reach the driver.
    levels = sorted(r[0] for r in levelled.select("_level").distinct().collect())
    cells = levelled.withColumn("_cell", F.explode(F.sequence(
        F.floor(micros(lo) / F.pow(F.lit(2.0), F.col("_level"))),
        F.floor(micros(hi) / F.pow(F.lit(2.0), F.col("_level"))))))
    looked = points.withColumn("_level", F.explode(F.array(*[F.lit(v) for v in levels]).cast("array<int>"))) \
        .withColumn("_cell", F.floor(micros(ts) / F.pow(F.lit(2.0), F.col("_level"))))
    joined = looked.join(cells, [*keys, "_level", "_cell"])
    return joined.where(F.col(ts).between(F.col(lo), F.col(hi))).drop("_level", "_cell")
