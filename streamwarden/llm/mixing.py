"""Mixing sources to target weights by Poisson replication.

A source's mean repetition rate is its target share of the budget over its own bytes.
Each document's count is the Poisson quantile of a hash-seeded uniform number, so it
depends on the row alone and not on the cluster; copies are then ordered by a hash,
which shuffles them globally.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..operators.skew import sized
from ..session import cut
from .common import text_key

SUMMED, MOST = 4096, 1_000_000  # mean copies: up to where factorials are summed, and where a mixture is refused
PIECE = 4096  # copies of a row made at once


def _bits(hex_text: Column, digits: int) -> Column:
    return F.conv(F.substring(hex_text, 1, digits), 16, 10).cast("long")


def rates(docs: DataFrame, weights: dict[str, float], default: float, budget: int | None,
          source: str, text: str) -> DataFrame:
    """``source, rate`` of each source present; sources of equal weight get equal bytes."""
    spark = docs.sparkSession
    sizes = docs.groupBy(F.col(source).alias("source")).agg(
        F.sum((F.octet_length(F.coalesce(text, F.lit(""))) + 1).cast("long")).alias("bytes"))
    given = spark.createDataFrame(list(weights.items()), "name string, weight double")
    weighed = sizes.join(F.broadcast(given), sizes["source"].eqNullSafe(given["name"]), "left").select(
        "source", "bytes", F.coalesce("weight", F.lit(float(default))).alias("weight"))
    all_of = weighed.agg(F.sum("weight").alias("weights"), F.sum("bytes").alias("total"))
    wanted = F.col("total") if budget is None else F.lit(budget)
    return weighed.crossJoin(F.broadcast(all_of)).select(  # one row
        "source", (F.col("weight") / F.col("weights") * wanted / F.col("bytes")).alias("rate"))


def quantiles(rate: DataFrame) -> DataFrame:
    """``source, least, steps``: the count of u is ``least`` plus the number of steps not above u.

    Steps cover twelve deviations around the mean, beyond what a 52-bit number can reach. Up to a mean of ``SUMMED`` the
    factorials are sums of logarithms; above it steps begin at ``least`` and factorials come from Stirling's series,
    so their number follows the deviation and not the mean.
    """
    reach = 12 * F.sqrt("rate") + 24
    ranged = rate.where("rate > 0").select(
        "source", "rate", F.greatest(F.lit(0), F.floor(F.col("rate") - reach)).cast("long").alias("least"),
        F.ceil(F.col("rate") + reach).cast("long").alias("most"))
    by_source = Window.partitionBy("source").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    first = F.when(F.col("rate") > SUMMED, F.col("least")).otherwise(F.lit(0))
    each = ranged.select("*", F.explode(F.sequence(first, "most")).alias("k"))
    n = F.col("k").cast("double")
    series = n * F.log(n) - n + F.log(2 * math.pi * n) / 2 + 1 / (12 * n) - 1 / (360 * n * n * n)
    factorial = F.when(F.col("rate") > SUMMED, series).otherwise(
        F.sum(F.log(F.greatest("k", F.lit(1)).cast("double"))).over(by_source))
    chance = each.withColumn("p", F.exp(F.col("k") * F.log("rate") - F.col("rate") - factorial))
    steps = chance.where("k >= least").withColumn("below", F.sum("p").over(by_source))
    return steps.groupBy("source", "least").agg(F.sort_array(F.collect_list("below")).alias("steps"))


def mix(docs: DataFrame, weights: dict[str, float], default: float = 1.0, budget: int | None = None, seed: str = "mix",
        id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Every row of ``docs`` as often as drawn, with all its columns, ``copies``, ``copy`` and ``shuffle_key``.

    ``weights`` names the sources with a weight of their own (0 drops a source), the
    others have ``default``; ``budget`` is the bytes wanted, by default the bytes there
    are. A null source is a source of its own; a null text has no bytes but one for its
    row. Equal rows draw equal counts. Columns named like the three added are replaced, other columns may have any names.
    Rows come range-sorted by the hash of their copy. A row's work follows its copies: a source of few bytes and great
    weight is repeated many times, as asked for, up to a mean of ``MOST`` copies; beyond it a ValueError names the source.
    An empty table gives no rows.
    """
    docs = docs.drop("copies", "copy", "shuffle_key")
    columns, p = docs.columns, "_mix"
    while any(c.lower().startswith(p) for c in columns):  # working columns must not be the caller's
        p = "_" + p
    rate = cut(rates(docs, weights, default, budget, source, text))
    worst = rate.orderBy(F.col("rate").desc()).first()
    if worst is not None and worst["rate"] > MOST:
        raise ValueError(f"source {worst['source']!r} would be repeated {worst['rate']:.3g} times, more than {MOST}")
    table = sized(quantiles(rate), keep=True).select(
        F.col("source").alias(f"{p}_source"), F.col("least").alias(f"{p}_least"), F.col("steps").alias(f"{p}_steps"))
    name = F.concat_ws(":", F.lit(seed), F.coalesce(docs[id].cast("string"), F.lit("")), F.lower(F.hex(text_key(docs[text]))))
    drawn = docs.withColumn(f"{p}_hash", F.md5(name))
    u = (_bits(F.col(f"{p}_hash"), 13) + 0.5) / float(1 << 52)
    counted = (drawn.join(table, drawn[source].eqNullSafe(table[f"{p}_source"])).withColumn(f"{p}_u", u).withColumn(
        "copies", (F.col(f"{p}_least") + F.expr(f"size(filter({p}_steps, x -> x <= {p}_u))")).cast("int")))
    pieces = counted.where("copies > 0").drop(f"{p}_steps").withColumn(
        f"{p}_from", F.explode(F.sequence(F.lit(0), F.col("copies") - 1, F.lit(PIECE))))
    copied = pieces.withColumn("copy", F.explode(F.sequence(f"{p}_from", F.least(F.col(f"{p}_from") + PIECE, F.col("copies")) - 1)))
    keyed = copied.withColumn("shuffle_key", _bits(F.md5(F.concat_ws(":", f"{p}_hash", F.col("copy").cast("string"))), 15))
    return (keyed.select(*[F.col(f"`{c}`") for c in columns], "copies", "copy", "shuffle_key")
            .repartitionByRange("shuffle_key").sortWithinPartitions("shuffle_key"))
