"""Benchmark decontamination by SimHash over item-sized windows.

A document's words give five-word shingles. A window of an item's own length that reaches the similarity
holds one of the item's rarest shingles (so few that it must). So where a document holds one, all windows of that length
over it are looked at, wherever in them it stands; those with too few shingles of the item to reach the similarity are
dropped by a sliding count. The others get a weighted 64-bit SimHash. Fingerprints meet in a multi-index:
the bits are cut into radius + 1 blocks, of which two fingerprints within the radius share one. Pairs within
the radius are then decided by their exact weighted similarity: the sum of the smaller
over the sum of the larger counts of their shingles. All steps are SQL functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.binding import let
from ..operators.skew import sized
from ..session import cut
from .common import fresh_name, picked, text_key

SHINGLE = 5
RADIUS = 20
SEPARATORS = " \t\n\x0b\f\r"


def word_array(text: Column) -> Column:
    """Words of a text: A-Z lower-cased, parted at the bytes 0x20 and 0x09-0x0D."""
    lower = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    plain = F.translate(lower, SEPARATORS, " " * len(SEPARATORS))
    return F.filter(F.split(plain, " "), lambda w: w != "")


def shingled(rows: DataFrame, text: str) -> DataFrame:
    """Adds ``n_words`` and ``grams``, the hashes of all shingles in order (fewer words are one shingle).

    The inner array is bound once by ``transform`` and ``inline``, so it is not computed anew for each use.
    """
    def both(h: Column) -> Column:
        each = F.transform(F.sequence(F.lit(0), F.size(h) - SHINGLE),
                           lambda i: F.xxhash64(*[h[i + k] for k in range(SHINGLE)]))
        grams = F.when(F.size(h) >= SHINGLE, each).when(F.size(h) > 0, F.array(F.xxhash64(h))).otherwise(
            F.array().cast("array<bigint>"))
        return F.struct(F.size(h).alias("n_words"), grams.alias("grams"))

    hashes = F.transform(word_array(F.col(text)), lambda w: F.xxhash64(w))
    return rows.select("*", F.inline(F.transform(F.array(hashes), both)))


def simhash(grams: str) -> Column:
    """64-bit SimHash of an array of hashes; a shingle weighs as often as it occurs."""
    return F.expr(f"aggregate(sequence(0, 63), 0L, (acc, b) -> acc | shiftleft(if(2 * size(filter({grams}, "
                  f"x -> (shiftright(x, b) & 1L) = 1L)) > size({grams}), 1L, 0L), b))")


def blocks(fingerprint: str, radius: int) -> Column:
    """(number, bits) of the radius + 1 blocks."""
    cuts = [64 * k // (radius + 1) for k in range(radius + 2)]
    return F.array(*[F.struct(F.lit(k).alias("block"), F.shiftrightunsigned(fingerprint, a).bitwiseAND(
        F.lit((1 << (b - a)) - 1)).alias("bits")) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))])


def similarity(a: str, b: str) -> Column:
    """Sum of smaller over sum of larger counts of the shingles of two arrays."""
    common = (f"aggregate(array_distinct({a}), 0, (acc, x) -> acc + least(size(filter({a}, y -> y = x)), "
              f"size(filter({b}, y -> y = x))))")
    return F.expr(f"{common} / cast(size({a}) + size({b}) - {common} as double)")


def items_of(benchmark: DataFrame, id: str, text: str, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Items with fingerprint, and the seeds: shingle to the items (by hash) of whose rarest shingles it is one.

    Among n shingles any n - ceil(threshold n) + 1 will do; those of fewest items are taken.
    """
    rows = picked(benchmark, item_id=id, text=text)
    distinct = shingled(rows.dropDuplicates(["item_id", "text"]), "text").where("n_words > 0").drop("text")
    items = cut(distinct.withColumn("print", simhash("grams")).withColumn("item", F.xxhash64("grams")))
    placed = items.select(F.col("item").alias("_item"), "grams").dropDuplicates(["_item"]).select(
        "_item", F.size("grams").alias("n"), F.posexplode("grams").alias("place", "gram"))
    spread = placed.groupBy("gram").agg(F.count_distinct("_item").alias("_df"))
    order = Window.partitionBy("_item").orderBy("_df", "gram", "place")
    keep = F.col("n") - F.ceil(F.col("n") * F.lit(threshold)) + 1
    seeds = (placed.join(spread, "gram").withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= keep)
             .groupBy("gram").agg(F.collect_set("_item").alias("_items")))
    return items, seeds


def starts(grams: str, ats: str, own: str, threshold: float) -> Column:
    """First places of the windows over the hits ``ats`` that hold enough shingles of the item ``own``.

    Windows are as long as the item, or the text if that is shorter, and do not stick out of it.
    """
    size, length = F.size(grams), F.least(F.size(grams), F.size(own))
    over = F.array_distinct(F.flatten(F.transform(ats, lambda at: F.transform(
        F.sequence(at - length + 1, at), lambda p: F.greatest(F.lit(0), F.least(p, size - length))))))
    need = F.ceil((F.size(own) + length) * F.lit(threshold / (1 + threshold)) - F.lit(1e-6))
    places = F.filter(F.sequence(F.lit(0), size - 1), lambda i: F.array_contains(own, F.get(grams, i)))
    return let(places, lambda places: F.filter(over, lambda p: F.size(
        F.filter(places, lambda i: (i >= p) & (i < p + length))) >= need))


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8, radius: int = RADIUS,
                 text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``key, item_id, similarity, first_word``: each text that holds an item, with its best window.

    ``key`` is ``text_key``: equal texts are one. Texts and items without words match
    nothing; one of fewer than five words matches only its own word sequence as a whole.
    Repeated items are one; items with a null id keep it. Empty tables give no rows. A
    window that would stick out of the text is moved inside it.
    """
    items, seeds = items_of(benchmark, item_id, item_text, threshold)
    seeds = sized(seeds, keep=True)
    rows = picked(docs, text=text).select("text", text_key(F.col("text")).alias("key"))
    grams = shingled(rows, "text").select("key", F.posexplode("grams").alias("at", "gram"))
    hits = cut(grams.join(seeds, "gram").select("key", "at", F.explode("_items").alias("item")).groupBy("key", "item").agg(
        F.collect_set("at").alias("ats")))
    # Only the texts that were hit are read again; the first pass moved no arrays.
    texts = rows.join(sized(hits.select("key").distinct(), keep=True), "key", "left_semi").dropDuplicates(["key"])
    whole = items.select("item", "n_words", F.col("grams").alias("own")).dropDuplicates(["item"])
    found = shingled(texts, "text").select("key", "grams").join(hits, "key").join(sized(whole, keep=True), "item")
    windows = (found.select("key", "n_words", "grams", F.explode(starts("grams", "ats", "own", threshold)).alias("first_word"), F.size("own").alias("n"))
               .groupBy("key", "first_word", "n_words").agg(F.first(F.slice("grams", F.col("first_word") + 1, F.col("n"))).alias("window"))
               .withColumn("print", simhash("window")))
    windows = cut(windows)
    left = windows.select("*", F.explode(blocks("print", radius)).alias("b"))
    right = items.select("item_id", F.col("n_words").alias("_n"), F.col("grams").alias("item"),
                         F.col("print").alias("_p"), F.explode(blocks("print", radius)).alias("c"))
    right = sized(right, keep=True)
    met = left.join(right, (left["n_words"] == right["_n"]) & (left["b"] == right["c"]))
    near = met.where(F.bit_count(F.col("print").bitwiseXOR(F.col("_p"))) <= radius)
    pairs = near.select("key", "first_word", "item_id", "window", "item").dropDuplicates(
        ["key", "first_word", "item_id", "item"])
    decided = pairs.withColumn("similarity", similarity("item", "window")).where(F.col("similarity") >= threshold)
    best = F.max(F.struct("similarity", (-F.col("first_word")).alias("_f"))).alias("best")
    return decided.groupBy("key", "item_id").agg(best).select(
        "key", "item_id", F.col("best.similarity").alias("similarity"), (-F.col("best._f")).alias("first_word"))


def leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8, radius: int = RADIUS, id: str = "doc_id",
          text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``doc_id, item_id, similarity, first_word`` of every row whose text holds an item."""
    found = contaminated(docs, benchmark, threshold, radius, text, item_id, item_text)
    rows = picked(docs, doc_id=id, text=text).select("doc_id", text_key(F.col("text")).alias("key"))
    return rows.join(found, "key").select("doc_id", "item_id", "similarity", "first_word")


def without_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8, radius: int = RADIUS,
                  text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text holds no item, with all their columns, whatever their names.

    Rows with a null, empty or wordless text stay, repeated rows stay or go together, an empty table gives no rows, and an
    empty benchmark leaves all rows.
    """
    own = fresh_name(docs, "key")
    found = contaminated(docs, benchmark, threshold, radius, text).select(F.col("key").alias(own)).distinct()
    return docs.withColumn(own, text_key(docs[text])).join(sized(found, keep=True), own, "left_anti").select(
        *[F.col(f"`{c}`") for c in docs.columns])
