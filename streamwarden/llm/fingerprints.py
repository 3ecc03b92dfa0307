"""MinHash fingerprints of documents, and near-duplicate classes by bands and verification.

A text's shingles are hashed and go through ``PERMUTATIONS`` universal (multiply, add,
shift) hash functions in numpy; the minima are its fingerprint. Bands of the fingerprint
are joined in Spark: first through the smallest text and the neighbours of each band, then
all texts of a band that are not connected yet, in pairs of bounded chunks. The exact Jaccard
similarity of shingle sets decides.
"""

from __future__ import annotations

from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import cut
from .common import picked, shingle_sets, text_key
from .components import components
from .ngram_join import CHUNK, Forest

PERMUTATIONS = 128
ROWS = 4  # of a band: 32 bands miss a pair of similarity 0.8 with a chance of 5e-8
_RNG = np.random.default_rng(20_240_601)
_A = _RNG.integers(1, 1 << 63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64)
_EMPTY = np.full(PERMUTATIONS, 0xFFFFFFFF, np.uint32)


def minima(shingles: np.ndarray) -> np.ndarray:
    """The minimum of each permutation over distinct shingle hashes; all ones for none."""
    out = _EMPTY.copy()
    x = shingles >> np.uint64(32)
    for first in range(0, len(x), 256):
        values = (x[first:first + 256, None] * _A + _B) >> np.uint64(32)
        np.minimum(out, values.min(axis=0).astype(np.uint32), out=out)
    return out


def fingerprints(texts: pa.Array) -> np.ndarray:
    """One row of minima for each text, null counting as empty."""
    return np.array([minima(s) for s in shingle_sets(texts)], np.uint32).reshape(-1, PERMUTATIONS)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal minima, an estimate of the Jaccard similarity."""
    return (a == b).mean(axis=1)


def as_hex(prints: np.ndarray) -> pa.Array:
    return pa.array([row.tobytes().hex() for row in prints.astype(">u4")], pa.string())


def with_next(docs: DataFrame, id: str, text: str) -> DataFrame:
    """``doc_id, text, next``: each row with the text after it in descending id (the last with the first).

    Rows are dealt by ranges of ids with bounds known beforehand. A range's last row
    needs the first row of the next range that has any; these few rows, one for each
    range, are sent along as guests. Equal ids go by ``text_key``; null ids come last.
    """
    spark = docs.sparkSession
    rows = picked(docs, doc_id=id, text=text)
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(20_000, size >> 24))
    bounds = rows.select(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], 10 * parts)).first()[0] if parts > 1 else []
    bounds = sorted(set(bounds or []))
    # 0 is the range of the largest ids; null ids have a range of their own after the others.
    rank = F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b > F.col("doc_id"))) if bounds else F.lit(0)
    ranged = rows.withColumn("part", F.when(F.col("doc_id").isNull(), len(bounds) + 1).otherwise(rank))
    order = [F.col("doc_id").desc_nulls_last(), text_key(F.col("text"))]
    first = F.min_by("text", F.struct((-F.col("doc_id")).alias("a"), text_key(F.col("text")).alias("k")))
    heads = ranged.groupBy("part").agg(F.max("doc_id").alias("top"))
    present = [r["part"] for r in heads.select("part").orderBy("part").collect()]  # at most one for each range
    if not present:
        return rows.withColumn("next", F.col("text"))
    before = {p: present[i - 1] for i, p in enumerate(present)}  # the first range's guest comes after the last
    to = F.create_map(*[F.lit(x) for kv in before.items() for x in kv])
    guests = ranged.groupBy("part").agg(first.alias("text")).select(
        F.lit(None).cast(rows.schema["doc_id"].dataType).alias("doc_id"), "text",
        F.element_at(to, F.col("part")).alias("part"), F.lit(1).alias("guest"))
    both = ranged.withColumn("guest", F.lit(0)).unionByName(guests)
    line = Window.partitionBy("part").orderBy("guest", *order)
    return both.withColumn("next", F.lead("text").over(line)).where("guest = 0").select("doc_id", "text", "next")


def edited_fingerprints(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of each text, of its edited text, and their likeness.

    The edited text has its last floor(n/2) code points replaced by the first as many
    (or all) of the next document in descending id. A null text counts as empty; texts
    without words share one fingerprint, which is like itself (1) and nothing else.
    Repeated rows and ids are kept; one row is its own next. An empty table gives none.
    """
    pairs = with_next(docs, id, text)
    whole = F.coalesce("text", F.lit(""))
    half = F.floor(F.char_length(whole) / 2).cast("int")
    pairs = pairs.select(
        "doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("next", F.lit("")).alias("next"),
        F.char_length(whole).cast("long").alias("n_chars"),
        F.concat(F.substring(whole, 1, F.char_length(whole) - half), F.substring(F.coalesce("next", F.lit("")), 1, half)).alias("edited"))
    pairs = pairs.withColumn("edited_sha256", F.sha2("edited", 256))
    schema = pairs.schema

    def printed(batches):
        for batch in batches:
            for first in range(0, batch.num_rows, 512):
                part = batch.slice(first, 512)
                own, nxt, edited = (fingerprints(part.column(c)) for c in ("text", "next", "edited"))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("n_chars"), part.column("edited_sha256"), as_hex(own), as_hex(edited),
                     pa.array(likeness(own, edited)), pa.array(likeness(own, nxt))],
                    names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    kind = schema["doc_id"].dataType.simpleString()
    return pairs.mapInArrow(printed, f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, "
                                     "edited_fingerprint string, near_edited double, near_next double")


def near_duplicates(docs: DataFrame, threshold: float = 0.8, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, class_id``: classes of texts linked by a shared band and Jaccard ``threshold`` or more.

    Within a band every text is first compared with the smallest key and with its neighbour
    in key order; bands that these links leave in several components are then compared whole
    (see ``rest_of_bands``), so no pair of a band is passed over unless it is connected.
    ``class_id`` is the smallest id reachable. Null and wordless texts are classes by their
    own id; null ids never lend their class a name unless it has no other. Repeated rows are kept.
    """
    rows = picked(docs, doc_id=id, text=text).withColumn("key", text_key(F.col("text")))
    texts = rows.where(F.col("text").isNotNull()).groupBy("key").agg(F.first("text").alias("text"))

    def banded(batches):
        for batch in batches:
            for first in range(0, batch.num_rows, 512):
                part = batch.slice(first, 512)
                prints = fingerprints(part.column("text"))
                some = (prints != _EMPTY).any(axis=1)
                bands = [[(int(x) ^ (i << 56)) for i, x in enumerate(_band_hashes(p))] if ok else [] for p, ok in zip(prints, some)]
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(bands, pa.list_(pa.int64()))], names=["key", "bands"])

    bands = cut(texts.mapInArrow(banded, "key binary, bands array<long>").select("key", F.explode("bands").alias("band")))
    low = bands.groupBy("band").agg(F.min("key").alias("low"))
    star = bands.join(low, "band").where("key != low").select(F.col("low").alias("a"), F.col("key").alias("b"))
    line = Window.partitionBy("band").orderBy("key")
    chain = bands.withColumn("a", F.lag("key").over(line)).where("a is not null and a != key").select("a", F.col("key").alias("b"))
    pairs = star.union(chain).distinct()
    sided = pairs.join(texts.select(F.col("key").alias("a"), F.col("text").alias("ta")), "a").join(
        texts.select(F.col("key").alias("b"), F.col("text").alias("tb")), "b")

    def verified(batches):
        for batch in batches:
            both = zip(shingle_sets(batch.column("ta")), shingle_sets(batch.column("tb")))
            near = [len(x) + len(y) > 0 and (o := len(np.intersect1d(x, y, True))) >= threshold * (len(x) + len(y) - o) for x, y in both]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(near, pa.bool_()))

    links = cut(sided.select("a", "b", "ta", "tb").mapInArrow(verified, "a binary, b binary"))
    links = links.union(cut(rest_of_bands(bands, texts, components(links), threshold)))
    label = components(links)
    named = rows.join(label, rows["key"] == label["node"], "left").withColumn("class", F.coalesce("label", "key"))
    empty = F.coalesce("text", F.lit("")).rlike(r"^[\x20\x09-\x0D]*$")
    lowest = named.where(~empty).groupBy("class").agg(F.min("doc_id").alias("_low"))
    return named.join(lowest, "class", "left").select(
        "doc_id", F.when(empty, F.col("doc_id")).otherwise(F.col("_low")).alias("class_id"))


def rest_of_bands(bands: DataFrame, texts: DataFrame, label: DataFrame, threshold: float) -> DataFrame:
    """``a, b``: links that connect whatever is linked within a band and not yet connected by ``label``.

    Star and chain have compared all pairs of up to three texts. Larger bands are dealt out as pairs
    of chunks of about ``CHUNK`` texts: tasks are bounded, but the work grows with the square of a
    band whose texts are alike and not connected.
    """
    parted = bands.join(label, bands["key"] == label["node"], "left").select("band", "key", F.coalesce("label", "key").alias("part"))
    parted = cut(parted)
    open_bands = (parted.groupBy("band").agg(F.count("*").alias("size"), F.min("part").alias("first"), F.max("part").alias("last"))
                  .where("size > 3 and first != last").select("band", F.ceil(F.col("size") / CHUNK).alias("chunks")))
    dealt = parted.join(open_bands, "band").withColumn("chunk", F.pmod(F.xxhash64("key"), F.col("chunks")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select(
        "band", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "chunk", "key", "part")
    full = dealt.join(texts, "key")
    cell = ["band", "i", "j"]

    def closed(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        keys = table.column("key").to_pylist()
        _, known = np.unique(np.array([p.hex() for p in table.column("part").to_pylist()]), return_inverse=True)
        whole = table.column("i")[0].as_py() == table.column("j")[0].as_py()
        sides = None if whole else np.array(table.column("chunk").to_pylist())
        pairs = closer(list(shingle_sets(table.column("text").combine_chunks())), threshold, known, sides) if known.any() else []
        return pa.RecordBatch.from_arrays([pa.array([keys[a] for a, _ in pairs], pa.binary()),
                                           pa.array([keys[b] for _, b in pairs], pa.binary())], names=["a", "b"])

    def compared(batches):  # rows come sorted by cell; one cell is held at a time
        held, key = [], None
        for batch in batches:
            first = 0
            for now, run in groupby(zip(*(batch.column(c).to_pylist() for c in cell))):
                last = first + sum(1 for _ in run)
                if now != key:
                    if held:
                        yield closed(held)
                    held, key = [], now
                held.append(batch.slice(first, last - first))
                first = last
        if held:
            yield closed(held)

    return full.select(*cell, "chunk", "key", "part", "text").repartition(*cell).sortWithinPartitions(*cell).mapInArrow(
        compared, "a binary, b binary")


def closer(sets: list[np.ndarray], threshold: float, known: np.ndarray, sides: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links of Jaccard ``threshold`` or more among ``sets`` (places) that connect what ``known`` numbers leave apart.

    Overlaps are counted exactly through inverted lists; between different ``sides`` only if given.
    """
    sizes = np.array([len(s) for s in sets])
    begin = np.concatenate([[0], np.cumsum(sizes)])
    grams = np.concatenate(sets)
    sort = np.argsort(grams, kind="stable")  # the lists, each in ascending place of its texts
    index = np.repeat(np.arange(len(sets)), sizes)[sort]
    new = np.flatnonzero(np.concatenate([[True], grams[sort][1:] != grams[sort][:-1]]))
    place = np.empty(len(grams), np.int64)
    place[sort] = np.arange(len(grams))
    start = np.empty(len(grams), np.int64)
    start[sort] = np.repeat(new, np.diff(np.concatenate([new, [len(grams)]])))
    forest, found, least = Forest(len(sets)), [], {}
    for x, part in enumerate(known.tolist()):
        forest.join(x, least.setdefault(part, x))
    for x in range(1, len(sets)):
        roots = np.array([forest.root(d) for d in range(x)])
        able = roots != forest.root(x)
        if sides is not None:
            able &= sides[:x] != sides[x]
        if not able.any():
            continue
        lists = [index[a:b] for a, b in zip(start[begin[x]:begin[x + 1]], place[begin[x]:begin[x + 1]]) if b > a]
        if not lists:
            continue
        same = np.bincount(np.concatenate(lists), minlength=x)
        for d in np.flatnonzero(able & (same >= threshold * (sizes[x] + sizes[:x] - same))):
            if forest.join(x, int(d)):
                found.append((x, int(d)))
    return found


def _band_hashes(row: np.ndarray) -> np.ndarray:
    from .common import mix
    parts = row.reshape(-1, ROWS).astype(np.uint64)
    out = np.zeros(len(parts), np.uint64)
    for k in range(ROWS):
        out = mix(out * np.uint64(31) + parts[:, k])
    return (out >> np.uint64(8)).astype(np.int64)
