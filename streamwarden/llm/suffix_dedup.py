"""Removing long repeats with column-wise suffix construction over aligned segments.

The bytes of a text are to go where a string of ``width`` bytes covers them that also
starts elsewhere. Sorting all suffixes of a corpus in one place is out of the question,
so the suffixes that can match are first brought together:

1. Every window of ``width`` bytes has an anchor, its ``gram``-byte string of least hash
   (the leftmost of equals). Equal windows have equal anchors at the same offset. The
   windows of one anchor are a run; together they span one segment of the text.
2. Segments whose anchor string occurs once are done. Of the others equal ones (same bytes, same place of
   the anchor) are found first: all of their windows repeat. The different ones, each once, meet by anchor.
3. A task builds the suffix order of its segments column by column, from the right:
   each round inserts one symbol for every segment (the next column of the collection's
   Burrows-Wheeler transform), sorts the suffixes by it from their order before, and
   updates the common prefixes of neighbours. As equal windows lie in the same column,
   suffixes of different columns need not be merged. A window repeats if it shares ``width`` bytes with a
   neighbour. Batches of whole anchors bound the memory; columns are read in sequence.
4. If an anchor has over ``LIMIT`` different segments, its windows go into
   classes by their offset, each keyed by the bytes that all windows of the class share,
   with classes of 64, 8 and at last one window, whose key is the window itself.
"""

from __future__ import annotations

import hashlib
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..operators.skew import sized
from ..session import cut
from .common import _BYTE, _powers, held_twice, mix, parts, picked, slices, text_key

WIDTH = 400
LIMIT = 20_000
BATCH = 4_000  # segments from which on a batch is sorted
CLASSES = (64, 8, 1)


def gram_size(width: int) -> int:
    return max(1, min(32, width // 8))


def string_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """64-bit hashes of all strings of ``size`` bytes."""
    n = len(data)
    power, inverse = _powers(1 << max(20, n.bit_length()))
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * power[:n], out=total[1:])
    return mix((total[size:] - total[:-size]) * inverse[:n - size + 1])


def anchors(data: np.ndarray, ends: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """(text, anchor hash, first window, last window, anchor's place) of the runs in a slice of texts."""
    size = gram_size(width)
    none = tuple(np.zeros(0, np.int64) for _ in range(5))
    if len(data) < width:
        return none
    hashes = string_hashes(data, size)
    if len(data) >= 1 << 32:
        raise ValueError("a text of 4 GB or more")
    lowest = (hashes & ~np.uint64(0xFFFFFFFF)) | np.arange(len(hashes), dtype=np.uint64)
    span, have = width - size + 1, 1
    while 2 * have <= span:
        lowest = np.minimum(lowest[:-have], lowest[have:])
        have *= 2
    if have < span:
        lowest = np.minimum(lowest[:len(lowest) - (span - have)], lowest[span - have:])
    at = (lowest & np.uint64(0xFFFFFFFF)).astype(np.int64)
    text = np.searchsorted(ends, np.arange(len(at)), "right") - 1
    inside = np.arange(len(at)) + width <= ends[text + 1]
    starts = np.flatnonzero(inside)
    if not len(starts):
        return none
    a, t = at[starts], text[starts]
    new = np.concatenate([[True], (a[1:] != a[:-1]) | (t[1:] != t[:-1])])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(starts)]]) - 1
    t, begin = t[first], ends[t[first]]
    return t, hashes[a[first]].astype(np.int64), starts[first] - begin, starts[last] - begin, a[first] - begin


def repeated_windows(segments: list[bytes], places: np.ndarray, groups: np.ndarray, width: int) -> list[np.ndarray]:
    """For each segment, which of its windows also occur in another segment of its group.

    ``places`` has each segment's column: where its first byte lies relative to the anchor.
    ``groups`` has to be sorted.
    """
    m = len(segments)
    sizes = np.array([len(s) for s in segments])
    left = int(places.min())
    columns = int((places + sizes).max()) - left
    symbols = np.zeros((columns, m), np.int16)  # 0 where a segment has no byte
    for i, s in enumerate(segments):
        a = int(places[i]) - left
        symbols[a:a + len(s), i] = np.frombuffer(s, np.uint8).astype(np.int16) + 1
    first, last = places - left, places - left + sizes - width
    found = np.zeros((columns, m), bool)
    rank = (np.cumsum(np.concatenate([[0], groups[1:] != groups[:-1]])).astype(np.int64) << 9)
    order, common = np.arange(m), np.zeros(m, np.uint16)  # common[i]: bytes that i shares with i - 1
    for column in range(columns - 1, -1, -1):
        symbol = symbols[column, order]  # this column of the transform
        key = rank[order] + symbol
        by = np.argsort(key, kind="stable")
        key = key[by]
        same = (key[1:] == key[:-1]) & (symbol[by][1:] > 0)
        new = np.zeros(m, np.uint16)
        at = np.flatnonzero(same)
        if len(at):
            new[at + 1] = np.minimum(range_minima(common, by[at] + 1, by[at + 1]) + 1, width)
        order, common = order[by], new
        whole = common >= width
        whole[:-1] |= whole[1:]
        hit = order[whole]
        found[column, hit[(first[hit] <= column) & (column <= last[hit])]] = True
    return [found[first[i]:last[i] + 1, i] for i in range(m)]


def range_minima(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Minima of values[low..high], ends included, by a table of power-of-two ranges."""
    power = np.frexp((high - low + 1).astype(np.float64))[1] - 1
    table = [values]
    for k in range(int(power.max())):
        step = 1 << k
        row = table[-1]
        table.append(np.minimum(row[:-step], row[step:]) if len(row) > step else row)
    out = np.empty(len(low), values.dtype)
    for k in np.unique(power):
        mine = power == k
        out[mine] = np.minimum(table[k][low[mine]], table[k][high[mine] - (1 << int(k)) + 1])
    return out


def _spans(batch: list[tuple], width: int):
    """(text key, begin, end) of the repeated stretches of (group, key, first window, place, bytes)."""
    groups = np.array([hash(g) for g, *_ in batch])
    groups = np.cumsum(np.concatenate([[0], groups[1:] != groups[:-1]]))
    places = np.array([r[3] for r in batch])
    for row, hits in zip(batch, repeated_windows([r[4] for r in batch], places, groups, width)):
        edge = np.flatnonzero(np.diff(np.concatenate([[0], hits.view(np.int8), [0]])))
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
            yield row[1], row[2] + a, row[2] + b - 1 + width


def _span_batch(spans) -> pa.RecordBatch:
    spans = list(spans)
    return pa.RecordBatch.from_arrays(
        [pa.array([s[0] for s in spans], pa.binary()), pa.array([s[1] for s in spans], pa.int64()),
         pa.array([s[2] for s in spans], pa.int64())], names=["key", "begin", "end"])


SEGMENT = "gram binary, key binary, first long, place int, bytes binary"
SPAN = "key binary, begin long, end long"


def sort_segments(segments: DataFrame, width: int) -> DataFrame:
    """``key, begin, end`` of repeats; every ``gram`` has at most ``LIMIT`` rows, which a task holds at once."""
    def sorted_columns(batches):
        held = []
        rows = few_at_once(batches, "gram", "key", "first", "place", "bytes")
        for _, group in groupby(rows, key=lambda r: r[0]):
            group = list(group)
            if len(group) < 2:
                continue
            held += group
            if len(held) >= BATCH:
                yield _span_batch(_spans(held, width))
                held = []
        if held:
            yield _span_batch(_spans(held, width))

    return segments.repartition("gram").sortWithinPartitions("gram").mapInArrow(sorted_columns, SPAN)


def divided(segments: DataFrame, width: int, size: int) -> DataFrame:
    """The segments cut into classes of ``size`` neighbouring windows, keyed by the bytes all of a class share."""
    def cut_up(batches):
        for batch in (b.slice(k, 256) for b in batches for k in range(0, b.num_rows, 256)):
            out = []
            for gram, key, first, place, data in zip(*(c.to_pylist() for c in batch.columns)):
                last = place + len(data) - width  # window columns relative to the anchor: place..last
                for c in range(place // size, last // size + 1):
                    low, high = max(place, c * size), min(last, c * size + size - 1)
                    a, b = (c * size + size - 1) - place, c * size - place + width
                    core = hashlib.blake2b(data[a:b], digest_size=16, salt=(c % (1 << 32)).to_bytes(16, "little")).digest()
                    out.append((core, key, first + low - place, low, data[low - place:high - place + width]))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in out], t) for k, t in enumerate((pa.binary(), pa.binary(), pa.int64(), pa.int32(), pa.binary()))],
                names=["gram", "key", "first", "place", "bytes"])

    return segments.mapInArrow(cut_up, SEGMENT)


def made_one(segments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(different segments, ``key, begin, end`` of those that are not alone): equal ones fall together before the shuffle."""
    marked = segments.withColumn("same", F.md5("bytes"))
    one = cut(marked.groupBy("gram", "place", "same").agg(
        F.count("*").alias("n"), *[F.first(c).alias(c) for c in ("key", "first", "bytes")]))
    alike = marked.select("gram", "place", "same", "key", F.col("first").alias("begin"),
                          (F.col("first") + F.octet_length("bytes")).alias("end"))
    many = one.where("n > 1").select("gram", "place", "same")
    return (one.select("gram", "key", "first", "place", "bytes"),
            alike.join(many, ["gram", "place", "same"], "left_semi").select("key", "begin", "end"))


def repeats(rows: DataFrame, width: int = WIDTH, limit: int = LIMIT) -> tuple[DataFrame, DataFrame]:
    """(``key, text`` of the texts that may hold repeats, ``key, begin, end`` of their repeats).

    ``rows`` has ``key`` and ``text``; every distinct text counts once here.
    """
    def marked(batches):
        for batch in parts(batches):
            lists = [[], [], [], []]
            for first, last, data, ends in slices(batch.column("text")):
                t, *runs = anchors(data, ends, width)
                at = np.searchsorted(t, np.arange(last - first + 1))
                for values, part in zip(runs, lists):
                    part += [values[a:b] for a, b in zip(at, at[1:])]
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), *[pa.array([v.astype(k.to_pandas_dtype()) for v in p], pa.list_(k))
                                        for k, p in zip(kinds, lists)]],
                names=["key", "gram", "first", "last", "place"])

    long = rows.where(F.octet_length("text") >= width)
    runs = long.mapInArrow(marked, "key binary, gram array<long>, first array<int>, last array<int>, place array<int>")
    once = cut(runs.groupBy("key").agg(*[F.first(c).alias(c) for c in ("gram", "first", "last", "place")]))
    each = cut(once.select("key", F.inline(F.arrays_zip("gram", "first", "last", "place"))))
    marks = cut(held_twice(each, ["gram"]).groupBy("key").agg(F.collect_list(F.struct("gram", "first", "last", "place")).alias("marks")))
    wanted = sized(marks.select("key"))  # keys alone; beyond a counted size the texts are shuffled instead
    texts = cut(long.join(wanted, "key", "left_semi").groupBy("key").agg(F.first("text").alias("text")).join(marks, "key"))

    def named(batches):
        """All segments by a hash of their bytes."""
        for key, text, found in few_at_once(batches, "key", "text", "marks"):
            data = text.encode()
            same = [hashlib.blake2b(data[m["first"]:m["last"] + width], digest_size=16).digest() for m in found]
            columns = [np.array([m[c] for m in found]) for c in ("gram", "first", "last", "place")]
            gram, first, last, place = columns
            yield pa.RecordBatch.from_arrays(
                [pa.array([key] * len(found), pa.binary()), pa.array(gram, pa.int64()), pa.array(first, pa.int32()),
                 pa.array(last, pa.int32()), pa.array((first - place).astype(np.int32)), pa.array(same, pa.binary())],
                names=["key", "gram", "first", "last", "place", "same"])

    segments = cut(texts.mapInArrow(named, "key binary, gram long, first int, last int, place int, same binary"))
    alike = ["gram", "place", "same"]
    spans = held_twice(segments, alike).select(
        "key", F.col("first").cast("long").alias("begin"), (F.col("last") + width).cast("long").alias("end"))
    # What is left to sort are the different segments of an anchor, each once; equal ones repeat as a whole.
    different = cut(segments.groupBy(*alike).agg(F.min(F.struct("key", "first", "last")).alias("one")).select(
        "gram", "place", "one.key", "one.first", "one.last"))
    mixed = cut(held_twice(different, ["gram"]))
    often = cut(mixed.groupBy("gram").agg(F.count("*").alias("n")).where(F.col("n") > limit).select("gram", F.lit(True).alias("hot")))
    asked = mixed.join(sized(often), "gram", "left").groupBy("key").agg(F.collect_list(F.struct(
        "gram", "first", "last", "place", F.coalesce("hot", F.lit(False)).alias("hot"))).alias("segs"))

    def emitted(batches):
        out = []
        for key, text, found in few_at_once(batches, "key", "text", "segs"):
            data = text.encode()
            for m in found:
                out.append((m["gram"].to_bytes(8, "little", signed=True), key, m["first"], m["place"],
                            data[m["first"]:m["last"] + width], m["hot"]))
                if len(out) == 2048:
                    yield _segment_batch(out)
                    out = []
        yield _segment_batch(out)

    bytes_of = texts.select("key", "text").join(cut(asked), "key").mapInArrow(emitted, SEGMENT + ", hot boolean")
    spans = spans.union(sort_segments(bytes_of.where("not hot").drop("hot"), width))
    if not often.isEmpty():
        hot = cut(bytes_of.where("hot").drop("hot"))
        for size in (c for c in CLASSES if c == 1 or 2 * c <= width):
            one, repeated = made_one(cut(divided(hot, width, size)))
            counted = held_twice(cut(one), ["gram"])
            many = cut(counted.groupBy("gram").agg(F.count("*").alias("n")).where(F.col("n") > limit).select("gram"))
            spans = spans.union(repeated).union(sort_segments(counted.join(sized(many), "gram", "left_anti"), width))
            if many.isEmpty():
                break
            hot = cut(counted.join(sized(many), "gram", "left_semi"))
    return texts.select("key", "text"), spans


def few_at_once(batches, *columns: str):
    """Rows of the named columns as Python values, a few at a time."""
    for batch in batches:
        for first in range(0, batch.num_rows, 64):
            part = batch.slice(first, 64)
            yield from zip(*(part.column(c).to_pylist() for c in columns))


def _segment_batch(out: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.binary(), pa.binary(), pa.int64(), pa.int32(), pa.binary(), pa.bool_())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)],
                                      names=["gram", "key", "first", "place", "bytes", "hot"])


def without_repeats(docs: DataFrame, width: int = WIDTH, limit: int = LIMIT, id: str = "doc_id",
                    text: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_kept, removed`` of every row; ``removed`` has the runs taken out.

    Lengths are in UTF-8 bytes. A null text counts as empty and shorter texts than
    ``width`` lose nothing. Two rows of the same text repeat each other, so both lose all of
    it. Null and repeated ids are kept. An empty table gives no rows.
    """
    rows = picked(docs, doc_id=id, text=text).withColumn("text", F.coalesce("text", F.lit("")))
    rows = rows.withColumn("key", text_key(F.col("text")))
    size = F.octet_length("text").cast("long")
    brief = cut(rows.select("doc_id", "key", size.alias("n_bytes"), F.sha2("text", 256).alias("whole")))
    texts, spans = repeats(rows.select("key", "text"), width, limit)
    copied = (brief.where(F.col("n_bytes") >= width).groupBy("key").agg(F.count("*").alias("n"), F.first("n_bytes").alias("end"))
              .where("n > 1").select("key", F.lit(0).cast("long").alias("begin"), "end"))
    spans = cut(spans).distinct()
    each = spans.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("begin", "end"))).alias("spans"))

    def removed(batches):
        kinds = (pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.list_(pa.int64())))
        for key, text, found in few_at_once(batches, "key", "text", "spans"):
            data, runs = text.encode(), []
            for s in found:
                if runs and s["begin"] <= runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], s["end"])
                else:
                    runs.append([s["begin"], s["end"]])
            kept, at = hashlib.sha256(), 0
            for a, b in runs:
                kept.update(data[at:a])
                at = b
            kept.update(data[at:])
            row = key, sum(b - a for a, b in runs), len(runs), kept.hexdigest(), runs
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds)],
                                             names=["key", "n_removed", "n_spans", "kept", "runs"])

    single = (texts.join(each, "key").join(copied.select("key"), "key", "left_anti")
              .mapInArrow(removed, "key binary, n_removed long, n_spans long, kept string, runs array<array<long>>"))
    nothing = F.lit(hashlib.sha256().hexdigest())
    all_of = copied.select("key", F.col("end").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), nothing.alias("kept"),
                           F.array(F.array("begin", "end")).alias("runs"))
    return brief.join(single.union(all_of), "key", "left").select(
        "doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"), F.coalesce("kept", "whole").alias("kept_sha256"),
        (F.col("n_bytes") - F.coalesce("n_removed", F.lit(0))).alias("n_kept"), F.coalesce("runs", F.array().cast("array<array<bigint>>")).alias("removed"))
