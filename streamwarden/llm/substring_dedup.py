"""Removing long repeats of words by level-wise doubling.

A window is ``width`` consecutive words of one text. All its shorter parts repeat where it repeats, so
windows are first tried at a fraction of their length, and only those found twice there are tried at twice
that length, until the length is the width itself:

1. Lengths are the width halved (rounded up) down to under ``SHORTEST``: 9, 18 and 35 words for 35.
2. At a length below the width every window still alive names one of its parts of that length, the one of least
   hash (the leftmost of equals). Equal windows name equal parts at equal offsets, so a window dies
   whose part stands at one place alone. Neighbours mostly name the same part: about one row goes out for each
   (width - length) / 2 words, not one for each word.
3. At the full length the windows that name one part are a segment. A segment found twice repeats as a whole.
   Where different segments share their part, their windows are compared one by one, each different segment once.
4. Equal texts are one text throughout; all of a long enough text goes if it has a copy.

Parts are found by 64-bit hashes, segments and windows at the last length by 128 bits. All comparisons are group counts and
semi-joins in Spark; a task holds one text at a time.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..operators.skew import salted_join
from ..session import cut
from .common import _WORD, held_twice, parts, picked, release, run_hashes, slices, span_hashes, text_key, words_in

WIDTH, SHORTEST = 35, 10
SALT = 0x5851F42D4C957F2D
_SAME = np.arange(256, dtype=np.uint8)


def lengths(width: int) -> list[int]:
    """Lengths tried, ascending; the last is the width."""
    out = [width]
    while out[0] >= SHORTEST:
        out.insert(0, -(-out[0] // 2))
    return out


def named_parts(words: np.ndarray, width: int, length: int) -> np.ndarray:
    """For each window of one text the place of its part of ``length`` words that has the least hash."""
    hashes, span = run_hashes(words, length), width - length + 1
    if len(hashes) < span:
        return np.zeros(0, np.int64)
    low, have = (hashes & ~np.uint64(0xFFFFFFFF)) | np.arange(len(hashes), dtype=np.uint64), 1
    while 2 * have <= span:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    if have < span:
        low = np.minimum(low[:len(low) - (span - have)], low[span - have:])
    return (low & np.uint64(0xFFFFFFFF)).astype(np.int64)


def alive(words: np.ndarray, width: int, tried: list[int], places: list[np.ndarray]) -> np.ndarray:
    """Windows (their first words) whose parts at all lengths tried are among the ``places`` found twice."""
    live = np.ones(max(0, len(words) - width + 1), bool)
    for length, known in zip(tried, places):
        if not live.any():
            break
        live &= np.isin(named_parts(words, width, length), known)
    return np.flatnonzero(live)


def hashed_words(text: str | None) -> np.ndarray:
    data = np.frombuffer((text or "").encode(), np.uint8)
    return words_in(data, np.array([0, len(data)]), _WORD, _SAME)[2]


PART = "key binary, part array<long>, place array<int>"


def first_parts(rows: DataFrame, width: int, length: int) -> DataFrame:
    """``doc_id, key, n_words, whole, part, place``: words, their hash, and the parts named at the first length."""
    def made(batches):
        release()
        for batch in parts(batches):
            n_words, whole, part, place = [], [], [], []
            texts = batch.column("text")
            for first, last, data, ends in slices(texts):
                words, at = words_in(data, ends, _WORD, _SAME)[2:]
                for k in range(last - first):
                    own = words[at[k]:at[k + 1]]
                    kept = b" ".join(data[ends[k]:ends[k + 1]].tobytes().split())
                    named = np.unique(named_parts(own, width, length))
                    n_words.append(len(own))
                    whole.append(hashlib.sha256(kept).hexdigest())
                    place.append(named.astype(np.int32))
                    part.append(run_hashes(own, length)[named].astype(np.int64) if len(named) else named)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("key"), pa.array(n_words, pa.int64()), pa.array(whole, pa.string()),
                 pa.array(part, pa.list_(pa.int64())), pa.array(place, pa.list_(pa.int32()))],
                names=["doc_id", "key", "n_words", "whole", "part", "place"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(made, f"doc_id {kind}, key binary, n_words long, whole string, part array<long>, place array<int>")


def found_twice(named: DataFrame, column: str) -> DataFrame:
    """``key, <column>``: for each text its places whose part stands at two places or more."""
    each = cut(named.select("key", F.inline(F.arrays_zip("part", "place"))))
    return held_twice(each, ["part"]).groupBy("key").agg(F.array_sort(F.collect_list("place")).alias(column))


def _rows(batches, *columns: str):
    """Rows of the named columns as Python values, a few at a time."""
    release()
    for batch in parts(batches, 16):
        yield from zip(*(batch.column(c).to_pylist() for c in columns))


def next_parts(live: DataFrame, width: int, tried: list[int], length: int) -> DataFrame:
    """``key, part, place`` named at ``length`` by the windows that are alive after the lengths tried."""
    known = [f"p{n}" for n in tried]

    def made(batches):
        for key, text, *places in _rows(batches, "key", "text", *known):
            words = hashed_words(text)
            windows = alive(words, width, tried, [np.array(p) for p in places])
            if len(windows):
                named = np.unique(named_parts(words, width, length)[windows])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([key], pa.binary()), pa.array([run_hashes(words, length)[named].astype(np.int64)], pa.list_(pa.int64())),
                     pa.array([named.astype(np.int32)], pa.list_(pa.int32()))], names=["key", "part", "place"])

    return live.mapInArrow(made, PART)


SEGMENT = "key binary, part long, low int, high int, a long, b long, first int"


def segments(live: DataFrame, width: int, tried: list[int]) -> DataFrame:
    """``key, part, low, high, a, b, first``: runs of live windows that name one part.

    ``low`` and ``high`` place the first and last window from the part, ``a`` and ``b`` are hashes of all words of the segment.
    """
    known, longest = [f"p{n}" for n in tried], tried[-1]

    def made(batches):
        for key, text, *places in _rows(batches, "key", "text", *known):
            words = hashed_words(text)
            windows = alive(words, width, tried, [np.array(p) for p in places])
            if not len(windows):
                continue
            part = named_parts(words, width, longest)[windows]
            new = np.flatnonzero(np.concatenate([[True], (part[1:] != part[:-1]) | (np.diff(windows) > 1)]))
            first, last, part = windows[new], windows[np.concatenate([new[1:], [len(windows)]]) - 1], part[new]
            a, b = (span_hashes(words, first, last + width, salt).astype(np.int64) for salt in (0, SALT))
            yield pa.RecordBatch.from_arrays(
                [pa.array([key] * len(new), pa.binary()), pa.array(run_hashes(words, longest)[part].astype(np.int64)),
                 pa.array((first - part).astype(np.int32)), pa.array((last - part).astype(np.int32)), pa.array(a), pa.array(b),
                 pa.array(first.astype(np.int32))], names=["key", "part", "low", "high", "a", "b", "first"])

    return live.mapInArrow(made, SEGMENT)


def window_rows(asked: DataFrame, width: int) -> DataFrame:
    """``key, first, a, b, n``: the windows of the segments in ``segs`` (first window, last window, how often) of each text."""
    def made(batches):
        for key, text, segs in _rows(batches, "key", "text", "segs"):
            at = [np.arange(s["first"], s["last"] + 1) for s in segs]
            n = np.repeat([s["n"] for s in segs], [len(x) for x in at])
            at, words = np.concatenate(at), hashed_words(text)
            a, b = (span_hashes(words, at, at + width, salt).astype(np.int64) for salt in (0, SALT))
            yield pa.RecordBatch.from_arrays([pa.array([key] * len(at), pa.binary()), pa.array(at.astype(np.int32)), pa.array(a),
                                              pa.array(b), pa.array(n.astype(np.int64))], names=["key", "first", "a", "b", "n"])

    return asked.mapInArrow(made, "key binary, first int, a long, b long, n long")


def repeats(texts: DataFrame, found: DataFrame, width: int) -> DataFrame:
    """``key, first, last``: windows that repeat, as runs of first words. ``found`` has all segments."""
    same = ["part", "low", "high", "a", "b"]
    whole = held_twice(found, same).select("key", "first", (F.col("first") + F.col("high") - F.col("low")).alias("last"))
    if width == 1:
        return whole
    different = found.groupBy(*same).agg(F.count("*").alias("n"), F.min(F.struct("key", "first")).alias("one"))
    different = cut(different.select("part", "n", "one.key", "one.first", (F.col("one.first") + F.col("high") - F.col("low")).alias("last")))
    mixed = cut(held_twice(different, ["part"]))
    asked = mixed.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("first", "last", "n"))).alias("segs"))
    windows = cut(window_rows(texts.join(asked, "key"), width))
    single = held_twice(windows, ["a", "b"], weight="n").where("n = 1")
    return whole.union(single.select("key", "first", F.col("first").alias("last")))


def without_repeats(docs: DataFrame, width: int = WIDTH, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256, n_kept, removed`` of every row of ``docs``.

    Words part at the bytes 0x20 and 0x09-0x0D and stay as they are. A word goes if a window of ``width`` words that
    covers it has its words also elsewhere, in the same text or another. ``kept_sha256`` is of the words that stay,
    joined by a space; ``removed`` has the runs of words that go, as [begin, end). A null text has no words; a text
    with fewer words than ``width`` keeps all. Two rows of one text repeat each other. Null and repeated ids are
    kept, other columns are not read, an empty table gives no rows.
    """
    if width < 1:
        raise ValueError("a window has a word at least")
    rows = picked(docs, doc_id=id, text=text).withColumn("key", text_key(F.col("text")))
    tried = lengths(width)
    brief = cut(first_parts(rows, width, tried[0]))
    copies = brief.where(F.col("n_words") >= width).groupBy("key").agg(
        F.count("*").alias("n"), *[F.first(c).alias(c) for c in ("part", "place")])
    copies = cut(copies)
    marks = found_twice(copies, f"p{tried[0]}")
    live = cut(rows.select("key", "text").join(marks, "key").groupBy("key").agg(
        *[F.first(c).alias(c) for c in ("text", f"p{tried[0]}")]))
    texts = live.select("key", "text")
    for k in range(1, len(tried) - 1):
        marks = found_twice(next_parts(live, width, tried[:k], tried[k]), f"p{tried[k]}")
        live = live.join(marks, "key")
    tried = tried[:-1] or tried
    spans = repeats(texts, cut(segments(live, width, tried)), width)
    each = spans.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias("spans"))
    once = copies.where("n = 1").select("key")

    def cleaned(batches):
        for key, text, found in _rows(batches, "key", "text", "spans"):
            words, runs = text.encode().split(), []
            for s in found:
                begin, end = s["first"], s["last"] + width
                if runs and begin <= runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], end)
                else:
                    runs.append([begin, end])
            kept, at = [], 0
            for begin, end in runs:
                kept += words[at:begin]
                at = end
            kept += words[at:]
            row = key, len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest(), runs
            kinds = pa.binary(), pa.int64(), pa.string(), pa.list_(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds)], names=["key", "n_removed", "kept", "runs"])

    some = texts.join(each, "key").join(once, "key", "left_semi").mapInArrow(
        cleaned, "key binary, n_removed long, kept string, runs array<array<long>>")
    result = some.union(copies.where("n > 1").select(
        "key", F.lit(None).cast("long"), F.lit(hashlib.sha256().hexdigest()), F.lit(None).cast("array<array<bigint>>")))
    all_of = F.col("kept").isNotNull() & F.col("n_removed").isNull()  # copies lose all their words
    removed = F.when(all_of, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0).cast("long")))
    return salted_join(brief.select("doc_id", "key", "n_words", "whole"), cut(result), ["key"], "left", 100_000).select(
        "doc_id", "n_words", removed.alias("n_removed"), F.coalesce("kept", "whole").alias("kept_sha256"),
        (F.col("n_words") - removed).alias("n_kept"),
        F.when(all_of, F.array(F.array(F.lit(0).cast("long"), F.col("n_words"))))
        .otherwise(F.coalesce("runs", F.array().cast("array<array<bigint>>"))).alias("removed"))
