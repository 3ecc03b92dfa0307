"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
import os
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..operators.skew import sized
from ..session import cut

SLICE_BYTES = 1_000_000
SHINGLE = 5
_R = np.uint64(0x9E3779B97F4A7C15)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.ones(256, bool)
_WORD[[9, 10, 11, 12, 13, 32]] = False
_BYTE = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64)


def text_key(text: Column) -> Column:
    """16 bytes that stand for a text; a null text has the key of the empty one."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def picked(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns of ``df``, renamed, so that further columns cannot clash."""
    return df.select(*[df[old].alias(new) for new, old in columns.items()])


def fresh_name(df: DataFrame, name: str) -> str:
    """A name for a working column that no column of ``df`` has, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while (name := "_" + name) in taken:
        pass
    return name


def reach(spark: SparkSession) -> None:
    """Lets Python workers import this package from where the driver found it, if they have it there."""
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    known = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in known:
        env["PYTHONPATH"] = os.pathsep.join([*known, root])


def mix(x: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit values (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_HELD: dict[str, object] = {}


def held(key: str, make):
    """What a worker keeps between its tasks, made once. It keeps one such thing: another key takes the place of the last."""
    if key not in _HELD:
        release()
        _HELD[key] = make()
    return _HELD[key]


def release() -> None:
    """Frees what another operator kept in this worker."""
    if _HELD:
        _HELD.clear()
        gc.collect()
        trim()


def trim() -> None:
    """Gives freed memory back to the system. Workers live on between tasks, and the C library keeps what was freed."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        return


def parts(batches, rows: int = 1000):
    """Record batches in pieces of a bounded number of rows."""
    for batch in batches:
        for first in range(0, batch.num_rows, rows):
            yield batch.slice(first, rows)
    trim()


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(_R), -1, 1 << 64))
    first = np.ones(1, np.uint64)
    return (np.concatenate([first, np.cumprod(np.full(n, _R))]),
            np.concatenate([first, np.cumprod(np.full(n, inverse))]))


def slices(texts: pa.Array, limit: int = SLICE_BYTES):
    """(first, last, bytes, offsets) of runs of whole texts of about ``limit`` bytes; null counts as empty."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    _, ends, data = texts.buffers()
    ends = np.frombuffer(ends, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(ends, ends[first] + limit, "right")) - 1)
        yield first, last, data[ends[first]:ends[last]], ends[first:last + 1] - ends[first]
        first = last


def words_in(data: np.ndarray, ends: np.ndarray, word: np.ndarray, fold: np.ndarray) -> tuple[np.ndarray, ...]:
    """(begin, end, 64-bit hash) of all words in order, and where each text's words begin.

    ``word`` says of each byte whether it belongs to words, ``fold`` what it counts as; words end at ends of texts.
    """
    n = len(data)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = word[data]
    fresh = np.zeros(n + 1, bool)
    fresh[ends] = True
    begin = np.flatnonzero(inside[1:-1] & (~inside[:-2] | fresh[:-1]))
    end = np.flatnonzero(inside[1:-1] & (~inside[2:] | fresh[1:])) + 1
    top = 1 << max(20, int(n).bit_length())
    power, inverse = _powers(top)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[fold[data]] * power[:n], out=total[1:])
    return begin, end, mix((total[end] - total[begin]) * inverse[begin]), np.searchsorted(begin, ends)


def word_hashes(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words in order, and where each text's words begin.

    A-Z count as a-z; words part at the bytes 0x20 and 0x09-0x0D and at ends of texts.
    """
    return words_in(data, ends, _WORD, _LOWER)[2:]


def span_hashes(words: np.ndarray, begin: np.ndarray, end: np.ndarray, salt: int = 0) -> np.ndarray:
    """64-bit hashes of the words from ``begin`` to before ``end``, from the words' hashes; another ``salt`` gives an independent hash."""
    power, inverse = _powers(1 << max(20, len(words).bit_length()))
    total = np.zeros(len(words) + 1, np.uint64)
    np.cumsum((mix(words + np.uint64(salt)) if salt else words) * power[:len(words)], out=total[1:])
    return mix((total[end] - total[begin]) * inverse[begin])


def run_hashes(words: np.ndarray, size: int, salt: int = 0) -> np.ndarray:
    """``span_hashes`` of all runs of ``size`` words."""
    begin = np.arange(max(0, len(words) - size + 1))
    return span_hashes(words, begin, begin + size, salt)


def numbered(df: DataFrame, order: list[Column]) -> DataFrame:
    """Adds ``number``, from 0 without gaps in the order given; rows that tie wholly come in any order.

    A range shuffle sorts, and one count for each partition gives its first number. The sorted rows are written
    out, as they must not change between the two.
    """
    rows = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
               .withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    first = F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = rows.groupBy("_part").agg(F.count("*").alias("n")).select("_part", first.alias("_first"))
    return rows.join(F.broadcast(parts), "_part").withColumn("number", F.col("_first") + F.col("_at")).drop(
        "_part", "_at", "_first")


def held_twice(each: DataFrame, by: list[str], hot: int = 1_000, weight: str | None = None) -> DataFrame:
    """The rows of ``each`` whose value of ``by`` stands in two rows or more (or sums up to two of ``weight``).

    Counts are combined before the shuffle. Values in over ``hot`` rows (at most one in ``hot`` of all rows) are looked up
    by broadcast where a count proves them few, so that no task gets all rows of one value. ``each`` should be a stored table.
    """
    counts = cut(each.groupBy(*by).agg(F.count("*").alias("_n"), (F.sum(weight) if weight else F.count("*")).alias("_w"))
                 .where("_w > 1").select(*by, "_n"))
    often = counts.where(F.col("_n") > hot).drop("_n")
    seldom = each.join(counts.where(F.col("_n") <= hot).drop("_n"), by, "left_semi")
    return seldom if often.isEmpty() else seldom.union(each.join(sized(often), by, "left_semi"))


def shingle_hashes(words: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Hashes of the shingles of one text's words; fewer words than ``size`` are one shingle."""
    if len(words) == 0:
        return words
    count = len(words) - size + 1
    if count < 1:
        out = np.zeros(1, np.uint64)
        for j in range(len(words)):
            out += words[j:j + 1] * np.uint64(pow(int(_R), j + 1, 1 << 64))
        return mix(out + np.uint64(len(words)))
    out = np.zeros(count, np.uint64)
    for j in range(size):
        out += words[j:j + count] * np.uint64(pow(int(_R), j + 1, 1 << 64))
    return mix(out + np.uint64(size))


def shingle_sets(texts: pa.Array):
    """The sorted distinct shingle hashes of each text, in order."""
    for first, last, data, ends in slices(texts):
        words, at = word_hashes(data, ends)
        for k in range(last - first):
            yield np.unique(shingle_hashes(words[at[k]:at[k + 1]]))
