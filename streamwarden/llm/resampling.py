"""Importance resampling towards a target distribution, over hashed word n-grams.

1. Runs of one to three words fall into buckets by their CRC-32. Tasks count the buckets of the raw and of the
   target texts in arrays; a bucket's gain is the logarithm of its share in the target over its share in the raw
   texts. A document's weight is the sum of the gains of its features, looked up in one array.
2. Score = weight + Gumbel noise from the hash of the id, so that the highest scores are a draw without
   replacement in proportion to exp(weight). Scores are written out.
3. The cutoff score comes from bisection of the range of scores: each job counts rows at or above the 15 values that four
   halvings can ask for. Rows at the cutoff are taken in order of their id, whose own cutoff is found in the same way.
4. The rows drawn are range-partitioned by (score, id) for their ranks; no task sees them all.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut
from .common import _LOWER, numbered, parts, picked, release, slices, words_in

BUCKETS, LENGTHS = 10_000, 3
PIVOTS = 15
LONG = 64  # bytes; longer words take other ways to their checksum
_LETTERS = np.zeros(256, bool)
_LETTERS[48:58] = _LETTERS[65:91] = _LETTERS[97:123] = _LETTERS[128:] = True


def _byte_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, np.uint32(0xEDB88320) ^ (table >> np.uint32(1)), table >> np.uint32(1))
    return table


_CRC = _byte_table()


def _zero_tables() -> np.ndarray:
    """[n, k, b]: what byte b in place k of a checksum becomes behind n zero bytes."""
    out = np.empty((LONG + 1, 4, 256), np.uint32)
    out[0] = np.arange(256, dtype=np.uint32)[None, :] << (np.arange(4, dtype=np.uint32) * 8)[:, None]
    for n in range(LONG):
        out[n + 1] = (out[n] >> np.uint32(8)) ^ _CRC[out[n] & np.uint32(255)]
    return out


_ZEROS = _zero_tables()


def behind(crc: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Checksums moved on by ``sizes`` bytes: crc(a + b) = behind(crc(a), len(b)) ^ crc(b)."""
    def step(c, n):
        return (_ZEROS[n, 0, c & 255] ^ _ZEROS[n, 1, (c >> 8) & 255] ^ _ZEROS[n, 2, (c >> 16) & 255] ^ _ZEROS[n, 3, c >> 24])

    crc, left = crc.astype(np.uint32), sizes.astype(np.int64)
    out = step(crc, np.minimum(left, LONG))
    far = np.flatnonzero(left > LONG)
    while len(far):
        left[far] -= LONG
        out[far] = step(out[far], np.minimum(left[far], LONG))
        far = far[left[far] > LONG]
    return out


def word_checksums(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-32 of each word of lower-cased ``data``, a byte of all words at a time."""
    sizes = end - begin
    order = np.argsort(-np.minimum(sizes, LONG + 1), kind="stable")  # longest first: those that go on are a head
    at, size = begin[order], sizes[order]
    crc = np.full(len(at), 0xFFFFFFFF, np.uint32)
    for k in range(min(int(size.max(initial=0)), LONG)):
        live = int(np.searchsorted(-size, -k, "left")) if k else len(size)
        c = crc[:live]
        crc[:live] = _CRC[(c ^ data[at[:live] + k]) & 255] ^ (c >> np.uint32(8))
    crc = ~crc
    for i in range(int(np.searchsorted(-size, -LONG, "left"))):
        crc[i] = zlib.crc32(data[at[i]:at[i] + size[i]].tobytes())
    out = np.empty_like(crc)
    out[order] = crc
    return out


def features(data: np.ndarray, ends: np.ndarray, buckets: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """(where each text's words begin, for each length the bucket of the run that begins at each word).

    A run of j + 1 words begins at every word but a text's last j; other places of the arrays mean nothing.
    """
    data = _LOWER[data]
    begin, end, _, at = words_in(data, ends, _LETTERS, _LOWER)
    size = end - begin
    crc = word_checksums(data, begin, end)
    spaced = behind(np.full(len(crc), zlib.crc32(b" "), np.uint32), size) ^ crc  # of " " + word
    out, run = [], crc
    for length in range(LENGTHS):
        if length:
            run = behind(run[:-1], size[length:] + 1) ^ spaced[length:]
        out.append((run % np.uint32(buckets)).astype(np.int64))
        if len(run) < 2:
            out += [np.zeros(0, np.int64)] * (LENGTHS - 1 - length)
            break
    return at, out


def bucket_counts(texts: DataFrame, buckets: int) -> DataFrame:
    """``bucket, n`` over all texts of the one column; each task sends at most one row for each bucket."""
    def counted(batches):
        release()
        total = np.zeros(buckets, np.int64)
        for batch in parts(batches):
            for _, _, data, ends in slices(batch.column(0)):
                at, runs = features(data, ends, buckets)
                for j, run in enumerate(runs):
                    whole = np.ones(len(run), bool)
                    for back in range(1, j + 1):  # a run may not reach into the next text
                        cut_at = at[1:] - back
                        whole[cut_at[(cut_at >= 0) & (cut_at < len(run))]] = False
                    total += np.bincount(run[whole], minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some], pa.int64())], names=["bucket", "n"])

    return texts.mapInArrow(counted, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(raw: DataFrame, target: DataFrame, buckets: int) -> np.ndarray:
    """Gain of each bucket in thousandths, rounded down; both sides are smoothed by one."""
    s, t = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
    for held, counts in ((s, raw), (t, target)):
        for bucket, n in bucket_counts(counts, buckets).collect():  # at most one row for each bucket
            held[bucket] = n
    all_s, all_t = int(s.sum()), int(t.sum())
    return np.array([math.floor(1000 * math.log((b + 1) * (all_s + buckets) / ((a + 1) * (all_t + buckets))))
                     for a, b in zip(s.tolist(), t.tolist())], np.int64)


def weighed(rows: DataFrame, gain: np.ndarray) -> DataFrame:
    """``doc_id, n_words, n_features, weight`` of each row of ``doc_id, text``."""
    buckets = len(gain)
    sent = rows.sparkSession.sparkContext.broadcast(gain)

    def scored(batches):
        release()
        for batch in parts(batches):
            out = [[], [], []]
            for _, _, data, ends in slices(batch.column("text")):
                at, runs = features(data, ends, buckets)
                n = np.diff(at)
                size, weight = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
                for j, run in enumerate(runs):
                    total = np.concatenate([[0], np.cumsum(sent.value[run])])
                    have = np.maximum(n - j, 0)
                    first = np.minimum(at[:-1], len(run))
                    size += have
                    weight += total[np.minimum(first + have, len(run))] - total[first]
                for held, values in zip(out, (n, size, weight)):
                    held.append(values)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array(np.concatenate([np.zeros(0, np.int64), *v]), pa.int64()) for v in out]],
                names=["doc_id", "n_words", "n_features", "weight"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(scored, f"doc_id {kind}, n_words long, n_features long, weight long")


def gumbel(id: Column, seed: str) -> Column:
    """Noise in thousandths from the hash of the id."""
    name = F.concat(F.lit(seed + ":"), F.coalesce(id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / float(1 << 32)))).cast("long")


def highest(rows: DataFrame, value: Column, want: int) -> tuple[int, int]:
    """(the largest c with ``want`` rows or more whose value is c or above, how many are above c).

    ``rows`` has at least ``want`` rows with a value; every job counts for ``PIVOTS`` thresholds at once.
    """
    least, most = rows.agg(F.min(value), F.max(value)).first()
    low, high, above = least, most + 1, 0
    while high - low > 1:
        step = -(-(high - low) // (PIVOTS + 1))
        pivots = list(range(low + step, high, step))
        found = rows.agg(*[F.count(F.when(value >= p, 1)) for p in pivots]).first()
        for p, n in zip(pivots, found):
            if n >= want:
                low = p
            else:
                high, above = p, n
                break
    return low, above


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, min_words: int = 20, buckets: int = BUCKETS,
             seed: str = "42", id: str = "doc_id", text: str = "text", target_text: str = "text") -> DataFrame:
    """``doc_id, n_features, weight, score, rank, n_words`` of every row of ``docs``; ``rank`` is null where it was not drawn.

    Words are runs of letters and digits (all but ASCII marks and spaces), A-Z lower-cased. Of the rows with
    ``min_words`` words or more, ``percent`` in a hundred are drawn (rounded down), by score, ties by
    the smaller id, null ids last. A null, empty or wordless text has no features and weight 0. Repeated rows count
    each time and tie; those of one id and score take their ranks in any order. Ids of any type will do: for other
    types than integers all rows at the cutoff score are sorted, not only those drawn. An empty table gives no
    rows, an empty target makes rare buckets the heavy ones. Other columns are not read.
    """
    rows = picked(docs, doc_id=id, text=text)
    gain = gains(rows.select("text"), picked(target, text=target_text), buckets)
    scored = cut(weighed(rows, gain).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed)))
    names = ["doc_id", "n_features", "weight", "score"]
    may = scored.where(F.col("n_words") >= min_words)
    want = may.count() * percent // 100
    undrawn = F.lit(None).cast("long").alias("rank")
    if not want:
        return scored.select(*names, undrawn, "n_words")
    least, above = highest(may, F.col("score"), want)
    chosen = (F.col("n_words") >= min_words) & (F.col("score") >= least)
    if scored.schema["doc_id"].dataType.typeName() in ("byte", "short", "integer", "long"):
        tied = may.where(F.col("score") == least).select(F.col("doc_id").cast("long").alias("doc_id"))
        if tied.where("doc_id is not null").count() >= want - above:
            last, _ = highest(tied.where("doc_id is not null"), -F.col("doc_id"), want - above)
            chosen &= (F.col("score") > least) | F.coalesce(F.col("doc_id") <= -last, F.lit(False))
    ranked = numbered(scored.where(chosen), [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features")])
    drawn = ranked.withColumn("rank", F.when(F.col("number") < want, F.col("number") + 1))
    return drawn.select(*names, "rank", "n_words").union(scored.where(~chosen).select(*names, undrawn, "n_words"))
