"""Phrase collocations by set-oriented mining of sorted occurrence relations.

An occurrence relation has the occurrences of all frequent phrases of one length: where each begins and which
phrase it is. It is stored sorted, in blocks of whole pieces of one language: ``joined`` has a bit for each occurrence
that says whether the next one begins a word later, ``numbers`` are the phrases' numbers in the table of all frequent
phrases, 4 bytes each. Both are packed arrays, which Spark passes on whole instead of value by value.

1. Words of all texts are counted: the first table.
2. Occurrences of infrequent phrases leave the relation (a semi-join); what is left is written.
3. The relation is merge-joined with itself by piece and adjacent place: a phrase of k words and the one that
   begins a word later make one of k + 1. Groups are counted over some blocks, then in Spark.
4. Steps 2 and 3 go on to the longest length. A phrase is known by the numbers of its two parts, so counts are exact.

Blocks stay whole in a task, so the join needs no shuffle. A task sends each phrase once for a million of its
occurrences. The semi-join looks phrases up in each task while a count proves them few, and goes through a shuffle
beyond that, where a block follows its known phrases row by row. Executors hold some megabytes of rows at a time: batches
to the workers and row groups of stored blocks are kept small.
"""

from __future__ import annotations

from collections import Counter
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..operators.skew import counted_small
from ..session import cut
from .common import _LOWER, numbered, release, slices, trim, words_in

WORDS = 100_000  # different words counted before they leave a task
PIECE = 30_000  # occurrences of a block, few enough for a row
COUNTED, ROWS = 1_000_000, 50_000  # pairs counted before they leave a task, and sent to Spark at once
LOOKED_UP = 2_000_000  # phrases a task may hold, 8 bytes each; of words, whose texts it needs, a quarter
BATCH = 8 << 20  # bytes that go to a worker at once
ROW_GROUP = {"parquet.block.size": str(BATCH), "parquet.block.size.row.check.min": "1", "parquet.page.size.row.check.min": "1"}
_PIECE_END = np.zeros(256, bool)
_PIECE_END[[*b".,;:!?", 10, 11, 12, 13]] = True
_IN_WORD = ~_PIECE_END
_IN_WORD[[9, 32]] = False

RELATION = "block long, joined binary, numbers binary"
BLOCK = f"{RELATION}, lang string, words array<string>"


@contextmanager
def small_batches(spark: SparkSession):
    """What runs meanwhile passes about ``BATCH`` bytes to a worker at once, or less if the session asks for less."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    if before is None or not 0 < spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(before) <= BATCH:
        spark.conf.set(key, str(BATCH))
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def _tokens(batches):
    """(language, steps, a code for each word, the distinct words) of about a megabyte of texts at a time."""
    for batch in batches:
        langs = np.array(batch.column("lang").to_pylist(), object)
        for first, last, data, ends in slices(batch.column("text")):
            data = _LOWER[data]
            begin, end, word, at = words_in(data, ends, _IN_WORD, _LOWER)
            if not len(begin):
                continue
            text = np.repeat(np.arange(last - first), np.diff(at))
            piece = np.cumsum(_PIECE_END[data])[begin]
            names, lang = np.unique(langs[first:last].astype(str), return_inverse=True)
            raw = data.tobytes()
            for k, name in enumerate(names):
                mine = np.flatnonzero(lang[text] == k)
                if not len(mine):
                    continue
                apart = (np.diff(piece[mine]) > 0) | (np.diff(text[mine]) > 0)
                _, one, codes = np.unique(word[mine], return_index=True, return_inverse=True)
                words = [raw[a:b].decode() for a, b in zip(begin[mine[one]].tolist(), end[mine[one]].tolist())]
                yield name, np.concatenate([[2], 1 + apart]).astype(np.int32), codes, words


def word_counts(rows: DataFrame) -> DataFrame:
    """``lang, phrase, n`` of each word in parts of the texts; the null phrase counts all words."""
    def sent(held: dict):
        for name, counts in held.items():
            words, n = list(counts), list(counts.values())
            for first in range(0, len(n), ROWS):
                some = slice(first, first + ROWS)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(n[some]), pa.string()), pa.array(words[some], pa.string()),
                                                  pa.array(n[some], pa.int64())], names=["lang", "phrase", "n"])

    def made(batches):
        release()
        held: dict[str, Counter] = {}
        for name, _, codes, words in _tokens(batches):
            own = held.setdefault(name, Counter())
            own.update(dict(zip([*words, None], [*np.bincount(codes).tolist(), len(codes)])))
            if sum(map(len, held.values())) >= WORDS:
                yield from sent(held)
                held = {}
        yield from sent(held)
        trim()

    return rows.mapInArrow(made, "lang string, phrase string, n long")


def occurrences(rows: DataFrame) -> DataFrame:
    """``BLOCK`` of ``lang, text``; ``numbers`` point into ``words``."""
    def made(batches):
        release()
        block = TaskContext.get().partitionId() << 32
        for name, steps, codes, words in _tokens(batches):
            yield pa.RecordBatch.from_arrays(
                [*_relation(block, np.cumsum(steps, dtype=np.int64), codes).columns, pa.array([name], pa.string()),
                 pa.array([words], pa.list_(pa.string()))], names=["block", "joined", "numbers", "lang", "words"])
            block += 1
        trim()

    return rows.mapInArrow(made, BLOCK)


def cut_points(place: np.ndarray, size: int):
    """(first, last) of stretches of about ``size`` occurrences, cut where no words are neighbours, so that no pair is lost."""
    gaps, first = np.flatnonzero(np.diff(place) > 1) + 1, 0
    while first < len(place):
        k = np.searchsorted(gaps, first + size)
        last = int(gaps[k]) if k < len(gaps) else len(place)
        yield first, last
        first = last


def known_words(rows: DataFrame, table: DataFrame) -> DataFrame:
    """The relation of the words in ``table``, which is small enough to be looked up in each task."""
    sent = rows.sparkSession.sparkContext.broadcast(table.select("lang", "phrase", "number").toArrow().combine_chunks())

    def made(batches):
        release()
        block = TaskContext.get().partitionId() << 32
        known = {}
        for name in sent.value["lang"].unique().to_pylist():
            own = sent.value.filter(pc.equal(sent.value["lang"], name))
            known[name] = own["phrase"].combine_chunks(), own["number"].to_numpy()
        for name, steps, codes, words in _tokens(batches):
            if name not in known:
                continue
            phrases, numbers = known[name]
            at = pc.index_in(pa.array(words, phrases.type), value_set=phrases).fill_null(-1).to_numpy(zero_copy_only=False)
            found = np.where(at >= 0, numbers[at], -1)[codes]
            place = np.cumsum(steps, dtype=np.int64)[found >= 0]
            found = found[found >= 0]
            for first, last in cut_points(place, PIECE):
                yield _relation(block, place[first:last], found[first:last])
                block += 1
        trim()

    return rows.mapInArrow(made, RELATION)


def _relation(block: int, place: np.ndarray, numbers: np.ndarray) -> pa.RecordBatch:
    """One block: the occurrences of phrases of these ``numbers``."""
    joined = np.packbits(np.append(np.diff(place) == 1, False))
    return pa.RecordBatch.from_arrays(
        [pa.array([block], pa.int64()), pa.array([joined.tobytes()], pa.binary()), pa.array([numbers.astype(np.int32).tobytes()], pa.binary())],
        names=["block", "joined", "numbers"])


def _unpacked(joined: pa.BinaryScalar, numbers: pa.BinaryScalar) -> tuple[np.ndarray, np.ndarray]:
    """(places, numbers) of a block; the places tell neighbours, not how far apart others are."""
    numbers = np.frombuffer(numbers.as_buffer(), np.int32).astype(np.int64)
    bits = np.unpackbits(np.frombuffer(joined.as_buffer(), np.uint8), count=len(numbers))
    return np.cumsum(np.append(0, 2 - bits[:-1].astype(np.int64))), numbers


def _blocks(batches):
    """(block, places, numbers) of one block at a time."""
    for batch in batches:
        for row in range(batch.num_rows):
            yield batch.column("block")[row].as_py(), *_unpacked(batch.column("joined")[row], batch.column("numbers")[row])
    trim()


def only_frequent(relation: DataFrame, asked: DataFrame, table: DataFrame, keys: list[str], joined: bool) -> DataFrame:
    """The occurrences of frequent phrases: a semi-join of blocks with ``table`` (``keys``, ``number``) by shuffle.

    ``asked`` has ``block, code`` and the keys of each phrase of a block; codes are the numbers in the relation, or those
    of the pairs of its merge-join with itself if ``joined``. The known codes of a block come to a task just before the block.
    """
    nothing = [F.lit(None).cast("binary").alias("joined"), F.lit(None).cast("binary").alias("numbers")]
    known = asked.join(table.select(*keys, "number"), keys).select("block", *nothing, "code", "number")
    blocks = relation.select("block", "joined", "numbers", F.lit(None).cast("int").alias("code"), F.lit(None).cast("long").alias("number"))
    dealt = blocks.union(known).repartition("block").sortWithinPartitions("block", F.col("code").asc_nulls_last())

    def kept(batches):
        release()
        held = []  # known codes and their numbers since the last block
        for batch in batches:
            ends = np.flatnonzero(batch.column("code").is_null().to_numpy(zero_copy_only=False)).tolist()
            found = np.stack([batch.column(c).cast(pa.int64()).fill_null(-1).to_numpy() for c in ("code", "number")])
            first = 0
            for end in ends:
                held.append(found[:, first:end])
                first = end + 1
                known, numbers = np.concatenate(held, axis=1)
                held = []
                if not len(known):
                    continue
                place, codes = _unpacked(batch.column("joined")[end], batch.column("numbers")[end])
                if joined:
                    place, codes, _ = adjacent(place, codes)
                of = np.full(int(codes.max()) + 1, -1, np.int64)
                of[known] = numbers
                some = of[codes] >= 0
                yield _relation(batch.column("block")[end].as_py(), place[some], of[codes[some]])
            held.append(found[:, first:])
        trim()

    return dealt.mapInArrow(kept, RELATION)


def adjacent(place: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merge-join with the occurrences one place later: (places, codes of the pairs, the distinct pairs)."""
    at = np.flatnonzero(place[1:] - place[:-1] == 1)
    size = int(codes.max(initial=0)) + 1
    pairs, both = np.unique(codes[at].astype(np.int64) * size + codes[at + 1], return_inverse=True)
    return place[at], both, np.stack([pairs // size, pairs % size])


def extended(relation: DataFrame, size: int) -> DataFrame:
    """``pair, n``: the phrases one word longer, counted over some blocks at a time. A pair is ``left * size + right``, numbers are below ``size``."""
    def counted(pairs: list):
        found, counts = np.unique(np.concatenate(pairs), return_counts=True)
        for first in range(0, len(found), ROWS):
            some = slice(first, first + ROWS)
            yield pa.RecordBatch.from_arrays([pa.array(found[some]), pa.array(counts[some])], names=["pair", "n"])

    def made(batches):
        release()
        held = []
        for _, place, numbers in _blocks(batches):
            at = np.flatnonzero(np.diff(place) == 1)
            held.append(numbers[at] * size + numbers[at + 1])
            if sum(map(len, held)) >= COUNTED:
                yield from counted(held)
                held = []
        if held:
            yield from counted(held)

    return relation.mapInArrow(made, "pair long, n long")


def extended_blocks(relation: DataFrame, size: int) -> DataFrame:
    """``block, code, pair``: the phrases one word longer that each block has."""
    def made(batches):
        release()
        for block, place, numbers in _blocks(batches):
            _, _, pairs = adjacent(place, numbers)
            n = pairs.shape[1]
            for first in range(0, n, ROWS):
                some = slice(first, first + ROWS)
                codes = np.arange(n, dtype=np.int32)[some]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(codes), block, np.int64)), pa.array(codes), pa.array(
                    pairs[0, some] * size + pairs[1, some])], names=["block", "code", "pair"])

    return relation.mapInArrow(made, "block long, code int, pair long")


def looked_up(relation: DataFrame, table: DataFrame, size: int) -> DataFrame:
    """``only_frequent`` for few phrases: their pairs, sorted as they are numbered, go to each task."""
    sent = table.sparkSession.sparkContext.broadcast(np.sort(table.select("pair").toArrow()["pair"].to_numpy()))

    def kept(batches):
        release()
        keys = sent.value
        for block, place, numbers in _blocks(batches):
            place, codes, pairs = adjacent(place, numbers)
            if not len(codes) or not len(keys):
                continue
            asked = pairs[0] * size + pairs[1]
            at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
            of = np.where(keys[at] == asked, at, -1)
            held = of[codes] >= 0
            if held.any():
                yield _relation(block, place[held], of[codes[held]])

    return relation.mapInArrow(kept, RELATION)


def _size(table: DataFrame) -> int:
    if (size := table.count()) >= 1 << 31:
        raise ValueError("more frequent phrases than pairs of them have numbers: ask for more occurrences")
    return size


def frequent_phrases(rows: DataFrame, longest: int, least: int, few: int) -> tuple[list[DataFrame], DataFrame]:
    """(one table for each length, ``lang, n`` of all words).

    Tables have ``number, lang, phrase, last`` (its last word), ``f, left, right`` (numbers of its parts) and ``heads, tails``:
    the counts of its first 1, 2, ... and of its last 1, 2, ... words.
    """
    counts = cut(word_counts(rows).groupBy("lang", "phrase").agg(F.sum("n").alias("f")).where((F.col("f") >= least) | F.col("phrase").isNull()))
    sizes = counts.where("phrase is null").select("lang", F.col("f").alias("n"))
    nothing = F.lit(None).cast("long")
    table = numbered(counts.where("phrase is not null"), [F.col("lang"), F.col("phrase")]).select(
        "number", "lang", "phrase", F.col("phrase").alias("last"), "f", nothing.alias("left"), nothing.alias("right"),
        F.array("f").alias("heads"), F.array("f").alias("tails"))
    tables = [cut(table)]
    size = _size(tables[0])
    if counted_small(tables[0].select("lang", "phrase"), few // 4):
        relation = cut(known_words(rows, tables[0]), **ROW_GROUP)
    else:
        first = cut(occurrences(rows), **ROW_GROUP)
        words = first.select("lang", "block", F.posexplode("words").alias("code", "phrase"))
        relation = cut(only_frequent(first, words, tables[0], ["lang", "phrase"], False), **ROW_GROUP)
    for length in range(2, longest + 1):
        # counts come combined from a task, so they are dealt as they are and summed once
        counted = cut(extended(relation, max(size, 1)).repartition("pair").groupBy("pair").agg(F.sum("n").alias("f")).where(F.col("f") >= least))
        before = tables[-1]
        pairs = numbered(counted, [F.col("pair")]).select(
            "number", "f", F.expr(f"pair div {max(size, 1)}").alias("left"), (F.col("pair") % max(size, 1)).alias("right"))
        left = before.select(F.col("number").alias("left"), "lang", F.col("phrase").alias("head"), "heads")
        right = before.select(F.col("number").alias("right"), "last", "tails")
        table = pairs.join(left, "left").join(right, "right").select(
            "number", "lang", F.concat_ws(" ", "head", "last").alias("phrase"), "last", "f", "left", "right",
            F.concat("heads", F.array("f")).alias("heads"), F.concat("tails", F.array("f")).alias("tails"))
        tables.append(cut(table))
        if length < longest:
            frequent = tables[-1].select("number", (F.col("left") * size + F.col("right")).alias("pair"))
            if (more := _size(frequent)) <= few:
                relation = cut(looked_up(relation, frequent, size), **ROW_GROUP)
            else:
                relation = cut(only_frequent(relation, extended_blocks(relation, size), frequent, ["pair"], True), **ROW_GROUP)
            size = more
    return tables, sizes


def scored(table: DataFrame, length: int) -> DataFrame:
    """Adds the lowest-scoring cut: ``score, l, r``."""
    def whole(c: Column) -> Column:
        return c.cast("decimal(15,0)")

    cuts = []
    for k in range(1, length):
        l, r = F.col("heads")[k - 1], F.col("tails")[length - k - 1]
        table = table.withColumns({f"_up{k}": whole(F.col("f")) * whole(F.col("f")) * F.lit(1_000_000).cast("decimal(7,0)"),
                                   f"_down{k}": whole(l) * whole(r)})
        cuts.append(F.struct(F.expr(f"_up{k} div _down{k}").alias("score"), F.lit(k).alias("k"), l.alias("l"), r.alias("r")))
    return table.withColumn("best", F.array_min(F.array(*cuts))).select(
        "number", "lang", "phrase", "f", F.col("best.score").alias("score"), F.col("best.l").alias("l"), F.col("best.r").alias("r"))


def collocations(docs: DataFrame, longest: int = 3, least: int = 10, top: int = 2000, covered: int = 50, lang: str = "lang",
                 text: str = "text", few: int = LOOKED_UP) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the best phrases of two to ``longest`` words of each language.

    Texts are lower-cased (A-Z), split into pieces at ``.,;:!?`` and line ends, pieces into words at spaces and tabs. A
    phrase is a candidate from ``least`` occurrences (a) on. Its score is floor(1000000 a a / (l r)), l and r the occurrences
    of its two parts at the cut that scores lowest. A candidate inside a longer one of ``covered`` percent of
    its occurrences or more goes. A null language is ``und``; null, empty and wordless texts have no occurrences. Repeated
    rows count each time. Empty tables give no rows; other columns are not read. Occurrences above 10^15 end in an error.
    """
    if longest < 2:
        raise ValueError("a phrase has two words at least")
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).alias("text"))
    with small_batches(docs.sparkSession):
        tables, sizes = frequent_phrases(rows, longest, least, few)
    found = []
    for length, table in enumerate(tables[1:], 2):
        phrases = scored(table, length)
        if length < longest:  # occurrences fall with length, so phrases one word longer decide
            inside = tables[length].select("f", F.explode(F.array("left", "right")).alias("number")).groupBy("number").agg(
                F.max("f").alias("longer"))
            phrases = phrases.join(inside, "number", "left").where(
                F.col("longer").isNull() | (100 * F.col("longer") < covered * F.col("f"))).drop("longer")
        found.append(phrases.select("lang", "phrase", F.col("f").alias("a"), "l", "r", "score"))
    every = found[0]
    for more in found[1:]:
        every = every.union(more)
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(64))  # a language is cut down in parts before it meets in one task
    few_of_each = every.withColumn("_part", part).withColumn(
        "rank", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order))).where(F.col("rank") <= top)
    ranked = few_of_each.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return ranked.where(F.col("rank") <= top).join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
