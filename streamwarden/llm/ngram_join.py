"""Exact n-gram Jaccard join: documents are linked when their shingle sets reach a similarity.

1. Every row gets its set of distinct five-word shingles as hashes. Equal sets are one.
2. Under any one order of shingles, two sets of n and m that reach the similarity s share m/16 + 1 of
   their first n - ceil(s n) + n/16 + 1 shingles (m the smaller). The order puts shingles found in
   many rows last. A set is sent only under these, as small (shingle, set) rows; sets that share too few of
   them with sets of a size near theirs drop out, again and again while that changes much.
3. Sets that share such a shingle name their smallest partner as leader; a leader's cluster
   holds all sets of near size that shared one with any of its followers. So each possible pair meets
   in a cluster, without one row per pair; clusters above ``CHUNK`` sets are dealt out as pairs
   of chunks, which keeps each task's memory bounded whatever the size of a group.
4. In a task the sets of a cluster are indexed by inverted lists and each set is searched with
   DivideSkip: with T the required overlap, the longest T - 1 lists are set aside, the short
   ones are heap-merged, and what they yield is binary-probed in the long lists. Partners that are
   already connected are not probed again, as only connectedness is asked for.
5. The links (a spanning forest of each chunk pair) go through ``components``.
"""

from __future__ import annotations

from heapq import merge
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..operators.skew import sized
from ..session import cut
from .common import fresh_name, mix, parts, picked, release, shingle_sets, text_key, trim
from .components import components

CHUNK = 512
COMMON_SAMPLE, COMMON_BATCH, COMMON_ROWS, COMMON_SHARE = 2_500, 2, 64, 1e-4
HEAP_ITEMS = 2_000


def set_id(shingles: np.ndarray) -> int:
    """64 bits that stand for a set."""
    total, folded = shingles.sum(dtype=np.uint64), np.bitwise_xor.reduce(shingles)
    out = mix(np.array([total], np.uint64) ^ mix(np.array([folded + np.uint64(len(shingles))], np.uint64)))
    return int(out.astype(np.int64)[0])


def needed(n: int, percent: int) -> int:
    """The least size of an intersection with a set of n or fewer."""
    return -(-n * percent // 100)


def extra(n):
    """Shingles sent beyond the first that must be shared; two sets share at least the smaller one's of these and one more."""
    return n // 16


def common_shingles(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles found often, sorted, and the bit length of their count; only the order of shingles rests on it.

    Every ``COMMON_SAMPLE`` rows report what they saw ``COMMON_BATCH`` times; a shingle counts from ``COMMON_ROWS``
    rows and ``COMMON_SHARE`` of all rows on, so there are at most 1/``COMMON_SHARE`` times the mean set.
    """
    def counted(batches):
        release()
        for batch in parts(batches, COMMON_SAMPLE):
            seen, times = np.unique(np.concatenate([np.zeros(0, np.uint64), *shingle_sets(batch.column(0))]), return_counts=True)
            often = times >= COMMON_BATCH
            yield pa.RecordBatch.from_arrays([pa.array(seen[often].astype(np.int64)), pa.array(times[often])], names=["gram", "n"])

    least = max(COMMON_ROWS, int(rows.count() * COMMON_SHARE))
    found = (rows.select("text").mapInArrow(counted, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
             .where(F.col("n") >= least).toPandas())
    grams = found["gram"].to_numpy(np.int64).astype(np.uint64)
    order = np.argsort(grams)
    level = np.array([int(n).bit_length() for n in found["n"]], np.uint64)
    return grams[order], level[order]


def prefixed(rows: DataFrame, percent: int) -> DataFrame:
    """``doc_id, key, n, set, grams, rare`` of each row; ``grams`` are those it is sent under, the first ``rare`` not found often."""
    grams, levels = common_shingles(rows)
    sent = rows.sparkSession.sparkContext.broadcast((grams, levels))

    def out(batches):
        common, level = sent.value
        for batch in parts(batches):
            ns, ids, heads, rare = [], [], [], []
            for s in shingle_sets(batch.column("text")):
                n = len(s)
                ns.append(n)
                ids.append(set_id(s) if n else None)
                keep = n - needed(n, percent) + 1 + extra(n) if n else 0
                few = keep
                if len(common) and n:
                    at = np.minimum(np.searchsorted(common, s), len(common) - 1)
                    rank = np.where(common[at] == s, level[at], np.uint64(0))
                    s = s[np.argsort(rank, kind="stable")]
                    few = min(keep, int((rank == 0).sum()))
                heads.append(s[:keep].astype(np.int64))
                rare.append(few)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("key"), pa.array(ns, pa.int64()), pa.array(ids, pa.int64()),
                 pa.array(heads, pa.list_(pa.int64())), pa.array(rare, pa.int32())],
                names=["doc_id", "key", "n", "set", "grams", "rare"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(out, f"doc_id {kind}, key binary, n long, set long, grams array<long>, rare int")


def once(sets: DataFrame) -> DataFrame:
    """``set, n, grams, rare`` of each different set with a shingle. Only sets that repeat are grouped."""
    some = sets.where("n > 0").select("set", "n", "grams", "rare")
    again = cut(some.groupBy("set").agg(F.count("*").alias("rows")).where("rows > 1").select("set"))
    known = sized(again)
    one = some.join(known, "set", "left_semi").groupBy("set").agg(*[F.first(c).alias(c) for c in ("n", "grams", "rare")])
    return some.join(known, "set", "left_anti").union(one)


def sharing(sets: DataFrame, percent: int) -> DataFrame:
    """``gram, set, n, size, low``: what sets that may be linked are sent under; ``low`` is the smallest set they meet there.

    ``size`` is the logarithm of n in millionths; linked sets differ by at most that of 100 / percent. Shingles not
    found often have few rows, which a window compares. Of the others, smallest and largest set of each cell of that width
    are combined before the shuffle and read from a cell and its neighbours, so that a frequent passage sends a few rows for
    each task and not all its sets to one.
    """
    width = near(percent)
    line = Window.partitionBy("gram").orderBy("size").rangeBetween(-width, width)
    least = F.floor(F.ceil(F.col("n") * percent / 100) / 16) + 1
    size = F.floor(F.log("n") * 1_000_000).alias("size")
    rows = once(sets).select("set", "n", size, "rare", F.posexplode("grams").alias("at", "gram")).select(
        "gram", "set", "n", "size", (F.col("at") >= F.col("rare")).alias("often"))
    names, before = ["gram", "set", "n", "size", "often", "low"], None
    while True:
        met = (rows.where("not often").withColumn("low", F.min("set").over(line)).withColumn("high", F.max("set").over(line))
               .where("low != high").select(*names))
        often = rows.where("often").withColumn("cell", F.floor(F.col("size") / width))
        ends = often.groupBy("gram", "cell").agg(F.min("set").alias("low"), F.max("set").alias("high"))
        wide = ends.select("gram", "low", "high", F.explode(F.array(F.col("cell") - 1, "cell", F.col("cell") + 1)).alias("cell"))
        seen = wide.groupBy("gram", "cell").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low != high")
        met = cut(met.union(often.join(seen, ["gram", "cell"]).select(*names)))
        enough = met.groupBy("set", "n").agg(F.count("*").alias("shared")).where(F.col("shared") >= least)
        rows = cut(met.join(enough.select("set"), "set", "left_semi"))
        now = rows.count()
        if before is not None and now >= 0.9 * before:
            return rows
        before, rows = now, rows.drop("low")


def near(percent: int) -> int:
    """The largest difference of ``size`` between linked sets."""
    return int(np.ceil(np.log(100 / percent) * 1_000_000)) + 1


def clusters(sets: DataFrame, percent: int) -> DataFrame:
    """``leader, i, j, chunk, set``: the sets of each pair of chunks of each cluster."""
    shared = sharing(sets, percent)
    leader = shared.groupBy("set").agg(F.min("low").alias("leader"))
    leads = shared.join(leader, "set").groupBy("gram", "leader").agg(F.min("size").alias("a"), F.max("size").alias("b"))
    close = F.col("size").between(F.col("a") - near(percent), F.col("b") + near(percent))
    members = cut(shared.select("gram", "set", "size").join(leads, "gram").where(close).select("leader", "set").distinct())
    sizes = (members.groupBy("leader").agg(F.count("*").alias("size")).where("size > 1")
             .select("leader", F.ceil(F.col("size") / CHUNK).alias("chunks")))
    dealt = members.join(sizes, "leader").withColumn("chunk", F.pmod(F.xxhash64("set"), F.col("chunks")))
    return (dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
            .select("leader", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "chunk", "set"))


class Forest:
    """Union-find over 0..n-1."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return int(x)

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def search(sets: list[np.ndarray], percent: int, sides: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links among ``sets`` (places), between different ``sides`` only if given."""
    count = len(sets)
    order = sorted(range(count), key=lambda i: len(sets[i]))
    sizes = np.array([len(sets[i]) for i in order])
    side = None if sides is None else sides[order]
    grams = np.concatenate([sets[i] for i in order])
    docs = np.repeat(np.arange(count), sizes)
    sort = np.argsort(grams, kind="stable")  # the lists, each in ascending size of its documents
    term_of = np.zeros(len(grams), np.int64)
    new = np.concatenate([[True], grams[sort][1:] != grams[sort][:-1]])
    starts = np.flatnonzero(new)
    term_of[sort] = np.cumsum(new) - 1
    place = np.empty(len(grams), np.int64)
    place[sort] = np.arange(len(grams))
    index = docs[sort]
    probes = (np.cumsum(new) - 1) * count + index  # sorted: a list's number, then its documents
    begin = np.concatenate([[0], np.cumsum(sizes)])
    forest, found = Forest(count), []
    for x in range(1, count):
        n = int(sizes[x])
        low = int(np.searchsorted(sizes, needed(n, percent)))  # smaller documents cannot reach it
        if low >= x:
            continue
        terms, mine = term_of[begin[x]:begin[x + 1]], place[begin[x]:begin[x + 1]]
        length = mine - starts[terms]  # of the part of each list before x
        some = length > 0
        least = needed_overlap(n, int(sizes[low]), percent)
        if some.sum() < least:
            continue
        terms, mine, length = terms[some], mine[some], length[some]
        by = np.argsort(length, kind="stable")
        aside = least - 1
        short, long = by[:len(by) - aside], terms[by[len(by) - aside:]]
        parts = [index[mine[k] - length[k]:mine[k]] for k in short]
        if int(length[short].sum()) <= HEAP_ITEMS:
            runs = [(d, sum(1 for _ in g)) for d, g in groupby(merge(*[p.tolist() for p in parts])) if d >= low]
            hit = np.array([d for d, _ in runs], np.int64)
            times = np.array([c for _, c in runs], np.int64)
        else:  # the same merge, by one sort
            hit, times = np.unique(np.concatenate(parts), return_counts=True)
            hit, times = hit[hit >= low], times[hit >= low]
        must = -(-(n + sizes[hit]) * percent // (100 + percent))
        ok = times + len(long) >= must
        if side is not None:
            ok &= side[hit] != side[x]
        hit, times, must = hit[ok], times[ok], must[ok]
        best = np.argsort(-times, kind="stable")
        hit, times, must = hit[best], times[best], must[best]
        step = 4
        while len(hit):
            roots = np.array([forest.root(int(d)) for d in hit])
            apart = roots != forest.root(x)
            hit, times, must, roots = hit[apart], times[apart], must[apart], roots[apart]
            if not len(hit):
                break
            rank = np.zeros(len(hit), np.int64)  # of a candidate within its component
            at = np.argsort(roots, kind="stable")
            edge = np.concatenate([[True], roots[at][1:] != roots[at][:-1]])
            rank[at] = np.arange(len(at)) - np.maximum.accumulate(np.where(edge, np.arange(len(at)), 0))
            now = rank < step
            asked = long[None, :] * count + hit[now][:, None]
            spot = np.minimum(np.searchsorted(probes, asked), len(probes) - 1)
            total = times[now] + (probes[spot] == asked).sum(axis=1)
            for d in hit[now][total >= must[now]]:
                if forest.join(x, int(d)):
                    found.append((order[x], order[int(d)]))
            hit, times, must = hit[~now], times[~now], must[~now]
            step *= 4
    return found


def needed_overlap(a: int, b: int, percent: int) -> int:
    """The least o with 100 o >= percent (a + b - o)."""
    return -(-(a + b) * percent // (100 + percent))


def linked(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``a, b``: links between different sets that connect whatever is connected."""
    dealt = cut(clusters(sets, percent))
    one = sets.where("n > 0").groupBy("set").agg(F.min("key").alias("key"))
    wanted = dealt.select("set").distinct().join(one, "set")
    texts = (rows.select("key", "text").join(wanted, "key").groupBy("key")
             .agg(F.first("set").alias("set"), F.first("text").alias("text")).select("set", "text"))
    full = dealt.join(texts, "set").select("leader", "i", "j", "chunk", "set", "text")
    cluster = ["leader", "i", "j"]

    def closed(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        ids = table.column("set").to_pylist()
        whole = table.column("i")[0].as_py() == table.column("j")[0].as_py()
        sides = None if whole else np.array(table.column("chunk").to_pylist())
        pairs = search(list(shingle_sets(table.column("text").combine_chunks())), percent, sides)
        return pa.RecordBatch.from_arrays([pa.array([ids[a] for a, _ in pairs], pa.int64()),
                                           pa.array([ids[b] for _, b in pairs], pa.int64())], names=["a", "b"])

    def searched(batches):  # rows come sorted by cluster; one cluster is held at a time
        release()
        held, key = [], None
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in cluster)))
            first = 0
            for now, run in groupby(keys):
                last = first + sum(1 for _ in run)
                if now != key:
                    if held:
                        yield closed(held)
                    held, key = [], now
                held.append(batch.slice(first, last - first))
                first = last
        if held:
            yield closed(held)
        held.clear()
        trim()

    return full.repartition(*cluster).sortWithinPartitions(*cluster).mapInArrow(searched, "a long, b long")


def groups(docs: DataFrame, percent: int = 80, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, key, n_shingles, group, component_id`` of every row.

    A null or wordless text has an empty set, is linked with nothing and is its own
    component; a text of fewer than five words has one shingle. ``component_id`` is the
    smallest id reachable; null ids count only where a component has no other. Repeated
    rows are kept and linked. An empty table gives no rows.
    """
    rows = picked(docs, doc_id=id, text=text).withColumn("key", text_key(F.col("text")))
    sets = cut(prefixed(rows, percent))
    label = components(linked(rows, sets, percent))
    named = (sets.select("doc_id", "key", "n", "set").join(label, F.col("set") == F.col("node"), "left")
             .select("doc_id", "key", "n", F.coalesce("label", "set").alias("group")))
    low = named.where("n > 0").groupBy("group").agg(F.min("doc_id").alias("low"))
    return named.join(low, "group", "left").select(
        "doc_id", "key", F.col("n").alias("n_shingles"), "group",
        F.when(F.col("n") > 0, F.col("low")).otherwise(F.col("doc_id")).alias("component_id"))


def join(docs: DataFrame, percent: int = 80, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row; see ``groups``."""
    return groups(docs, percent, id, text).select("doc_id", "n_shingles", "component_id")


def one_of_each(docs: DataFrame, percent: int = 80, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of ``docs`` for each component, with all its columns: the smallest id, nulls last, then ``text_key``.

    Rows without words are components of their own and all stay. Of repeated rows (equal id and text) one stays, any.
    Columns may have any names. An empty table gives no rows.
    """
    found = groups(docs, percent, id, text).where("n_shingles > 0")
    first = F.struct(F.col("doc_id").isNull().alias("a"), F.col("doc_id").alias("b"), F.col("key").alias("c"))
    # Ids and keys alone decide; texts are moved only where the one that stays stands in several rows.
    best = cut(found.groupBy("group").agg(F.min(first).alias("first"), F.count("*").alias("n")))
    chosen = best.select(F.col("first.b").alias("doc_id"), F.col("first.c").alias("key"))
    lost = cut(found.select("doc_id", "key").distinct().join(
        chosen, found["key"].eqNullSafe(chosen["key"]) & found["doc_id"].eqNullSafe(chosen["doc_id"]), "left_anti"))
    own_id, own_key = fresh_name(docs, "id"), fresh_name(docs, "key")
    keyed = docs.withColumns({own_id: docs[id], own_key: text_key(docs[text])})
    gone = keyed[own_id].eqNullSafe(lost["doc_id"]) & (keyed[own_key] == lost["key"])
    kept = keyed.join(sized(lost), gone, "left_anti")
    again = found.groupBy("doc_id", "key").agg(F.count("*").alias("n")).where("n > 1").select("doc_id", "key")
    if not again.isEmpty():
        again = cut(again)
        twice = keyed[own_id].eqNullSafe(again["doc_id"]) & (keyed[own_key] == again["key"])
        names = docs.columns
        single = kept.join(again, twice, "left_semi").groupBy(own_id, own_key).agg(
            F.first(F.struct(*[F.col(f"`{c}`") for c in names])).alias("row")).select("row.*")
        return kept.join(again, twice, "left_anti").select(*[F.col(f"`{c}`") for c in names]).unionByName(single)
    return kept.drop(own_id, own_key)
