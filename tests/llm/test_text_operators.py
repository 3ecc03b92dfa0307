"""Operators on texts against brute force, on rows that hold every awkward case."""

import collections
import hashlib
import re
import zlib

import public_tokenizers
import pytest

from streamwarden.llm import (decontaminate, fingerprints, language_id, mixing, ngram_join, sharding, suffix_dedup,
                              token_counts, token_files)
from streamwarden.llm.queries import BPE, PIECES

from .conftest import rows

BPE_PATH, PIECE_PATH = public_tokenizers.path(BPE), public_tokenizers.path(PIECES)
WORDS = re.compile(rb"[^\x20\x09-\x0D]+")


def words(text):
    return WORDS.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))


def shingles(text):
    w = words(text)
    return [] if not w else [tuple(w)] if len(w) < 5 else [tuple(w[i:i + 5]) for i in range(len(w) - 4)]


def pairs(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def library():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(BPE_PATH)


# --- token counts and files -----------------------------------------------------------------------------------------

def test_token_counts_match_the_library(odd, none):
    lib = library()
    want = [(r[0], len((r[1] or "").encode()), n := len(lib.encode(r[1] or "", add_special_tokens=False).ids), n > 2048) for r in rows()]
    assert pairs(token_counts.token_counts(odd, BPE_PATH)) == sorted(want, key=repr)
    assert token_counts.token_counts(none, BPE_PATH).count() == 0


ODD_TEXTS = ["a<|endoftext|>b <|startoftext|>", "it's we'll I'M don't", "ΣΑΣ İ ſ \u212a ①½ 3٣", "a\x1cb\x1f \x85c\xa0d\u3000e",
             "e\u0301 \u00e9", "!!!...,,'s", "\x00\x01\x7f", "한글 字 😀😀", "_a_1-2_", "ends.", "<|endoftext|", "x" * 3000]


def test_encoding_odd_texts():
    import numpy as np
    lib = library()
    want = [lib.encode(t, add_special_tokens=False).ids for t in ODD_TEXTS]
    assert token_counts.count_tokens(ODD_TEXTS, BPE_PATH) == [len(w) for w in want]
    assert [np.frombuffer(b, np.uint16).tolist() for b in token_files.encode(ODD_TEXTS, BPE_PATH)] == want


def test_merging_pops_lowest_rank_leftmost_first():
    ranks = {("a", "a"): 0, ("aa", "a"): 1, ("b", "aa"): 2}
    assert token_counts.merged_count(list("aaaaa"), ranks) == 2  # aa aa a -> aa aaa
    assert token_counts.merged_count(list("baa"), ranks) == 1
    assert token_counts.merged_count([], ranks) == 0


def test_token_files_round_trip(odd, none):
    lib = library()
    got = token_files.token_files(odd, BPE_PATH, length=64).orderBy("start").collect()
    want = sorted(rows(), key=lambda r: (r[0] is not None, r[0] or 0))
    assert [r["doc_id"] for r in got] == [r[0] for r in want]
    at = 0
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]

    def crc(text):
        ids = [*lib.encode(text or "", add_special_tokens=False).ids, 2]
        return len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))

    assert sorted((r["n_tokens"], r["ids_crc32"]) for r in got) == sorted(crc(r[1]) for r in want)
    assert token_files.token_files(none, BPE_PATH).count() == 0


def test_sequences_have_one_length_and_a_mask(odd):
    import pyarrow as pa
    folder, files = token_files.write_token_files(odd, BPE_PATH, length=64)
    path = folder.removeprefix("file:")
    for name, tokens in files:
        with pa.memory_map(f"{path}/{name}.arrow") as f:
            stored = token_files.Tokens(pa.ipc.open_file(f))
            ids, mask = stored.sequence(-(-tokens // 64) - 1)
            assert len(ids) == len(mask) == 64
            assert mask.sum() == (tokens - 1) % 64 + 1


# --- language -------------------------------------------------------------------------------------------------------

def test_forward_sums_all_segmentations():
    import math
    import numpy as np
    ids, _ = language_id._pieces(PIECE_PATH)
    rng = np.random.default_rng(0)
    log_p = np.log(rng.uniform(1e-6, 1e-3, (32_000, 2)))
    s = language_id.Scorer(PIECE_PATH, ["a", "b"], log_p, -12.0)

    def brute(word, lang):
        total = [0.0] * len(word) + [1.0]
        for i in reversed(range(len(word))):
            for j in range(i + 1, len(word) + 1):
                if (k := ids.get(word[i:j])) is not None:
                    total[i] += math.exp(log_p[k, lang]) * total[j]
            if word[i] not in ids:
                total[i] += math.exp(-12.0 * len(word[i].encode())) * total[i + 1]
        return math.log(total[0])

    some = ["the", "international", "naïve", "x", "字字", "😀a"]
    got = s.score_words(some)
    for w, g in zip(some, got):
        assert g == pytest.approx([brute("\u2581" + w, 0), brute("\u2581" + w, 1)])
        assert s._long("\u2581" + w) == pytest.approx(g)


def test_language_of_held_out_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = language_id.identify(docs, PIECE_PATH).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(got) > 20
    assert sum(r["lang"] == r["lang_pred"] for r in got) / len(got) >= 0.9
    assert all(0 <= r["score"] <= 1 for r in got)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)


def test_language_of_odd_rows(odd, none):
    got = language_id.identify(odd, PIECE_PATH).collect()
    assert len(got) == len(rows())
    blank = sum(not any(c.isalpha() for c in r[1] or "") for r in rows())
    assert sum(r["lang_pred"] == "und" and r["score"] == 0 for r in got) == blank
    assert language_id.identify(none, PIECE_PATH).count() == 0
    unlabelled = odd.withColumn("lang", odd["lang"].substr(1, 0)).where("doc_id < 0")
    assert language_id.identify(unlabelled, PIECE_PATH).count() == 0


# --- fingerprints ---------------------------------------------------------------------------------------------------

def test_edited_texts_and_likeness(odd, none):
    got = fingerprints.edited_fingerprints(odd).collect()
    key = lambda t: hashlib.md5((t or "").encode()).digest()
    order = sorted(rows(), key=lambda r: (r[0] is None, -(r[0] or 0), key(r[1])))
    want = []
    for r, nxt in zip(order, order[1:] + order[:1]):
        text, after = r[1] or "", nxt[1] or ""
        half = len(text) // 2
        edited = text[:len(text) - half] + after[:half]
        want.append((r[0], len(text), hashlib.sha256(edited.encode()).hexdigest()))
    assert sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got), key=repr) == sorted(want, key=repr)
    by = {}
    for r in got:
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        by.setdefault(r["doc_id"], set()).add(r["fingerprint"])
    assert by[6] == by[15] and by[9] == by[10] == by[11]
    assert fingerprints.edited_fingerprints(none).count() == 0


def test_likeness_estimates_jaccard():
    import numpy as np
    rng = np.random.default_rng(3)
    a = np.unique(rng.integers(0, 1 << 63, 900, dtype=np.uint64))
    b = np.concatenate([a[:700], rng.integers(0, 1 << 63, 200, dtype=np.uint64)])
    got = fingerprints.likeness(fingerprints.minima(a)[None], fingerprints.minima(b)[None])[0]
    assert abs(got - 700 / 1100) < 0.15
    assert (fingerprints.minima(a[:0]) == 0xFFFFFFFF).all()


def components(threshold=80):
    data = [r for r in rows()]
    sets = [set(shingles(r[1])) for r in data]
    up = list(range(len(data)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= threshold * len(a | b):
                up[root(i)] = root(j)
    groups = collections.defaultdict(list)
    for i in range(len(data)):
        groups[root(i)].append(i)
    out = []
    for members in groups.values():
        ids = [data[i][0] for i in members if data[i][0] is not None]
        out += [(data[i][0], len(sets[i]), min(ids) if ids and sets[i] else data[i][0]) for i in members]
    return sorted(out, key=repr)


def test_near_duplicate_classes(odd, none):
    assert pairs(fingerprints.near_duplicates(odd)) == sorted(((i, c) for i, _, c in components()), key=repr)
    assert fingerprints.near_duplicates(none).count() == 0


def test_near_duplicates_inside_a_large_band(spark, monkeypatch):
    # 300 texts of Jaccard 0.775 over one boilerplate fill the bands; twenty pairs inside are just above 0.8.
    shared = [f"w{i}" for i in range(280)]
    own = [[f"t{k}x{i}" for i in range(40)] for k in range(300)]
    for k in range(20):
        own[150 + k][:8] = own[k][:8]
    texts = [" ".join(shared + o) for o in own]
    sets = [set(shingles(t)) for t in texts]
    class_of = list(range(300))
    for j in range(300):
        for i in range(j):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) and class_of[i] != class_of[j]:
                low, high = sorted((class_of[i], class_of[j]))
                class_of = [low if c == high else c for c in class_of]
    assert sum(c != i for i, c in enumerate(class_of)) == 20
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    monkeypatch.setattr(fingerprints, "CHUNK", 20)
    assert dict(fingerprints.near_duplicates(docs).collect()) == dict(enumerate(class_of))


# --- n-gram join ----------------------------------------------------------------------------------------------------

@pytest.mark.parametrize("chunk", [512, 2])
def test_ngram_join(odd, none, monkeypatch, chunk):
    monkeypatch.setattr(ngram_join, "CHUNK", chunk)
    assert pairs(ngram_join.join(odd)) == components()
    assert ngram_join.join(none).count() == 0


def test_one_of_each_component(odd, none):
    got = ngram_join.one_of_each(odd)
    assert got.columns == odd.columns
    blank = sum(not words(r[1]) for r in rows())
    named = {c for i, n, c in components() if n}
    assert sorted(r["doc_id"] for r in got.collect() if words(r["text"])) == sorted(named)
    assert got.count() == len(named) + blank
    assert ngram_join.one_of_each(none).count() == 0


def test_one_of_each_with_working_names_of_its_own(spark):
    text = " ".join(f"w{i}" for i in range(40))
    docs = [(1, text, "a", 5, "p"), (2, text, "b", 6, "q"), (1, text, "c", 7, "r"), (3, None, "d", 8, "s"), (3, None, "e", 9, "t")]
    df = spark.createDataFrame(docs, "doc_id long, text string, _key string, _id int, `_group` string")
    got = ngram_join.one_of_each(df)
    assert got.columns == df.columns
    kept = [tuple(r) for r in got.collect()]
    assert sorted(r[0] for r in kept) == [1, 3, 3] and set(kept) <= set(docs)


def test_frequent_shingles_meet_by_cells(spark, monkeypatch):
    """The same components when every shingle counts as frequent."""
    rng = __import__("random").Random(3)
    base = [f"w{rng.randrange(50)}" for _ in range(120)]
    docs = []
    for i in range(60):
        w = list(base[:rng.choice([60, 75, 90, 110, 120])])
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10 ** 6)}"
        docs.append((i, " ".join(w)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = pairs(ngram_join.join(df))
    monkeypatch.setattr(ngram_join, "COMMON_ROWS", 1)
    monkeypatch.setattr(ngram_join, "COMMON_SHARE", 0.0)
    assert pairs(ngram_join.join(df)) == want
    up = {i: i for i in range(60)}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    sets = [set(shingles(t)) for _, t in docs]
    for i in range(60):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    assert [(d, root(d)) for d in range(60)] == sorted((r[0], r[2]) for r in want)


@pytest.mark.parametrize("heap", [10**9, 0])
def test_search_finds_what_pairs_find(monkeypatch, heap):
    import numpy as np
    monkeypatch.setattr(ngram_join, "HEAP_ITEMS", heap)
    rng = np.random.default_rng(5)
    base = rng.choice(10_000, 60, replace=False).astype(np.uint64)
    sets = []
    for _ in range(80):
        s = base.copy()
        at = rng.choice(60, rng.integers(0, 9), replace=False)
        s[at] = rng.integers(20_000, 90_000, len(at))
        sets.append(np.unique(s[:rng.integers(48, 61)]))
    found = ngram_join.search(sets, 80)

    def classes(links):
        up = list(range(80))

        def root(x):
            while up[x] != x:
                x = up[x]
            return x
        for a, b in links:
            up[max(root(a), root(b))] = min(root(a), root(b))
        return [root(x) for x in range(80)]

    every = [(i, j) for i in range(80) for j in range(i)
             if 100 * (o := len(np.intersect1d(sets[i], sets[j]))) >= 80 * (len(sets[i]) + len(sets[j]) - o)]
    assert set(map(frozenset, found)) <= set(map(frozenset, every))
    assert classes(found) == classes(every)


# --- long repeats ---------------------------------------------------------------------------------------------------

def repeats_by_hand(width):
    data = [(r[1] or "").encode() for r in rows()]
    seen = collections.Counter(b[i:i + width] for b in data for i in range(len(b) - width + 1))
    out = []
    for r, b in zip(rows(), data):
        gone = bytearray(len(b))
        for i in range(len(b) - width + 1):
            if seen[b[i:i + width]] > 1:
                gone[i:i + width] = b"\1" * width
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((r[0], len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("width, limit", [(40, 2000), (40, 2), (8, 1)])
def test_repeats(odd, none, width, limit):
    got = suffix_dedup.without_repeats(odd, width, limit)
    assert pairs(got.drop("removed", "n_kept")) == repeats_by_hand(width)
    for r in got.collect():
        assert r["n_kept"] == r["n_bytes"] - r["n_removed"]
        assert len(r["removed"]) == r["n_spans"] and sum(b - a for a, b in r["removed"]) == r["n_removed"]
    assert suffix_dedup.without_repeats(none, width, limit).count() == 0


# --- shards ---------------------------------------------------------------------------------------------------------

def test_shards(odd, none):
    got = sharding.shard_by_size(odd, 3).collect()
    assert sorted((r["size"], r["text_crc32"]) for r in got) == sorted(
        (len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows())
    slots = collections.defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        assert r["law"] == "bytes" and r["grown_shard"] is None
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    where = {}
    assert all(where.setdefault((r["size"], r["text_crc32"]), r["shard"]) == r["shard"] for r in got)
    assert sharding.shard_by_size(none, 3).count() == 0


def test_longest_first_goes_to_the_least_loaded():
    got = sharding.longest_first([("a", 7), ("b", 6), ("c", 5), ("d", 4), ("e", 3)], 2)
    assert got == {"a": 0, "b": 1, "c": 1, "d": 0, "e": 0} or got == {"a": 0, "b": 1, "c": 1, "d": 0, "e": 1}


def test_shards_are_near_equal(spark, sf):
    got = sharding.shard_by_size(spark.read.parquet(f"{sf}/documents.parquet"), 4).groupBy("shard").sum("size").collect()
    sizes = [r[1] for r in got]
    assert max(sizes) - min(sizes) < 0.02 * sum(sizes)


# --- mixing ---------------------------------------------------------------------------------------------------------

def test_mixing_odd_rows(odd, none):
    got = mixing.mix(odd, {"src0": 3.0, "src1": 0.0})
    added = ["copies", "copy", "shuffle_key"]  # the fixture has a column "copies" too, which is replaced
    assert got.columns == [c for c in odd.columns if c not in added] + added
    found = got.collect()
    assert all(isinstance(r["copies"], int) and isinstance(r["copy"], int) and 0 <= r["shuffle_key"] < 1 << 60 for r in found)
    by_row = collections.Counter((r["doc_id"], r["text"], r["copies"]) for r in found)
    times = collections.Counter((r[0], r[1]) for r in rows())
    assert all(n == copies * times[id, text] for (id, text, copies), n in by_row.items())
    kept = [c for c in odd.columns if c not in added]
    given = {tuple(r) for r in odd.select(*kept).collect()}
    assert all(tuple(r[c] for c in kept) in given for r in found)
    assert all(r["source"] != "src1" and 0 <= r["copy"] < r["copies"] for r in found)
    again = mixing.mix(odd.repartition(5), {"src0": 3.0, "src1": 0.0}).collect()
    brief = lambda rs: sorted((str(r["doc_id"]), r["copy"], r["shuffle_key"]) for r in rs)
    assert brief(found) == brief(again)
    keys = [r["shuffle_key"] for r in found]
    assert keys == sorted(keys)
    assert mixing.mix(none, {}).count() == 0


def test_mixing_keeps_columns_of_any_name(spark):
    df = spark.createDataFrame([(i, f"t{i}", "a", f"h{i}", "u", "x", "m", 1) for i in range(30)],
                               "doc_id long, text string, source string, _hash string, _u string, _steps string, _mix_hash string, `a.b` int")
    got = mixing.mix(df, {}, budget=400)
    assert got.columns == df.columns + ["copies", "copy", "shuffle_key"]
    assert got.count() > 0 and all(r["_hash"] == f"h{r['doc_id']}" and r["_mix_hash"] == "m" and r["a.b"] == 1 for r in got.collect())


def test_mixing_refuses_endless_copies_and_takes_large_means(spark):
    df = spark.createDataFrame([(1, "x", "small"), (2, "y" * 100, "large")], "doc_id long, text string, source string")
    with pytest.raises(ValueError, match="small"):
        mixing.mix(df, {}, budget=10 ** 8)
    got = mixing.mix(df, {"large": 0.0}, budget=2 * 50_000).count()  # a mean of 50 000 copies of one row
    assert abs(got - 50_000) < 12 * 50_000 ** 0.5


def test_mixing_reaches_the_rates(spark):
    docs = spark.range(20_000).selectExpr("id as doc_id", "cast('x' as string) text", "if(id % 10 = 0, 'a', 'b') source")
    got = {r["source"]: r["n"] for r in mixing.mix(docs, {"a": 1.0, "b": 1.0}).groupBy("source").count()
           .withColumnRenamed("count", "n").collect()}
    assert abs(got["a"] - 10_000) < 600 and abs(got["b"] - 10_000) < 600
    many = mixing.mix(docs.limit(50), {}, budget=50 * 2 * 900)  # a mean of hundreds of copies
    assert abs(many.count() - 45_000) < 3_000


# --- benchmark leaks ------------------------------------------------------------------------------------------------

def leaks_by_hand(items):
    out = set()
    for r in rows():
        doc = shingles(r[1])
        for item_id, text in items:
            item = shingles(text)
            if not item or not doc:
                continue
            rare = len(item)
            for at in range(len(doc)):
                window = doc[at:at + rare]
                a, b = collections.Counter(item), collections.Counter(window)
                if sum((a & b).values()) >= 0.8 * sum((a | b).values()):
                    out.add((str(r[0]), str(item_id)))
                    break
    return out


def test_leaks(spark, odd, none):
    data = rows()
    near = data[7][1].split()
    near[20] = "other"
    items = [(0, data[4][1]), (1, " ".join(near[:60])), (2, data[1][1]), (3, None), (4, ""), (None, data[5][1]), (0, data[4][1]),
             (5, "nothing like it stands in any of these documents at all")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(str(r["doc_id"]), str(r["item_id"])) for r in decontaminate.leaks(odd, bench).collect()}
    assert got == leaks_by_hand(items)
    kept = decontaminate.without_leaks(odd, bench)
    assert kept.columns == odd.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(r[0]) for r in data if not leaks_of(r, items))
    assert decontaminate.leaks(none, bench).count() == 0
    assert decontaminate.leaks(odd, bench.limit(0)).count() == 0


def leaks_of(row, items):
    doc = shingles(row[1])
    for _, text in items:
        item = shingles(text)
        for at in range(len(doc) if item else 0):
            a, b = collections.Counter(item), collections.Counter(doc[at:at + len(item)])
            if sum((a & b).values()) >= 0.8 * sum((a | b).values()):
                return True
    return False


def test_leaks_in_shifted_windows(spark):
    """Seeds between an insertion and a deletion, seeds behind moved parts, windows against all of a brute force."""
    import random
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    front, end = [word() for _ in range(60)], [word() for _ in range(60)]
    items = [front + [word() for _ in range(34)] + end for _ in range(3)] + [[word() for _ in range(n)] for n in (15, 40, 60)]
    docs = []
    for item in items[:3]:
        docs.append([word() for _ in range(30)] + item[:20] + [word() for _ in range(8)] + item[20:-8] + [word() for _ in range(40)])
    for item in items[3:]:
        n = len(item)
        docs.append(item[n // 2:] + item[:n // 2])  # halves changed places
        docs.append([word() for _ in range(5)] + item[:n - n // 10] + [word() for _ in range(20)])
        docs.append(item[:n // 3] + [word() for _ in range(2)] + item[n // 3:] + [word()])
        docs.append(item[:n // 2] + [word() for _ in range(30)] + item[n // 2:])
        docs.append(item[:-1])
        docs.append([word() for _ in range(9)] + item + [word() for _ in range(9)] + item[2:])
    df = spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string")
    want = {}
    for i, d in enumerate(docs):
        for k, t in enumerate(items):
            doc, item = shingles(" ".join(d)), shingles(" ".join(t))
            size = min(len(doc), len(item))
            for at in range(len(doc) - size + 1):
                a, b = collections.Counter(item), collections.Counter(doc[at:at + size])
                found = sum((a & b).values()) / sum((a | b).values())
                if found >= 0.8 and found > want.get((i, k), (0, 0))[0]:
                    want[i, k] = found, at
    got = {(r.doc_id, r.item_id): (r.similarity, r.first_word) for r in decontaminate.leaks(df, bench).collect()}
    assert set(got) == set(want) and {(0, 0), (1, 1), (2, 2)} <= set(got)
    assert all(got[k][1] == at and got[k][0] == pytest.approx(found) for k, (found, at) in want.items())


def test_without_leaks_with_working_names_of_its_own(spark):
    item = " ".join(f"w{i}" for i in range(30))
    df = spark.createDataFrame([(1, item, "a", "b", 1), (2, "clean text", "c", None, 2)], "doc_id long, text string, _key string, key string, `x.y` int")
    got = decontaminate.without_leaks(df, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert got.columns == df.columns and [tuple(r) for r in got.collect()] == [(2, "clean text", "c", None, 2)]


def test_blocks_cover_the_radius():
    """Two 64-bit numbers within the radius agree on one of radius + 1 blocks at least."""
    import random
    rng = random.Random(2)
    cuts = [64 * k // (decontaminate.RADIUS + 1) for k in range(decontaminate.RADIUS + 2)]
    assert cuts[0] == 0 and cuts[-1] == 64 and all(a < b for a, b in zip(cuts, cuts[1:]))
    for _ in range(200):
        x = rng.getrandbits(64)
        y = x
        for b in rng.sample(range(64), decontaminate.RADIUS):
            y ^= 1 << b
        assert any((x >> a) & ((1 << (b - a)) - 1) == (y >> a) & ((1 << (b - a)) - 1) for a, b in zip(cuts, cuts[1:]))
