"""Phrase collocations against brute force."""

import random
import re
from collections import Counter

import pytest
from pyspark import AccumulatorParam

from streamwarden.llm import collocations

from .conftest import prose, rows


def contiguous(phrase, longer):
    return any(longer[i:i + len(phrase)] == phrase for i in range(len(longer) - len(phrase) + 1))


def brute(docs, longest, least, top, covered=50):
    f, n = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i:i + k])) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    candidates = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= least}
    found = []
    for (lang, p), a in candidates.items():
        if any(lang == other and len(q) > len(p) and contiguous(p, q) and 100 * b >= covered * a
               for (other, q), b in candidates.items()):
            continue
        score, k = min((1_000_000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
        found.append((lang, " ".join(p), a, f[lang, p[:k]], f[lang, p[k:]], n[lang], score))
    out = []
    for lang in {x[0] for x in found}:
        mine = sorted((x for x in found if x[0] == lang), key=lambda x: (-x[6], -x[2], x[1].encode()))
        out += [(lang, rank, *x[1:]) for rank, x in enumerate(mine[:top], 1)]
    return sorted(out)


def found(df):
    return sorted(tuple(r) for r in df.collect())


def planted(seed):
    rng = random.Random(seed)
    words = [prose(rng, 1) for _ in range(25)] + ["New", "YORK", "city", "é", "\xa0x"]
    out = []
    for _ in range(150):
        w = [rng.choice(words) for _ in range(rng.randint(0, 60))]
        for _ in range(3):
            at = rng.randint(0, len(w))
            w[at:at] = rng.choice([["new", "York", "city"], ["new", "york"], ["san", "fran", "cis", "co"], ["a", "a", "a"]])
        text = "".join(x + rng.choice([" ", " ", " ", "\t", "  ", ", ", ".", "\n", " ! "]) for x in w)
        out.append((rng.choice(["en", "en", "fr", None, "und"]), text))
    return out + [out[3]] * 5 + [("en", None), ("en", ""), (None, " \t"), ("de", "...")]


@pytest.mark.parametrize("seed, longest, least, few", [(1, 3, 10, 2_000_000), (2, 3, 10, 0), (3, 4, 3, 0), (3, 5, 3, 2_000_000), (4, 2, 2, 0)])
def test_against_brute_force(spark, seed, longest, least, few):
    docs = planted(seed)
    df = spark.createDataFrame([(*d, 1, "x") for d in docs], "lang string, text string, rank int, phrase string").repartition(4)
    assert found(collocations.collocations(df, longest, least, 2000, few=few)) == brute(docs, longest, least, 2000)


def test_top_of_each_language(spark):
    docs = planted(5)
    df = spark.createDataFrame(docs, "lang string, text string")
    assert found(collocations.collocations(df, 3, 2, 7)) == brute(docs, 3, 2, 7)


def test_odd_rows(odd, none):
    assert found(collocations.collocations(odd, 3, 2)) == brute([(r[2], r[1]) for r in rows()], 3, 2, 2000)
    assert collocations.collocations(none).count() == 0


def test_scores_are_exact_beyond_64_bits(spark):
    a, l, r = 4 * 10 ** 12 + 1, 5 * 10 ** 12 + 3, 6 * 10 ** 12 + 7
    table = spark.createDataFrame([(0, "en", "x y", a, [l, a], [r, a])],
                                  "number long, lang string, phrase string, f long, heads array<long>, tails array<long>")
    row = collocations.scored(table, 2).first()
    assert (row.score, row.l, row.r) == (1_000_000 * a * a // (l * r), l, r)


def test_blocks_are_cut_between_neighbours():
    import numpy as np
    rng = np.random.default_rng(2)
    for size in (1, 3, 50):
        place = np.cumsum(rng.choice([1, 1, 1, 2, 5], 300))
        cuts = list(collocations.cut_points(place, size))
        assert [i for a, b in cuts for i in range(a, b)] == list(range(300))
        assert all(place[b] - place[b - 1] > 1 for _, b in cuts[:-1]) and all(b - a >= size for a, b in cuts[:-1])


def test_a_worker_gets_few_bytes_at_once(spark):
    class Largest(AccumulatorParam):
        def zero(self, value):
            return 0

        def addInPlace(self, a, b):
            return max(a, b)

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    seen, before = spark.sparkContext.accumulator(0, Largest()), spark.conf.get(key)

    def measured(batches):
        for batch in batches:
            seen.add(batch.nbytes)
            yield batch

    docs = spark.range(500, numPartitions=1).selectExpr("'en' lang", "repeat('new york city. ', 4000) text")
    out = collocations.collocations(docs.mapInArrow(measured, "lang string, text string"), 3, 10)
    assert found(out) == [("en", 1, "new york city", 2_000_000, 2_000_000, 2_000_000, 6_000_000, 1_000_000)]
    assert 0 < seen.value < 2 * collocations.BATCH < 500 * 4000 * 15
    assert spark.conf.get(key) == before


def test_known_words_and_blocks_in_many_batches(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    docs, before = planted(6), spark.conf.get(key)
    spark.conf.set(key, "3")
    try:
        assert found(collocations.collocations(spark.createDataFrame(docs, "lang string, text string"), 3, 10, few=0)) == brute(docs, 3, 10, 2000)
    finally:
        spark.conf.set(key, before)


def test_blocks_pack_and_unpack():
    import numpy as np
    rng = np.random.default_rng(3)
    for size in (1, 7, 8, 9, 300):
        place, numbers = np.cumsum(rng.choice([1, 1, 2, 9], size)), rng.integers(0, (1 << 31) - 1, size)
        [(block, places, same)] = collocations._blocks([collocations._relation(1 << 33, place, numbers)])
        assert block == 1 << 33 and same.tolist() == numbers.tolist()
        assert (np.diff(places) == 1).tolist() == (np.diff(place) == 1).tolist() and (np.diff(places) > 0).all()
