"""Importance resampling against brute force."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from streamwarden.llm import resampling

from .conftest import SCHEMA, prose, rows


def words(text):
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))


def runs(w):
    return [b" ".join(w[i:i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def brute(docs, target, percent=5, least=20, buckets=10_000):
    s, t = [0] * buckets, [0] * buckets
    for held, texts in ((s, [x for _, x in docs]), (t, target)):
        for text in texts:
            for f in runs(words(text)):
                held[zlib.crc32(f) % buckets] += 1
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + buckets) / ((a + 1) * (sum(t) + buckets)))) for a, b in zip(s, t)]
    out = []
    for id, text in docs:
        w = words(text)
        weight = sum(gain[zlib.crc32(f) % buckets] for f in runs(w))
        h = int(hashlib.sha256(f"42:{'' if id is None else id}".encode()).hexdigest()[:8], 16)
        out.append([id, len(runs(w)), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2 ** 32))), None, len(w)])
    order = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for k, r in enumerate(order[:len(order) * percent // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=repr)


def found(df):
    return sorted(((r.doc_id, r.n_features, r.weight, r.score, r.rank) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def target(spark):
    rng = random.Random(5)
    texts = [prose(rng, n) for n in (3, 20, 60)] + [None, "", rows()[6][1], "a-b c1 \u00e9t\u00e9 \U0001f600x"]
    return texts, spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "item_id int, text string")


@pytest.mark.parametrize("percent", [5, 40, 100])
def test_odd_rows(odd, target, percent):
    want = brute([(r[0], r[1]) for r in rows()], target[0], percent)
    assert found(resampling.resample(odd, target[1], percent)) == want


def test_many_ties_and_ranks(spark, target):
    rng = random.Random(2)
    docs = [(i, prose(rng, 30)) for i in range(150)] + [(7, "same words " * 20)] * 60 + [(None, "same words " * 20)] * 3
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    for percent in (3, 20, 55):
        assert found(resampling.resample(df, target[1], percent)) == brute(docs, target[0], percent)


def test_empty_tables_and_text_ids(spark, odd, none, target):
    empty = target[1].limit(0)
    assert resampling.resample(none, target[1]).count() == 0
    assert found(resampling.resample(odd, empty, 30)) == brute([(r[0], r[1]) for r in rows()], [], 30)
    docs = [(f"d{i}", prose(random.Random(i), 25)) for i in range(40)]
    named = spark.createDataFrame([(a, b, 1) for a, b in docs], "doc_id string, text string, rank int")
    assert found(resampling.resample(named, target[1], 25)) == brute(docs, target[0], 25)


def test_cutoff_by_bisection(spark):
    rng = random.Random(1)
    values = [rng.randint(-10 ** 12, 10 ** 12) for _ in range(300)] + [5] * 50
    df = spark.createDataFrame([(v,) for v in values], "v long")
    ordered = sorted(values, reverse=True)
    for want in (1, 2, 150, 170, 200, 350):
        c, above = resampling.highest(df, df["v"], want)
        assert c == ordered[want - 1] and above == sum(v > c for v in values)


def test_checksums_of_long_words():
    texts = [b"x" * n for n in (1, 63, 64, 65, 128, 129, 1000)] + [b"", b"ab", b"z" * 200]
    data = b" ".join(texts[:7]) + b" ab " + texts[-1]
    at, found = resampling.features(np.frombuffer(data, np.uint8), np.array([0, len(data)]), 10_000)
    w = data.split()
    for j, run in enumerate(found):
        assert run.tolist() == [zlib.crc32(b" ".join(w[i:i + j + 1])) % 10_000 for i in range(len(w) - j)]


def test_schema_has_clashing_names():
    assert "score" in SCHEMA  # the fixture's table has a column that the result has too
