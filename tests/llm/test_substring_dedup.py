"""Removing repeated runs of words against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from streamwarden.llm import substring_dedup

from .conftest import prose, rows


def brute(docs, width):
    seen, texts = Counter(), [(id, (text or "").encode().split()) for id, text in docs]
    for _, w in texts:
        seen.update(tuple(w[k:k + width]) for k in range(len(w) - width + 1))
    out = []
    for id, w in texts:
        gone = np.zeros(len(w), bool)
        for k in range(len(w) - width + 1):
            if seen[tuple(w[k:k + width])] > 1:
                gone[k:k + width] = True
        kept = [x for x, g in zip(w, gone) if not g]
        edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]]))).tolist()
        out.append((id, len(w), len(w) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest(), len(kept),
                    [list(x) for x in zip(edge[::2], edge[1::2])]))
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("width", [35, 20, 4])
def test_odd_rows(odd, width):
    assert found(substring_dedup.without_repeats(odd, width)) == brute([(r[0], r[1]) for r in rows()], width)


def test_empty_table_and_text_ids(spark, none):
    assert substring_dedup.without_repeats(none).count() == 0
    text = prose(random.Random(1), 50)
    docs = [("a", text), ("b", text + " more"), ("c", text.upper()), ("c", None)]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id string, text string, removed int")
    assert found(substring_dedup.without_repeats(df)) == brute(docs, 35)


def planted(seed):
    """Passages in many contexts, passages inside passages, repeats within one text, groups of near copies."""
    rng = random.Random(seed)
    vocabulary = [prose(rng, 1) for _ in range(12)]
    passages = [[rng.choice(vocabulary) for _ in range(n)] for n in (36, 35, 34, 60, 90)]
    base = [rng.choice(vocabulary) for _ in range(150)]
    docs = []
    for i in range(60):
        w = [prose(rng, 1) for _ in range(rng.randint(0, 40))]
        for _ in range(rng.randint(0, 3)):
            at, p = rng.randint(0, len(w)), rng.choice(passages)
            a = rng.randint(0, 5)
            w[at:at] = p[a:len(p) - rng.randint(0, 5)]
        docs.append((i, rng.choice([" ", "  ", "\n"]).join(w)))
    for i in range(60, 100):
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = prose(rng, 1)
        docs.append((i, " ".join(w)))
    docs += [(100, " ".join(["a", "b"] * 60)), (101, "a " * 36), (102, "a " * 35), (103, "A " * 35)]
    return docs + docs[60:64]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_planted(spark, seed):
    docs = planted(seed)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    assert found(substring_dedup.without_repeats(df)) == brute(docs, 35)


def test_hot_values_are_looked_up_alike(spark):
    from streamwarden.llm.common import held_twice
    df = spark.createDataFrame([(i, v) for i, v in enumerate([1] * 50 + [2] * 3 + [3] + [None, None])], "i int, v long")
    want = sorted(i for i, v in enumerate([1] * 50 + [2] * 3))
    for hot in (1, 10, 1000):
        assert sorted(r.i for r in held_twice(df, ["v"], hot).collect()) == want


def test_lengths_double_up_to_the_width():
    assert substring_dedup.lengths(35) == [9, 18, 35]
    assert substring_dedup.lengths(4) == [4]
    for width in range(1, 400):
        tried = substring_dedup.lengths(width)
        assert tried[-1] == width and all(b <= 2 * a <= b + 1 for a, b in zip(tried, tried[1:]))


def test_equal_windows_name_equal_parts():
    rng = np.random.default_rng(3)
    words = rng.integers(0, 3, 500).astype(np.uint64)
    named = substring_dedup.named_parts(words, 12, 5)
    by = {}
    for i in range(len(words) - 11):
        assert i <= named[i] <= i + 7
        assert by.setdefault(words[i:i + 12].tobytes(), named[i] - i) == named[i] - i
