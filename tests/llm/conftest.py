import random

import pytest

from streamwarden.llm.common import reach

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, key string, gram string, shard string, "
          "copies string, score string, `set` string, first string, part string")


@pytest.fixture(scope="session", autouse=True)
def workers(spark):
    reach(spark)


def prose(rng, words):
    return " ".join("".join(rng.choice("aeinrst") for _ in range(rng.randint(2, 6))) for _ in range(words))


def rows(seed=1):
    """Nulls in every column, empty and very long texts, ties, repeated rows, copies and near copies."""
    rng = random.Random(seed)
    base = [prose(rng, n) for n in (1, 3, 5, 9, 40, 80, 120, 200, 300)]
    texts = base + [None, "", " \t\n", "é ñ ß 😀 " * 30, "x" * 30_000, "Word " * 20_000, base[6], base[6].upper(), base[7]]
    near = base[7].split()
    for k in (3, 60, 150):
        changed = list(near)
        changed[k] = "changed"
        texts.append(" ".join(changed))
    texts.append(base[5] + " " + prose(rng, 60))
    texts.append(prose(rng, 30) + " " + base[8] + " " + prose(rng, 30))
    out = [(i, t, rng.choice(["en", "fr", None]), rng.choice(["src0", "src1", None]), len(t or "")) for i, t in enumerate(texts)]
    out += [out[4], out[4], (None, base[8], None, None, None), (None, None, None, None, None), (7, base[3], "en", "src0", 1)]
    return [(*r, "k", None, "s", "c", None, "z", "f", "p") for r in out]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
