"""Ranges of window numbers against windows that copy each row."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from streamwarden import vocab
from streamwarden.operators import ranges, windows
from streamwarden.operators.windows import Agg
from streamwarden.plans.continuous import ContinuousQuery, WindowSpec

T0 = datetime(2024, 1, 1)
ALL = [Agg("count", "*", "n"), Agg("sum", "i", "total"), Agg("avg", "i", "mean"), Agg("min", "x", "low"), Agg("max", "x", "high"),
       Agg("sum", "x", "sum_x"), Agg("avg", "x", "mean_x"), Agg("count_distinct", "i", "kinds"), Agg("sample", "i", "some"), Agg("count", "i", "known"),
       Agg("group_concat", "i", "listed", ",")]


def observed(spark, seed, rows=120):
    rng = random.Random(seed)
    made = [(rng.choice(["a", "a", "b", None]), rng.choice([1, 2, 3, None]), rng.choice([0.5, 2.25, 1e6, None]),
             T0 + timedelta(milliseconds=rng.randint(-30_000, 60_000) if seed % 2 else rng.choice([0, 1000, 1999, 5000, 9000])))
            for _ in range(rows)]
    return spark.createDataFrame(made, "k string, i int, x double, t timestamp")


def key(df):
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("seed, range_ms, step_ms, by, limit", [
    (1, 10_000, 1000, ["k"], 2_000_000), (1, 10_000, 1000, ["k"], 7), (1, 10_500, 1000, [], 11), (2, 9000, 100, ["k"], 2_000_000),
    (3, 700, 1000, ["k"], 2_000_000), (3, 1000, 1000, [], 2_000_000), (2, 3000, 1000, [], 3)])
def test_aggregates_equal_windows(spark, seed, range_ms, step_ms, by, limit):
    df = observed(spark, seed, 120 if limit > 100 else 60)
    plain = windows.windowed(df, "t", range_ms, step_ms, ALL, by)
    assert key(ranges.windowed(df, "t", range_ms, step_ms, ALL, by, limit)) == key(plain)


@pytest.mark.parametrize("left, right", [((10_000, 1000), (10_000, 1000)), ((10_000, 1000), (4000, 2000)), ((5000, 3000), (4000, 2000)),
                                         ((3000, 2000), (4000, 2000)), ((900, 1000), (2000, 1000))])
@pytest.mark.parametrize("limit", [2_000_000, 5])
def test_join_equals_windows(spark, left, right, limit):
    a, b = observed(spark, 1, 50), observed(spark, 5, 50)
    want = windows.window_join(a, b, ["k", "i"], "t", left, right).select("window_start", "window_end", "k", "i")
    assert key(ranges.window_join(a, b, ["k", "i"], "t", left, right, limit)) == key(want)


def test_sides_with_different_variables(spark):
    a = observed(spark, 1, 60).select("t", "k", "i").where("k is not null")
    b = observed(spark, 3, 60).select("t", "k", F.col("x").alias("y")).where("k is not null")
    found, grid = ranges.joined([(a, "t"), (b, "t")], [(6000, 1000), (3000, 1000)])
    got = ranges.expanded(found, grid, ["k", "i", "y"])
    left = windows.assign(a, "t", 6000, 1000).drop("t").distinct()
    right = windows.assign(b, "t", 3000, 1000).drop("t", "window_start").distinct()
    assert key(got) == key(left.join(right, ["window_end", "k"]).select("window_start", "window_end", "k", "i", "y"))


def test_united_ranges(spark):
    df = spark.createDataFrame([("a", 0, 3), ("a", 2, 5), ("a", 6, 7), ("a", 9, 9), ("b", 1, 1), ("b", 1, 1), (None, -4, -2)],
                               "k string, _lo long, _hi long")
    want = [("a", 0, 7), ("a", 9, 9), ("b", 1, 1), (None, -4, -2)]
    for limit in (2_000_000, 1):
        assert key(ranges.united(df, ["k"], limit)) == sorted(want, key=repr)


def test_empty(spark):
    df = observed(spark, 1).limit(0)
    assert ranges.windowed(df, "t", 10_000, 20, ALL, ["k"]).count() == 0
    assert ranges.window_join(df, df, ["k"], "t", (10_000, 20), (10_000, 20)).count() == 0


def test_work_does_not_follow_the_overlap(spark):
    """Two rows of one solution under the templates' STEP and a span of thirty days."""
    df = observed(spark, 1, 40)
    found, grid = ranges.joined([(df.select("t", "k", "i"), "t")] * 2, [(30 * 86_400_000, 20)] * 2)
    stretches = ranges.aggregated(found, [], [Agg("avg", "i", "mean")], 30 * 86_400_000 // 20)
    assert stretches.count() < 200
    assert stretches.agg(F.max(F.col("_hi") - F.col("_lo"))).first()[0] > 100_000_000


def test_query_of_two_windows(spark):
    rows = [(f"u{i % 3}", "http://s/1" if i % 2 else "http://s/2", "p", float(i % 5), T0 + timedelta(milliseconds=377 * i)) for i in range(60)]
    obs = spark.createDataFrame(rows, "resource_id string, stream string, property string, value double, event_time timestamp")

    def query(step):
        frames = tuple(WindowSpec(f"w{i}", f"http://s/{i}", 4000, step) for i in (1, 2))
        body = tuple((w.name, "?s", vocab.HAS_VALUE, "?o") for w in frames)
        return ContinuousQuery("q", frames, body, (Agg("avg", "o", "mean"), Agg("count", "*", "n")), filters=("?o > 0",))

    fine = query(100).over_observations(obs)  # through ranges
    coarse = query(1000).over_observations(obs)  # rows copied into their windows
    some = fine.where("unix_millis(cast(window_start as timestamp)) % 1000 = 0")
    assert key(some.select("window_start", "window_end", "mean", "n")) == key(coarse.select("window_start", "window_end", "mean", "n"))


def test_texts_are_written_by_blocks(spark, monkeypatch):
    """A row goes once to each block of pieces, and small blocks, pieces and batches give the same texts."""
    sent = spark.createDataFrame([(0, 2047), (1000, 5000), (7, 7)], "_from long, _to long")
    assert ranges._blocks(sent).count() == 2 + 5 + 1
    rows = [("a" if i % 3 else None, ["x", "\u00e9\u4e2d", "", None, "10", "9"][i % 6], i % 4, T0 + timedelta(milliseconds=137 * i)) for i in range(70)]
    df = spark.createDataFrame(rows, "k string, v string, i int, t timestamp")
    aggs = [Agg("group_concat", "v", "texts", " | "), Agg("group_concat", "i", "numbers", ""), Agg("count", "*", "n")]
    for name, small in (("LISTED", 4), ("EXPANDED", 3), ("TEXT_BYTES", 40)):
        monkeypatch.setattr(ranges, name, small)
    for by in ([], ["k"]):
        assert key(ranges.windowed(df, "t", 4000, 50, aggs, by)) == key(windows.windowed(df, "t", 4000, 50, aggs, by))
