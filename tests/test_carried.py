"""Jobs that hand tables from batch to batch, and the incremental store."""

import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from streamwarden.operators import windows
from streamwarden.operators.windows import Agg
from streamwarden.sinks import incremental
from streamwarden.streaming import carried

T0 = datetime(2024, 1, 1)
SCHEMA = "id long, k string, t timestamp, v int"


def land(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def events(seed, n=60, hours=3):
    rng = random.Random(seed)
    return [(i, rng.choice("ab"), T0 + timedelta(seconds=rng.randint(0, hours * 3600)), rng.randint(1, 9)) for i in range(n)]


def run(spark, tmp_path, parts, job):
    folder = str(tmp_path / "in")
    spark.createDataFrame([], SCHEMA).write.parquet(folder)
    for part in parts:
        land(spark, folder, part)
        job(spark.readStream.schema(SCHEMA).parquet(folder)).awaitTermination()


def key(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("range_ms, step_ms", [(600_000, 300_000), (700_000, 300_000), (300_000, 300_000), (200_000, 300_000)])
def test_results_and_late_rows_hold_every_row(spark, tmp_path, range_ms, step_ms):
    rows = sorted(events(1), key=lambda r: r[2])
    parts = [rows[:20], rows[20:40] + [], rows[40:]]
    moved = parts[0].pop(3)
    parts[2].append(moved)  # two parts late
    end = [(-1, "z", T0 + timedelta(days=9), 0)]
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")
    aggs = [Agg("count", "*", "n"), Agg("avg", "v", "mean"), Agg("max", "v", "most")]
    run(spark, tmp_path, [*parts, end], lambda df: carried.sliding_with_late(
        df, "t", range_ms, step_ms, aggs, ["k"], out, checkpoint, delay_ms=60_000, available_now=True))
    late = {r.id for r in spark.read.parquet(f"{out}/late").collect()}
    upto, seen = None, set()
    for part in parts:
        seen |= {r[0] for r in part if upto is not None and r[2] < upto}
        upto = max([upto or T0, *(r[2] - timedelta(seconds=60) for r in part)])
    assert late == seen and moved[0] in late
    kept = spark.createDataFrame([r for r in rows if r[0] not in late], SCHEMA)
    want = windows.windowed(kept, "t", range_ms, step_ms, aggs, ["k"])
    assert key(spark.read.parquet(f"{out}/results").drop("batch")) == key(want)


def test_queue_releases_in_order_of_time(spark, tmp_path):
    rows = events(2)
    rows[7] = (7, "a", rows[8][2], 1)  # a tie, told apart by id
    parts = [rows[:25], rows[25:50], rows[50:], [(1000, "a", T0 + timedelta(days=9), 0), (1001, "b", T0 + timedelta(days=9), 0)]]
    out = str(tmp_path / "out")
    run(spark, tmp_path, parts, lambda df: carried.earliest_first(
        df, "t", "id", ["k"], out, str(tmp_path / "checkpoint"), delay_ms=4 * 3_600_000, available_now=True))
    got = {r.id: r.position for r in spark.read.parquet(f"{out}/released").collect()}
    want = {}
    for k in "ab":
        mine = sorted((r for r in rows if r[1] == k), key=lambda r: (r[2], r[0]))
        want |= {r[0]: i for i, r in enumerate(mine, 1)}
    assert got == want and spark.read.parquet(f"{out}/late").count() == 0
    assert {r.id for r in spark.read.parquet(f"{out}/waiting/batch=3").collect()} == {1000, 1001}


MEMBERS = "id long, stream string, event_time timestamp"


def members(seed, n, streams=("http://h/a/", "http://h/b/", "http://h/c/"), days=3):
    rng = random.Random(seed)
    return [(seed * 1000 + i, rng.choice(streams), T0 + timedelta(minutes=rng.randint(0, days * 1440 - 1))) for i in range(n)]


def files(root):
    return {os.path.join(d, f) for d, _, names in os.walk(root) for f in names if f.endswith(".parquet") and "/data/" in d}


def test_three_batches_equal_one(spark, tmp_path):
    batches = [members(1, 150), members(2, 90), members(3, 30, ("http://h/b/",), 1)]
    steps, whole = str(tmp_path / "steps"), str(tmp_path / "whole")
    for i, rows in enumerate(batches):
        incremental.append(spark.createDataFrame(rows, MEMBERS), steps, i, size=5)
    incremental.append(spark.createDataFrame(sum(batches, []), MEMBERS), whole, 0, size=5)
    columns = ["id", "stream", "event_time", "new_bucket"]
    got = key(incremental.current(spark, steps, 2, MEMBERS).select(*columns))
    assert got == key(incremental.current(spark, whole, 0, MEMBERS).select(*columns)) and len(got) == 270
    assert len(incremental.current(spark, steps, 0, MEMBERS).collect()) == 150  # what a batch left can still be read
    versions = {(r.day, r.slot): r.version for r in incremental.manifest(spark, steps, 2).collect()}
    touched = [place for place, version in versions.items() if version == 2]
    assert len(touched) == 1 and len(versions) > 3  # the last batch was one stream on one day


def test_a_batch_rewrites_only_what_it_touches(spark, tmp_path):
    root = str(tmp_path / "store")
    incremental.append(spark.createDataFrame(members(1, 200), MEMBERS), root, 0)
    before = {f: os.path.getmtime(f) for f in files(root)}
    late = [(9_001, "http://h/a/", T0 + timedelta(minutes=5)), (9_002, None, T0), (9_003, "http://h/a/", None)]
    incremental.append(spark.createDataFrame(late, MEMBERS), root, 1)
    after = files(root)
    assert all(f in after and os.path.getmtime(f) == m for f, m in before.items())
    assert {os.path.dirname(f).split("/data/")[1].split("/")[0] for f in after - set(before)} == {"version=1"}
    stored = incremental.current(spark, root, 1, MEMBERS)
    assert stored.count() == 201 and stored.where(F.col("id") > 9_001).count() == 0
    ids = key(stored.select("id"))
    incremental.append(spark.createDataFrame(late, MEMBERS), root, 1)  # the batch runs again
    assert key(incremental.current(spark, root, 1, MEMBERS).select("id")) == ids
    incremental.append(spark.createDataFrame([], MEMBERS), root, 2)
    assert incremental.current(spark, root, 2, MEMBERS).count() == 201


def test_registrations_in_batches(spark, tmp_path):
    schema = "registration_id long, query_text string, registered_at timestamp"
    text = "REGISTER RStream <o> AS SELECT (MAX(?{0}) AS ?m) FROM NAMED WINDOW <w> ON STREAM <http://s/{1}> [RANGE 10 STEP 5] WHERE {{ WINDOW <w> {{ ?s <p> ?{0} }} }}"
    rows = [(i, text.format(v, s), T0 + timedelta(minutes=i)) for i, (v, s) in enumerate([("a", 1), ("b", 1), ("a", 2), ("c", 1), ("d", 2), ("e", 3)])]
    folder, out, checkpoint = (str(tmp_path / k) for k in ("in", "out", "checkpoint"))
    spark.createDataFrame([], schema).write.parquet(folder)
    for part in (rows[:2], rows[2:4], rows[4:]):
        spark.createDataFrame(part, schema).write.mode("append").parquet(folder)
        carried.check_registrations(spark.readStream.schema(schema).parquet(folder), out, checkpoint, available_now=True).awaitTermination()
    got = {r.registration_id: (r.is_unique, r.equivalent_to) for r in spark.read.parquet(f"{out}/checked").collect()}
    assert got == {0: (True, None), 1: (False, 0), 2: (True, None), 3: (False, 0), 4: (False, 2), 5: (True, None)}
    assert spark.read.parquet(f"{out}/registry").count() == 3
