import json
import time
from datetime import datetime, timedelta

import duckdb
import pytest
from pyspark.sql import functions as F

from streamwarden import vocab
from streamwarden.operators import rules
from streamwarden.operators.windows import Agg, windowed
from streamwarden.plans import stream_queries
from streamwarden.plans.registered import SQL
from streamwarden.sources import live
from streamwarden.streaming import monitor

T0 = datetime(2024, 1, 1)
MINUTE = 60_000


def at(seconds):
    return T0 + timedelta(seconds=seconds)


def put(folder, name, messages):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps(m) for m in messages))


def message(i, seconds, value, kind="Add", stream="acc-x"):
    iso = at(seconds).strftime("%Y-%m-%dT%H:%M:%S.000Z")
    body = "\n".join([
        f"<http://h/o{i}> <{vocab.RELATES_TO}> <http://p> .",
        f'<http://h/o{i}> <{vocab.HAS_TIMESTAMP}> "{iso}" .',
        f'<http://h/o{i}> <{vocab.HAS_VALUE}> "{value}"^^<{vocab.XSD_FLOAT}> .'])
    return {"type": kind, "target": f"http://h/alice/{stream}/", "published": iso, "body": body}


def test_live_alerts_are_delivered_and_equal_the_batch_result(spark, tmp_path):
    inbox = tmp_path / "inbox"
    put(inbox, "a.json", [message(1, 0, 5), message(2, 30, 9), message(3, 70, 40), message(9, 75, 1, kind="Update")])
    put(inbox, "b.json", [message(4, 130, 60), message(5, 140, 70, stream="secret"), message(6, 7200, 1)])
    grants = spark.createDataFrame([("http://h/alice/derived/acc-x", "m")], "resource string, agent string")
    observed = monitor.observations_of(live.notification_stream(spark, str(inbox), max_files=1), grants)
    rule_list = rules.threshold_rules([(None, 10.0, "calm"), (10.0, None, "busy")])
    out = monitor.alerts(observed, MINUTE, MINUTE, rule_list, ["stream"], delay="0 seconds").withColumn("query_hash", F.lit("q"))

    subs = str(tmp_path / "subs")
    spark.createDataFrame([("q", "c1"), ("q", "c2")], "query_hash string, subscriber string").write.parquet(subs)
    q = monitor.deliver(out, subs, str(tmp_path / "out"), str(tmp_path / "cp"), available_now=True)
    q.awaitTermination()
    got = sorted((r.subscriber, r.window_start, r.value, r.derived_o)
                 for r in spark.read.parquet(str(tmp_path / "out" / "delivered")).collect())
    want = [(at(0), 7.0, "calm"), (at(60), 40.0, "busy"), (at(120), 60.0, "busy")]
    assert got == [(c, *w) for c in ("c1", "c2") for w in want]
    assert monitor.late_rows(q) == 0

    # The same plan in batch over the same files.
    batch = monitor.observations_of(spark.read.schema("type string, target string, published timestamp, body string")
                                    .json(str(inbox)), grants)
    plain = windowed(batch, "event_time", MINUTE, MINUTE, [Agg("avg", "value", "value")], ["stream"])
    assert [(r.window_start, r.value) for r in plain.orderBy("window_start").collect()][:3] == [w[:2] for w in want]


def test_unwanted_results_are_kept(spark, tmp_path):
    inbox = tmp_path / "in"
    put(inbox, "a.json", [message(1, 0, 1)])
    results = live.notification_stream(spark, str(inbox)).select(F.lit("nobody").alias("query_hash"), "target")
    subs = str(tmp_path / "subs")
    spark.createDataFrame([("q", "c1")], "query_hash string, subscriber string").write.parquet(subs)
    monitor.deliver(results, subs, str(tmp_path / "out"), str(tmp_path / "cp"), available_now=True).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out" / "unmatched")).count() == 1


def test_history_then_new_files_then_resume(spark, tmp_path):
    folder, out, cp = str(tmp_path / "obs"), str(tmp_path / "out"), str(tmp_path / "cp")
    schema = "resource_id string, event_time timestamp_ntz, value double"

    def add(ids):
        spark.createDataFrame([(f"r{i}", at(i), float(i)) for i in ids], schema).coalesce(1).write.mode("append").parquet(folder)

    def run():
        df = live.observation_stream(spark, folder, schema, "historical+live", max_files=1)
        q = monitor.start(monitor.without_repeats(df, delay="1 hour"), out, cp, available_now=True)
        q.awaitTermination()

    add(range(5))
    run()
    add(range(3, 8))  # overlaps what was read
    run()
    assert sorted(r.resource_id for r in spark.read.parquet(out).collect()) == [f"r{i}" for i in range(8)]
    recent = live.observation_stream(spark, folder, schema, "live", start=at(6))
    assert sorted(r.resource_id for r in monitor.run_available(recent).collect()) == ["r6", "r7"]
    registered = live.lookback_stream(spark, folder, schema, 3000, now=at(8))
    assert sorted(r.resource_id for r in monitor.run_available(registered).collect()) == ["r5", "r6", "r7"]


def test_results_wait_for_a_full_batch(spark, tmp_path):
    folder, out, cp = str(tmp_path / "res"), str(tmp_path / "out"), str(tmp_path / "cp")
    schema = "query_hash string, container string, event_time timestamp, id int"

    def add(ids):
        spark.createDataFrame([("q", "http://h/agg/", at(i), i) for i in ids], schema).coalesce(1).write.mode("append").parquet(folder)

    def run():
        df = spark.readStream.schema(schema).parquet(folder)
        monitor.publish_batches(df, ["query_hash"], "container", "event_time", ["event_time", "id"], out, cp, n=4,
                                available_now=True).awaitTermination()

    add(range(6))
    run()
    add(range(6, 9))
    run()
    stored = spark.read.parquet(out + "/stored")
    ms = lambda s: int((at(s) - datetime(1970, 1, 1)).total_seconds() * 1000)
    assert sorted((r.id, r.bucket) for r in stored.collect()) == [
        (i, f"http://h/agg/{ms(3 if i < 4 else 7)}/") for i in range(8)]
    assert [r.id for r in spark.read.parquet(out + "/waiting/batch=1").collect()] == [8]


def test_late_rows_are_counted(spark, tmp_path):
    folder = str(tmp_path / "late")
    schema = "event_time timestamp, value double"
    for s in ([0, 500], [600], [1]):
        spark.createDataFrame([(at(x), 1.0) for x in s], schema).coalesce(1).write.mode("append").parquet(folder)
    df = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    out = monitor.sliding(df, "event_time", MINUTE, MINUTE, [Agg("count", "*", "n")], delay="0 seconds")
    q = monitor.start(out, str(tmp_path / "o"), str(tmp_path / "c"), available_now=True)
    q.awaitTermination()
    assert monitor.late_rows(q) == 1


def test_late_rows_of_a_whole_run_are_counted(spark, tmp_path):
    folder = str(tmp_path / "late")
    schema = "event_time timestamp, value double"
    for s in ([0, 500], [600], [1], [2]):
        spark.createDataFrame([(at(x), 1.0) for x in s], schema).coalesce(1).write.mode("append").parquet(folder)
    counter = monitor.LateRows()
    spark.streams.addListener(counter)
    try:
        df = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
        out = monitor.sliding(df, "event_time", MINUTE, MINUTE, [Agg("count", "*", "n")], delay="0 seconds")
        q = monitor.start(out, str(tmp_path / "o"), str(tmp_path / "c"), available_now=True)
        q.awaitTermination()
        for _ in range(50):
            if counter.counts.get(str(q.id)) == monitor.late_rows(q) > 0:
                break
            time.sleep(0.2)
        assert counter.counts[str(q.id)] == monitor.late_rows(q) == 2
    finally:
        spark.streams.removeListener(counter)


@pytest.mark.parametrize("name", ["stream_window_join", "stream_live_alerts", "stream_live_delivery"])
def test_a_tail_of_one_type_and_an_ungranted_user_loses_nothing(spark, tmp_path, name):
    kinds = ["click", "view", "purchase", "error", "signup"]
    events = [(i, at(600 * i), 1 + i % 2, kinds[i % 5], float(i)) for i in range(40)]
    events += [(1000 + i, at(24_000 + i), 3, "click", 1.0) for i in range(300)]  # user 3 has no grant
    spark.createDataFrame(events, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").coalesce(1) \
        .write.parquet(str(tmp_path / "events.parquet"))
    customers = [(1, "c1", 5.0, 1), (2, "c2", 5.0, 2), (3, "c3", -5.0, 3)]
    spark.createDataFrame(customers, "c_custkey long, c_name string, c_acctbal double, c_nationkey int").coalesce(1) \
        .write.parquet(str(tmp_path / "customer.parquet"))
    db = duckdb.connect()
    for table in ("events", "customer"):
        db.execute(f"create view {table} as select * from read_parquet('{tmp_path}/{table}.parquet/*.parquet')")
    result = db.execute(SQL[name])
    columns = [c[0] for c in result.description]
    want = sorted(result.fetchall())
    assert want
    got = getattr(stream_queries, name)(spark, str(tmp_path)).select(*columns)
    assert sorted(tuple(r) for r in got.collect()) == want
