"""Registered queries: streaming runs over all input, against the batch SQL.

Append mode gives a window once the watermark has passed its end. An end marker after
the last input moves it past all windows, so a run gives what the batch form gives.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import vocab
from ..functions import literals
from ..operators.windows import Agg
from ..operators import events, rules, skew, windows
from ..session import cut, scratch_path
from ..sinks import incremental
from ..sources import rated
from ..streaming import carried, monitor
from . import registry_queries, tables
from .continuous import ContinuousQuery, WindowSpec
from .registered import HOUR, MINUTE, query, win
from .window_queries import _USER_SQL, bounds, user_query

BASE = tables.BASE
R, S = 60 * MINUTE, 20 * MINUTE
# Input comes in one batch here, so nothing is late; a service says how late rows may be.
DELAY = "0 seconds"


def observation_stream(spark, sf, end=None):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    ev = monitor.table_stream(spark, sf, "events.parquet")
    if end is not None:
        ev = ev.unionByName(end.stream())
    return ev.select(
        F.col("ts").cast("timestamp").alias("event_time"), "event_id", "user_id", "event_type", "value",
        F.round(F.col("value") * 100).cast("long").alias("cents"),
        F.concat(F.lit(tables.RESOURCE), F.col("event_id").cast("string")).alias("resource_id"))


def end_of(spark, sf, users=None):
    """One event of each type, all at one time thirty years after the last event.

    A query that filters types before its watermark so has a marker that passes, whatever the last
    events are. ``users`` (one column) are those a query lets through: the markers are then of one of them.
    """
    events = tables.load(spark, sf, "events")
    every = F.struct(*events.columns)
    last = events.groupBy("event_type").agg(F.max_by(every, F.struct("ts", "event_id")).alias("row")).select("row.*")
    rows = last.crossJoin(events.agg((F.date_trunc("year", F.max("ts")) + F.expr("interval 30 years")).alias("_then")))
    if users is not None:
        rows = rows.crossJoin(users.agg(F.min(users.columns[0]).alias("_user"))).withColumn("user_id", F.coalesce("_user", "user_id"))
    return monitor.EndMarker(rows.withColumn("ts", F.col("_then")).withColumn(
        "value", F.lit(100.0)).select(*[F.col(c).cast(t) for c, t in events.dtypes]))


@query(f"with {win(R, S)} select ws window_start_ms, we window_end_ms, event_type, avg(cents) avg_cents, count(*) n, "
       f"max(value) max_value from w group by all")
def stream_sliding_avg(spark, sf):
    end = end_of(spark, sf)
    aggs = [Agg("avg", "cents", "avg_cents"), Agg("count", "*", "n"), Agg("max", "value", "max_value")]
    out = monitor.sliding(observation_stream(spark, sf, end), "event_time", R, S, aggs, ["event_type"], delay=DELAY)
    return monitor.run_available(out, "sliding", end).select(*bounds(), "event_type", "avg_cents", "n", "max_value")


@query(f"with {win(R, R)} select ws window_start_ms, we window_end_ms, user_id, cast(sum(cents) as bigint) total from w "
       "group by all")
def stream_tumbling_sum(spark, sf):
    end = end_of(spark, sf)
    out = monitor.sliding(observation_stream(spark, sf, end), "event_time", R, R, [Agg("sum", "cents", "total")], ["user_id"],
                          delay=DELAY)
    return monitor.run_available(out, "tumbling", end).select(*bounds(), "user_id", "total")


_ROWS = f"with {win(R, S)}, r as (select distinct ws, we, user_id from w) "


@query(_ROWS + f"select ws window_start_ms, we window_end_ms, user_id from r where not exists "
       f"(select 1 from r q where q.user_id = r.user_id and q.ws = r.ws - {S})")
def stream_istream(spark, sf):
    end = end_of(spark, sf)
    out = monitor.deltas(observation_stream(spark, sf, end), "event_time", R, S, ["user_id"], "IStream", delay_ms=0)
    return monitor.run_available(out, "istream", end).select(*bounds(), "user_id")


@query(_ROWS + f"select ws + {S} window_start_ms, we + {S} window_end_ms, user_id from r where not exists "
       f"(select 1 from r q where q.user_id = r.user_id and q.ws = r.ws + {S})")
def stream_dstream(spark, sf):
    end = end_of(spark, sf)
    out = monitor.deltas(observation_stream(spark, sf, end), "event_time", R, S, ["user_id"], "DStream", delay_ms=0)
    return monitor.run_available(out, "dstream", end).select(*bounds(), "user_id")


_GAPS = (f"with e as (select *, (epoch_us(ts) // {2 * R * 1000}) * {2 * R} ws, round(value * 100)::bigint cents, epoch_us(ts) u "
         f"from events), w as (select *, ws + {S} we from e where u < (ws + {S}) * 1000) ")


@query(_GAPS + "select ws window_start_ms, we window_end_ms, event_type, count(*) n from w group by all")
def stream_gapped_windows(spark, sf):
    """RANGE below STEP on a stream."""
    end = end_of(spark, sf)
    out = monitor.sliding(observation_stream(spark, sf, end), "event_time", S, 2 * R, [Agg("count", "*", "n")], ["event_type"],
                          delay=DELAY)
    return monitor.run_available(out, "gapped", end).select(*bounds(), "event_type", "n")


@query("select event_id, value from events")
def stream_gap_dedup(spark, sf):
    # History and live input overlap completely: every event is offered twice.
    twice = monitor.union_of([observation_stream(spark, sf), observation_stream(spark, sf)])
    out = monitor.without_repeats(twice, delay="60 days").select("event_id", "value", "event_time")
    return monitor.run_available(out, "dedup").select("event_id", "value")


@query(_USER_SQL + "select ws window_start_ms, we window_end_ms, k, max_o, n from r")
def stream_continuous_query(spark, sf):
    end = end_of(spark, sf)
    obs = observation_stream(spark, sf, end).withColumn("stream", F.lit("http://example.org/streams/all/")).withColumn(
        "property", F.concat(F.lit(tables.PROPERTY), F.col("event_type"))).withWatermark("event_time", DELAY)
    return monitor.run_available(user_query().over_observations(obs), "continuous", end).select(*bounds(), "k", "max_o", "n")


def _user_stream(spark, sf, end):
    return observation_stream(spark, sf, end).withColumn("stream", F.lit("http://example.org/streams/all/")).withColumn(
        "property", F.concat(F.lit(tables.PROPERTY), F.col("event_type"))).withWatermark("event_time", DELAY)


@query(_USER_SQL + f"select ws window_start_ms, we window_end_ms, k, max_o, n from r where not exists (select 1 "
       f"from r q where q.k = r.k and q.max_o = r.max_o and q.n = r.n and q.ws = r.ws - {S})")
def stream_continuous_query_istream(spark, sf):
    """What a live query's window results have that those a step before had not."""
    end = end_of(spark, sf)
    out = user_query("IStream").over_observations(_user_stream(spark, sf, end))
    return monitor.run_available(out, "continuous-istream", end).select(*bounds(), "k", "max_o", "n")


@query(_USER_SQL + f"select ws + {S} window_start_ms, we + {S} window_end_ms, k, max_o, n from r where not exists (select 1 "
       f"from r q where q.k = r.k and q.max_o = r.max_o and q.n = r.n and q.ws = r.ws + {S})")
def stream_continuous_query_dstream(spark, sf):
    """What a live query's window results no longer have a step later."""
    end = end_of(spark, sf)
    out = user_query("DStream").over_observations(_user_stream(spark, sf, end))
    return monitor.run_available(out, "continuous-dstream", end).select(*bounds(), "k", "max_o", "n")


@query(f"with {win(48 * HOUR, 12 * HOUR)}, a as (select distinct ws, we, user_id, cast(floor(value) as bigint) o from w where event_type = 'click'), "
       "x as (select *, epoch_us(ts) u from events), "
       "b as (select distinct ((u // 43200000000) - g) * 43200000 + 86400000 we, user_id, "
       "cast(floor(value) as bigint) o from x, range(2) t(g) where event_type = 'view') "
       "select a.ws window_start_ms, a.we window_end_ms, a.user_id, a.o from a join b using (we, user_id, o)")
def stream_window_join_unequal(spark, sf):
    """Windows of different length on live streams meet where they end together."""
    end = end_of(spark, sf)
    obs = observation_stream(spark, sf, end).withColumn("o", F.floor("value")).withWatermark("event_time", DELAY)
    row = ["user_id", "o"]
    out = windows.window_join_stream(
        [(obs.where(F.col("event_type") == kind), row) for kind in ("click", "view")], "event_time",
        [(48 * HOUR, 12 * HOUR), (24 * HOUR, 12 * HOUR)]).drop("_end")
    return monitor.run_available(out, "window-join-unequal", end).select(*bounds(), *row)


@query(f"with {win(24 * HOUR, 12 * HOUR)}, a as (select distinct ws, we, user_id % 20 s, value o from w where event_type = 'click'), "
       "x as (select *, epoch_us(ts) u from events), "
       "b as (select distinct ((u // 21600000000) - g) * 21600000 + 43200000 we, user_id % 20 s from x, range(2) t(g) where event_type = 'view') "
       "select ws window_start_ms, we window_end_ms, max(o) max_o, count(*) n from a join b using (we, s) group by all")
def stream_continuous_query_two_windows(spark, sf):
    """A spec of two windows with frames of their own, aggregated over their joined solutions."""
    end = end_of(spark, sf)
    kinds = F.when(F.col("event_type") == "click", "http://example.org/streams/a/").when(
        F.col("event_type") == "view", "http://example.org/streams/b/")
    obs = _user_stream(spark, sf, end).withColumn("stream", kinds).withColumn(
        "resource_id", F.concat(F.lit("http://example.org/user/"), F.pmod("user_id", F.lit(20)).cast("string")))
    a = WindowSpec("w1", "http://example.org/streams/a/", 24 * HOUR, 12 * HOUR)
    b = WindowSpec("w2", "http://example.org/streams/b/", 12 * HOUR, 6 * HOUR)
    q = ContinuousQuery("two", (a, b), (("w1", "?s", vocab.HAS_VALUE, "?o"), ("w2", "?s", vocab.RELATES_TO, tables.PROPERTY + "view")),
                        (Agg("max", "o", "max_o"), Agg("count", "*", "n")))
    return monitor.run_available(q.over_observations(obs), "two-windows", end).select(*bounds(), "max_o", "n")


def _side(kind):
    return f"select distinct ws, we, user_id from w where event_type = '{kind}'"


@query(f"with {win(6 * HOUR, 2 * HOUR)}, a as ({_side('click')}), b as ({_side('view')}) "
       "select a.ws window_start_ms, a.we window_end_ms, user_id from a join b using (ws, we, user_id)")
def stream_window_join(spark, sf):
    end = end_of(spark, sf)
    obs = observation_stream(spark, sf, end)
    out = monitor.joined_windows(obs.where("event_type = 'click'"), obs.where("event_type = 'view'"), ["user_id"],
                                 "event_time", 6 * HOUR, 2 * HOUR, delay=DELAY)
    return monitor.run_available(out, "window-join", end).select(*bounds(), "user_id")


def notification_stream(spark, sf, end=None):
    """Messages with the event's document as body; updates are not additions."""
    obs = observation_stream(spark, sf, end)
    subject = F.concat(F.lit("<"), F.col("resource_id"), F.lit(">"))
    iso = F.date_format("event_time", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    body = F.concat_ws(
        "\n",
        F.concat(subject, F.lit(f" <{vocab.RELATES_TO}> <{tables.PROPERTY}"), F.col("event_type"), F.lit("> .")),
        F.concat(subject, F.lit(f" <{vocab.HAS_TIMESTAMP}> "), literals.literal_text(iso), F.lit(" .")),
        F.concat(subject, F.lit(f" <{vocab.HAS_VALUE}> "),
                 literals.literal_text(F.col("cents").cast("string"), F.lit(vocab.XSD_FLOAT)), F.lit(" .")))
    return obs.select(F.when(F.col("event_type") == "error", "Update").otherwise("Add").alias("type"),
                      tables.stream_url().alias("target"), F.col("event_time").alias("published"), body.alias("body"))


_RULE = "case when value <= 600 then 'low' when value <= 3000 then 'usual' else 'high' end"


@query("with e0 as (select * from events where event_type <> 'error' and user_id in "
       "(select c_custkey from customer where c_acctbal >= 0)), "
       + win(R, S, "e0").replace("epoch_us(ts) u", "(epoch_us(ts) // 1000) * 1000 u")
       + f", r as (select ws, we, user_id, event_type, avg(cents) as value from w group by all) "
         f"select ws window_start_ms, we window_end_ms, concat('{BASE}', user_id, '/', event_type, '/') stream, value, "
         f"concat('{vocab.EX}', {_RULE}) derived_o from r")
def stream_live_alerts(spark, sf):
    """Notification -> grant -> document -> window -> rules."""
    kinds = F.array(*[F.lit(k) for k in ("click", "view", "signup", "purchase", "error")])
    allowed = tables.load(spark, sf, "customer").where("c_acctbal >= 0").select("c_custkey")
    grants = allowed.select("c_custkey", F.explode(kinds).alias("kind")).select(
        F.concat(tables.user_url("c_custkey"), F.lit("derived/"), "kind").alias("resource"))
    end = end_of(spark, sf, allowed)
    observed = monitor.observations_of(notification_stream(spark, sf, end), grants)

    rule_list = rules.threshold_rules([(None, 600.0, vocab.EX + "low"), (600.0, 3000.0, vocab.EX + "usual"),
                                       (3000.0, None, vocab.EX + "high")])
    out = monitor.alerts(observed, R, S, rule_list, ["stream"], delay=DELAY)
    return monitor.run_available(out, "alerts", end).select(*bounds(), "stream", "value", "derived_o")


_SUBSCRIBED = "select concat('{0}', c_custkey, '/purchase/') stream, c_name subscriber from customer where c_nationkey < 10"


@query("with e0 as (select * from events where event_type = 'purchase' and user_id in "
       "(select c_custkey from customer where c_acctbal >= 0)), "
       + win(R, S, "e0").replace("epoch_us(ts) u", "(epoch_us(ts) // 1000) * 1000 u")
       + f", r as (select ws, we, concat('{BASE}', user_id, '/purchase/') stream, avg(cents) as value from w group by all) "
         f"select subscriber, stream, ws window_start_ms, we window_end_ms, value, concat('{vocab.EX}', {_RULE}) derived_o "
         f"from r join ({_SUBSCRIBED.format(BASE)}) using (stream)")
def stream_live_delivery(spark, sf):
    """The whole live path: notification, grant, document, window, event, rules, and delivery with grants read per batch."""
    customers = tables.load(spark, sf, "customer")
    stream = F.concat(tables.user_url("c_custkey"), F.lit("purchase/"))
    paths = {k: scratch_path(spark, k) for k in ("grants", "subscriptions", "delivered", "checkpoint")}
    allowed = customers.where("c_acctbal >= 0")
    derived = allowed.select(F.concat(tables.user_url("c_custkey"), F.lit("derived/purchase")).alias("resource"))
    allowed.select(stream.alias("resource")).write.parquet(paths["grants"])
    customers.where("c_nationkey < 10").select(F.md5(stream).alias("query_hash"), F.col("c_name").alias("subscriber")).write.parquet(
        paths["subscriptions"])
    end = end_of(spark, sf, allowed.select("c_custkey"))
    observed = monitor.observations_of(notification_stream(spark, sf, end), derived)
    averages = monitor.sliding(observed, "event_time", R, S, [Agg("avg", "value", "value")], ["stream"], delay=DELAY)
    made = events.construct(averages, F.md5("stream"), "value", F.array("stream"), F.col("window_end"), by=["stream"])
    rule_list = rules.threshold_rules([(None, 600.0, vocab.EX + "low"), (600.0, 3000.0, vocab.EX + "usual"),
                                       (3000.0, None, vocab.EX + "high")])
    found = rules.apply_thresholds(made, rule_list)
    for step in (None, end):
        if step is not None:
            step()
        monitor.deliver(found, paths["subscriptions"], paths["delivered"], paths["checkpoint"], available_now=True,
                        grants_path=paths["grants"]).awaitTermination()
    out = spark.read.parquet(paths["delivered"] + "/delivered")
    return out.select("subscriber", "stream", *bounds(), "value", "derived_o")


# --- jobs that hand tables from batch to batch; events come in four parts, every tenth of them a part too late ---------

PARTS = 4
_ARRIVED = (f"r as (select *, (row_number() over (order by ts, event_id) - 1) * {PARTS} // count(*) over () p from events), "
            f"arrived as (select *, least({PARTS - 1}, p + if(event_id % 10 = 0, 1, 0)) part from r)")


def _arriving(spark, sf, job, end=None):
    """Runs ``job(stream)`` after each part has landed, as a service would that is started again and again."""
    events = tables.load(spark, sf, "events")
    order = skew.positions(events, [], ["ts", "event_id"], "_pos").crossJoin(F.broadcast(events.agg(F.count("*").alias("n"))))  # one row
    part = F.expr(f"least({PARTS - 1}, cast((_pos - 1) * {PARTS} div n + if(event_id % 10 = 0, 1, 0) as int))")
    arrived, folder = cut(order.withColumn("part", part).select(*events.columns, "part")), scratch_path(spark, "arriving")
    arrived.limit(0).drop("part").write.parquet(folder)
    for k in range(PARTS + (end is not None)):
        rows = arrived.where(F.col("part") == k).drop("part") if k < PARTS else end.rows
        rows.coalesce(1).write.mode("append").parquet(folder)
        job(spark.readStream.schema(events.schema).parquet(folder)).awaitTermination()


@query(f"with {_ARRIVED}, m as (select part, max(epoch_us(ts)) - 3600000000 upto from arrived group by 1), "
       "k as (select a.*, coalesce(epoch_us(ts) < (select max(upto) from m where m.part < a.part), false) late from arrived a), "
       f"ok as (select * from k where not late), {win(R, S, 'ok')} "
       "select 'window' kind, event_type, ws at_ms, count(*) n, cast(sum(cents) as bigint) total from w group by all "
       "union all select 'late', event_type, event_id, 1, round(value * 100)::bigint from k where late")
def stream_late_rows(spark, sf):
    """Sliding windows over rows of which some come late, and the late rows beside them: no row is lost."""
    out, checkpoint, end = scratch_path(spark, "late"), scratch_path(spark, "late-checkpoint"), end_of(spark, sf)

    def job(stream):
        rows = stream.select("event_id", "event_type", "value", F.col("ts").cast("timestamp").alias("event_time"),
                             F.round(F.col("value") * 100).cast("long").alias("cents"))
        return carried.sliding_with_late(rows, "event_time", R, S, [Agg("count", "*", "n"), Agg("sum", "cents", "total")], ["event_type"],
                                         out, checkpoint, delay_ms=HOUR, available_now=True)

    _arriving(spark, sf, job, end)
    windows_of = spark.read.parquet(f"{out}/results").select(
        F.lit("window").alias("kind"), "event_type", tables.ms("window_start").alias("at_ms"), "n", "total")
    late = spark.read.parquet(f"{out}/late").select(
        F.lit("late").alias("kind"), "event_type", F.col("event_id").cast("long").alias("at_ms"), F.lit(1).cast("long").alias("n"),
        F.col("cents").alias("total"))
    return windows_of.unionByName(late)


@query("select event_id, row_number() over (order by ts, event_id) as position from events")
def stream_earliest_first(spark, sf):
    """Events that come out of order leave the queue in order of their time."""
    out, checkpoint, end = scratch_path(spark, "queue"), scratch_path(spark, "queue-checkpoint"), end_of(spark, sf)
    last = tables.load(spark, sf, "events").agg(F.max("ts").alias("last"))
    span = tables.load(spark, sf, "events").agg(
        ((F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))) / 1000).cast("long")).first()[0]

    def job(stream):
        rows = stream.select("event_id", F.col("ts").cast("timestamp").alias("event_time"))
        return carried.earliest_first(rows, "event_time", "event_id", [], out, checkpoint, delay_ms=span, available_now=True)

    _arriving(spark, sf, job, end)
    released = spark.read.parquet(f"{out}/released")
    real = last.select(F.col("last").cast("timestamp").alias("last"))  # one row
    return released.join(F.broadcast(real), released["event_time"] <= real["last"]).select("event_id", "position")


@query(registry_queries.SQL_OF_DUPLICATES)
def stream_duplicate_queries(spark, sf):
    """Registrations checked against the registry as they arrive, in three batches by date."""
    out, checkpoint, folder = (scratch_path(spark, k) for k in ("checked", "checked-checkpoint", "arriving"))
    every = cut(registry_queries.registrations(spark, sf))
    dates = every.agg(*[F.percentile_approx(F.unix_micros(F.col("registered_at").cast("timestamp")), q) for q in (0.33, 0.66)]).first()
    at = F.unix_micros(F.col("registered_at").cast("timestamp"))
    every.limit(0).write.parquet(folder)
    for part in (at <= dates[0], (at > dates[0]) & (at <= dates[1]), at > dates[1]):
        every.where(part).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(every.schema).parquet(folder)
        carried.check_registrations(stream, out, checkpoint, available_now=True).awaitTermination()
    return spark.read.parquet(f"{out}/checked").select("registration_id", "is_unique", "equivalent_to")


@query(f"with m as (select event_id id, concat('{BASE}', user_id, '/') stream, date_trunc('day', ts) d, ts from events), "
       "r as (select *, row_number() over (partition by stream, d order by ts, id) - 1 p from m), "
       "o as (select distinct stream, d, ts from r where p > 0 and p % 20 = 0), "
       "x as (select m.*, (select max(o.ts) from o where o.stream = m.stream and o.d = m.d and o.ts <= m.ts) n from m) "
       "select id, stream, concat(stream, coalesce(epoch_us(n) // 1000, epoch_us(d::timestamp) // 1000), '/') new_bucket from x")
def stream_incremental_store(spark, sf):
    """Members stored as they arrive, in four batches that rewrite only the days and streams they touch."""
    out, checkpoint = scratch_path(spark, "store"), scratch_path(spark, "store-checkpoint")

    def job(stream):
        rows = stream.select(F.col("event_id").alias("id"), tables.user_url().alias("stream"), F.col("ts").cast("timestamp").alias("event_time"))
        return carried.store(rows, out, checkpoint, available_now=True)

    _arriving(spark, sf, job)
    kind = dict(tables.load(spark, sf, "events").dtypes)["event_id"]
    return incremental.current(spark, out, PARTS - 1, f"id {kind}, stream string, event_time timestamp").select("id", "stream", "new_bucket")


@query("select event_id, value from events")
def stream_rated_history(spark, sf):
    """History read at a rate, 20 000 rows a second: every row comes, none twice."""
    events = tables.load(spark, sf, "events").select("event_id", "value", F.col("ts").cast("timestamp").alias("event_time"))
    total, out = events.count(), scratch_path(spark, "rated-out")
    job = monitor.start(rated.replay(events, ["event_time", "event_id"], 20_000, 1000), out, scratch_path(spark, "rated-checkpoint"))
    try:
        while job.isActive:
            job.processAllAvailable()  # what the rate lets through by now
            if spark.read.schema(events.schema).parquet(out).count() >= total:
                break
            job.awaitTermination(0.2)
    finally:
        job.stop()
    return spark.read.parquet(out).select("event_id", "value")
