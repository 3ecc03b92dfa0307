"""Registered queries: history scans, time buckets, rules, provenance, discovery."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Window, functions as F

from .. import vocab
from ..functions import times, urls
from ..operators import buckets, discovery, events, ordering, provenance, rules, windows
from ..operators.windows import Agg
from ..sinks import storage
from ..sources import history, live
from . import graph_queries, tables
from .registered import MINUTE, query, win

BASE, RES, PROP = tables.BASE, tables.RESOURCE, tables.PROPERTY
MS = "(epoch_us(ts) // 1000)"
FROM, TO = datetime(2024, 1, 8), datetime(2024, 1, 15, 12)
RANGE_SQL = "ts between timestamp '2024-01-08' and timestamp '2024-01-15 12:00:00'"


def ms(c: str, alias: str):
    return tables.ms(c).alias(alias)


# --- history -------------------------------------------------------------------------------

@query(f"select event_id, {MS} event_ms from events where {RANGE_SQL}")
def time_range_scan(spark, sf):
    members = tables.load(spark, sf, "events").withColumnRenamed("ts", "event_time")
    return history.historical_scan(members, None, FROM, TO, "event_id").select("event_id", ms("event_time", "event_ms"))


def _daily_buckets(spark, sf):
    day = F.date_trunc("day", "event_time")
    return tables.observations(spark, sf).select("stream", day.alias("lower_ts")).distinct().withColumn(
        "bucket", F.concat("stream", tables.ms("lower_ts").cast("string"), F.lit("/")))


_DAILY = (f"b as (select distinct concat('{BASE}', user_id, '/') stream, date_trunc('day', ts) lower_ts from events), "
          "i as (select *, lead(lower_ts) over (partition by stream order by lower_ts) upper_ts from b), "
          "k as (select * from i where lower_ts <= timestamp '2024-01-15 12:00:00' and "
          "(upper_ts is null or upper_ts > timestamp '2024-01-08')) ")


@query(f"with {_DAILY} select stream, epoch_ms(lower_ts) lower_ms, epoch_ms(upper_ts) upper_ms from k")
def fragment_pruning(spark, sf):
    return history.prune_fragments(_daily_buckets(spark, sf), FROM, TO).select(
        "stream", ms("lower_ts", "lower_ms"), ms("upper_ts", "upper_ms"))


@query(f"select event_id, concat('{BASE}', user_id, '/', epoch_ms(date_trunc('day', ts)), '/') bucket, {MS} event_ms "
       f"from events where {RANGE_SQL}")
def member_range_read(spark, sf):
    obs = tables.observations(spark, sf)
    placed = obs.withColumn("bucket", F.concat(
        "stream", F.unix_millis(F.date_trunc("day", "event_time")).cast("string"), F.lit("/")))
    return history.member_range_read(placed, _daily_buckets(spark, sf), FROM, TO).select(
        "event_id", "bucket", ms("event_time", "event_ms"))


def _order_documents(spark, sf):
    """Orders as documents; finished ones list their lines as members."""
    orders, lines = tables.load(spark, sf, "orders"), tables.load(spark, sf, "lineitem")
    doc = F.concat(F.lit("http://example.org/order/"), F.col("o_orderkey").cast("string"))
    stream = F.concat(F.lit(BASE), F.col("o_custkey").cast("string"), F.lit("/"))
    head = orders.select("o_orderkey", "o_orderstatus", doc.alias("resource_id"), stream.alias("stream"))
    joined = head.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).withColumn("line", F.concat(
        F.col("resource_id"), F.lit("/"), F.col("l_linenumber").cast("string"), F.lit("-"),
        F.col("l_partkey").cast("string")))
    quantity = joined.select("resource_id", "stream", F.col("line").alias("s"), F.lit(vocab.HAS_VALUE).alias("p"),
                             F.col("l_quantity").cast("string").alias("o"))
    links = joined.where("o_orderstatus = 'F'").select(
        "resource_id", "stream", F.col("stream").alias("s"), F.lit(vocab.TREE_MEMBER).alias("p"), F.col("line").alias("o"))
    return quantity.unionByName(links)


_LINES = (f"l as (select o_orderstatus st, concat('http://example.org/order/', o_orderkey) doc, "
          "concat('http://example.org/order/', o_orderkey, '/', l_linenumber, '-', l_partkey) line, "
          "cast(l_quantity as varchar) q from orders join lineitem on o_orderkey = l_orderkey) ")


@query(f"with {_LINES} select doc resource_id, case when st = 'F' then line else doc end member_id, line s, q o, "
       "count(*) n from l group by all")
def fragment_members(spark, sf):
    out = history.fragment_members(_order_documents(spark, sf))
    # A line listed twice in one document stays two rows of the same member.
    return out.groupBy("resource_id", "member_id", "s", "o").agg(F.count("*").alias("n"))


@query(f"with {_LINES} select doc resource_id, line s, q o, count(*) n from l group by all")
def strip_membership(spark, sf):
    return history.strip_membership(_order_documents(spark, sf)).groupBy("resource_id", "s", "o").agg(
        F.count("*").alias("n"))


# --- buckets -----------------------------------------------------------------------------------

def _members(spark, sf):
    return tables.observations(spark, sf).select(F.col("event_id").alias("id"), "stream", "event_time")


def _signup_buckets(spark, sf):
    """Every signup opens a bucket: irregular bounds, some members older than all of them."""
    obs = tables.observations(spark, sf).where("event_type = 'signup'")
    return obs.select("stream", F.concat("stream", F.lit("b"), F.col("event_id").cast("string"), F.lit("/")).alias("bucket"),
                      F.col("event_time").alias("lower_ts"))


_ASOF = (f"m as (select event_id id, concat('{BASE}', user_id, '/') stream, ts from events), "
         f"b as (select concat('{BASE}', user_id, '/') stream, concat('{BASE}', user_id, '/b', event_id, '/') bucket, "
         "ts lower_ts from events where event_type = 'signup'), "
         "a as (select m.id, m.stream, m.ts, b.bucket, b.lower_ts from m asof left join b "
         "on m.stream = b.stream and m.ts >= b.lower_ts) ")


@query(f"with {_ASOF} select id, stream, coalesce(bucket, 'none') bucket, epoch_us(lower_ts) // 1000 lower_ms from a")
def bucket_assign_asof(spark, sf):
    out = buckets.assign(_members(spark, sf), _signup_buckets(spark, sf))
    return out.select("id", "stream", "bucket", ms("lower_ts", "lower_ms"))


@query(f"with {_ASOF} select stream, coalesce(bucket, 'none') bucket, count(*) members from a group by all")
def bucket_count(spark, sf):
    return buckets.counts(buckets.assign(_members(spark, sf), _signup_buckets(spark, sf)))


@query(f"select distinct concat('{BASE}', user_id, '/') stream, concat('{BASE}', user_id, '/b', event_id, '/') bucket "
       "from events where event_type = 'signup'")
def bucket_exists(spark, sf):
    """Candidates are named after every event, and once more under another stream; only sign-ups opened a bucket."""
    obs = tables.observations(spark, sf)
    named = obs.select("stream", F.concat("stream", F.lit("b"), F.col("event_id").cast("string"), F.lit("/")).alias("bucket"))
    elsewhere = named.select(F.lit(BASE + "none/").alias("stream"), "bucket")
    return buckets.exists(named.unionByName(elsewhere), _signup_buckets(spark, sf))


def _daily_members(spark, sf):
    """Times cut to the day, so that many members share one."""
    return _members(spark, sf).select("id", "stream", F.date_trunc("day", "event_time").alias("event_time"),
                                      F.concat("stream", F.lit("1/")).alias("bucket"))


@query(f"with m as (select event_id id, concat('{BASE}', user_id, '/') stream, date_trunc('day', ts) t from events), "
       "r as (select *, row_number() over (partition by stream order by t, id) - 1 p from m), "
       "b as (select distinct stream, t from r where p > 0 and p % 20 = 0), "
       "x as (select m.*, (select max(b.t) from b where b.stream = m.stream and b.t <= m.t) n from m) "
       "select id, stream, epoch_ms(n) new_lower_ms, "
       "case when n is null then concat(stream, '1/') else concat(stream, epoch_ms(n), '/') end new_bucket from x")
def bucket_rebalance(spark, sf):
    out = buckets.rebalance(_daily_members(spark, sf))
    return out.select("id", "stream", ms("new_lower_ts", "new_lower_ms"), "new_bucket")


@query(f"with {_ASOF}, f as (select stream, min(ts) first_ts from m group by stream), "
       "s as (select id, a.stream, ts, coalesce(bucket, concat(a.stream, epoch_us(first_ts) // 1000, '/')) bucket "
       "from a join f on a.stream = f.stream), "
       "r as (select *, row_number() over (partition by stream, bucket order by ts, id) - 1 p from s), "
       "o as (select distinct stream, bucket, ts from r where p > 0 and p % 20 = 0), "
       "x as (select s.*, (select max(o.ts) from o where o.stream = s.stream and o.bucket = s.bucket and o.ts <= s.ts) n "
       "from s) select id, bucket, case when n is null then bucket else concat(stream, epoch_us(n) // 1000, '/') end "
       "new_bucket from x")
def store_and_rebalance(spark, sf):
    out = buckets.store_and_rebalance(_members(spark, sf), _signup_buckets(spark, sf))
    return out.select("id", "bucket", "new_bucket")


@query(f"select concat('{BASE}', user_id, '/') stream, min({MS}) earliest_ms from events group by 1")
def earliest_unassigned(spark, sf):
    return buckets.earliest(_members(spark, sf)).select("stream", ms("earliest_ts", "earliest_ms"))


@query(f"with r as (select event_id id, concat('{BASE}', user_id, '/') stream, ts, (row_number() over "
       "(partition by user_id order by ts, event_id) - 1) // 20 batch, count(*) over (partition by user_id) n from events), "
       f"k as (select *, max({MS}) over (partition by stream, batch) last_ms from r where batch < n // 20) "
       "select id, stream, batch, concat(stream, last_ms, '/') bucket from k")
def batch_of_20(spark, sf):
    full = buckets.batches(_members(spark, sf), ["stream"], ["event_time", "id"])
    return buckets.batch_buckets(full, ["stream"], "stream", "event_time", ["event_time", "id"]).select(
        "id", "stream", "batch", "bucket")


@query(f"with b as (select concat('{BASE}', user_id, '/') st, concat('{BASE}', user_id, '/b', event_id, '/') bucket, ts, "
       "event_id from events where event_type = 'signup'), "
       "x as (select *, md5(concat_ws('|', st, bucket)) n, strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') iso from b) "
       f"select s, p, o from (select st s, '{vocab.TREE_RELATION}' p, n o from x union all "
       f"select n, '{vocab.RDF_TYPE}', '{vocab.TREE_GREATER_EQ}' from x union all "
       f"select n, '{vocab.TREE_NODE}', bucket from x union all select n, '{vocab.TREE_PATH}', '{vocab.HAS_TIMESTAMP}' from x "
       f"union all select n, '{vocab.TREE_VALUE}', iso from x union all "
       f"select distinct concat(st, '#EventStream'), '{vocab.RDF_TYPE}', '{vocab.LDES_STREAM}' from b union all "
       f"select distinct concat(st, '#EventStream'), '{vocab.LDES_TIMESTAMP_PATH}', '{vocab.HAS_TIMESTAMP}' from b union all "
       f"select distinct concat(st, '#EventStream'), '{vocab.LDES_VERSION_OF_PATH}', '{vocab.VERSION_OF}' from b union all "
       f"select distinct concat(st, '#EventStream'), '{vocab.TREE_VIEW}', st from b union all "
       f"select distinct st, '{vocab.RDF_TYPE}', '{vocab.TREE_NODE_CLASS}' from b union all "
       f"select st, '{vocab.LDP_INBOX}', arg_max(bucket, (ts, bucket)) from b group by st)")
def bucket_metadata_rows(spark, sf):
    return storage.bucket_description(_signup_buckets(spark, sf)).select("s", "p", "o")


def _inboxes(spark, sf):
    obs = tables.observations(spark, sf)
    seconds = F.expr("div(unix_millis(event_time), 1000)").cast("string")
    pointers = obs.select(F.col("stream").alias("s"), F.lit(vocab.LDP_INBOX).alias("p"),
                          F.concat("stream", seconds, F.lit("/")).alias("o"))
    return pointers.unionByName(obs.select(F.col("stream").alias("s"), F.lit(vocab.RELATES_TO).alias("p"),
                                           F.col("property").alias("o")).distinct())


_POINTER = (f"select distinct concat('{BASE}', user_id, '/') s, '{vocab.RELATES_TO}' p, concat('{PROP}', event_type) o "
            "from events union all ")


@query(_POINTER + f"select concat('{BASE}', user_id, '/'), '{vocab.LDP_INBOX}', concat('{BASE}', user_id, '/', "
       "max(epoch_us(ts) // 1000000), '/') from events group by user_id")
def latest_pointer(spark, sf):
    return storage.latest_pointer(_inboxes(spark, sf))


@query(_POINTER + f"select concat('{BASE}', user_id, '/'), '{vocab.LDP_INBOX}', max(concat('{BASE}', user_id, '/', "
       "epoch_us(ts) // 1000000, '/')) from events group by user_id")
def latest_pointer_by_name(spark, sf):
    return storage.latest_pointer(_inboxes(spark, sf), numeric=False)


@query(f"select concat('{BASE}', c_custkey, '/') stream, case when i.u is not null then "
       f"concat('{BASE}', c_custkey, '/inbox-', i.e, '/') end inbox from customer left join "
       "(select user_id u, min(event_id) e from events group by 1) i on i.u = c_custkey")
def inbox_lookup(spark, sf):
    obs = tables.observations(spark, sf)
    known = obs.select("stream", F.lit(vocab.LDP_INBOX).alias("p"), F.col("event_id").alias("seq"), F.concat(
        F.lit("inbox-"), F.col("event_id").cast("string"), F.lit("/")).alias("o"))
    streams = tables.load(spark, sf, "customer").select(tables.user_url("c_custkey").alias("stream"))
    return ordering.inbox_of(streams, known)


@query(f"select concat('{RES}', event_id) s, '{vocab.DCT_SOURCE}' p, concat('{BASE}', user_id, '/', {MS}, '/', event_id) o "
       "from events")
def source_link(spark, sf):
    stored = tables.observations(spark, sf).select(F.col("resource_id").alias("s"), F.concat(
        "stream", tables.ms("event_time").cast("string"), F.lit("/"), F.col("event_id").cast("string")).alias("location"))
    return storage.source_links(stored).select("s", "p", "o")


# --- events, rules -------------------------------------------------------------------------------

R, S = 60 * MINUTE, 20 * MINUTE
ISO_WS = "strftime(make_timestamp(ws * 1000), '%Y-%m-%dT%H:%M:%S.%gZ')"
ISO_WE = "strftime(make_timestamp(we * 1000), '%Y-%m-%dT%H:%M:%S.%gZ')"
_MAX = (f"{win(R, S)}, r as (select ws, we, user_id, max(value) v from w group by all), "
        f"ev as (select *, md5(concat_ws('|', 'max-by-user', {ISO_WS}, {ISO_WE}, user_id)) id from r)")


def _max_events(spark, sf):
    obs = tables.observations(spark, sf)
    out = windows.sliding(obs, "event_time", R, S, [Agg("max", "value", "max_value")], ["user_id"])
    return events.construct(out, F.lit("max-by-user"), "max_value", F.array(tables.user_url()), F.col("window_end"),
                            by=["user_id"])


@query(f"with {_MAX} select id event_id, 'max-by-user' query_hash, v as value, ws window_start_ms, we window_end_ms, "
       f"concat('{BASE}', user_id, '/') streams from ev")
def aggregation_events(spark, sf):
    return _max_events(spark, sf).select("event_id", "query_hash", "value", ms("window_start", "window_start_ms"),
                                         ms("window_end", "window_end_ms"), F.array_join("streams", ",").alias("streams"))


_EVENT_TRIPLES = (
    f"t as (select concat('{vocab.EVENT_BASE}', id) s, '{vocab.RDF_TYPE}' p, '{vocab.MEASUREMENT}' o from ev union all "
    f"select concat('{vocab.EVENT_BASE}', id), '{vocab.HAS_TIMESTAMP}', {ISO_WE} from ev union all "
    f"select concat('{vocab.EVENT_BASE}', id), '{vocab.HAS_VALUE}', cast(v as varchar) from ev union all "
    f"select concat('{vocab.EVENT_BASE}', id), '{vocab.PROV_DERIVED}', '{vocab.AGGREGATOR_AGENT}' from ev union all "
    f"select concat('{vocab.EVENT_BASE}', id), '{vocab.RSP_STARTED}', {ISO_WS} from ev union all "
    f"select concat('{vocab.EVENT_BASE}', id), '{vocab.RSP_ENDED}', {ISO_WE} from ev union all "
    f"select concat('{vocab.EVENT_BASE}', id), '{vocab.PROV_GENERATED_BY}', concat('{BASE}', user_id, '/') from ev)")


@query(f"with {_MAX}, {_EVENT_TRIPLES} select s, p, o from t")
def aggregation_event_triples(spark, sf):
    return events.to_triples(_max_events(spark, sf)).select("s", "p", "o")


@query(f"with {_MAX} select id event_id, concat('{{\"query_hash\":\"max-by-user\",\"aggregation_event\":\"', id, "
       "'\",\"aggregation_window_from\":\"2024-01-08T00:00:00.000Z\",\"aggregation_window_to\":"
       "\"2024-01-15T12:00:00.000Z\"}') message from ev")
def result_envelope(spark, sf):
    out = events.envelope(_max_events(spark, sf), F.col("event_id"), times.iso_utc(times.moment(FROM)), times.iso_utc(times.moment(TO)))
    return out.select("event_id", "message")


@query(f"with {_MAX} select id event_id, we generated_ms from ev where "
       "make_timestamp(we * 1000) between timestamp '2024-01-08' and timestamp '2024-01-15 12:00:00'")
def materialised_result_read(spark, sf):
    return history.stored_results(_max_events(spark, sf), FROM, TO, "max-by-user").select(
        "event_id", ms("generated_at", "generated_ms"))


@query(f"with {_MAX}, q as (select * from ev) select q.id event_id, e.event_id source_event from q join events e "
       "on e.user_id = q.user_id and e.ts >= make_timestamp(q.ws * 1000) and e.ts <= make_timestamp(q.we * 1000)")
def provenance_events(spark, sf):
    results = _max_events(spark, sf).select(F.col("event_id").alias("result_id"), F.col("streams")[0].alias("stream"),
                                            "window_start", "window_end")
    out = provenance.trace(results, tables.observations(spark, sf).select("stream", "event_time", "event_id"))
    return out.select(F.col("result_id").alias("event_id"), F.col("event_id").alias("source_event"))


@query(f"with {_MAX} select concat('{vocab.EVENT_BASE}', id) event, ws window_start_ms, we window_end_ms, "
       f"concat('{BASE}', user_id, '/') stream from ev")
def provenance_windows(spark, sf):
    return provenance.windows_of_results(events.to_triples(_max_events(spark, sf))).select(
        "event", ms("window_start", "window_start_ms"), ms("window_end", "window_end_ms"), "stream")


_NATION_RULES = ("nr as (select concat('http://example.org/rules/', n_nationkey) rule_set, 'high' rule_id, n_nationkey * 2.0 lo "
                 "from nation union all select concat('http://example.org/rules/', n_nationkey), 'low', n_nationkey * 2.0 "
                 "from nation)")


def _nation_rules(spark, sf):
    """Two rules per nation: above its own threshold, and up to it."""
    bound = (F.col("n_nationkey") * 2.0).cast("double")
    open_ = F.lit(None).cast("double")

    def rule(name, low, high):
        return F.struct(F.lit(name).alias("rule_id"), low.alias("lower"), F.lit(False).alias("lower_incl"),
                        high.alias("upper"), F.lit(True).alias("upper_incl"))

    return tables.load(spark, sf, "nation").select(
        F.concat(F.lit("http://example.org/rules/"), F.col("n_nationkey").cast("string")).alias("rule_set"),
        F.lit(vocab.HAS_VALUE).alias("premise_p"), F.lit(vocab.EX + "is").alias("derived_p"),
        F.explode(F.array(rule("high", bound, open_), rule("low", open_, bound))).alias("r"),
    ).select("rule_set", "premise_p", "derived_p", "r.*", F.col("r.rule_id").alias("derived_o"))


@query(f"with {_MAX}, {_NATION_RULES} select ev.id event_id, nr.rule_id, nr.rule_id derived_o from ev "
       "join customer c on c.c_custkey = ev.user_id join nr on nr.rule_set = concat('http://example.org/rules/', c_nationkey) "
       "where (nr.rule_id = 'high' and v > lo) or (nr.rule_id = 'low' and v <= lo)")
def rule_table_match(spark, sf):
    customers = tables.load(spark, sf, "customer").select(
        F.col("c_custkey").alias("user_id"),
        F.concat(F.lit("http://example.org/rules/"), F.col("c_nationkey").cast("string")).alias("rule_set"))
    facts = _max_events(spark, sf).join(customers, "user_id").withColumn("premise_p", F.lit(vocab.HAS_VALUE))
    return rules.match_rules(facts, _nation_rules(spark, sf)).select("event_id", "rule_id", "derived_o")


_CHAIN = ("c as (select c_custkey, case when c_acctbal > 0 then concat('http://example.org/rules/', c_nationkey) end loc "
          "from customer)")


def _rule_chain(spark, sf):
    customers = tables.load(spark, sf, "customer")
    profiles = customers.where("c_acctbal > 0").select(
        urls.owner_profile(F.concat(tables.user_url("c_custkey"), F.lit("hr/"))).alias("s"),
        F.lit(vocab.RULE_LOCATION).alias("p"),
        F.concat(F.lit("http://example.org/rules/"), F.col("c_nationkey").cast("string")).alias("o"))
    queries = customers.select("c_custkey", F.concat(tables.user_url("c_custkey"), F.lit("hr/")).alias("stream"))
    return rules.rules_for_streams(queries, profiles, _nation_rules(spark, sf))


@query(f"with {_CHAIN}, {_NATION_RULES} select c_custkey, rule_set, rule_id, '' as error from c join nr on rule_set = loc "
       "union all select c_custkey, null, null, 'rules not found' from c where loc is null")
def rules_for_stream(spark, sf):
    found, missing = _rule_chain(spark, sf)
    return found.select("c_custkey", "rule_set", "rule_id", F.lit("").alias("error")).unionByName(
        missing.select("c_custkey", "rule_set", F.lit(None).cast("string").alias("rule_id"), "error"))


_IS = vocab.EX + "is"


@query(f"select concat('{RES}', event_id) s, '{_IS}' p, case when value <= 6 then '{vocab.EX}sitting' "
       f"when value <= 14 then '{vocab.EX}standing' when value <= 30 then '{vocab.EX}lightActivity' when value <= 45 then "
       f"'{vocab.EX}slowWalking' when value <= 55 then '{vocab.EX}briskWalking' else '{vocab.EX}fastWalkingOrJogging' end o "
       "from events where event_type <> 'view' or value > 6")
def derivations_only(spark, sf):
    # Sitting viewers are already known as such, so that is no derivation.
    obs = tables.observations(spark, sf)
    known = obs.where("event_type = 'view' and value <= 6").select(
        F.col("resource_id").alias("s"), F.lit(_IS).alias("p"), F.lit(vocab.EX + "sitting").alias("o"))
    facts = graph_queries.event_triples(spark, sf).select("s", "p", "o").unionByName(known)
    made = rules.apply_thresholds(obs, tables.activity_rules()).select(
        F.col("resource_id").alias("s"), F.col("derived_p").alias("p"), F.col("derived_o").alias("o"))
    return rules.derivations(made, facts)


@query(f"with {graph_queries.T} select distinct s, p, s as o from t")
def rule_template(spark, sf):
    return rules.apply_template(graph_queries.event_triples(spark, sf),
                                rules.Template("swap", ("?s", "?p", "?o"), ("?s", "?p", "?s")))


CHAIN_RULES = [("sitting", "inactive"), ("standing", "inactive"), ("inactive", "needsReview"),
               ("needsReview", "notifyNurse"), ("briskWalking", "active"), ("active", "healthy")]
_CHAIN_SQL = ", ".join(f"('{vocab.EX}{a}', '{vocab.EX}{b}')" for a, b in CHAIN_RULES)


@query(f"with recursive ch(a, b) as (values {_CHAIN_SQL}), d(s, o) as (select concat('{RES}', event_id), "
       f"case when value <= 6 then '{vocab.EX}sitting' when value <= 14 then '{vocab.EX}standing' when value <= 30 then "
       f"'{vocab.EX}lightActivity' when value <= 45 then '{vocab.EX}slowWalking' when value <= 55 then "
       f"'{vocab.EX}briskWalking' else '{vocab.EX}fastWalkingOrJogging' end from events union "
       f"select d.s, ch.b from d join ch on ch.a = d.o) select s, '{_IS}' p, o from d")
def rule_fixpoint(spark, sf):
    chain = [rules.Template(f"c{i}", ("?s", _IS, vocab.EX + a), ("?s", _IS, vocab.EX + b))
             for i, (a, b) in enumerate(CHAIN_RULES)]
    return rules.fixpoint(graph_queries.event_triples(spark, sf), [*tables.activity_rules(), *chain])


@query("with recursive e as (select concat('c', c_custkey) a, concat('n', c_nationkey) b from customer union all "
       "select concat('s', s_suppkey), concat('n', s_nationkey) from supplier union all "
       "select concat('n', n_nationkey), concat('r', n_regionkey) from nation union all "
       "select concat('r', r_regionkey), 'world' from region), p(a, b) as (select * from e union select p.a, e.b from p "
       "join e on e.a = p.b) select a s, 'partOf' p, b o from p where not exists (select 1 from e where e.a = p.a and e.b = p.b)")
def rule_path_closure(spark, sf):
    def edge(table, a, x, b, y):
        df = tables.load(spark, sf, table)
        to = F.concat(F.lit(b), F.col(y).cast("string")) if y else F.lit(b)
        return df.select(F.concat(F.lit(a), F.col(x).cast("string")).alias("s"), F.lit("partOf").alias("p"), to.alias("o"))

    facts = edge("customer", "c", "c_custkey", "n", "c_nationkey").unionByName(
        edge("supplier", "s", "s_suppkey", "n", "s_nationkey")).unionByName(
        edge("nation", "n", "n_nationkey", "r", "n_regionkey")).unionByName(edge("region", "r", "r_regionkey", "world", None))
    return rules.fixpoint(facts, [rules.Path("part", "partOf", "partOf", "partOf")])


# --- discovery -----------------------------------------------------------------------------------

_K = "json_extract_string(props, '$.k')"


def _type_index(spark, sf):
    """Owner's index: each event describes a stream with its metric and a view."""
    ev = tables.load(spark, sf, "events")
    metric = F.concat("event_type", F.lit("-"), F.get_json_object("props", "$.k"))
    stream = F.concat(tables.user_url(), F.col("event_id").cast("string"), F.lit("/"))
    return ev.select(F.col("user_id").alias("owner"), F.col("event_id").alias("seq"), stream.alias("s"), F.explode(F.array(
        F.struct(F.lit(vocab.RELATES_TO).alias("p"), metric.alias("o")),
        F.struct(F.lit(vocab.TREE_VIEW).alias("p"), F.concat(stream, F.lit("view")).alias("o")))).alias("t")).select(
        "owner", "seq", "s", "t.*")


@query(f"select user_id owner, concat('{BASE}', user_id, '/', event_id, '/view') stream from events where user_id in ("
       f"select user_id from events where concat(event_type, '-', {_K}) in (select concat('click-', r_regionkey) from region))")
def stream_discovery(spark, sf):
    metrics = tables.load(spark, sf, "region").select(
        F.concat(F.lit("click-"), F.col("r_regionkey").cast("string")).alias("metric"))
    return discovery.relevant_streams(_type_index(spark, sf), metrics)


@query(f"with x as (select user_id, concat(event_type, '-', {_K}) metric, arg_min(event_id, event_id) e from events group by all), "
       "v as (select user_id, min(event_id) e from events group by 1), "
       "q as (select c_custkey, concat('click-', c_nationkey) metric from customer) "
       f"select q.c_custkey owner, q.metric, case when x.e is not null then concat('{BASE}', x.user_id, '/', x.e, '/') "
       f"when v.e is not null then concat('{BASE}', v.user_id, '/', v.e, '/view') end stream from q "
       "left join x on x.user_id = q.c_custkey and x.metric = q.metric left join v on v.user_id = q.c_custkey")
def stream_lookup(spark, sf):
    wanted = tables.load(spark, sf, "customer").select(
        F.col("c_custkey").alias("owner"), F.concat(F.lit("click-"), F.col("c_nationkey").cast("string")).alias("metric"))
    return discovery.lookup(_type_index(spark, sf), wanted)


@query("select c_custkey owner, case when c_acctbal > 0 then concat('http://example.org/index/', c_custkey) else '' end "
       "type_index from customer")
def type_index_of_owner(spark, sf):
    customers = tables.load(spark, sf, "customer")
    profile = customers.select(F.col("c_custkey").alias("owner"), F.when(
        F.col("c_acctbal") > 0, F.lit(discovery.TYPE_INDEX)).otherwise(F.lit(vocab.RULE_LOCATION)).alias("p"),
        F.concat(F.lit("http://example.org/index/"), F.col("c_custkey").cast("string")).alias("o"))
    return discovery.type_index_of(profile)


# --- notifications -------------------------------------------------------------------------------

def notifications(spark, sf):
    """A message per event; updates are not additions."""
    return tables.observations(spark, sf).select(
        "event_id", F.when(F.col("event_type") == "error", "Update").otherwise("Add").alias("type"),
        tables.stream_url().alias("target"), F.col("event_time").alias("published"))


@query(f"select event_id, concat('{BASE}', user_id, '/', event_type, '/') stream, "
       f"concat('{BASE}', user_id, '/derived/', event_type) derived from events where event_type <> 'error'")
def notification_filter(spark, sf):
    return live.added(notifications(spark, sf)).select("event_id", "stream", "derived")


@query("with recursive n as (select o_orderkey a, o_orderpriority p, "
       "lead(o_orderkey) over (partition by o_custkey order by o_orderdate, o_orderkey) b, "
       "lead(o_orderpriority) over (partition by o_custkey order by o_orderdate, o_orderkey) q from orders), "
       "k as (select a, b from n where b is not null and p = q), "
       "r as (select a, b from k union select r.a, k.b from r join k on r.b = k.a) "
       f"select concat('{vocab.EX}o', a) s, '{vocab.EX}runsTo' p, concat('{vocab.EX}o', b) o from r")
def rule_recursive_body(spark, sf):
    """A rule of three premises over its own conclusions: orders of one customer that follow each other with one priority."""
    line = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    orders = tables.load(spark, sf, "orders").withColumn("b", F.lead("o_orderkey").over(line))
    name = lambda c: F.concat(F.lit(vocab.EX + "o"), F.col(c).cast("string"))
    after = orders.where("b is not null").select(name("o_orderkey").alias("s"), F.lit("before").alias("p"), name("b").alias("o"))
    of = orders.select(name("o_orderkey").alias("s"), F.lit("priority").alias("p"), F.col("o_orderpriority").alias("o"))
    runs = vocab.EX + "runsTo"
    first = rules.Body("first", (("?a", "before", "?b"), ("?a", "priority", "?k"), ("?b", "priority", "?k")), ("?a", runs, "?b"))
    more = rules.Body("more", (("?a", runs, "?b"), ("?b", "before", "?c"), ("?b", "priority", "?k"), ("?c", "priority", "?k")), ("?a", runs, "?c"))
    return rules.fixpoint(after.unionByName(of), [first, more])
