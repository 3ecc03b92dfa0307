"""Registered queries: query catalogue, registry, audit, access, delivery."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import vocab
from ..functions import query_text
from ..operators import access, discovery, registry, windows
from ..operators.windows import Agg
from ..session import scratch_path, spread
from ..sinks import annotation, audit, delivery
from . import storage_queries, tables
from .registered import query, win

BASE, PROP = tables.BASE, tables.PROPERTY
DAY = 24 * 3_600_000

# Query text of an order, in SQL that Spark and the check share. Names of variables,
# window and result differ in every text; what the query asks for does not.
_TEXT = (
    "concat('PREFIX saref: <https://saref.etsi.org/core/>', chr(10), 'PREFIX : <http://example.org/>', chr(10), "
    "'REGISTER ', case o_orderstatus when 'F' then 'RStream' when 'O' then 'IStream' else 'DStream' end, "
    "' <out', cast(o_orderkey as {s}), '> AS', chr(10), 'SELECT (', case substr(o_orderpriority, 1, 1) when '1' then 'AVG' "
    "when '2' then 'MAX' when '3' then 'MIN' when '4' then 'SUM' else 'COUNT' end, '(?v', cast(o_orderkey as {s}), "
    "') AS ?r', cast(o_orderkey as {s}), ')', chr(10), 'FROM NAMED WINDOW :w', cast(o_orderkey as {s}), ' ON STREAM <" + BASE
    + "', cast(o_custkey as {s}), '/> [RANGE 180000 STEP 30000]', chr(10), 'WHERE {{ WINDOW :w', cast(o_orderkey as {s}), "
    "' {{ ?s', cast(o_orderkey as {s}), ' saref:hasValue ?v', cast(o_orderkey as {s}), ' . ?s', cast(o_orderkey as {s}), "
    "' saref:relatesToProperty :heart .}} }}')"
)
Q = f"q as (select *, {_TEXT.format(s='varchar')} query_text from orders)"
HASH = "md5(regexp_replace(query_text, '\\s', '', 'g'))"


def registrations(spark, sf):
    """Every order registers a continuous query."""
    return spread(tables.load(spark, sf, "orders")).select(
        F.col("o_orderkey").alias("registration_id"), F.col("o_orderdate").alias("registered_at"),
        "o_custkey", "o_orderstatus", F.expr(_TEXT.format(s="string")).alias("query_text"))


@query(f"with {Q} select o_orderkey registration_id, {HASH} query_hash from q")
def query_hash(spark, sf):
    return registrations(spark, sf).select("registration_id", query_text.query_hash("query_text").alias("query_hash"))


@query(f"with {Q} select o_orderkey registration_id, {HASH} query_hash, case o_orderstatus when 'F' then 'RStream' "
       "when 'O' then 'IStream' else 'DStream' end r2s_operator, concat('out', o_orderkey) r2s_name, "
       f"concat('http://example.org/w', o_orderkey) window_name, concat('{BASE}', o_custkey, '/') stream, "
       "180000 width_ms, 30000 slide_ms, case substr(o_orderpriority, 1, 1) when '1' then 'avg' when '2' then 'max' "
       "when '3' then 'min' when '4' then 'sum' else 'count' end aggregate, concat('r', o_orderkey) projection_var from q")
def query_catalog_windows(spark, sf):
    out = query_text.catalog(registrations(spark, sf))
    return out.select("registration_id", "query_hash", "r2s_operator", "r2s_name", "aggregate", "projection_var",
                      F.explode("windows").alias("w")).select(
        "registration_id", "query_hash", "r2s_operator", "r2s_name", F.col("w.name").alias("window_name"),
        F.col("w.stream").alias("stream"), F.col("w.width_ms").alias("width_ms"), F.col("w.slide_ms").alias("slide_ms"),
        "aggregate", "projection_var")


@query(f"with {Q} select {HASH} query_hash, 'http://example.org/heart' focus from q")
def query_focus(spark, sf):
    cat = query_text.catalog(registrations(spark, sf))
    # Before an inner explode Spark tests the array in a filter of its own, for which the text would be read once more.
    patterns = cat.select("query_hash", F.explode_outer("patterns").alias("t")).select(
        "query_hash", F.regexp_replace("t.p", "^<|>$", "").alias("p"), F.regexp_replace("t.o", "^<|>$", "").alias("o"))
    return discovery.query_focus(patterns)


_CLASS = "partition by o_custkey, o_orderstatus, o_orderpriority"
_DUP = (f"d as (select *, first_value(o_orderkey) over ({_CLASS} order by o_orderdate, o_orderkey) f from q)")


def _checked(spark, sf):
    return registry.detect_duplicates(registrations(spark, sf))


SQL_OF_DUPLICATES = (f"with {Q}, {_DUP} select o_orderkey registration_id, f = o_orderkey is_unique, "
                     "case when f <> o_orderkey then f end equivalent_to from d")


@query(SQL_OF_DUPLICATES)
def duplicate_queries(spark, sf):
    return _checked(spark, sf).select("registration_id", "is_unique", "equivalent_to")


# Nine forms of a query, by order key; the two last say the same as the first, and only they are its duplicates.
_FORMS = 9
_FORM = (
    "concat(case o_orderkey % 9 when 8 then 'register RSTREAM <out' else 'REGISTER RStream <out' end, cast(o_orderkey as {s}), "
    "case o_orderkey % 9 when 8 then '> as select ' else '> AS SELECT ' end, "
    "case o_orderkey % 9 when 1 then '?s ' when 2 then '(COUNT(?v) AS ?n) ' else '' end, "
    "case o_orderkey % 9 when 3 then '(AVG(DISTINCT ?v) AS ?r)' when 7 then '(AVG(?x) AS ?y)' when 8 then '(avg(?v) as ?r)' "
    "else '(AVG(?v) AS ?r)' end, case o_orderkey % 9 when 8 then ' from named window' else ' FROM NAMED WINDOW' end, "
    "' <w> ON STREAM <" + BASE + "', cast(o_custkey as {s}), '/>  [RANGE 180000 STEP 30000] WHERE {{ WINDOW <w> {{ ', "
    "case o_orderkey % 9 when 7 then '?q <http://e/p> <http://e/heart> . ?q <http://e/v> ?x .' "
    "when 6 then '?s <http://e/v> ?v . OPTIONAL {{ ?s <http://e/p> <http://e/heart> }}' "
    "else '?s <http://e/v> ?v . ?s <http://e/p> <http://e/heart> .' end, ' }} ', "
    "case o_orderkey % 9 when 4 then 'FILTER(?v > 5) ' when 5 then 'FILTER(?v > 9) ' else '' end, '}}', "
    "case o_orderkey % 9 when 1 then ' GROUP BY ?s' else '' end)")


@query("with f as (select *, case when o_orderkey % 9 in (0, 7, 8) then 0 else o_orderkey % 9 end form from orders), "
       "d as (select *, first_value(o_orderkey) over (partition by o_custkey, form, case when form = 6 then o_orderkey end "
       "order by o_orderdate, o_orderkey) f from f) "
       "select o_orderkey registration_id, f = o_orderkey is_unique, case when f <> o_orderkey then f end equivalent_to from d")
def duplicate_query_forms(spark, sf):
    """Filters, grouping, further aggregates, DISTINCT and nested groups tell queries apart; names, order and case do not."""
    rows = spread(tables.load(spark, sf, "orders")).select(
        F.col("o_orderkey").alias("registration_id"), F.col("o_orderdate").alias("registered_at"),
        F.expr(_FORM.format(s="string")).alias("query_text"))
    return registry.detect_duplicates(rows).select("registration_id", "is_unique", "equivalent_to")


@query(f"with {Q}, {_DUP} select o_orderkey registration_id, 'duplicate_query' as status from d where f <> o_orderkey")
def duplicate_status(spark, sf):
    return delivery.duplicate_status(_checked(spark, sf)).select("registration_id", "status")


@query(f"with {Q}, {_DUP} select count(*) size from d where f = o_orderkey")
def executing_registry_size(spark, sf):
    return registry.size(registry.executing(_checked(spark, sf)))


@query("select o_orderkey registration_id from orders order by o_orderdate, o_orderkey limit 1 offset 44")
def registry_item(spark, sf):
    return registry.item(registrations(spark, sf), 44, ["registered_at", "registration_id"]).select("registration_id")


@query("select o_custkey item, o_orderkey seq from (select *, row_number() over (partition by o_custkey order by o_orderkey) r "
       "from orders) where r > 1 or o_custkey not in (select c_custkey from customer where c_acctbal < 0)")
def registry_remove(spark, sf):
    items = tables.load(spark, sf, "orders").select(F.col("o_custkey").alias("item"), F.col("o_orderkey").alias("seq"))
    gone = tables.load(spark, sf, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("item"))
    return registry.remove_first(items, gone, ["item"], ["seq"])


@query("select count(*) stored, 0::bigint left_after, 3::bigint columns from orders")
def registry_cleared(spark, sf):
    """A stored registry is emptied in place and read back."""
    path = scratch_path(spark, "registry")
    registrations(spark, sf).select("registration_id", "registered_at", "o_custkey").write.parquet(path)
    before = spark.read.parquet(path).count()
    after = registry.clear(spark, path)
    return after.agg(F.lit(before).alias("stored"), F.count("*").alias("left_after"),
                     F.lit(len(after.columns)).cast("long").alias("columns"))


@query(f"with {Q}, {_DUP}, r as (select l_orderkey, l_linenumber, l_partkey from lineitem join d on o_orderkey = l_orderkey "
       "where f = o_orderkey) select o_orderkey asked_by, l_orderkey registration_id, l_linenumber::int line, l_partkey part "
       "from d join r on r.l_orderkey = d.f")
def duplicate_gets_stored_results(spark, sf):
    """Only first registrations ran and stored results; a duplicate is answered from them."""
    checked = _checked(spark, sf)
    ran = registry.executing(checked).select("registration_id")
    results = tables.load(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("registration_id"), F.col("l_linenumber").cast("int").alias("line"),
        F.col("l_partkey").alias("part")).join(ran, "registration_id", "left_semi")
    return registry.answered(checked, results).select("asked_by", "registration_id", "line", "part")


@query(f"with {Q} select {HASH} query_hash, o_orderkey registration_id from q where o_orderstatus = 'F'")
def results_exist(spark, sf):
    regs = registrations(spark, sf).withColumn("query_hash", query_text.query_hash("query_text"))
    stored = regs.where("o_orderstatus = 'F'").select("query_hash")
    return registry.results_exist(regs, stored).select("query_hash", "registration_id")


# --- audit -----------------------------------------------------------------------------------------

_ENTRY = ("md5(regexp_replace(concat(query_text, epoch_ms(o_orderdate) - 180000, epoch_ms(o_orderdate)), '\\s', '', 'g'))")


def _entries(spark, sf):
    end = tables.ms("registered_at")
    return audit.registration_entries(
        _checked(spark, sf), "query_text", end - 180_000, end, F.concat(F.lit("user-"), F.col("o_custkey").cast("string")),
        "registered_at")


@query(f"with {Q}, {_DUP} select {_ENTRY} query_id, concat('user-', o_custkey) registered_by, "
       "epoch_ms(o_orderdate) registered_ms from d where f = o_orderkey")
def audit_entries(spark, sf):
    return _entries(spark, sf).select("query_id", "registered_by", tables.ms("registered_at").alias("registered_ms"))


_ACCESS = (f"a as (select {_ENTRY} query_id, f = o_orderkey u, l_suppkey, l_shipdate, l_partkey from d "
           "join lineitem on l_orderkey = o_orderkey)")


def _accesses(spark, sf):
    regs = registrations(spark, sf)
    end = tables.ms("registered_at")
    ids = regs.select("registration_id", query_text.registration_id(F.col("query_text"), end - 180_000, end).alias("query_id"))
    return tables.load(spark, sf, "lineitem").join(ids, F.col("l_orderkey") == F.col("registration_id")).select(
        "query_id", F.concat(F.lit("agent-"), F.col("l_suppkey").cast("string")).alias("user"),
        F.col("l_shipdate").alias("accessed_at"), F.col("l_partkey").cast("string").alias("data_accessed"))


@query(f"with {Q}, {_DUP}, {_ACCESS} select query_id, concat('agent-', l_suppkey) as user, epoch_ms(l_shipdate) accessed_ms, "
       "cast(l_partkey as varchar) data_accessed from a where u")
def audit_access_append(spark, sf):
    kept = audit.access_entries(_accesses(spark, sf), _entries(spark, sf))
    return kept.select("query_id", "user", tables.ms("accessed_at").alias("accessed_ms"), "data_accessed")


@query(f"with {Q}, {_DUP}, {_ACCESS}, g as (select query_id, count(*) n, min(epoch_ms(l_shipdate)) a0, "
       f"max(epoch_ms(l_shipdate)) a1 from a where u group by 1), e as (select {_ENTRY} query_id from d where f = o_orderkey) "
       "select e.query_id, coalesce(n, 0) accesses, a0 first_ms, a1 last_ms from e left join g using (query_id)")
def audit_with_access(spark, sf):
    entries = _entries(spark, sf)
    out = audit.with_access(entries, audit.access_entries(_accesses(spark, sf), entries))
    return out.select("query_id", "accesses", tables.ms("first_access").alias("first_ms"),
                      tables.ms("last_access").alias("last_ms"))


@query(f"with {Q}, {_DUP}, {_ACCESS}, e as (select {_ENTRY} query_id from d where f = o_orderkey) select e.query_id, "
       "coalesce(string_agg(case when l_shipdate is not null then concat(epoch_ms(l_shipdate), ':agent-', l_suppkey, ':', "
       "l_partkey) end, ',' order by l_shipdate, "
       "concat('agent-', l_suppkey), cast(l_partkey as varchar)), '') log from e left join (select * from a where u) a "
       "on a.query_id = e.query_id group by e.query_id")
def audit_nested_log(spark, sf):
    entries = _entries(spark, sf)
    out = audit.nested_log(entries, audit.access_entries(_accesses(spark, sf), entries))
    return out.select("query_id", F.coalesce(F.array_join(F.transform("access_log", lambda a: F.concat(
        F.unix_millis(a["accessed_at"].cast("timestamp")).cast("string"), F.lit(":"), a["user"], F.lit(":"),
        a["data_accessed"])), ","), F.lit("")).alias("log"))


# The constant part of a query's description, as (subject, predicate, object).
_X = "http://example.org/"
_EXEC, _FUN, _OUT = annotation.EXECUTION, annotation.FUNCTION, annotation.RESULTS
_PARAM = vocab.PARAMETER_BASE
_CONSTANT = [
    (_EXEC, vocab.RDF_TYPE, vocab.FNO + "Execution"), (_EXEC, vocab.FNO + "executes", _FUN),
    (_FUN, vocab.RDF_TYPE, vocab.FNO + "Function"), (_FUN, vocab.FNO + "name", "aggregation_function"),
    (_FUN, vocab.DCT_DESCRIPTION, "A function that executes an aggregation function on a RDF stream of data"),
    (_FUN, vocab.FNO_HTTP + "solves", annotation.PROBLEM), (_FUN, vocab.FNO_HTTP + "expects", _PARAM + "pod_url"),
    (_FUN, vocab.FNO_HTTP + "expects", _PARAM + "aggregation_query"),
    (_FUN, vocab.FNO_HTTP + "expects", _PARAM + "latest_minutes_to_monitor"),
    (_FUN, vocab.FNO_HTTP + "returns", _OUT), (_FUN, vocab.FNO_HTTP + "implements", annotation.IMPLEMENTATION),
    (_OUT, vocab.RDF_TYPE, vocab.FNO_HTTP + "OutputStream"), (_OUT, vocab.RDF_TYPE, vocab.SAO_STREAM_DATA),
    (_OUT, vocab.DCT_DESCRIPTION,
     "The stream of generated aggregation data that is the result of the aggregation function"),
    (annotation.PROBLEM, vocab.RDF_TYPE, vocab.FNO_HTTP + "Problem"),
    (_PARAM + "aggregation_query", vocab.RDF_TYPE, vocab.FNO_HTTP + "Parameter"),
]
_VARYING = [
    (f"'{_EXEC}'", vocab.RSP_STREAMS, f"concat('{BASE}', o_custkey, '/')"),
    (f"'{_EXEC}'", _X + "aggregation_start_time", "cast(epoch_ms(o_orderdate) - 180000 as varchar)"),
    (f"'{_EXEC}'", _X + "aggregation_end_time", "cast(epoch_ms(o_orderdate) as varchar)"),
    (f"'{_EXEC}'", _X + "last_execution_time", "cast(epoch_ms(o_orderdate) as varchar)"),
    (f"'{_EXEC}'", _X + "aggregation_query", "qi"), ("qi", vocab.RDF_TYPE, f"'{vocab.FNO_HTTP}Query'"),
    ("qi", "http://www.example.org/has_query_string", "query_text"),
    ("qi", "http://www.example.org/has_projection_variable", "concat('r', o_orderkey)"),
    ("qi", "http://www.example.org/has_window_name", "concat('http://example.org/w', o_orderkey)"),
    ("qi", "http://www.example.org/has_window_size", "'180000'"),
    ("qi", "http://www.example.org/has_window_slide", "'30000'"),
    ("qi", "http://www.example.org/has_focus", "'http://example.org/heart'"),
]
_ROWS = ", ".join([f"{{'s': '{s}', 'p': '{p}', 'o': '{o}'}}" for s, p, o in _CONSTANT]
                  + [f"{{'s': {s}, 'p': '{p}', 'o': {o}}}" for s, p, o in _VARYING])


@query(f"with {Q}, h as (select *, {HASH} query_hash, concat('{annotation.QUERY_BASE}', {HASH}) qi from q), "
       f"u as (select query_hash, unnest([{_ROWS}]) t from h) select query_hash, t.s s, t.p p, t.o o from u")
def annotation_rows(spark, sf):
    cat = query_text.catalog(registrations(spark, sf))
    end = F.unix_millis(F.col("registered_at").cast("timestamp"))
    with_times = cat.withColumn("_end", end)
    out = annotation.describe(with_times, F.col("_end") - 180_000, F.col("_end"), F.col("_end"))
    return out.select("query_hash", "s", "p", "o")


# --- access ----------------------------------------------------------------------------------------

_NOTE = (f"n as (select event_id, concat('{BASE}', user_id, '/derived/', event_type) derived from events "
         "where event_type <> 'error')")
_GRANT = (f"g as (select distinct concat('{BASE}', c_custkey, '/derived/', t.event_type) r from customer, "
          "(select distinct event_type from events) t where c_acctbal >= 3000 or (c_acctbal >= 0 and t.event_type = 'view'))")


def _grants(spark, sf):
    kinds = ["click", "view", "signup", "purchase", "error"]
    rich = F.array(*[F.lit(k) for k in kinds])
    return tables.load(spark, sf, "customer").select("c_custkey", F.explode(
        F.when(F.col("c_acctbal") >= 3000, rich).when(F.col("c_acctbal") >= 0, F.array(F.lit("view")))).alias("kind")).select(
        F.concat(tables.user_url("c_custkey"), F.lit("derived/"), "kind").alias("resource"), F.lit("monitor").alias("agent"))


def _added(spark, sf):
    return storage_queries.live.added(storage_queries.notifications(spark, sf))


@query(f"with {_NOTE}, {_GRANT} select event_id, derived from n where derived in (select r from g)")
def access_gate(spark, sf):
    return access.granted(_added(spark, sf), _grants(spark, sf)).select("event_id", "derived")


@query(f"with {_NOTE}, {_GRANT} select event_id, derived from n where derived not in (select r from g)")
def access_rejected(spark, sf):
    return access.rejected(_added(spark, sf), _grants(spark, sf)).select("event_id", "derived")


@query("select o_orderkey request_id, coalesce(c_acctbal >= 0 and substr(o_orderpriority, 1, 1) <> '5' and "
       "c_mktsegment = case substr(o_orderpriority, 1, 1) when '1' then 'BUILDING' when '2' then 'FURNITURE' "
       "when '3' then 'MACHINERY' else 'AUTOMOBILE' end and (o_orderstatus = 'F') = (c_nationkey < 12), false) granted "
       "from orders left join customer on c_custkey = o_custkey")
def policy_decision(spark, sf):
    agent = F.lit("http://example.org/monitor/card#me")
    customers, orders = tables.load(spark, sf, "customer"), tables.load(spark, sf, "orders")

    def constraint(left, right):
        return F.struct(F.lit(left).alias("left"), F.lit("eq").alias("op"), right.alias("right"))

    policies = customers.select(
        tables.user_url("c_custkey").alias("target"), F.concat(tables.user_url("c_custkey"), F.lit("card#me")).alias("assigner"),
        agent.alias("assignee"), F.when(F.col("c_acctbal") >= 0, "read").otherwise("write").alias("action"),
        F.array(constraint(vocab.ODRL_PURPOSE, F.col("c_mktsegment")),
                constraint(vocab.LEGAL_BASIS, F.when(F.col("c_nationkey") < 12, "A9-2-a").otherwise("A6-1-a"))
                ).alias("constraints"))
    first = F.substring("o_orderpriority", 1, 1)
    purpose = F.when(first == "1", "BUILDING").when(first == "2", "FURNITURE").when(first == "3", "MACHINERY").otherwise(
        "AUTOMOBILE")
    basis = F.when(F.col("o_orderstatus") == "F", "A9-2-a").otherwise("A6-1-a")
    # Requests of the lowest priority come without a purpose.
    claims = F.when(first == "5", F.create_map(F.lit(vocab.LEGAL_BASIS), basis)).otherwise(
        F.create_map(F.lit(vocab.ODRL_PURPOSE), purpose, F.lit(vocab.LEGAL_BASIS), basis))
    requests = orders.select(
        F.col("o_orderkey").alias("request_id"), tables.user_url("o_custkey").alias("target"),
        F.concat(tables.user_url("o_custkey"), F.lit("card#me")).alias("assigner"), agent.alias("assignee"),
        F.lit("read").alias("action"), claims.alias("claims"))
    return access.decide(requests, policies).select("request_id", "granted")


@query(f"select distinct concat('{BASE}', user_id, '/') stream, c_mktsegment config from events left join customer "
       "on c_custkey = user_id and c_acctbal > 0")
def stream_config_lookup(spark, sf):
    streams = tables.observations(spark, sf).select("stream").distinct()
    config = tables.load(spark, sf, "customer").where("c_acctbal > 0").select(
        tables.user_url("c_custkey").alias("stream"), F.col("c_mktsegment").alias("config"))
    return access.with_config(streams, config)


# --- delivery --------------------------------------------------------------------------------------

_DAILY = f"{win(DAY, DAY)}, r as (select md5(concat('{BASE}', user_id, '/')) query_hash, ws, max(value) v from w group by all)"
_SUBS = (f"s as (select distinct md5(concat('{BASE}', o_custkey, '/')) query_hash, concat('client-', o_orderkey) subscriber "
         "from orders where o_orderstatus = 'O')")


def _results(spark, sf):
    daily = windows.sliding(tables.observations(spark, sf), "event_time", DAY, DAY, [Agg("max", "value", "payload")], ["stream"])
    return daily.select(F.md5("stream").alias("query_hash"), tables.ms("window_start").alias("window_start_ms"), "payload")


def _subscriptions(spark, sf):
    return tables.load(spark, sf, "orders").where("o_orderstatus = 'O'").select(
        F.md5(tables.user_url("o_custkey")).alias("query_hash"),
        F.concat(F.lit("client-"), F.col("o_orderkey").cast("string")).alias("subscriber"))


@query(f"with {_DAILY}, {_SUBS} select query_hash, subscriber, ws window_start_ms, v payload from r join s using (query_hash)")
def result_fanout(spark, sf):
    return delivery.fan_out(_results(spark, sf), _subscriptions(spark, sf)).select(
        "query_hash", "subscriber", "window_start_ms", "payload")


@query(f"with {_DAILY}, {_SUBS} select query_hash, ws window_start_ms from r where query_hash not in (select query_hash from s)")
def result_unmatched(spark, sf):
    return delivery.unmatched(_results(spark, sf), _subscriptions(spark, sf)).select("query_hash", "window_start_ms")


@query(f"with {_SUBS}, p as (select *, (row_number() over (partition by query_hash order by subscriber) - 1) // 4 part from s) "
       "select query_hash, part, string_agg(subscriber, ',' order by subscriber) subscribers from p group by 1, 2")
def subscriber_lists(spark, sf):
    return delivery.subscriber_lists(_subscriptions(spark, sf), per_row=4).select(
        "query_hash", "part", F.array_join("subscribers", ",").alias("subscribers"))


@query(f"select concat('{BASE}', user_id, '/') stream, count(*) members, 'stream_reader_ended' as status from events group by 1")
def status_rows(spark, sf):
    return delivery.reader_ended(tables.observations(spark, sf))
