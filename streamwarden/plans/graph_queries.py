"""Registered queries: triples, patterns, set operations, ordering, text formats."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import vocab
from ..functions import literals, query_text, times, urls
from ..operators import graph, ordering, patterns, skew
from ..session import spread
from ..sinks import storage
from ..sources import triples as source
from . import tables
from .registered import query

RES, PROP, BASE = tables.RESOURCE, tables.PROPERTY, tables.BASE
ISO = "strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ')"
# The three triples of an event, as SQL.
T = (
    f"t as (select concat('{RES}', event_id) s, '{vocab.HAS_VALUE}' p, cast(value as varchar) o, 'literal' o_kind, "
    f"'{vocab.XSD_FLOAT}' o_datatype, event_id, user_id, event_type, ts from events union all "
    f"select concat('{RES}', event_id), '{vocab.RELATES_TO}', concat('{PROP}', event_type), 'iri', null, "
    "event_id, user_id, event_type, ts from events union all "
    f"select concat('{RES}', event_id), '{vocab.HAS_TIMESTAMP}', {ISO}, 'literal', '{vocab.XSD_DATETIME}', "
    "event_id, user_id, event_type, ts from events)"
)


def event_triples(spark, sf):
    return source.observations_to_triples(tables.observations(spark, sf))


@query(f"with {T} select s, p, o, o_kind, o_datatype, (epoch_us(ts) // 1000) event_ms from t")
def triples_from_events(spark, sf):
    return event_triples(spark, sf).select("s", "p", "o", "o_kind", "o_datatype", tables.ms("event_time").alias("event_ms"))


@query(f"with {T} select s, o from t where p = '{vocab.RELATES_TO}' and o = '{PROP}click'")
def triple_pattern(spark, sf):
    return patterns.match(event_triples(spark, sf), p=vocab.RELATES_TO, o=PROP + "click").select("s", "o")


@query(f"select concat('{RES}', event_id) s, cast(value as varchar) v, concat('{PROP}', event_type) k from events")
def bgp_subject_join(spark, sf):
    return patterns.join(event_triples(spark, sf), [
        ("?s", vocab.HAS_VALUE, "?v"), ("?s", vocab.RELATES_TO, "?k")])


@query(f"select concat('{RES}', event_id) subject, concat('{BASE}', user_id, '/') stream, "
       f"concat('{PROP}', event_type) property, value, (epoch_us(ts) // 1000) event_ms from events")
def observation_pivot(spark, sf):
    out = patterns.observation_shape(event_triples(spark, sf))
    return out.select("subject", "stream", "property", "value", tables.ms("event_time").alias("event_ms"))


@query(f"select concat('{RES}', event_id) s, cast(value as varchar) v, "
       f"case when event_type = 'error' then {ISO} end \"at\" from events")
def bgp_optional(spark, sf):
    t = event_triples(spark, sf)
    values = patterns.bindings(t, ("?s", vocab.HAS_VALUE, "?v"))
    errors = patterns.join(t, [("?s", vocab.RELATES_TO, PROP + "error"), ("?s", vocab.HAS_TIMESTAMP, "?at")])
    return patterns.optional(values, errors)


@query(f"select concat('{RES}', event_id) s, cast(value as varchar) v from events where event_type <> 'error'")
def bgp_minus(spark, sf):
    t = event_triples(spark, sf)
    return patterns.minus(patterns.bindings(t, ("?s", vocab.HAS_VALUE, "?v")),
                          patterns.bindings(t, ("?s", vocab.RELATES_TO, PROP + "error")))


# --- text in and out ------------------------------------------------------------------------

def _documents(spark, sf):
    """One N-Triples document per event."""
    lines = event_triples(spark, sf).select("resource_id", "p", literals.triple_text().alias("line"))
    return lines.groupBy("resource_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "line"))), lambda x: x["line"]), "\n")
        .alias("body"))


@query(f"with {T} select s resource_id, s, 'iri' s_kind, p, o, o_kind, o_datatype from t")
def ntriples_roundtrip(spark, sf):
    good, _ = source.ntriples_ingest(_documents(spark, sf))
    return good.select("resource_id", "s", "s_kind", "p", "o", "o_kind", "o_datatype")


@query("with l as (select doc_id, unnest(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10))) line "
       "from documents) select doc_id, count(*) bad_lines, cast(sum(length(line)) as bigint) chars from l "
       "where trim(line, ' ') <> '' and not starts_with(trim(line, ' '), '#') group by doc_id")
def ntriples_quarantine(spark, sf):
    # Prose is no N-Triples: every line is set aside and none is lost.
    docs = spread(tables.load(spark, sf, "documents")).select("doc_id", F.col("text").alias("body"))
    _, bad = source.ntriples_ingest(docs)
    return bad.groupBy("doc_id").agg(F.count("*").alias("bad_lines"), F.sum(F.length("line")).alias("chars"))


@query("with p as (select case when page_id % 7 = 0 then 'not found' when page_id % 5 = 0 then 'wrong media type' "
       "when html is null or html = '' then 'empty' end reason from pages) "
       "select case when reason is null then 'good' else 'bad' end as state, coalesce(reason, '') reason, count(*) n from p group by all")
def tolerant_resource_read(spark, sf):
    pages = tables.load(spark, sf, "pages").select(
        "page_id", F.col("html").alias("body"),
        F.when(F.col("page_id") % 5 != 0, F.lit("text/turtle")).otherwise(F.lit("text/html")).alias("content_type"),
        F.when(F.col("page_id") % 7 != 0, F.lit(200)).otherwise(F.lit(404)).alias("status"))
    good, bad = source.tolerant_read(pages)
    return bad.groupBy("reason").agg(F.count("*").alias("n")).withColumn("state", F.lit("bad")).unionByName(
        good.agg(F.count("*").alias("n")).where("n > 0").withColumn("state", F.lit("good")).withColumn("reason", F.lit("")))


@query(f"select concat('{RES}', event_id) resource_id, concat('{PROP}', event_type) property, value, "
       "(epoch_us(ts) // 1000) event_ms from events")
def observation_ingest(spark, sf):
    good, _ = source.usable(source.observations_from_documents(_documents(spark, sf)))
    return good.select("resource_id", "property", "value", tables.ms("event_time").alias("event_ms"))


@query(f"with {T} select s, p, o, max((epoch_us(ts) // 1000)) event_ms from t group by s, p, o")
def resource_event_time(spark, sf):
    out = source.with_event_time(event_triples(spark, sf))
    return out.select("s", "p", "o", tables.ms("event_time").alias("event_ms"))


def _listing(spark, sf):
    """(user, made, event) and (event, about, property) triples with blank measurement nodes."""
    ev = tables.load(spark, sf, "events")
    lit = lambda v: F.lit(v).cast("string")

    def t(s, s_kind, p, o, o_kind, datatype=None):
        return F.struct(s.alias("s"), F.lit(s_kind).alias("s_kind"), F.lit(p).alias("p"), o.alias("o"),
                        F.lit(o_kind).alias("o_kind"), lit(datatype).alias("o_datatype"), lit(None).alias("o_lang"))

    event = F.concat(F.lit(RES), F.col("event_id").cast("string"))
    node = F.concat(F.lit("m"), F.col("event_id").cast("string"))
    return ev.select(F.explode(F.array(
        t(tables.user_url(), "iri", vocab.TREE_MEMBER, event, "iri"),
        t(tables.user_url(), "iri", vocab.RELATES_TO, F.concat(F.lit(PROP), "event_type"), "iri"),
        t(event, "iri", vocab.SAREF + "measurement", node, "blank"),
        t(node, "blank", vocab.HAS_VALUE, F.col("value").cast("string"), "literal", vocab.XSD_FLOAT),
    )).alias("t")).select("t.*")


@query(f"with a as (select distinct concat('{BASE}', user_id, '/') s, '{vocab.TREE_MEMBER}' p, "
       f"concat('ev:', 'e') q, concat('<{RES}', event_id, '>') o from events union all "
       f"select distinct concat('{BASE}', user_id, '/'), '{vocab.RELATES_TO}', '', "
       "concat('prop:', event_type) from events union all "
       f"select concat('{RES}', event_id), '{vocab.SAREF}measurement', '', "
       f"concat('[saref:hasValue \"', cast(value as varchar), '\"^^xsd:float]') from events), "
       "n as (select *, row_number() over (partition by s, p order by o) - 1 i from a) "
       "select s, p, i // 20 part, "
       f"concat('<', s, '> ', case p when '{vocab.TREE_MEMBER}' then 'tree:member' when '{vocab.RELATES_TO}' "
       "then 'saref:relatesToProperty' else 'saref:measurement' end, ' ', string_agg(o, ', ' order by o), ' .') as text "
       "from n group by s, p, i // 20")
def rdf_export(spark, sf):
    return storage.export(_listing(spark, sf), {
        "saref": vocab.SAREF, "tree": vocab.TREE, "prop": PROP, "xsd": "http://www.w3.org/2001/XMLSchema#"},
        objects_per_line=20)


@query("select concat('http://e/', c_custkey) s, 'http://e/m' p, 0::bigint part, concat('<http://e/', c_custkey, '> <http://e/m> "
       "[<http://e/v> \"', c_name, '\"] .') as text from customer")
def rdf_export_own_blanks(spark, sf):
    """Every document calls its blank node b0; none gets another's values."""
    docs = tables.load(spark, sf, "customer").select(
        F.concat(F.lit("http://e/"), F.col("c_custkey").cast("string")).alias("resource_id"),
        F.expr("concat('<http://e/', c_custkey, '> <http://e/m> _:b0 .\n_:b0 <http://e/v> \"', c_name, '\" .')").alias("body"))
    made, _ = source.ntriples_ingest(docs)
    return storage.export(made)


@query("select n_name prefix, concat('http://ns.example/', n_nationkey, '#') namespace from nation "
       "union all select '', 'http://ns.example/#'")
def prefix_table(spark, sf):
    nation = tables.load(spark, sf, "nation")
    none = F.lit(None).cast("string")
    rows = nation.select(
        F.concat(F.lit("http://ns.example/"), F.col("n_nationkey").cast("string"), F.lit("#")).alias("s"),
        F.explode(F.array(
            F.struct(F.lit(vocab.PREFIX_TERM).alias("p"), F.col("n_name").alias("o"),
                     F.lit("literal").alias("o_kind"), none.alias("o_lang")),
            F.struct(F.lit(vocab.PREFIX_TERM).alias("p"), F.lit("http://not/a/literal").alias("o"),
                     F.lit("iri").alias("o_kind"), none.alias("o_lang")),
            F.struct(F.lit(vocab.PREFIX_TERM).alias("p"), F.lit("tagged").alias("o"),
                     F.lit("literal").alias("o_kind"), F.lit("en").alias("o_lang")))).alias("t"),
    ).select("s", "t.*", none.alias("o_datatype"))
    return source.prefix_table(rows, "http://ns.example/")


# --- set operations --------------------------------------------------------------------------

@query(f"with {T} select distinct s, p, o from t where event_type in ('click', 'view') "
       f"union select s, p, o from t where event_type in ('view', 'error')")
def graph_union(spark, sf):
    t = event_triples(spark, sf).join(tables.load(spark, sf, "events").select(
        F.concat(F.lit(RES), F.col("event_id").cast("string")).alias("resource_id"), "event_type"), "resource_id")
    return graph.union(t.where(F.col("event_type").isin("click", "view")),
                       t.where(F.col("event_type").isin("view", "error"))).select("s", "p", "o")


_STATES = (f"g as (select distinct concat('{BASE}', user_id, '/') s, '{vocab.EX}is' p, event_type o from events), "
           f"d as (select distinct concat('{BASE}', c_custkey, '/') s, '{vocab.EX}is' p, 'error' o from customer "
           f"where c_acctbal > 0), i as (select distinct concat('{BASE}', c_custkey, '/') s, '{vocab.EX}is' p, 'view' o "
           "from customer)")


def _states(spark, sf):
    def t(df, s, o):
        return df.select(s.alias("s"), F.lit("iri").alias("s_kind"), F.lit(vocab.EX + "is").alias("p"), o.alias("o"),
                         F.lit("literal").alias("o_kind"), F.lit(None).cast("string").alias("o_datatype"),
                         F.lit(None).cast("string").alias("o_lang"))

    events, customers = tables.load(spark, sf, "events"), tables.load(spark, sf, "customer")
    url = tables.user_url("c_custkey")
    return (graph.dedup(t(events, tables.user_url(), F.col("event_type"))),
            t(customers.where("c_acctbal > 0"), url, F.lit("error")), t(customers, url, F.lit("view")))


@query(f"with {_STATES} (select * from g except select * from d) union select * from i")
def insert_delete_data(spark, sf):
    g, gone, new = _states(spark, sf)
    return graph.insert_data(graph.delete_data(g, gone), new).select("s", "p", "o")


@query(f"with {_STATES} select concat('DELETE DATA {{<', s, '> <', p, '> \"', o, '\" .', chr(10), '}}') as update from d")
def delete_texts(spark, sf):
    return graph.delete_text(_states(spark, sf)[1])


@query(f"with {T} select s, p, o, 1 n from t")
def quad_dedup(spark, sf):
    t = event_triples(spark, sf)
    once = graph.dedup(graph.union_streams(t, t), ["resource_id"])
    return once.groupBy("s", "p", "o").agg(F.count("*").cast("int").alias("n"))


@query(f"with {T} select s, p, o from t where p <> '{vocab.HAS_VALUE}'")
def container_metadata(spark, sf):
    t = event_triples(spark, sf).withColumn("p", F.when(F.col("p") == vocab.HAS_VALUE, vocab.LDP_CONTAINS).otherwise(F.col("p")))
    return patterns.container_metadata(t).select("s", "p", "o")


# --- order ----------------------------------------------------------------------------------

@query("select event_id, (epoch_us(ts) // 1000) event_ms from events order by ts, event_id limit 25")
def earliest_first(spark, sf):
    # A drain of the k earliest is the operator itself.
    return ordering.drain(tables.observations(spark, sf), 25, "event_time", "event_id").select(
        "event_id", tables.ms("event_time").alias("event_ms"))


@query("select user_id, arg_min(event_id, (ts, event_id)) event_id, (epoch_us(min(ts)) // 1000) event_ms from events group by user_id")
def peek_earliest(spark, sf):
    out = ordering.peek(tables.observations(spark, sf), "event_id", "event_time", "event_id", ["user_id"])
    return out.select("user_id", "event_id", tables.ms("event_time").alias("event_ms"))


@query("select user_id, event_type, arg_min(value, event_id) first_value, max(props) latest_name, count(*) size, "
       "false is_empty from events group by all")
def first_last_match(spark, sf):
    ev, by = tables.load(spark, sf, "events"), ["user_id", "event_type"]
    return (
        ordering.first_match(ev, by, "value", "event_id").withColumnRenamed("value", "first_value")
        .join(ordering.latest_name(ev, by, "props").withColumnRenamed("props", "latest_name"), by)
        .join(ordering.queue_state(ev, by), by))


@query("select event_id, row_number() over (order by ts, event_id) as rank from events")
def chronological_rank(spark, sf):
    out = skew.positions(tables.observations(spark, sf), [], ["event_time", "event_id"], "rank", limit=5000)
    return out.select("event_id", "rank")


@query("select p_brand, p_name, row_number() over (partition by p_brand order by p_name) as rank from "
       "(select distinct p_brand, p_name from part)")
def string_sort(spark, sf):
    part = tables.load(spark, sf, "part").select("p_brand", "p_name").distinct()
    return skew.positions(part, ["p_brand"], ["p_name"], "rank")


# --- URL and time functions over whole tables -----------------------------------------------------

@query(f"with x as (select event_id, user_id, event_type, concat('{BASE}', user_id, '/', event_type, '/') c, "
       f"concat('{BASE}', user_id, '/', event_type, '/', (epoch_us(ts) // 1000) // 1000, '/') t, (epoch_us(ts) // 1000) ms from events) "
       f"select event_id, c stream_of_target, concat('{BASE}', user_id, '/', event_type, '/derived/', ms // 1000) derived_item, "
       f"concat('{BASE}', user_id, '/derived/', event_type) derived_container, "
       f"concat('{BASE}', user_id, '/derived/', event_type) derived_resource, "
       f"concat('{BASE}', user_id, '/', event_type, '/', ms, '/') sibling, concat(c, ms, '/') child, ms // 1000 epoch, "
       f"concat('{BASE}', user_id, '/profile/card#me') profile, "
       f"'http://example.org' root, concat(c, ms // 1000, '/.meta') meta from x")
def derived_urls(spark, sf):
    obs = tables.observations(spark, sf)
    seconds = F.expr("div(unix_millis(event_time), 1000)").cast("string")
    x = obs.select("event_id", tables.stream_url().alias("c"), tables.ms("event_time").alias("ms"),
                   F.concat(tables.stream_url(), seconds, F.lit("/")).alias("t"))
    return x.select(
        "event_id", urls.stream_of_target("t").alias("stream_of_target"), urls.derived_target("t").alias("derived_item"),
        urls.derived_target("c").alias("derived_container"), urls.derived_resource("c").alias("derived_resource"),
        urls.sibling_bucket_url("t", F.col("ms")).alias("sibling"), urls.child_bucket_url("c", F.col("ms")).alias("child"),
        urls.bucket_epoch("t").alias("epoch"), urls.owner_profile("c").alias("profile"),
        urls.server_root("t").alias("root"), urls.container_meta("t").alias("meta"))


@query(f"select event_id, {ISO} iso, (epoch_us(ts) // 1000) back_ms, (epoch_us(ts) // 1000) - 180000 lookback_ms, "
       "(epoch_us(ts) // 1000) - epoch_ms(timestamp '2024-01-01') span_ms, md5(props) props_hash from "
       "(select event_id, ts, regexp_replace(props, '\\s', '', 'g') props from events)")
def time_functions(spark, sf):
    ev = tables.load(spark, sf, "events")
    iso = times.iso_utc("ts")
    return ev.select(
        "event_id", iso.alias("iso"), times.epoch_ms(iso).alias("back_ms"),
        times.ts_ms(times.lookback_start("ts", 180_000)).alias("lookback_ms"),
        times.span_ms(F.lit("2024-01-01").cast("timestamp"), "ts").alias("span_ms"),
        query_text.query_hash("props").alias("props_hash"))
