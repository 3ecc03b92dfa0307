"""Registered queries: windows, emit modes, window joins, continuous queries."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from .. import vocab
from ..operators import events, ranges, rules, windows
from ..operators.windows import Agg
from ..sources import triples as triple_source
from . import tables, templates
from .continuous import ContinuousQuery, WindowSpec
from .registered import HOUR, MINUTE, query, win

R, S = 60 * MINUTE, 20 * MINUTE


def bounds() -> list:
    return [tables.ms("window_start").alias("window_start_ms"), tables.ms("window_end").alias("window_end_ms")]


def _sliding(spark, sf, range_ms, step_ms, aggs, by=("event_type",), run=windows.windowed):
    out = run(tables.observations(spark, sf), "event_time", range_ms, step_ms, aggs, list(by))
    return out.select(*bounds(), *by, *[a.alias for a in aggs])


def _sql(range_ms, step_ms, select, by="event_type"):
    return (f"with {win(range_ms, step_ms)} select ws window_start_ms, we window_end_ms, {by}, {select} "
            f"from w group by ws, we, {by}")


@query(_sql(R, S, "avg(cents) avg_cents"))
def window_avg_sliding(spark, sf):
    return _sliding(spark, sf, R, S, [Agg("avg", "cents", "avg_cents")])


@query(_sql(180_000, 30_000, "max(value) max_value"))
def window_max_sliding(spark, sf):
    return _sliding(spark, sf, 180_000, 30_000, [Agg("max", "value", "max_value")])


@query(_sql(180_000, 30_000, "min(value) min_value", "event_type, user_id"))
def window_min_sliding(spark, sf):
    return _sliding(spark, sf, 180_000, 30_000, [Agg("min", "value", "min_value")], ("event_type", "user_id"))


@query(_sql(800, 100, "avg(cents) avg_cents"))
def window_avg_overlap_8(spark, sf):
    return _sliding(spark, sf, 800, 100, [Agg("avg", "cents", "avg_cents")])


@query(_sql(R, R, "count(*) n, cast(sum(cents) as bigint) sum_cents, count(distinct user_id) users, "
            "min(user_id) sample_user, string_agg(cast(event_id as varchar), ' ' order by cast(event_id as varchar)) "
            "event_ids") + " having count(*) > 1")
def window_count_sum_tumbling(spark, sf):
    aggs = [Agg("count", "*", "n"), Agg("sum", "cents", "sum_cents"), Agg("count_distinct", "user_id", "users"),
            Agg("sample", "user_id", "sample_user"), Agg("group_concat", "event_id", "event_ids")]
    return _sliding(spark, sf, R, R, aggs).where("n > 1")


_FIVE = [Agg("avg", "cents", "avg_cents"), Agg("count", "cents", "n"), Agg("sum", "cents", "sum_cents"),
         Agg("min", "value", "min_value"), Agg("max", "value", "max_value")]
_FIVE_SQL = ("avg(cents) avg_cents, count(cents) n, cast(sum(cents) as bigint) sum_cents, "
             "min(value) min_value, max(value) max_value")


@query(_sql(R, S, _FIVE_SQL))
def window_avg_panes(spark, sf):
    return _sliding(spark, sf, R, S, _FIVE, run=windows.windowed_by_panes)


@query(_sql(9000 * 288_000, 288_000, _FIVE_SQL))
def window_panes_overlap_9000(spark, sf):
    return _sliding(spark, sf, 9000 * 288_000, 288_000, _FIVE, run=windows.sliding)


@query(f"with e as (select *, epoch_us(ts) u from events) select (u // 1200000000) * 1200000 window_start_ms, "
       f"(u // 1200000000) * 1200000 + 300000 window_end_ms, event_type, count(*) n from e "
       f"where u % 1200000000 < 300000000 group by all")
def window_range_below_step(spark, sf):
    rows = windows.assign(tables.observations(spark, sf), "event_time", 300_000, 1_200_000)
    return rows.groupBy("window_start", "window_end", "event_type").agg(F.count("*").alias("n")).select(
        *bounds(), "event_type", "n")


@query("with e as (select *, epoch_us(ts) u from events), w as (select e.*, "
       "((u + 1000000000) // 1200000000 - g) * 1200000 - 1000000 ws from e, range(3) t(g)) "
       "select ws window_start_ms, ws + 3400000 window_end_ms, event_type, count(*) n from w "
       "where (ws + 3400000) * 1000 > u group by all")
def window_aligned_ends(spark, sf):
    # 3 400 s over 1 200 s steps: ends, not starts, are multiples of the step.
    out = windows.windowed(tables.observations(spark, sf), "event_time", 3_400_000, 1_200_000,
                           [Agg("count", "*", "n")], ["event_type"], align_end=True)
    return out.select(*bounds(), "event_type", "n")


_ROWS = f"with {win(R, S)}, r as (select distinct ws, we, user_id from w) "


@query(_ROWS + "select ws window_start_ms, we window_end_ms, user_id from r")
def rstream_multi_user(spark, sf):
    obs = tables.observations(spark, sf)
    return windows.rstream(obs, "event_time", R, S, ["user_id"]).select(*bounds(), "user_id")


@query(_ROWS + f"select ws window_start_ms, we window_end_ms, user_id from r where not exists "
       f"(select 1 from r q where q.user_id = r.user_id and q.ws = r.ws - {S})")
def istream_delta(spark, sf):
    return windows.istream(tables.observations(spark, sf), "event_time", R, S, ["user_id"]).select(*bounds(), "user_id")


@query(_ROWS + f"select ws + {S} window_start_ms, we + {S} window_end_ms, user_id from r where not exists "
       f"(select 1 from r q where q.user_id = r.user_id and q.ws = r.ws + {S})")
def dstream_delta(spark, sf):
    return windows.dstream(tables.observations(spark, sf), "event_time", R, S, ["user_id"]).select(*bounds(), "user_id")


_MAXES = f"with {win(R, S)}, r as (select ws, we, event_type, max(cents) m from w group by all) "


@query(_MAXES + f"select ws window_start_ms, we window_end_ms, event_type, m max_cents from r where not exists "
       f"(select 1 from r q where q.event_type = r.event_type and q.m = r.m and q.ws = r.ws - {S})")
def istream_of_results(spark, sf):
    obs = tables.observations(spark, sf)
    results = windows.windowed(obs, "event_time", R, S, [Agg("max", "cents", "max_cents")], ["event_type"])
    return windows.result_delta(results, S, ["event_type", "max_cents"], "IStream").select(
        *bounds(), "event_type", "max_cents")


def _side(kind: str) -> str:
    return f"select distinct ws, we, user_id, cast(floor(value) as bigint) o from w where event_type = '{kind}'"


@query(f"with {win(48 * HOUR, 12 * HOUR)}, a as ({_side('click')}), b as ({_side('view')}) "
       "select a.ws window_start_ms, a.we window_end_ms, avg(o) avg_o, count(*) solutions "
       "from a join b using (ws, we, user_id, o) group by a.ws, a.we")
def multi_window_join(spark, sf):
    obs = tables.observations(spark, sf).withColumn("o", F.floor("value"))
    frame = (48 * HOUR, 12 * HOUR)
    both = windows.window_join(obs.where("event_type = 'click'"), obs.where("event_type = 'view'"),
                               ["user_id", "o"], "event_time", frame, frame)
    return both.groupBy("window_start", "window_end").agg(
        F.avg("o").alias("avg_o"), F.count("*").alias("solutions")).select(*bounds(), "avg_o", "solutions")


@query(f"with {win(48 * HOUR, 12 * HOUR)}, a as ({_side('click')}), "
       "x as (select *, epoch_us(ts) u from events), "
       "b as (select distinct ((u // 43200000000) - g) * 43200000 + 86400000 we, user_id, "
       "cast(floor(value) as bigint) o from x, range(2) t(g) where event_type = 'view') "
       "select a.ws window_start_ms, a.we window_end_ms, a.user_id, a.o from a join b using (we, user_id, o)")
def multi_window_join_unequal(spark, sf):
    # Windows of different length meet where they end together.
    obs = tables.observations(spark, sf).withColumn("o", F.floor("value"))
    both = windows.window_join(obs.where("event_type = 'click'"), obs.where("event_type = 'view'"),
                               ["user_id", "o"], "event_time", (48 * HOUR, 12 * HOUR), (24 * HOUR, 12 * HOUR))
    return both.select(*bounds(), "user_id", "o")


# --- the flagship: windows -> events -> rules -> alerts -------------------------------------

def _averages(spark, sf):
    out = windows.sliding(tables.observations(spark, sf), "event_time", R, S,
                          [Agg("avg", "cents", "_avg")], ["user_id", "event_type"])
    return out.withColumn("value", F.col("_avg") / 100)


_CLASS = ("case when value <= 6 then 'sitting' when value <= 14 then 'standing' when value <= 30 then 'lightActivity' "
          "when value <= 45 then 'slowWalking' when value <= 55 then 'briskWalking' else 'fastWalkingOrJogging' end")
_AVERAGES_SQL = (f"with {win(R, S)}, r as (select ws, we, user_id, event_type, avg(cents) / 100 as value "
                 "from w group by all) ")
_ID = "md5(concat_ws('|', '{q}', strftime(make_timestamp(ws * 1000), '%Y-%m-%dT%H:%M:%S.%gZ'), " \
      "strftime(make_timestamp(we * 1000), '%Y-%m-%dT%H:%M:%S.%gZ'), user_id, event_type))"
ALERT_QUERY = "activity-by-user"


@query(_AVERAGES_SQL + f"select {_ID.format(q=ALERT_QUERY)} event_id, ws window_start_ms, we window_end_ms, "
       f"user_id, event_type, value, '{vocab.EX}is' derived_p, concat('{vocab.EX}', {_CLASS}) derived_o from r")
def activity_rules(spark, sf):
    return activity_alerts(_averages(spark, sf)).select(
        "event_id", *bounds(), "user_id", "event_type", "value", "derived_p", "derived_o")


def activity_alerts(results):
    """Averages per window to events to derived activity."""
    made = events.construct(results, F.lit(ALERT_QUERY), "value", F.array(tables.stream_url()),
                            F.col("window_end"), by=["user_id", "event_type"])
    return rules.apply_thresholds(made, tables.activity_rules())


# --- user queries and named templates --------------------------------------------------------

def user_query(emit: str = "RStream", **options) -> ContinuousQuery:
    w = WindowSpec("http://example.org/w1", "http://example.org/streams/all/", R, S)
    return ContinuousQuery(
        "output", (w,), ((w.name, "?s", vocab.HAS_VALUE, "?o"), (w.name, "?s", vocab.RELATES_TO, "?k")),
        (Agg("max", "o", "max_o"), Agg("count", "o", "n")), group_by=("k",), filters=("?o > 5.0",), having="?n >= 2",
        emit=emit, **options)


def _one_stream(spark, sf):
    return tables.observations(spark, sf).withColumn("stream", F.lit("http://example.org/streams/all/"))


_USER_SQL = (f"with {win(R, S)}, r as (select ws, we, concat('{tables.PROPERTY}', event_type) k, max(value) max_o, "
             "count(*) n from w where value > 5.0 group by all having count(*) >= 2) ")


@query(_USER_SQL + "select ws window_start_ms, we window_end_ms, k, max_o, n from r")
def continuous_query_table(spark, sf):
    return user_query().over_observations(_one_stream(spark, sf)).select(*bounds(), "k", "max_o", "n")


@query(_USER_SQL + "select ws window_start_ms, we window_end_ms, k, max_o, n from r")
def continuous_query_triples(spark, sf):
    triples = triple_source.observations_to_triples(_one_stream(spark, sf))
    return user_query().over_triples(triples, own_documents=True).select(*bounds(), "k", "max_o", "n")


@query(f"with {win(R, S)}, a as (select distinct ws, we, user_id, value from w where event_type = 'click'), "
       "b as (select distinct ws, we, user_id from w where event_type = 'view') "
       "select ws window_start_ms, we window_end_ms, max(value) max_o, count(*) n from a join b using (ws, we, user_id) group by all")
def continuous_query_across_documents(spark, sf):
    """A value in one document and a property of the same subject in another, at any times of one window."""
    events = _one_stream(spark, sf)
    user = F.concat(F.lit("http://example.org/user/"), F.col("user_id").cast("string"))
    stated = events.where("event_type in ('click', 'view')").select(
        "stream", "event_time", user.alias("s"),
        F.when(F.col("event_type") == "click", F.lit(vocab.HAS_VALUE)).otherwise(F.lit(vocab.RELATES_TO)).alias("p"),
        F.when(F.col("event_type") == "click", F.col("value").cast("string")).otherwise(F.lit("seen")).alias("o"))
    w = WindowSpec("http://example.org/w1", "http://example.org/streams/all/", R, S)
    q = ContinuousQuery("across", (w,), ((w.name, "?s", vocab.HAS_VALUE, "?o"), (w.name, "?s", vocab.RELATES_TO, "seen")),
                        (Agg("max", "o", "max_o"), Agg("count", "o", "n")))
    return q.over_triples(stated).select(*bounds(), "max_o", "n")


_GAPPED = (f"with e as (select *, (epoch_us(ts) // {2 * R * 1000}) * {2 * R} ws, round(value * 100)::bigint cents, epoch_us(ts) u "
           f"from events), w as (select *, ws + {S} we from e where u < (ws + {S}) * 1000) ")


@query(_GAPPED + "select ws window_start_ms, we window_end_ms, event_type, avg(cents) avg_cents, count(*) n from w group by all")
def window_avg_gapped(spark, sf):
    """RANGE below STEP: rows between two windows belong to none."""
    aggs = [Agg("avg", "cents", "avg_cents"), Agg("count", "*", "n")]
    out = windows.sliding(tables.observations(spark, sf), "event_time", S, 2 * R, aggs, ["event_type"])
    return out.select(*bounds(), "event_type", "avg_cents", "n")


@query(_USER_SQL + f"select ws window_start_ms, we window_end_ms, k, max_o, n from r where not exists (select 1 "
       f"from r q where q.k = r.k and q.max_o = r.max_o and q.n = r.n and q.ws = r.ws - {S})")
def continuous_query_istream(spark, sf):
    return user_query("IStream").over_observations(_one_stream(spark, sf)).select(*bounds(), "k", "max_o", "n")


_FROM, _TO = datetime(2024, 1, 1), datetime(2024, 1, 31)


def _participant_streams(spark, sf):
    obs = tables.observations(spark, sf)
    # Two patients' streams, split by the property the template asks for.
    number = F.when(F.col("event_type").isin("click", "view"), F.lit("1")).otherwise(F.lit("2"))
    return obs.withColumn("stream", F.concat(F.lit("http://localhost:3000/dataset_participant"), number, F.lit("/data/"))) \
        .withColumn("property", F.lit(templates.BVP)).withColumn("value", F.col("cents")) \
        .withColumn("resource_id", F.concat(F.lit("http://example.org/user/"), F.col("user_id").cast("string")))


_SPAN, _STEP = 30 * 24 * HOUR, 24 * HOUR


@query(f"with {win(_SPAN, _STEP)} select ws window_start_ms, we window_end_ms, "
       'avg(cents) "averageHR1" from w where event_type in (\'click\', \'view\') group by ws, we')
def template_patient_1(spark, sf):
    out = templates.run_named("averageHRPatient1", _participant_streams(spark, sf), _FROM, _TO, step_ms=_STEP)
    return out.select(*bounds(), "averageHR1")


@query(f"with {win(_SPAN, _STEP)} select ws window_start_ms, we window_end_ms, "
       'avg(cents) "averageHR2" from w where event_type not in (\'click\', \'view\') group by ws, we')
def template_patient_2(spark, sf):
    out = templates.run_named("averageHRPatient2", _participant_streams(spark, sf), _FROM, _TO, step_ms=_STEP)
    return out.select(*bounds(), "averageHR2")


# The templates at their own STEP, over the history of one hour: 180 000 windows overlap.
_HOUR_FROM, _HOUR_TO = datetime(2024, 1, 15), datetime(2024, 1, 15, 1)
_HOUR_SQL = (f"with h as (select * from events where ts >= timestamp '{_HOUR_FROM}' and ts < timestamp '{_HOUR_TO}'), "
             f"{win(HOUR, templates.STEP_MS, 'h')} select ws window_start_ms, we window_end_ms, ")


def _own_step(spark, sf, name):
    history = _participant_streams(spark, sf).where((F.col("event_time") >= F.lit(str(_HOUR_FROM)).cast("timestamp")) & (F.col("event_time") < F.lit(str(_HOUR_TO)).cast("timestamp")))
    return templates.run_named(name, history, _HOUR_FROM, _HOUR_TO)


@query(_HOUR_SQL + 'avg(cents) "averageHR1" from w where event_type in (\'click\', \'view\') group by ws, we')
def template_patient_1_own_step(spark, sf):
    return _own_step(spark, sf, "averageHRPatient1").select(*bounds(), "averageHR1")


@query(_HOUR_SQL + 'avg(cents) "averageHR2" from w where event_type not in (\'click\', \'view\') group by ws, we')
def template_patient_2_own_step(spark, sf):
    return _own_step(spark, sf, "averageHRPatient2").select(*bounds(), "averageHR2")


@query(f"with {win(_SPAN, _STEP)}, "
       "a as (select distinct ws, we, user_id, cents from w where event_type in ('click', 'view')), "
       "b as (select distinct ws, we, user_id, cents from w where event_type not in ('click', 'view')) "
       'select ws window_start_ms, we window_end_ms, avg(cents) "averageHR1" '
       "from a join b using (ws, we, user_id, cents) group by ws, we")
def template_patients_joined(spark, sf):
    out = templates.run_named("averageHRPatientMultiple", _participant_streams(spark, sf), _FROM, _TO, step_ms=_STEP)
    return out.select(*bounds(), "averageHR1")


def _coarse_streams(spark, sf):
    """Both patients' streams with few subjects and values, so that they agree now and then."""
    obs = _participant_streams(spark, sf)
    return obs.withColumn("resource_id", F.concat(F.lit("http://example.org/user/"), F.pmod("user_id", F.lit(7)).cast("string"))) \
        .withColumn("value", F.expr("cents div 2000"))


_JOINED_FROM, _JOINED_TO = datetime(2024, 1, 15), datetime(2024, 1, 15, 1)
_COARSE = "user_id % 7 s, cast(round(value * 100) as bigint) // 2000 o"


@query(f"with h as (select * from events where ts >= timestamp '{_JOINED_FROM}' and ts < timestamp '{_JOINED_TO}'), "
       f"{win(HOUR, templates.STEP_MS, 'h')}, "
       f"a as (select distinct ws, we, {_COARSE} from w where event_type in ('click', 'view')), "
       f"b as (select distinct ws, we, {_COARSE} from w where event_type not in ('click', 'view')) "
       'select ws window_start_ms, we window_end_ms, avg(o) "averageHR1" from a join b using (ws, we, s, o) group by ws, we')
def template_patients_joined_own_step(spark, sf):
    """The template over two patients at its own STEP: 180 000 windows overlap."""
    history = _coarse_streams(spark, sf).where((F.col("event_time") >= F.lit(str(_JOINED_FROM)).cast("timestamp"))
                                               & (F.col("event_time") < F.lit(str(_JOINED_TO)).cast("timestamp")))
    return templates.run_named("averageHRPatientMultiple", history, _JOINED_FROM, _JOINED_TO).select(*bounds(), "averageHR1")


@query(f"with {win(30 * 24 * HOUR, 288_000)}, "
       "a as (select distinct ws, we, user_id % 50 u from w where event_type = 'click'), "
       "b as (select distinct ws, we, user_id % 50 u from w where event_type = 'error') "
       "select ws window_start_ms, we window_end_ms, sum(u)::bigint total, count(*) solutions from a join b using (ws, we, u) group by all")
def multi_window_join_overlap_9000(spark, sf):
    """Two windows of all events, each in 9 000 windows."""
    obs = tables.observations(spark, sf).withColumn("u", F.pmod("user_id", F.lit(50)))
    frame = (30 * 24 * HOUR, 288_000)
    found, grid = ranges.joined([(obs.where(F.col("event_type") == kind).select("event_time", "u"), "event_time")
                                 for kind in ("click", "error")], [frame, frame])
    sums = ranges.aggregated(found, [], [Agg("sum", "u", "total"), Agg("count", "*", "solutions")], 9000)
    return ranges.expanded(sums, grid, ["total", "solutions"]).select(*bounds(), "total", "solutions")


@query(f"with r as (select * from events where event_type = 'error'), {win(9000 * 8000, 8000, 'r')} "
       "select ws window_start_ms, we window_end_ms, count(distinct user_id) users, min(user_id) sample_user, "
       "md5(string_agg(cast(event_id as varchar), ' ' order by cast(event_id as varchar))) event_ids from w group by ws, we")
def window_values_overlap_9000(spark, sf):
    """DISTINCT, SAMPLE and GROUP_CONCAT where each row is in 9 000 windows."""
    aggs = [Agg("count_distinct", "user_id", "users"), Agg("sample", "user_id", "sample_user"), Agg("group_concat", "event_id", "ids")]
    errors = tables.observations(spark, sf).where("event_type = 'error'")
    out = windows.sliding(errors, "event_time", 9000 * 8000, 8000, aggs)
    return out.select(*bounds(), "users", "sample_user", F.md5("ids").alias("event_ids"))
