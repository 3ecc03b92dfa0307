import math
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from streamwarden import vocab
from streamwarden.functions import literals
from streamwarden.operators import (access, buckets, discovery, events, graph, ordering, patterns, provenance, registry,
                                    rules, skew, windows)
from streamwarden.operators.windows import Agg
from streamwarden.plans import templates
from streamwarden.plans.continuous import ContinuousQuery, WindowSpec
from streamwarden.plans.tables import activity_rules
from streamwarden.sinks import annotation, audit, delivery, storage
from streamwarden.sources import history, live, triples

T0 = datetime(2024, 1, 1)
LIMITS = [1_000_000, 4]  # ordinary windows, and every group of more than four rows treated as hot


def at(seconds):
    return T0 + timedelta(seconds=seconds)


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


# --- skew -------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def skewed(spark):
    """One key with a third of all rows, ties, a null key and small groups."""
    data = [("hot", i // 3, i) for i in range(40)] + [(None, i, 100 + i) for i in range(9)]
    data += [(f"k{i % 17}", i, 200 + i) for i in range(71)]
    return spark.createDataFrame(data, "k string, t int, id int").repartition(5)


@pytest.mark.parametrize("limit", LIMITS)
def test_positions(skewed, limit):
    got = {r.id: (r.pos, r.n) for r in skew.positions(skewed, ["k"], ["t", "id"], "pos", "n", limit).collect()}
    groups = {}
    for r in skewed.collect():
        groups.setdefault(r.k, []).append((r.t, r.id))
    want = {i: (p + 1, len(g)) for g in groups.values() for p, (_, i) in enumerate(sorted(g))}
    assert got == want


@pytest.mark.parametrize("limit", LIMITS)
def test_positions_over_everything(skewed, limit):
    got = [r.id for r in skew.positions(skewed, [], ["t", "id"], "pos", limit=limit).orderBy("pos").collect()]
    assert got == [i for _, i in sorted((r.t, r.id) for r in skewed.collect())]


@pytest.mark.parametrize("limit", LIMITS)
def test_fill_forward_and_next_value(skewed, limit):
    marked = skewed.withColumn("v", F.when(F.col("id") % 7 == 0, F.col("id")))
    filled = {r.id: r.f for r in skew.fill_forward(marked, ["k"], ["t", "id"], "v", "f", limit).collect()}
    nxt = {r.id: r.x for r in skew.next_value(skewed, ["k"], ["t", "id"], "id", "x", limit).collect()}
    groups = {}
    for r in marked.collect():
        groups.setdefault(r.k, []).append((r.t, r.id, r.v))
    for g in groups.values():
        g.sort(key=lambda x: x[:2])
        last = None
        for i, (_, id_, v) in enumerate(g):
            last = v if v is not None else last
            assert filled[id_] == last
            assert nxt[id_] == (g[i + 1][1] if i + 1 < len(g) else None)


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_equals_plain_join(spark, skewed, how):
    right = spark.createDataFrame([("hot", 1), ("hot", 2), ("k3", 3), ("zz", 4)], "k string, w int")
    plain = sorted(map(str, skewed.join(right, ["k"], how).collect()))
    assert sorted(map(str, skew.salted_join(skewed, right, ["k"], how, limit=4).collect())) == plain


def test_interval_join(spark):
    points = spark.createDataFrame([(s, at(i)) for s in "ab" for i in range(50)], "s string, t timestamp")
    spans = [("a", 0, 0, 0), ("a", 1, 3, 7), ("a", 2, 7, 49), ("b", 3, 10, 11), ("c", 4, 0, 9), ("b", 5, 9, 8)]
    intervals = spark.createDataFrame([(s, i, at(a), at(b)) for s, i, a, b in spans],
                                      "s string, i int, lo timestamp, hi timestamp")
    got = rows(skew.interval_join(points, intervals, ["s"], "t", "lo", "hi"), "s", "i", "t")
    assert got == sorted((s, i, at(x)) for s, i, a, b in spans for x in range(50) if s in "ab" and a <= x <= b)


# --- windows ------------------------------------------------------------------------------------

ALL = [Agg("avg", "v", "a"), Agg("sum", "v", "s"), Agg("count", "v", "c"), Agg("min", "v", "lo"), Agg("max", "v", "hi")]


@pytest.mark.parametrize("range_ms,step_ms", [(1000, 1000), (3000, 1000), (20_000, 1000), (9000, 3000)])
def test_panes_equal_windows(spark, range_ms, step_ms):
    data = [("a" if i % 3 else "b", at(i * 0.7 if i < 40 else 500 + i), float(i % 11) if i % 5 else None) for i in range(80)]
    data.append(("c", datetime(1969, 12, 31, 23, 59, 58), 1.0))  # before the epoch
    df = spark.createDataFrame(data, "k string, t timestamp, v double")
    plain = windows.windowed(df, "t", range_ms, step_ms, ALL, ["k"])
    panes = windows.windowed_by_panes(df, "t", range_ms, step_ms, ALL, ["k"])
    cols = ["window_start", "window_end", "k", "a", "s", "c", "lo", "hi"]
    key = lambda df: sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)
    assert key(panes) == key(plain)


@pytest.mark.parametrize("by", [["k"], []])
def test_panes_in_short_runs_equal_windows(spark, monkeypatch, by):
    monkeypatch.setattr(windows, "SPOTS", 4)
    monkeypatch.setattr(windows, "EXPANDED", 3)
    data = [("a" if i % 3 else "b", at(i * 0.7 if i < 40 else 500 + 3 * i), float(i % 11) if i % 5 else None) for i in range(80)]
    data += [(None, at(90), 5.0), ("b", at(59), None), ("b", at(60), 2.0)]
    df = spark.createDataFrame(data, "k string, t timestamp, v double")
    cols = ["window_start", "window_end", *by, "a", "s", "c", "lo", "hi"]
    key = lambda df: sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)
    assert key(windows.windowed_by_panes(df, "t", 30_000, 1000, ALL, by)) == key(windows.windowed(df, "t", 30_000, 1000, ALL, by))


def test_template_at_its_own_step_over_thirty_days(spark):
    start, end, length = datetime(2024, 1, 1), datetime(2024, 1, 31), 129_600_000
    seen = [(templates.PARTICIPANT_STREAM.format(1), templates.BVP, "s", start + timedelta(days=d), v) for d, v in ((0, 10), (10, 40))]
    obs = spark.createDataFrame(seen, "stream string, property string, resource_id string, event_time timestamp, value long")
    out = templates.run_named("averageHRPatient1", obs, start, end)
    third = length // 3  # ten days: the first row alone, both, the second alone
    got = out.groupBy("averageHR1").agg(F.count("*").alias("n")).collect()
    assert sorted((r.averageHR1, r.n) for r in got) == [(10.0, third), (25.0, 2 * third), (40.0, third)]


def test_window_bounds_are_half_open_and_epoch_aligned(spark):
    df = spark.createDataFrame([(datetime(1970, 1, 1, 0, 0, s),) for s in (0, 19, 20)], "t timestamp")
    got = rows(windows.windowed(df, "t", 20_000, 20_000, [Agg("count", "*", "n")]), "window_start", "window_end", "n")
    z = datetime(1970, 1, 1)
    assert got == [(z, z + timedelta(seconds=20), 2), (z + timedelta(seconds=20), z + timedelta(seconds=40), 1)]


def test_rstream_is_previous_plus_istream_minus_dstream(spark):
    data = [(at(i * 13 % 200), f"r{i % 6}") for i in range(40)]
    df = spark.createDataFrame(data, "t timestamp, r string")
    frame = ("t", 60_000, 20_000)
    by_window = {}
    for name, fn in (("r", windows.rstream), ("i", windows.istream), ("d", windows.dstream)):
        for x in fn(df, *frame, ["r"]).collect():
            by_window.setdefault(x.window_start, {}).setdefault(name, set()).add(x.r)
    step = timedelta(seconds=20)
    for w, x in by_window.items():
        before = by_window.get(w - step, {}).get("r", set())
        assert x.get("r", set()) == (before | x.get("i", set())) - x.get("d", set())
        assert not x.get("i", set()) & before and x.get("d", set()) <= before


def test_two_window_join_uses_set_semantics(spark):
    left = spark.createDataFrame([(at(1), "s1", 5), (at(2), "s1", 5), (at(3), "s2", 7)], "t timestamp, s string, o int")
    right = spark.createDataFrame([(at(4), "s1", 5), (at(5), "s1", 5), (at(6), "s2", 8)], "t timestamp, s string, o int")
    out = windows.window_join(left, right, ["s", "o"], "t", (10_000, 10_000), (10_000, 10_000))
    assert rows(out, "s", "o") == [("s1", 5)]


# --- triples --------------------------------------------------------------------------------------

DOC = "\n".join([
    "<http://h/obs1> <http://rdfs.org/ns/void#inDataset> <http://h/participant1> .",
    f"<http://h/obs1> <{vocab.MADE_BY}> <http://h/sensors/E4.Accelerometer> .",
    f"<http://h/obs1> <{vocab.VERSION_OF}> <{vocab.MEASUREMENT}> .",
    f"<http://h/obs1> <{vocab.RELATES_TO}> <http://h/sensors/wearable.acceleration.x> .",
    f'<http://h/obs1> <{vocab.HAS_TIMESTAMP}> "2025-05-05T12:57:59.166Z" .',
    f'<http://h/obs1> <{vocab.HAS_VALUE}> "-22.0"^^<{vocab.XSD_FLOAT}> .', ""])


def docs(spark, *bodies):
    return spark.createDataFrame([(f"d{i}", "st", b) for i, b in enumerate(bodies)], "resource_id string, stream string, body string")


def test_observation_document(spark):
    good, bad = triples.ntriples_ingest(docs(spark, DOC))
    assert good.count() == 6 and bad.count() == 0
    expected = ("http://h/sensors/wearable.acceleration.x", -22.0, datetime(2025, 5, 5, 12, 57, 59, 166000))
    shaped = patterns.observation_shape(good).first()
    assert (shaped.property, shaped.value, shaped.event_time) == expected
    read = triples.observations_from_documents(docs(spark, DOC)).first()
    assert (read.property, read.value, read.event_time) == expected


def test_quarantine(spark):
    no_time = f'<http://h/a> <{vocab.HAS_VALUE}> "1" .'
    no_number = f'<http://h/a> <{vocab.HAS_VALUE}> "x" .\n<http://h/a> <{vocab.HAS_TIMESTAMP}> "2025-01-01T00:00:00Z" .'
    readable, broken = triples.tolerant_read(docs(spark, DOC, "", None, no_time, no_number))
    assert rows(broken, "resource_id", "reason") == [("d1", "empty"), ("d2", "empty")]
    good, bad = triples.usable(triples.observations_from_documents(readable))
    assert rows(good, "resource_id") == [("d0",)]
    assert rows(bad, "resource_id", "reason") == [("d3", "no event time"), ("d4", "no numeric value")]
    _, lines = triples.ntriples_ingest(docs(spark, "no triple\n# comment\n\n<http://a> <http://b> _:x ."))
    assert rows(lines, "line") == [("no triple",)]


def test_term_forms(spark):
    body = '_:b1 <http://p> "q\\"uote"@en-GB .\n<http://s> <http://p> "1"^^<http://t> . # note\n<http://s> <http://p> <http://o>.'
    good, bad = triples.ntriples_ingest(docs(spark, body))
    assert bad.count() == 0
    text = [r[0] for r in good.orderBy("seq").select(literals.triple_text()).collect()]
    assert text == ['_:b1 <http://p> "q\\"uote"@en-GB .', '<http://s> <http://p> "1"^^<http://t> .', '<http://s> <http://p> <http://o> .']


def test_event_time_first_or_each(spark):
    body = f'<http://a> <{vocab.HAS_TIMESTAMP}> "2025-01-02T00:00:00Z" .\n<http://a> <{vocab.HAS_TIMESTAMP}> "2025-01-01T00:00:00Z" .'
    good, _ = triples.ntriples_ingest(docs(spark, body))
    once = triples.with_event_time(good)
    assert once.count() == 2 and once.select("event_time").distinct().first()[0] == datetime(2025, 1, 2)
    assert triples.with_event_time(good, per_timestamp=True).count() == 4


@pytest.fixture(scope="module")
def graph9(spark):
    body = "\n".join([f'<http://e/1> <http://p/{i}> "{i}" .' for i in range(6)]
                     + [f"<http://e/1> <http://p/gen> <http://h/acc-{a}/> ." for a in "xyz"])
    return triples.ntriples_ingest(docs(spark, body))[0]


def test_template_rule_drops_repeats(graph9):
    assert rules.apply_template(graph9, rules.Template("r", ("?s", "?p", "?o"), ("?s", "?p", "?s"))).count() == 7


def test_pattern_with_repeated_variable_and_unbound_join(spark):
    df = spark.createDataFrame([("a", "p", "a"), ("a", "p", "b")], "s string, p string, o string")
    assert rows(patterns.bindings(df, ("?x", "p", "?x")), "x") == [("a",)]
    with pytest.raises(ValueError):
        patterns.join(df, [("?a", "p", "?b"), ("?c", "p", "?d")])


def test_set_update(spark):
    g = triples.ntriples_ingest(docs(spark, "<http://s1> <http://p1> <http://o1> .\n<http://s2> <http://p2> \"x\" ."))[0]
    one = g.where("s = 'http://s1'")
    assert graph.delete_text(one).first()[0] == "DELETE DATA {<http://s1> <http://p1> <http://o1> .\n}"
    assert graph.delete_data(graph.union(g), one).count() == 1
    assert graph.insert_data(graph.union(g), one).count() == 2


def test_export_inlines_blank_nodes_and_dedups(spark):
    body = ('<http://n/s> <http://n/p> _:b .\n_:b <http://n/x> "1" .\n<http://n/s> <http://n/q> <http://n/b> .\n'
            '<http://n/s> <http://n/q> <http://n/a> .\n<http://n/s> <http://n/q> <http://n/a> .')
    out = storage.export(triples.ntriples_ingest(docs(spark, body))[0], {"n": "http://n/"})
    assert rows(out, "text") == [("n:s n:p [n:x \"1\"] .",), ("n:s n:q n:a, n:b .",)]
    split = storage.export(triples.ntriples_ingest(docs(spark, body))[0], objects_per_line=1)
    assert split.count() == 3


# --- rules ----------------------------------------------------------------------------------------

def test_activity_boundaries(spark):
    values = [(-1.0, "sitting"), (6.0, "sitting"), (8.0, "standing"), (14.0, "standing"), (30.0, "lightActivity"),
              (45.0, "slowWalking"), (55.0, "briskWalking"), (55.1, "fastWalkingOrJogging"), (None, None), (math.nan, None)]
    df = spark.createDataFrame([(v,) for v, _ in values], "value double")
    want = sorted((v, vocab.EX + d) for v, d in values if d)
    assert rows(rules.apply_thresholds(df, activity_rules()), "value", "derived_o") == want
    table = rules.rule_table(spark, "set", activity_rules())
    facts = df.withColumn("rule_set", F.lit("set")).withColumn("premise_p", F.lit(vocab.HAS_VALUE))
    assert rows(rules.match_rules(facts, table), "value", "derived_o") == want


def test_two_sided_rule_and_comparisons(spark):
    rule = rules.Threshold("r", (("greaterThan", 5), ("notGreaterThan", 15)), vocab.EX + "standing")
    facts = spark.createDataFrame([("http://e/1", vocab.HAS_VALUE, "10"), ("http://e/2", vocab.HAS_VALUE, "5"),
                                   ("http://e/3", vocab.HAS_VALUE, "x")], "s string, p string, o string")
    assert rows(rules.fixpoint(facts, [rule]), "s", "p", "o") == [("http://e/1", vocab.EX + "is", vocab.EX + "standing")]
    at_least = rules.Threshold("r", (("notLessThan", 6),), vocab.EX + "standing")
    df = spark.createDataFrame([(5.9,), (6.0,)], "value double")
    assert rows(rules.apply_thresholds(df, [at_least]), "value") == [(6.0,)]
    assert rows(rules.match_rules(df.withColumn("rule_set", F.lit("x")).withColumn("premise_p", F.lit(vocab.HAS_VALUE)),
                                  rules.rule_table(spark, "x", [at_least])), "value") == [(6.0,)]


def by_bodies(facts, bodies):
    """Naive evaluation: every combination of facts, again and again."""
    known = set(facts)
    while True:
        new = set()
        for r in bodies:
            found = [{}]
            for pattern in r.premises:
                grown = []
                for b in found:
                    for t in known:
                        c = dict(b)
                        if all((c.setdefault(x, v) == v) if x.startswith("?") else x == v for x, v in zip(pattern, t)):
                            grown.append(c)
                found = grown
            for b in found:
                ok = True
                for v, name, bound in r.tests:
                    if isinstance(bound, str):
                        ok &= rules.COMPARISONS[name](b[v], b[bound])
                    else:
                        try:
                            ok &= rules.COMPARISONS[name](float(b[v]), bound)
                        except ValueError:
                            ok = False
                if ok:
                    new.add(tuple(b.get(x, x) for x in r.conclusion))
        if new <= known:
            return known - set(facts)
        known |= new


@pytest.mark.parametrize("seed", [1, 2])
def test_rules_of_several_premises(spark, seed):
    rng = random.Random(seed)
    facts = {(f"n{rng.randrange(9)}", "e", f"n{rng.randrange(9)}") for _ in range(14)} | {
        (f"n{i}", "v", str(rng.randrange(4))) for i in range(9)} | {("n1", "v", "high")}
    bodies = [
        rules.Body("base", (("?a", "e", "?b"), ("?a", "v", "?x"), ("?b", "v", "?y")), ("?a", "up", "?b"), (("?x", "lessThan", "?y"),)),
        rules.Body("step", (("?a", "up", "?b"), ("?b", "e", "?c"), ("?c", "v", "?x")), ("?a", "up", "?c"), (("?x", "greaterThan", 0.0),)),
        rules.Body("loop", (("?a", "up", "?a"),), ("?a", "is", "looped")),
        rules.Body("any", (("?a", "?p", "?b"), ("?b", "is", "looped")), ("?a", "?p", "loop"))]
    df = spark.createDataFrame(sorted(facts), "s string, p string, o string")
    got = rules.fixpoint(df, bodies)
    assert {tuple(r) for r in got.collect()} == by_bodies(facts, bodies)
    assert got.count() == got.distinct().count()


def test_bodies_have_to_be_connected():
    with pytest.raises(ValueError):
        rules.Body("r", (("?a", "p", "?b"), ("?c", "q", "?d")), ("?a", "x", "?d"))
    with pytest.raises(ValueError):
        rules.Body("r", (("?a", "p", "?b"),), ("?a", "x", "?z"))


def test_fixpoint_of_cycle_ends(spark):
    facts = spark.createDataFrame([("a", "next", "b"), ("b", "next", "c"), ("c", "next", "a")], "s string, p string, o string")
    assert rules.fixpoint(facts, [rules.Path("r", "next", "next", "next")]).count() == 6
    # A template that counts one further by a path of its own: as many rounds as the chain is long.
    chain = [("n0", "at", "start")] + [(f"n{i}", "to", f"n{i + 1}") for i in range(6)]
    steps = spark.createDataFrame([(b, "from", a) if p == "to" else (a, p, b) for a, p, b in chain], "s string, p string, o string")
    assert rules.fixpoint(steps, [rules.Path("r", "from", "at", "at")]).count() == 6
    with pytest.raises(RuntimeError):
        rules.fixpoint(facts, [rules.Path("r", "next", "next", "next")], max_rounds=1)


# --- buckets --------------------------------------------------------------------------------------

STREAM = "http://h/s/"


def members(spark, seconds):
    return spark.createDataFrame([(i, STREAM, at(s)) for i, s in enumerate(seconds)], "id int, stream string, event_time timestamp")


@pytest.mark.parametrize("limit", LIMITS)
@pytest.mark.parametrize("seconds,size,sizes", [
    (list(range(1, 46)), 20, [20, 20, 5]), (list(range(1, 21)), 20, [20]), (list(range(1, 22)), 20, [20, 1]),
    (list(range(1, 19)) + [50] * 5 + [60, 61], 20, [18, 7]), ([5] * 30, 10, [30]),
    ([1] * 3 + [2] * 25 + [3] * 3, 5, [3, 27, 1])])
def test_rebalance(spark, limit, seconds, size, sizes):
    df = members(spark, seconds).withColumn("bucket", F.lit(STREAM + "1/"))
    out = buckets.rebalance(df, size, limit=limit)
    assert out.count() == len(seconds)
    ordered = sorted(seconds)
    bounds = sorted({ordered[k * size] for k in range(1, (len(seconds) - 1) // size + 1)})
    for r in out.collect():
        lower = max([at(b) for b in bounds if at(b) <= r.event_time], default=None)
        assert r.new_lower_ts == lower
    counted = out.groupBy("new_bucket").count().collect()
    assert sum(r["count"] for r in counted) == sum(sizes) == len(seconds)
    if bounds:
        want = {}
        for s in seconds:
            b = max([x for x in bounds if x <= s], default=None)
            want[b] = want.get(b, 0) + 1
        assert sorted(r["count"] for r in counted) == sorted(want.values())


def test_rebalance_fixture_sizes(spark):
    df = members(spark, range(1, 46)).withColumn("bucket", F.lit(STREAM + "1/"))
    out = buckets.rebalance(df, 20).groupBy("new_bucket").count().collect()
    ms = lambda s: int((at(s) - datetime(1970, 1, 1)).total_seconds() * 1000)
    assert {r["new_bucket"]: r["count"] for r in out} == {
        STREAM + "1/": 20, f"{STREAM}{ms(21)}/": 20, f"{STREAM}{ms(41)}/": 5}
    tied = members(spark, list(range(1, 19)) + [50] * 5 + [60, 61]).withColumn("bucket", F.lit(STREAM + "1/"))
    assert sorted(r["count"] for r in buckets.rebalance(tied, 20).groupBy("new_bucket").count().collect()) == [7, 18]


@pytest.mark.parametrize("limit", LIMITS)
def test_assign(spark, limit):
    bounds = spark.createDataFrame(
        [(STREAM, "b1", at(10), 1), (STREAM, "b1-again", at(10), 2), (STREAM, "b2", at(20), 3),
         (STREAM, "epoch", datetime(1970, 1, 1), 4), ("other", "x", at(0), 5)],
        "stream string, bucket string, lower_ts timestamp, seq int")
    out = buckets.assign(members(spark, [9, 10, 19, 20, 99, 1, 2, 3]), bounds, limit=limit)
    assert rows(out, "id", "bucket") == [(0, "none"), (1, "b1"), (2, "b1"), (3, "b2"), (4, "b2"), (5, "none"),
                                         (6, "none"), (7, "none")]


@pytest.mark.parametrize("limit", LIMITS)
def test_store_and_rebalance(spark, limit):
    bounds = spark.createDataFrame([(STREAM, STREAM + "b/", at(100))], "stream string, bucket string, lower_ts timestamp")
    out = buckets.store_and_rebalance(members(spark, [5, 7, 100, 101, 102, 103]), bounds, 3, limit=limit)
    ms = lambda s: int((at(s) - datetime(1970, 1, 1)).total_seconds() * 1000)
    assert rows(out, "id", "bucket", "new_bucket") == [
        (0, f"{STREAM}{ms(5)}/", f"{STREAM}{ms(5)}/"), (1, f"{STREAM}{ms(5)}/", f"{STREAM}{ms(5)}/"),
        *[(i, STREAM + "b/", STREAM + "b/") for i in (2, 3, 4)], (5, STREAM + "b/", f"{STREAM}{ms(103)}/")]


@pytest.mark.parametrize("limit", LIMITS)
def test_batches_hold_back_the_rest(spark, limit):
    out = buckets.batches(members(spark, range(47)), ["stream"], ["event_time", "id"], 20, limit=limit)
    assert rows(out.groupBy("batch").count(), "batch", "count") == [(0, 20), (1, 20)]


def test_publish_appends_and_returns_the_rest(spark, tmp_path):
    df = members(spark, range(45)).withColumn("key", F.lit("q"))
    left = storage.publish(df, str(tmp_path / "store"), ["key"], "stream", "event_time", ["event_time", "id"])
    stored = spark.read.parquet(str(tmp_path / "store"))
    assert left.count() == 5 and stored.count() == 40
    last = stored.where("batch = 1").agg(F.max("event_time").alias("m"), F.min("bucket_ts").alias("b")).first()
    assert last.m == last.b == at(39)
    storage.append_to_buckets(stored.drop("day"), str(tmp_path / "store"))
    assert spark.read.parquet(str(tmp_path / "store")).count() == 80


def test_prune_fragments(spark):
    b = spark.createDataFrame([(STREAM, f"b{i}", at(i * 10)) for i in range(5)], "stream string, bucket string, lower_ts timestamp")
    assert rows(history.prune_fragments(b, at(15), at(30)), "bucket") == [("b1",), ("b2",), ("b3",)]
    assert history.prune_fragments(b, None, None).count() == 5
    m = members(spark, [5, 15, 16, 30, 31]).withColumnRenamed("id", "resource_id").withColumn(
        "bucket", F.concat(F.lit("b"), (F.second("event_time") / 10).cast("int").cast("string")))
    assert rows(history.member_range_read(m, b, at(15), at(30)), "resource_id") == [(1,), (2,), (3,)]


# --- queue, registry, delivery, access ------------------------------------------------------------

def test_queue(spark):
    events_ = [(1, 100), (2, 200), (3, 50), (4, 150), (5, 250), (6, 300), (7, 250), (8, 200)]
    q = spark.createDataFrame([(e, t, i) for i, (e, t) in enumerate(events_)], "event int, timestamp long, seq int")
    first = ordering.peek(q).first()
    assert (first.event, first.timestamp) == (3, 50)
    assert [r.event for r in ordering.stable_sort(q).collect()] == [3, 1, 4, 2, 8, 5, 7, 6]
    assert [r.event for r in ordering.drain(q, 3).collect()] == [3, 1, 4]
    assert ordering.peek(q.limit(0)).count() == 0
    assert ordering.queue_state(q.limit(0)).first().is_empty and ordering.queue_state(q).first().size == 8
    words = spark.createDataFrame([(w,) for w in ("test", "hello", "world", "a", "b", "c")], "w string")
    assert [r.w for r in ordering.string_sort(words, "w").collect()] == ["a", "b", "c", "hello", "test", "world"]


def test_registry_items(spark):
    reg = spark.createDataFrame([(43, 0), (44, 1), (45, 2)], "item int, seq int")
    assert registry.size(reg).first().size == 3
    assert registry.item(reg, 1, ["seq"]).first().item == 44
    two = spark.createDataFrame([(43, 0), (43, 1)], "item int, seq int")
    assert rows(registry.remove_first(two, two.limit(1), ["item"], ["seq"]), "seq") == [(1,)]
    assert registry.cleared(reg).count() == 0


def test_registry_is_cleared_in_place(spark, tmp_path):
    path = str(tmp_path / "registry")
    spark.createDataFrame([(43, 0), (44, 1)], "item int, seq int").write.parquet(path)
    assert registry.clear(spark, path).count() == 0
    assert spark.read.parquet(path).columns == ["item", "seq"]


def test_large_rows_are_not_broadcast(spark):
    wide = spark.range(3).selectExpr("id", "repeat('x', 100) t")
    assert "Broadcast" in skew.sized(wide)._jdf.queryExecution().analyzed().toString() or "hint" in str(
        skew.sized(wide)._jdf.queryExecution().analyzed().toString()).lower()
    assert skew.sized(wide, max_rows=2) is wide


@pytest.mark.parametrize("limit", [1_000_000, 1])
def test_duplicate_queries(spark, limit):
    from test_functions import text
    base, any_p = text(), text(body="?s ?p ?o")
    renamed = base.replace("?s", "?x").replace("?o", "?y")
    data = [(1, base, at(0)), (2, base, at(1)), (3, any_p, at(2)), (4, renamed, at(3)), (5, text(op="IStream"), at(4))]
    regs = spark.createDataFrame(data, "registration_id int, query_text string, registered_at timestamp")
    out = registry.detect_duplicates(regs, limit=limit)
    assert rows(out, "registration_id", "is_unique") == [(1, True), (2, False), (3, True), (4, False), (5, True)]
    assert {r.registration_id: r.equivalent_to for r in out.collect()}[4] == 1
    stored = out.where("registration_id = 1").select("query_key", F.lit(0).alias("registration_id"))
    later = registry.detect_duplicates(regs, registry=stored, limit=limit)
    assert rows(registry.executing(later), "registration_id") == [(3,), (5,)]


def test_fan_out(spark):
    results = spark.createDataFrame([("h1", "a"), ("h2", "b")], "query_hash string, payload string")
    subs = delivery.subscribe(spark.createDataFrame([("h1", "c1")], "query_hash string, subscriber string"), "h1", "c2")
    assert rows(delivery.fan_out(results, subs), "subscriber", "payload") == [("c1", "a"), ("c2", "a")]
    assert rows(delivery.fan_out(results, subs, limit=0), "subscriber", "payload") == [("c1", "a"), ("c2", "a")]
    assert rows(delivery.unmatched(results, subs), "query_hash") == [("h2",)]
    assert delivery.subscriber_lists(subs).first().subscribers == ["c1", "c2"]


def test_access(spark):
    notes = spark.createDataFrame([("Add", "http://h/alice/acc-x/"), ("Add", "http://h/alice/acc-x/1715000000/"),
                                   ("Update", "http://h/alice/acc-x/")], "type string, target string")
    added = live.added(notes)
    assert rows(added, "stream", "derived") == [
        ("http://h/alice/acc-x/", "http://h/alice/acc-x/derived/1715000000"), ("http://h/alice/acc-x/", "http://h/alice/derived/acc-x")]
    grants = spark.createDataFrame([("http://h/alice/derived/acc-x", "m")], "resource string, agent string")
    assert rows(access.granted(added, grants), "target") == [("http://h/alice/acc-x/",)]
    assert rows(access.rejected(added, grants), "target") == [("http://h/alice/acc-x/1715000000/",)]


def test_policies(spark):
    con = [(vocab.ODRL_PURPOSE, "eq", "care"), (vocab.LEGAL_BASIS, "eq", "A9")]
    policies = spark.createDataFrame(
        [("t", "a", "m", "read", con), ("t2", "a", "m", "read", [(vocab.ODRL_PURPOSE, "neq", "x")])],
        "target string, assigner string, assignee string, action string, constraints array<struct<left:string,op:string,right:string>>")
    full = {vocab.ODRL_PURPOSE: "care", vocab.LEGAL_BASIS: "A9"}
    asked = [(1, "t", full), (2, "t", {**full, vocab.ODRL_PURPOSE: "ads"}), (3, "t", {vocab.ODRL_PURPOSE: "care"}), (4, "t2", full)]
    requests = spark.createDataFrame([(i, t, "a", "m", "read", c) for i, t, c in asked],
                                     "request_id int, target string, assigner string, assignee string, action string, claims map<string,string>")
    assert rows(access.decide(requests, policies), "request_id", "granted") == [(1, True), (2, False), (3, False), (4, False)]


def test_pointer_variants(spark):
    base = "http://h/s/"
    data = [(base, vocab.LDP_INBOX, base + "9/"), (base, vocab.LDP_INBOX, base + "10/"), (base, "p", "o")]
    df = spark.createDataFrame(data, "s string, p string, o string")
    assert rows(storage.latest_pointer(df), "o") == [(base + "10/",), ("o",)]
    assert rows(storage.latest_pointer(df, numeric=False), "o") == [(base + "9/",), ("o",)]


# --- events, provenance, annotation, audit ---------------------------------------------------------

def test_event_triples_and_provenance(spark):
    results = spark.createDataFrame([(datetime(1970, 1, 1), datetime(1970, 1, 1, 0, 0, 20), 38.1051177665153)],
                                    "window_start timestamp, window_end timestamp, v double")
    streams = F.array(*[F.lit(f"http://h/alice/acc-{a}/") for a in "xyz"])
    made = events.construct(results, F.lit("q"), "v", streams, F.lit("2025-05-07T10:48:30.658Z").cast("timestamp"))
    out = events.to_triples(made)
    assert out.count() == 9
    assert rows(out.where(F.col("p") == vocab.HAS_VALUE), "o", "o_datatype") == [("38.1051177665153", vocab.XSD_FLOAT)]
    assert rows(out.where(F.col("p") == vocab.RSP_ENDED), "o") == [("1970-01-01T00:00:20.000Z",)]
    assert provenance.windows_of_results(out).count() == 3
    obs = spark.createDataFrame([(f"o{s}", "http://h/alice/acc-x/", datetime(1970, 1, 1, 0, 0, s)) for s in (0, 20, 21)],
                                "id string, stream string, event_time timestamp")
    assert rows(provenance.trace(provenance.windows_of_results(out), obs), "id") == [("o0",), ("o20",)]
    ids = events.construct(results, F.lit("q"), "v", streams, random_ids=True).select("event_id").first()[0]
    assert ids != made.first().event_id


def test_annotation_has_28_rows(spark):
    from streamwarden.functions import query_text
    from test_functions import text
    cat = query_text.catalog(spark.createDataFrame([(text(),)], "query_text string"))
    out = annotation.describe(cat, F.lit("from"), F.lit("to"), F.lit(5))
    assert out.count() == 28
    assert rows(out.where(F.col("p").endswith("has_window_size")), "o") == [("800",)]


def test_audit(spark):
    entries = spark.createDataFrame([("q1",), ("q2",)], "query_id string")
    access_ = spark.createDataFrame([("q1", "u", at(i), "d") for i in range(5)] + [("zz", "u", at(0), "d")],
                                    "query_id string, user string, accessed_at timestamp, data_accessed string")
    kept = audit.access_entries(access_, entries)
    assert kept.count() == 5
    assert rows(audit.with_access(entries, kept), "query_id", "accesses") == [("q1", 5), ("q2", 0)]
    nested = audit.nested_log(entries, kept, per_row=2)
    assert nested.where("query_id = 'q2' and access_log is null").count() == 1
    assert rows(nested.where("query_id = 'q1'").withColumn("n", F.size("access_log")), "part", "n") == [(0, 2), (1, 2), (2, 1)]


def test_container_streams(spark):
    meta = spark.createDataFrame([("c1", vocab.RSP_STREAMS, "st"), ("c2", "p", "o")], "resource_id string, p string, o string")
    found, missing = provenance.container_streams(meta)
    assert rows(found, "resource_id", "stream") == [("c1", "st")] and rows(missing, "resource_id") == [("c2",)]


def test_discovery_needs_one_matching_stream(spark):
    index = spark.createDataFrame(
        [("o1", 1, "s1", vocab.RELATES_TO, "hr"), ("o1", 2, "s1", vocab.TREE_VIEW, "v1"), ("o1", 3, "s2", vocab.TREE_VIEW, "v2"),
         ("o2", 4, "s3", vocab.TREE_VIEW, "v3")], "owner string, seq int, s string, p string, o string")
    metrics = spark.createDataFrame([("hr",)], "metric string")
    assert rows(discovery.relevant_streams(index, metrics), "stream") == [("v1",), ("v2",)]
    wanted = spark.createDataFrame([("o1", "hr"), ("o1", "bp"), ("o3", "hr")], "owner string, metric string")
    got = {(r.owner, r.metric): r.stream for r in discovery.lookup(index, wanted).collect()}
    assert got == {("o1", "hr"): "s1", ("o1", "bp"): "v1", ("o3", "hr"): None}


# --- continuous queries ---------------------------------------------------------------------------

def test_named_templates():
    start, end = datetime(2024, 1, 1), datetime(2024, 1, 1, 0, 3)
    q = templates.named_query("averageHRPatient1", start, end)
    assert [(w.width_ms, w.slide_ms) for w in q.windows] == [(180_000, 20)]
    assert len(templates.named_query("averageHRPatientMultiple", start, end).windows) == 2
    assert templates.named_query("unknown", start, end) is None


def test_query_text_is_catalogued_as_written(spark):
    from streamwarden.functions import query_text
    q = templates.named_query("averageHRPatientMultiple", datetime(2024, 1, 1), datetime(2024, 1, 1, 0, 3))
    row = query_text.catalog(spark.createDataFrame([(q.text(),)], "query_text string")).first()
    assert [(w.stream, w.width_ms, w.slide_ms) for w in row.windows] == [(w.stream, 180_000, 20) for w in q.windows]
    assert len(row.patterns) == 4 and row.query_hash == q.query_hash()
    assert row.focus == [templates.BVP, templates.BVP]


def test_two_windows_over_triples_and_observations_agree(spark):
    w = [WindowSpec("w1", "st1", 10_000, 5_000), WindowSpec("w2", "st2", 10_000, 5_000)]
    q = ContinuousQuery("out", tuple(w), tuple((x.name, "?s", vocab.HAS_VALUE, "?o") for x in w), (Agg("avg", "o", "m"),))
    data = [("a", "st1", "p", 1.0, at(1)), ("a", "st2", "p", 1.0, at(3)), ("b", "st1", "p", 5.0, at(4)), ("b", "st2", "p", 5.0, at(6))]
    obs = spark.createDataFrame(data, "resource_id string, stream string, property string, value double, event_time timestamp")
    tri = triples.observations_to_triples(obs)
    want = rows(q.over_observations(obs), "window_start", "m")
    assert want == rows(q.over_triples(tri), "window_start", "m") and len(want) == 2
    alerts = ContinuousQuery("out", tuple(w), q.patterns, q.aggregates, rules=tuple(activity_rules())).alerts(q.over_observations(obs))
    assert alerts.count() == 2


def test_live_mode_needs_start(spark):
    with pytest.raises(ValueError):
        live.observation_stream(spark, "/tmp/none", "event_time timestamp", "live")
    with pytest.raises(ValueError):
        live.observation_stream(spark, "/tmp/none", "event_time timestamp", "historical")


def test_long_literals_are_read_whole(spark):
    plain, escaped = "x" * 300_000, 'a"b\\' * 40_000
    text = escaped.replace("\\", "\\\\").replace('"', '\\"')
    body = f'<http://a> <{vocab.MADE_BY}> "{plain}" .\n<http://a> <{vocab.RELATES_TO}> "{text}"@en .\nno triple "{plain}'
    good, bad = triples.ntriples_ingest(docs(spark, body))
    assert [r.o for r in good.orderBy("seq").collect()] == [plain, escaped] and bad.count() == 1
    assert triples.observations_from_documents(docs(spark, body)).first().property == escaped


def test_rules_join_only_premises_that_may_be_new(spark):
    first = rules.Body("first", (("?a", "next", "?b"), ("?a", "kind", "?k"), ("?b", "kind", "?k")), ("?a", "runs", "?b"))
    more = rules.Body("more", (("?a", "runs", "?b"), ("?b", "next", "?c"), ("?b", "kind", "?k"), ("?c", "kind", "?k")), ("?a", "runs", "?c"))
    steps, kinds = list(zip("abcde", "bcdef")), dict(zip("abcdef", "xxxyyy"))
    facts = spark.createDataFrame([(a, "next", b) for a, b in steps] + [(a, "kind", k) for a, k in kinds.items()], "s string, p string, o string")
    joins = [len(rules._of_body(r, facts, facts, facts, {"runs"})) for r in (first, more)]
    assert joins == [0, 1] and len(rules._of_body(more, facts, facts, facts)) == 4
    assert {(r.s, r.o) for r in rules.fixpoint(facts, [first, more]).collect()} == {
        (a, b) for part in ("abc", "def") for a in part for b in part if a < b}
    # Nothing follows from what the only rule derives.
    assert rules.fixpoint(facts, [first]).count() == 4
    assert rules.fixpoint(facts, [rules.Path("p", "next", "next", "twice")]).count() == 4
