import random
from datetime import datetime

from pyspark.sql import functions as F

from streamwarden.functions import literals, query_text, times, urls

QUERY = """
    PREFIX saref: <https://saref.etsi.org/core/>
    PREFIX sensors: <http://example.org/sensors/>
    PREFIX : <http://example.org/q/>
    REGISTER {op} <output> AS
    SELECT ({agg})
    FROM NAMED WINDOW :w1 ON STREAM <{stream}> [RANGE {r} STEP {s}]
    WHERE{{
        WINDOW :w1 {{ {body} }}
    }}
"""


def text(agg="AVG(?o) as ?avgSKT", stream="http://h1/skt/", r=800, s=100,
         body="?s saref:hasValue ?o", op="RStream"):
    return QUERY.format(agg=agg, stream=stream, r=r, s=s, body=body, op=op)


def one(spark, value, fn, type_="string"):
    df = spark.createDataFrame([(value,)], f"x {type_}")
    return df.select(fn(F.col("x")).alias("y")).first()["y"]


def test_hash_ignores_whitespace(spark):
    assert one(spark, "test", query_text.query_hash) == "098f6bcd4621d373cade4e832627b4f6"
    assert one(spark, " te st\n", query_text.query_hash) == "098f6bcd4621d373cade4e832627b4f6"


def test_unwrap(spark):
    prefixes = F.create_map(F.lit("saref"), F.lit("https://saref.etsi.org/core/"))
    want = {"saref:hasValue": "https://saref.etsi.org/core/hasValue",
            "<https://saref.etsi.org/core/hasValue>": "https://saref.etsi.org/core/hasValue",
            "hasValue": "", "other:hasValue": ""}
    for given, expected in want.items():
        assert one(spark, given, lambda c: query_text.unwrap(c, prefixes)) == expected


def test_catalog_of_max_query(spark):
    q = text("MAX(?o) as ?maxSKT", "http://localhost:3000/", 180000, 30000,
             "?s saref:hasValue ?o . ?s saref:relatesToProperty sensors:wearable.skt .")
    row = query_text.catalog(spark.createDataFrame([(q,)], "query_text string")).first()
    assert (row.r2s_operator, row.r2s_name) == ("RStream", "output")
    assert [tuple(w) for w in row.windows] == [("http://example.org/q/w1", "http://localhost:3000/", 180000, 30000)]
    assert len(row.prefixes) == 3
    assert (row.aggregate, row.aggregate_var, row.projection_var) == ("max", "o", "maxSKT")
    assert [t.p for t in row.patterns] == ["<https://saref.etsi.org/core/hasValue>",
                                          "<https://saref.etsi.org/core/relatesToProperty>"]
    assert row.focus == ["http://example.org/sensors/wearable.skt"]
    assert "GRAPH :w1" in row.sparql and "REGISTER" not in row.sparql


def test_catalog_defaults_and_repeated_prefix(spark):
    q = "PREFIX a: <http://one/>\nPREFIX a: <http://two/>\nSELECT ?s WHERE { ?s ?p ?o }"
    row = query_text.catalog(spark.createDataFrame([(q,)], "query_text string")).first()
    assert (row.r2s_operator, row.r2s_name, row.windows) == ("RStream", "undefined", [])
    assert row.prefixes == {"a": "http://two/"}


def test_equivalence_key(spark):
    base = text()
    texts = {
        "base": base,
        "same": base,
        "renamed": base.replace("?s", "?x").replace("?o", "?y"),
        "spaced": base.replace("WINDOW :w1 {", "WINDOW   :w1{\n"),
        "window renamed": base.replace(":w1", ":w7"),
        "prefix renamed": base.replace("saref:", "sf:"),
        "any predicate": base.replace("saref:hasValue", "?p"),
        "istream": text(op="IStream"),
        "wider": text(r=900),
        "min": text("MIN(?o) as ?avgSKT"),
        "joined": text(body="?s saref:hasValue ?o . ?s saref:relatesToProperty ?k"),
        "joined swapped": text(body="?s saref:relatesToProperty ?k . ?s saref:hasValue ?o"),
        "not joined": text(body="?s saref:hasValue ?o . ?z saref:relatesToProperty ?k"),
    }
    df = spark.createDataFrame(list(texts.items()), "name string, query_text string")
    keys = {r.name: r.query_key for r in query_text.with_equivalence_key(df).collect()}
    for name in ("same", "renamed", "spaced", "window renamed", "prefix renamed"):
        assert keys[name] == keys["base"], name
    for name in ("any predicate", "istream", "wider", "min", "joined"):
        assert keys[name] != keys["base"], name
    assert keys["joined"] == keys["joined swapped"] != keys["not joined"]


def test_url_forms(spark):
    assert one(spark, "http://h/alice/acc-x/", urls.derived_target) == "http://h/alice/derived/acc-x"
    assert one(spark, "http://h/alice/acc-x/1715000000/", urls.derived_target) == \
        "http://h/alice/acc-x/derived/1715000000"
    assert one(spark, "http://h//a///b", urls.derived_target) == "http://h/a/derived/b"
    assert one(spark, "http://h/x", urls.derived_target) == "http://h/derived/x"
    assert one(spark, "http://h/", urls.derived_target) is None
    assert one(spark, "http://h/alice/acc-x/", urls.derived_resource) == "http://h/alice/derived/acc-x"
    assert one(spark, "http://h/alice/acc-x/1715000000/", urls.stream_of_target) == "http://h/alice/acc-x/"
    assert one(spark, "http://h/alice/acc-x/", urls.stream_of_target) == "http://h/alice/acc-x/"
    assert one(spark, "http://h/a/17/", lambda c: urls.sibling_bucket_url(c, F.lit(99))) == "http://h/a/99/"
    assert one(spark, "http://h/a/", lambda c: urls.child_bucket_url(c, F.lit(99))) == "http://h/a/99/"
    assert one(spark, "a/", lambda c: urls.child_bucket_url(c, F.lit(99))) == "none"
    assert one(spark, "http://h/a/17/", urls.bucket_epoch) == 17
    assert one(spark, "http://h/a/x/", urls.bucket_epoch) is None
    assert one(spark, "http://h/alice/acc-x/", urls.owner_profile) == "http://h/alice/profile/card#me"
    assert one(spark, "http://h/alice/acc-x", lambda c: urls.owner_profile(c, False)) == \
        "http://h/alice/profile/card#me"
    assert one(spark, "http://h/alice/acc-x/", lambda c: urls.owner_profile(c, False)) == "http://h/alice/acc-x/"
    assert one(spark, "http://h/alice/acc-x/", urls.server_root) == "http://h"
    assert one(spark, "http://h/alice/acc-x/1", urls.container_meta) == "http://h/alice/acc-x/.meta"


def test_times(spark):
    assert one(spark, "2025-05-05T12:57:59.166Z", times.epoch_ms) == 1746449879166
    assert one(spark, "Date.First", times.epoch_ms) is None
    assert one(spark, 20000, times.iso_from_ms, "bigint") == "1970-01-01T00:00:20.000Z"
    at = datetime(2025, 5, 5, 12, 0, 0)
    assert one(spark, at, lambda c: times.ts_ms(times.lookback_start(c, 1000)), "timestamp_ntz") == 1746446399000


def test_string_escapes_round_trip(spark):
    for raw in ['plain', 'a "q" b', 'tab\there', 'line\nbreak\r', 'back\\slash', '\\n literal', 'é 😀', '\\\\"']:
        assert one(spark, raw, lambda c: literals.unescape(literals.escape(c))) == raw
    assert one(spark, r"é\U0001F600\\U0001F600", literals.unescape) == "é😀\\U0001F600"


def test_numbers(spark):
    assert one(spark, "-22.0", literals.number) == -22.0
    assert one(spark, "Date", literals.number) is None


BASE_QUERY = ("REGISTER RStream <out> AS SELECT {select} FROM NAMED WINDOW <w> ON STREAM <http://s/> [RANGE 10 STEP 5] "
              "WHERE {{ WINDOW <w> {{ ?s <http://v> ?o . ?s <http://k> ?k . {block} }} {filter} }} {end}")


def keys_of(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, query_text string")
    out = query_text.with_equivalence_key(df).orderBy("i").collect()
    return [r["query_key"] for r in out]


def test_different_queries_have_different_keys(spark):
    def q(select="(MAX(?o) AS ?m)", block="", filter="", end=""):
        return BASE_QUERY.format(select=select, block=block, filter=filter, end=end)

    texts = [q(), q(filter="FILTER(?o > 5)"), q(filter="FILTER(?o > 9)"), q(end="HAVING(?m > 3)"), q(end="GROUP BY ?k"),
             q("?k (MAX(?o) AS ?m)", end="GROUP BY ?k"), q("?k (MIN(?o) AS ?m)", end="GROUP BY ?k"), q("(MAX(?o) AS ?m) (COUNT(?o) AS ?n)"),
             q("(COUNT(?o) AS ?m)"), q("(COUNT(DISTINCT ?o) AS ?m)"), q("(MAX(?k) AS ?m)"), q(block="OPTIONAL { ?s <http://z> ?z }"),
             q(filter="FILTER(?k = \"?o\")"), q(filter="FILTER(?k = \"?x\")"), q(filter="OPTIONAL { WINDOW <w> { ?s <http://z> ?z } }"),
             q().replace("STEP 5", "STEP five"), q().replace("STEP 5", "STEP six"), q(filter="FILTER(x:f(?o))"),
             "PREFIX x: <http://a/> " + q(filter="FILTER(x:f(?o))"), "PREFIX x: <http://b/> " + q(filter="FILTER(x:f(?o))"),
             q().replace("RStream", "IStream"), q(end="LIMIT 3"), q("DISTINCT ?o")]
    keys = keys_of(spark, texts)
    assert len(set(keys)) == len(texts)


def test_same_query_in_another_form_has_the_same_key(spark):
    one = BASE_QUERY.format(select="(MAX(?o) AS ?m)", block="", filter="FILTER(?o > 5)", end="GROUP BY ?k")
    two = ("# a comment\nregister   rstream <other> as\nselect ( max(?a) as ?b )\nfrom named window <win> on stream <http://s/>\n"
           "[ range 10 step 5 ] where {\n window <win> { ?x <http://k> ?y . $x <http://v> $a } filter ( ?a > 5 ) } group by ?y")
    three = one.replace("<http://v>", "v:").replace("<http://k>", "p:k").replace("REGISTER", "PREFIX v: <http://v> PREFIX p: <http://> REGISTER")
    assert len(set(keys_of(spark, [one, two, three]))) == 1


def pattern_query(patterns, order, names, select="(COUNT(*) AS ?n)"):
    body = " . ".join(f"?{names[a]} {p} ?{names[b]}" for a, p, b in order)
    return ("REGISTER RStream <out> AS SELECT " + select + " FROM NAMED WINDOW <w> ON STREAM <http://s/> [RANGE 10 STEP 5] "
            "WHERE { WINDOW <w> { " + body + " } }")


SHAPES = {
    "cycle of 4": [(0, "<p>", 1), (1, "<p>", 2), (2, "<p>", 3), (3, "<p>", 0)],
    "two cycles of 3": [(0, "<p>", 1), (1, "<p>", 2), (2, "<p>", 0), (3, "<p>", 4), (4, "<p>", 5), (5, "<p>", 3)],
    "cycle of 6": [(i, "<p>", (i + 1) % 6) for i in range(6)],
    "star of 8": [(0, "<p>", i) for i in range(1, 9)],
    "K3,3 less one": [(i, "<p>", j) for i in range(3) for j in range(3, 6) if (i, j) != (2, 5)],
    "K2,4": [(i, "<p>", j) for i in range(2) for j in range(2, 6)],
    "path": [(i, "<p>", i + 1) for i in range(5)],
    "path of two kinds": [(i, "<p>" if i % 2 else "<q>", i + 1) for i in range(5)],
    "there and back": [(0, "<p>", 1), (1, "<p>", 0), (2, "<p>", 3), (3, "<p>", 2)],
    "K3,3": [(i, "<p>", j) for i in range(3) for j in range(3, 6)],
}


def test_symmetric_patterns_have_one_key(spark):
    """Any names and any order give one key; near misses stay apart."""
    rng = random.Random(4)
    rows = []
    for shape, patterns in SHAPES.items():
        size = 1 + max(max(a, b) for a, _, b in patterns)
        for _ in range(6):
            names, order = rng.sample("abcdefghijklmopq", size), list(patterns)
            rng.shuffle(order)
            rows.append((shape, pattern_query(patterns, order, names)))
    found = query_text.with_equivalence_key(spark.createDataFrame(rows, "shape string, query_text string"))
    by = {}
    for r in found.select("shape", "query_key").collect():
        by.setdefault(r.shape, set()).add(r.query_key)
    assert {shape: len(keys) for shape, keys in by.items()} == dict.fromkeys(SHAPES, 1)
    assert len(set.union(*by.values())) == len(SHAPES)


def test_names_around_the_patterns_count(spark):
    """In a symmetric pattern a selected variable tells which one is meant."""
    cycle, names = SHAPES["cycle of 4"], "abcd"
    ask = lambda select, names=names: pattern_query(cycle, cycle, names, select)
    texts = {"a": ask("(MAX(?a) AS ?m)"), "c": ask("(MAX(?c) AS ?m)"), "renamed": ask("(MAX(?x) AS ?m)", "xyzw"),
             "two": ask("(MAX(?a) AS ?m) (MIN(?b) AS ?k)"), "two turned": ask("(MAX(?b) AS ?m) (MIN(?c) AS ?k)"),
             "two apart": ask("(MAX(?a) AS ?m) (MIN(?c) AS ?k)")}
    df = spark.createDataFrame(list(texts.items()), "name string, query_text string")
    key = {r.name: r.query_key for r in query_text.with_equivalence_key(df).collect()}
    assert key["a"] == key["c"] == key["renamed"] and key["two"] == key["two turned"]
    assert len({key["a"], key["two"], key["two apart"]}) == 3


def test_texts_are_read_in_few_passes(spark):
    """Keywords of any case between names that hold them, and symbols after $: one split and one extraction for all keywords."""
    head = "REGISTER RStream <o> AS {} FROM NAMED WINDOW <w> ON STREAM <s> [RANGE 10 STEP 5] WHERE {{ WINDOW <w> {{ ?s <p> ?v }} {}}} {}"
    texts = [head.format("SELECT (AVG(?v) AS ?r)", "", "GROUP BY ?s"), head.format("select (avg($x) as $y)", "", "group By $t").replace("?s <p> ?v", "$t <p> $x"),
             head.format("SELECT (GROUP_CONCAT(?v) AS ?r)", "", ""), head.format("sElect (group_concat(?v) As ?r)", "", ""),
             head.format("SELECT (AVG(?v) AS ?avg)", "", ""), head.format("SELECT (AVG(?v) AS ?AVG)", "", ""), head.format("", "", "")]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, query_text string")
    keyed = query_text.with_equivalence_key(df)
    keys = [r.query_key for r in keyed.orderBy("i").collect()]
    assert keys[0] == keys[1] and keys[2] == keys[3] and keys[4] == keys[5] and len({keys[i] for i in (0, 2, 4, 6)}) == 4
    plan = keyed._jdf.queryExecution().optimizedPlan().toString()
    assert sum(plan.count(f"){w}(?!") for w in query_text.KEYWORDS) == 0  # no pattern for each keyword
    # One pass over the text for each form, the rest reads matches.
    assert plan.count("regexp_extract_all(_text") <= 3 and plan.count("regexp_extract_all(sparql") <= 1
