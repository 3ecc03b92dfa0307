import re

import pytest

import corpus_pipeline
from streamwarden.llm import url_filter
from streamwarden.llm.queries import RULES


URLS = ["http://WWW.Example.com/en/1", "https://shop.example.com/en/2?x=1", "https://www.example.com/en/", "https://example.com/fr/",
        "http://a.net/es/1", "http://a.net/fr", "http://notexample.com/en/", "http://x.org", "no scheme", "", None, "a://b://c/d",
        "http://casino-win.example.org/en/5", "http://user@host.net:80/fr/x#y", "http://host.org?q=/p", "http://é.net/fr/\n1"]


def by_hand(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest, re.S)[0]
    path = re.match(r"[^?#]*", rest[len(host):], re.S)[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    rule = max(fits)[1:] if fits else (None, None)
    return host, path, rule[0], rule[1]


def test_rules(spark):
    pages = spark.createDataFrame([(i, u, "rule", "host") for i, u in enumerate(URLS)] + [(None, URLS[0], None, None)] * 2,
                                  "page_id long, url string, rule string, host string")
    got = url_filter.judge(pages, RULES).collect()
    assert len(got) == len(URLS) + 2
    for r in got:
        host, path, rule, verdict = by_hand(URLS[r["page_id"] or 0])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == (verdict or ("block" if r["blocked_chance"] > 0.5 else "allow"))
    assert url_filter.judge(pages.limit(0), RULES).count() == 0


# Hosts that are not in the training table: the ones of earlier rounds' tests and probes, and others.
UNSEEN_BLOCKED = ["casino-club.example.org", "poker-win.example.net", "betting4u.example.org", "payday-loans.example.net", "ads-tracker.example.org",
                  "casinoland.example.org", "poker-hall.example.net", "spam-farm.example.com", "gambling.example.net", "viagra-shop.example.org",
                  "casino-win.example.org", "phishing-login.example.com", "royalslots.net", "xxxfilms.org", "adultcams.com",
                  "jackpotparty.net", "pillsdirect.org", "loans-quick.com", "pornstar-clips.net", "verify-login-account.org"]
UNSEEN_ALLOWED = ["thering.example.org", "ththan.example.net", "gardening.example.org", "oldmuseum.example.net", "northernnews.example.org",
                  "univ-berlin.example.org", "wikipedia.example.net", "ththst.example.com", "tionsh.example.com", "blog.thther.example.net",
                  "science-library.org", "villagebakery.net", "historyforum.com", "weather-station.org", "riverside-school.net",
                  "mothers-kitchen.com", "cs.univ-rome.example.com", "townorchestra.org", "python-docs.net", "treefarm.example.org"]
MISSED = {"viagra-shop.example.org", "treefarm.example.org"}


def test_regression_tells_unseen_urls(spark):
    sites = {s for kind in (url_filter.BLOCKED_SITES, url_filter.ALLOWED_SITES) for s in kind.split()}
    assert not sites & {*UNSEEN_BLOCKED, *UNSEEN_ALLOWED}
    urls = [f"https://{front}{h}/en/{i}" for i, h in enumerate(UNSEEN_BLOCKED + UNSEEN_ALLOWED) for front in ("", "www.")]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge(pages, []).collect()}
    n = 2 * len(UNSEEN_BLOCKED)
    wrong = {u.split("/")[2].removeprefix("www.") for i, u in enumerate(urls) if got[i] != ("block" if i < n else "allow")}
    assert wrong <= MISSED  # 38 of 40 hosts; the table was not changed to catch them


def test_training_table_is_stated_and_even(spark):
    blocked, allowed = url_filter.BLOCKED_SITES.split(), url_filter.ALLOWED_SITES.split()
    assert len(set(blocked)) == len(blocked) and len(set(allowed)) == len(allowed) and not set(blocked) & set(allowed)
    assert url_filter.training_table(spark).groupBy("label").count().count() == 2


@pytest.fixture(scope="module")
def stages(spark, sf):
    docs = [spark.read.parquet(f"{sf}/documents.parquet")]
    from streamwarden.session import cut
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs.append(cut(stage(spark, docs[-1], sf)))
    return docs


def test_stages_keep_the_columns_of_documents(stages):
    assert all(d.columns == stages[0].columns for d in stages)


def test_language_stage_decides(spark, sf):
    """Missing labels are filled, a label that the text contradicts is corrected, others stay; without any label nothing with letters goes."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    long = docs.where("length(text) > 1500 and lang in ('en', 'fr')").orderBy("doc_id").limit(4).collect()
    wrong, blank = long[0]["doc_id"], long[1]["doc_id"]
    changed = docs.selectExpr("doc_id", "text", f"case when doc_id = {wrong} then 'es' when doc_id = {blank} then null else lang end as lang", "source", "n_chars")
    got = {r["doc_id"]: r["lang"] for r in corpus_pipeline.keep_languages(spark, changed, sf).collect()}
    assert (got[wrong], got[blank]) == (long[0]["lang"], long[1]["lang"])
    assert (got[long[2]["doc_id"]], got[long[3]["doc_id"]]) == (long[2]["lang"], long[3]["lang"])
    unlabelled = docs.selectExpr("doc_id", "text", "cast(null as string) as lang", "source", "n_chars")
    kept = corpus_pipeline.keep_languages(spark, unlabelled, sf)
    assert kept.columns == docs.columns
    assert kept.count() == sum(1 for r in docs.collect() if r["text"] and any(c.isalpha() for c in r["text"]))


def test_pipeline_against_brute_force(spark, sf, stages):
    from .test_text_operators import shingles
    raw, lang, single, clean, mixed = (sorted(d.collect(), key=lambda r: r["doc_id"]) for d in stages)
    assert [r["doc_id"] for r in lang] == [r["doc_id"] for r in raw if r["text"] and any(c.isalpha() for c in r["text"])]
    sets = {r["doc_id"]: set(shingles(r["text"])) for r in lang}
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            if b < a and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    assert [r["doc_id"] for r in single] == sorted({root(i) for i in sets})
    items = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    exact = {r["doc_id"] for r in single if any(t in r["text"] for t in items)}
    gone = {r["doc_id"] for r in single} - {r["doc_id"] for r in clean}
    assert exact <= gone and len(gone) <= len(exact) + 3
    assert {r["doc_id"] for r in mixed} <= {r["doc_id"] for r in clean}


def test_last_stage_returns_every_document(spark, sf, stages):
    name, last = corpus_pipeline.STAGES[-1]
    assert last(spark, stages[-1], sf).count() == stages[-1].count()
    assert corpus_pipeline.run(spark, sf).count() == stages[-1].count()


def test_pipeline_of_an_empty_table(spark, sf, stages):
    docs = stages[0].limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf).count() == 0
