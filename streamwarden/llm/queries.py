"""One query for each operator, over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from .common import reach
from . import (collocations, decontaminate, fingerprints, language_id, mixing, ngram_join, resampling, sharding, substring_dedup, suffix_dedup,
               token_counts, token_files, url_filter)

BPE, PIECES = "word_bpe_49k.json", "piece_bpe_32k.model"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn
    return keep


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    reach(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@query()
def op1_fingerprints(spark, sf_dir):
    return fingerprints.edited_fingerprints(documents(spark, sf_dir))


@query()
def op2_sharding(spark, sf_dir):
    return sharding.shard_by_size(documents(spark, sf_dir), 8)


WEIGHTS = {"src0": 4.0}  # the first source counts four times as much as any other


@query("""
with d as (select *, octet_length(encode(coalesce(text, ''))) + 1 bytes,
                  md5(concat_ws(':', 'mix', coalesce(cast(doc_id as varchar), ''), md5(coalesce(text, '')))) h from documents),
s as (select source, sum(bytes) bytes, case when source = 'src0' then 4.0::double else 1.0::double end weight from d group by 1),
r as (select source, weight / (select sum(weight) from s) * (select sum(bytes) from s) / bytes rate from s),
k as (select source, rate, unnest(range(0, cast(ceil(rate + 12 * sqrt(rate) + 24) as bigint) + 1)) k from r),
p as (select *, exp(k * ln(rate) - rate - sum(ln(greatest(k, 1)::double)) over (partition by source order by k)) p from k),
c as (select source, k, sum(p) over (partition by source order by k) below from p),
n as (select d.doc_id, d.source, d.h, count(*) filter (where below <=
        (cast('0x' || substr(h, 1, 13) as bigint) + 0.5) / 4503599627370496.0) copies
      from d join c on d.source = c.source group by all)
select doc_id, source, cast(copies as int) copies, cast(copy as int) as copy,
       cast('0x' || substr(md5(h || ':' || copy), 1, 15) as bigint) shuffle_key
from (select *, unnest(range(0, copies)) as copy from n where copies > 0)
""")
def op3_mixing(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return mixing.mix(docs, WEIGHTS).select("doc_id", "source", "copies", "copy", "shuffle_key")


RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
         ("block", "net", "/es/"), ("block", "net", "/fr/")]


@query()
def op4_url_filter(spark, sf_dir):
    return url_filter.judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), RULES)


@query()
def op5_decontamination(spark, sf_dir):
    return decontaminate.leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@query()
def op6_ngram_join(spark, sf_dir):
    return ngram_join.join(documents(spark, sf_dir))


@query()
def op7_suffix_dedup(spark, sf_dir):
    return suffix_dedup.without_repeats(documents(spark, sf_dir))


@query()
def op8_language_id(spark, sf_dir):
    return language_id.identify(documents(spark, sf_dir), public_tokenizers.path(PIECES))


@query()
def op9_token_counts(spark, sf_dir):
    return token_counts.token_counts(documents(spark, sf_dir), public_tokenizers.path(BPE))


@query()
def op10_token_files(spark, sf_dir):
    return token_files.token_files(documents(spark, sf_dir), public_tokenizers.path(BPE))


@query("""
with d as (select coalesce(lang, 'und') lang, unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
             'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) piece from documents),
p as (select lang, list_filter(string_split_regex(piece, '[ \\t]'), lambda w: w <> '') ws from d),
w as (select lang, ws, unnest(range(1, len(ws) + 1)) i from p),
o as materialized (select lang, ws[i] w1, ws[i + 1] w2, ws[i + 2] w3 from w),
n as (select lang, count(*) n from o group by 1),
f1 as materialized (select lang, w1, count(*) f from o group by all),
f2 as materialized (select lang, w1, w2, count(*) f from o where w2 is not null group by all),
f3 as materialized (select lang, w1, w2, w3, count(*) f from o where w3 is not null group by all having count(*) >= 10),
c3 as (select c.lang, c.w1 || ' ' || c.w2 || ' ' || c.w3 phrase, c.f a, a1.f l1, b1.f r1, a2.f l2, b2.f r2,
         1000000::hugeint * c.f * c.f // (a1.f::hugeint * b1.f) s1, 1000000::hugeint * c.f * c.f // (a2.f::hugeint * b2.f) s2
       from f3 c join f1 a1 on a1.lang = c.lang and a1.w1 = c.w1
       join f2 b1 on b1.lang = c.lang and b1.w1 = c.w2 and b1.w2 = c.w3
       join f2 a2 on a2.lang = c.lang and a2.w1 = c.w1 and a2.w2 = c.w2
       join f1 b2 on b2.lang = c.lang and b2.w1 = c.w3),
c2 as (select c.lang, c.w1, c.w2, c.f a, a1.f l, b1.f r, 1000000::hugeint * c.f * c.f // (a1.f::hugeint * b1.f) score
       from f2 c join f1 a1 on a1.lang = c.lang and a1.w1 = c.w1 join f1 b1 on b1.lang = c.lang and b1.w1 = c.w2
       where c.f >= 10),
longer as (select lang, w1, w2, max(f) f from (select lang, w1, w2, f from f3 union all select lang, w2, w3, f from f3) group by all),
found as (select c2.lang, c2.w1 || ' ' || c2.w2 phrase, a, l, r, score from c2 left join longer x using (lang, w1, w2)
          where x.f is null or 100 * x.f < 50 * a
          union all select lang, phrase, a, if(s1 <= s2, l1, l2), if(s1 <= s2, r1, r2), least(s1, s2) from c3),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from found)
select lang, rank, phrase, a, l, r, n, score::bigint score from ranked join n using (lang) where rank <= 2000
""")
def op11_collocations(spark, sf_dir):
    return collocations.collocations(documents(spark, sf_dir))


@query()
def op12_substring_dedup(spark, sf_dir):
    return substring_dedup.without_repeats(documents(spark, sf_dir))


@query()
def op13_resampling(spark, sf_dir):
    return resampling.resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
