"""A training corpus from ``documents``: language, near copies, benchmark leaks, mixture, token files.

Each stage takes (spark, docs, sf_dir) and works on all rows of ``docs``; the runner
writes a stage's rows as Parquet and reads them again for the next.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from streamwarden.llm import decontaminate, language_id, mixing, ngram_join, token_files
from streamwarden.llm.common import reach
from streamwarden.llm.queries import BPE, PIECES, WEIGHTS
from streamwarden.session import cut

SURE, LETTERS = 0.999, 200
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
ORACLE_SQL = None  # neither the language model nor the token files can be said in SQL


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language: a null text, or one without a letter.

    The prediction labels documents without a label, and corrects a label that it contradicts with a chance of ``SURE`` or
    more over ``LETTERS`` letters or more. Where no label could be learned, documents with letters stay as they are. An empty
    table gives no rows; repeated rows and null ids stay.
    """
    reach(spark)
    model = language_id.fit(docs, public_tokenizers.path(PIECES))
    if not model["langs"]:
        return docs.where(F.col("text").rlike(r"\p{L}")).select(*COLUMNS)
    known = language_id.predict(docs, model).where(F.col("lang_pred") != language_id.UNDETERMINED)
    long = F.length(F.regexp_replace("text", r"[^\p{L}]", "")) >= LETTERS
    sure = F.col("lang").isNull() | ((F.col("score") >= SURE) & long)
    return known.withColumn("lang", F.when(sure, F.col("lang_pred")).otherwise(F.col("lang"))).select(*COLUMNS)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of linked documents.

    Documents without words (null and empty texts too) are linked with nothing and stay; null ids come last; of equal rows
    one stays; an empty table gives no rows.
    """
    reach(spark)
    return ngram_join.one_of_each(docs).select(*COLUMNS)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item. Null, empty and wordless texts stay, equal texts go or stay together, and an
    empty benchmark drops nothing."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.without_leaks(docs, benchmark).select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or drops documents so that sources have their target weights, in shuffled order.

    A null source is one of its own, a null text weighs one byte, equal rows draw equal counts, an empty table gives no rows."""
    return mixing.mix(docs, WEIGHTS).select(*COLUMNS)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes Arrow token files and returns the documents as read back from them: one row for each, null texts as their end
    id alone; no rows for an empty table."""
    reach(spark)
    return token_files.token_files(docs, public_tokenizers.path(BPE))


STAGES = [("language_id", keep_languages), ("ngram_jaccard_join", one_of_each_group),
          ("benchmark_decontamination", without_benchmark), ("mixing", mixture), ("token_files", token_output)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
