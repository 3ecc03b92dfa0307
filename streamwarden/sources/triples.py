"""Triples in: N-Triples text, whole documents and plain observation tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import vocab
from ..functions import literals, times

TERM_COLUMNS = ["s", "s_kind", "p", "o", "o_kind", "o_datatype", "o_lang"]


def _terms(parts: Column) -> list[Column]:
    """Columns of a statement from its eight groups; a group that is absent is ''."""
    def filled(i: int) -> Column:
        return F.when(parts[i] != "", parts[i])

    iri_subject, iri_object, blank_object = parts[0] != "", parts[3] != "", parts[4] != ""
    return [
        F.when(iri_subject, parts[0]).otherwise(parts[1]).alias("s"),
        F.when(iri_subject, F.lit("iri")).otherwise(F.lit("blank")).alias("s_kind"),
        parts[2].alias("p"),
        F.when(iri_object, parts[3]).when(blank_object, parts[4]).otherwise(literals.unescape(parts[5])).alias("o"),
        F.when(iri_object, F.lit("iri")).when(blank_object, F.lit("blank")).otherwise(F.lit("literal")).alias("o_kind"),
        filled(6).alias("o_datatype"), filled(7).alias("o_lang"),
    ]


def ntriples_lines(docs: DataFrame, text: str = "body") -> DataFrame:
    """One row per statement line with its number in the document; blanks and comments dropped."""
    return docs.select(
        *[c for c in docs.columns if c != text],
        F.posexplode(F.split(text, r"\r?\n", -1)).alias("seq", "line"),
    ).where(F.trim("line") != "").where(~F.startswith(F.trim("line"), F.lit("#")))


def ntriples_ingest(docs: DataFrame, text: str = "body") -> tuple[DataFrame, DataFrame]:
    """(triples, quarantine). Keeps the other columns; lines that are no triple are set aside.

    Labels of blank nodes are as written and hold inside their document; ``scoped`` makes them unique.
    """
    lines = ntriples_lines(docs, text)
    kept = [c for c in lines.columns if c != "line"]
    # One regex pass: a statement becomes its groups, one per line. A line has no
    # line break of its own, so what does not match stays in one piece.
    groups = "\n".join(f"${i}" for i in range(1, 9))
    marked = lines.withColumn("_parts", F.split(F.regexp_replace("line", literals.TRIPLE_LINE, groups), "\n", -1))
    whole = F.size("_parts") == 8
    return marked.where(whole).select(*kept, *_terms(F.col("_parts"))), marked.where(~whole).select(
        *kept, "line", F.lit("not a triple").alias("reason"))


def scoped(triples: DataFrame) -> DataFrame:
    """Blank labels with a hash of their document, so that equal labels of two documents differ."""
    def own(term: str) -> Column:
        return F.when(F.col(f"{term}_kind") == "blank", F.concat_ws("-", term, F.md5("resource_id"))).otherwise(F.col(term))

    return triples.withColumns({"s": own("s"), "o": own("o")})


def tolerant_read(docs: DataFrame, text: str = "body", media_type: str = "content_type",
                  status: str = "status", accepted: str = "text/turtle") -> tuple[DataFrame, DataFrame]:
    """(readable, quarantine): one faulty document never stops the rest.

    A missing status or media-type column is taken as good.
    """
    checks = F.lit(None).cast("string")
    empty = F.col(text).isNull() | (F.col(text) == "")
    checks = F.when(empty, F.lit("empty"))
    if media_type in docs.columns:
        checks = F.when(~F.col(media_type).eqNullSafe(accepted), F.lit("wrong media type")).otherwise(checks)
    if status in docs.columns:
        checks = F.when(~F.col(status).eqNullSafe(200), F.lit("not found")).otherwise(checks)
    marked = docs.withColumn("reason", checks)
    return marked.where(F.col("reason").isNull()).drop("reason"), marked.where(F.col("reason").isNotNull())


def read_text_documents(spark, path: str, pattern: str = "*.nt") -> DataFrame:
    """Files as documents (resource_id, body); files that vanish or break are passed over."""
    return (
        spark.read.option("ignoreMissingFiles", "true").option("ignoreCorruptFiles", "true")
        .option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").option("wholetext", "true")
        .text(path).select(F.input_file_name().alias("resource_id"), F.col("value").alias("body"))
    )


def _first_object(body: Column, predicate: str) -> Column:
    """Object of the first statement with this predicate in a document; one regex pass."""
    pattern = (r"(?m)^\s*(?:<[^>]*>|_:\S+)\s*<" + r"\Q" + predicate + r"\E"
               + r">\s*(<[^>]*>|" + literals.STRING.replace("(", "(?:", 1) + r")")
    term = F.regexp_extract(body, pattern, 1)
    inside = F.substr(term, F.lit(2), F.length(term) - 2)
    return F.when(F.startswith(term, F.lit("<")), inside).when(F.startswith(term, F.lit('"')), literals.unescape(inside))


def observations_from_documents(docs: DataFrame, text: str = "body", time_path: str = vocab.HAS_TIMESTAMP
                                ) -> DataFrame:
    """One row per document, read in place: no shuffle, so it also runs on a stream.

    The event time is the first ``time_path`` value of the document.
    """
    body = F.col(text)
    return docs.select(
        *[c for c in docs.columns if c != text],
        _first_object(body, vocab.RELATES_TO).alias("property"),
        _first_object(body, vocab.HAS_VALUE).try_cast("double").alias("value"),
        times.event_time(_first_object(body, time_path)).alias("event_time"),
    )


def usable(observations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(usable, quarantine): a row needs a time and a numeric value."""
    reason = F.when(F.col("event_time").isNull(), F.lit("no event time")).when(
        F.col("value").isNull(), F.lit("no numeric value"))
    marked = observations.withColumn("reason", reason)
    return marked.where(F.col("reason").isNull()).drop("reason"), marked.where(F.col("reason").isNotNull())


def with_event_time(triples: DataFrame, time_path: str = vocab.HAS_TIMESTAMP,
                    per_timestamp: bool = False) -> DataFrame:
    """Give all quads of a resource the time of its first ``time_path`` triple.

    ``per_timestamp`` repeats the resource once for each of its times instead.
    Resources without a time drop out.
    """
    stamps = triples.where(F.col("p") == time_path).select(
        "resource_id", times.event_time("o").alias("event_time"), *(["seq"] if "seq" in triples.columns else []))
    if per_timestamp:
        found = stamps.select("resource_id", "event_time").distinct()
    else:
        order = F.struct("seq", "event_time") if "seq" in triples.columns else F.col("event_time")
        found = stamps.groupBy("resource_id").agg(F.min_by("event_time", order).alias("event_time"))
    return triples.drop("event_time").join(found.where(F.col("event_time").isNotNull()), "resource_id")


def observations_to_triples(observations: DataFrame) -> DataFrame:
    """Value, property and time triple of each observation, without a shuffle."""
    def term(p: str, o: Column, kind: str, datatype: str | None) -> Column:
        return F.struct(F.lit(p).alias("p"), o.alias("o"), F.lit(kind).alias("o_kind"),
                        F.lit(datatype).cast("string").alias("o_datatype"))

    return observations.select(
        "resource_id", "stream", F.col("resource_id").alias("s"), F.lit("iri").alias("s_kind"),
        F.explode(F.array(
            term(vocab.HAS_VALUE, F.col("value").cast("string"), "literal", vocab.XSD_FLOAT),
            term(vocab.RELATES_TO, F.col("property"), "iri", None),
            term(vocab.HAS_TIMESTAMP, times.iso_utc("event_time"), "literal", vocab.XSD_DATETIME),
        )).alias("t"), "event_time",
    ).select("resource_id", "stream", "s", "s_kind", "t.*", F.lit(None).cast("string").alias("o_lang"), "event_time")


def prefix_table(triples: DataFrame, url: str | None = None) -> DataFrame:
    """(prefix, namespace) from preferred-prefix triples with a plain string; '' for ``url#``."""
    found = triples.where(
        (F.col("p") == vocab.PREFIX_TERM) & (F.col("o_kind") == "literal") & (F.col("o") != "")
        & F.col("o_lang").isNull()
        & (F.col("o_datatype").isNull() | (F.col("o_datatype") == vocab.XSD_STRING))
    ).select(F.col("o").alias("prefix"), F.col("s").alias("namespace"))
    if url is None:
        return found
    own = triples.sparkSession.createDataFrame([("", url + "#")], found.schema)
    return found.unionByName(own)
