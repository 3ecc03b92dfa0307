"""Window results as aggregation events: rows, triples and envelopes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import vocab
from ..functions import times


def construct(results: DataFrame, query_hash: Column, value: str, streams: Column,
              generated_at: Column | None = None, random_ids: bool = False, by: list[str] = ()) -> DataFrame:
    """One event per result row.

    The id is a hash of query, window and group, so a repeated task or batch gives
    the same event; ``random_ids`` draws a fresh one instead.
    """
    stable = F.md5(F.concat_ws("|", query_hash, times.iso_utc("window_start"), times.iso_utc("window_end"),
                               *[F.col(c).cast("string") for c in by]))
    return results.select(
        (F.uuid() if random_ids else stable).alias("event_id"), query_hash.alias("query_hash"),
        F.col(value).cast("double").alias("value"), "window_start", "window_end",
        (generated_at if generated_at is not None else F.current_timestamp()).alias("generated_at"),
        streams.alias("streams"), *by)


def to_triples(events: DataFrame, base: str = vocab.EVENT_BASE, agent: str = vocab.AGGREGATOR_AGENT) -> DataFrame:
    """Six triples per event and one per source stream."""
    def term(p: str, o: Column, kind: str, datatype: str | None) -> Column:
        return F.struct(F.lit(p).alias("p"), o.alias("o"), F.lit(kind).alias("o_kind"),
                        F.lit(datatype).cast("string").alias("o_datatype"))

    fixed = F.array(
        term(vocab.RDF_TYPE, F.lit(vocab.MEASUREMENT), "iri", None),
        term(vocab.HAS_TIMESTAMP, times.iso_utc("generated_at"), "literal", vocab.XSD_DATETIME),
        term(vocab.HAS_VALUE, F.col("value").cast("string"), "literal", vocab.XSD_FLOAT),
        term(vocab.PROV_DERIVED, F.lit(agent), "iri", None),
        term(vocab.RSP_STARTED, times.iso_utc("window_start"), "literal", vocab.XSD_DATETIME),
        term(vocab.RSP_ENDED, times.iso_utc("window_end"), "literal", vocab.XSD_DATETIME),
    )
    sources = F.transform("streams", lambda s: term(vocab.PROV_GENERATED_BY, s, "iri", None))
    return events.select(
        F.concat(F.lit(base), F.col("event_id")).alias("s"), F.lit("iri").alias("s_kind"),
        F.explode(F.concat(fixed, sources)).alias("t")).select(
        "s", "s_kind", "t.*", F.lit(None).cast("string").alias("o_lang"))


def envelope(results: DataFrame, payload: Column, start: Column, end: Column) -> DataFrame:
    """JSON message per result; from/to are the range of the query, not of the window."""
    return results.withColumn("message", F.to_json(F.struct(
        F.col("query_hash"), payload.alias("aggregation_event"),
        start.alias("aggregation_window_from"), end.alias("aggregation_window_to"))))
