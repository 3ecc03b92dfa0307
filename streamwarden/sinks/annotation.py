"""Description triples of a registered query (function, execution, stream, window)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import vocab

EXECUTION = "http://example.org/aggregation_function_execution"
FUNCTION = "http://example.org/aggregation_function"
RESULTS = "http://example.org/aggregation_result_stream"
PROBLEM = "http://example.org/continuous_monitoring"
IMPLEMENTATION = "http://example.org/stream_aggregation_function"
QUERY_BASE = "http://example.org/aggregation_query/"


def describe(catalog: DataFrame, start: Column, end: Column, executed_at: Column,
             parameters: str = vocab.PARAMETER_BASE, problem: str = PROBLEM,
             implementation: str = IMPLEMENTATION) -> DataFrame:
    """28 triples per catalogued query, from the query's own text.

    ``problem`` and ``implementation`` are neutral names by default; a service states its own.
    """
    query = F.concat(F.lit(QUERY_BASE), F.col("query_hash"))
    w = F.get("windows", F.lit(0))
    ex = "http://example.org/"

    def iri(value) -> tuple[Column, str, str | None, str | None]:
        return (F.lit(value) if isinstance(value, str) else value, "iri", None, None)

    def text(value: Column, datatype: str | None = None, lang: str | None = None):
        return (value.cast("string"), "literal", datatype, lang)

    # The description's terms, in the order in which it is read.
    rows = [
        (EXECUTION, vocab.RDF_TYPE, iri(vocab.FNO + "Execution")),
        (EXECUTION, vocab.FNO + "executes", iri(FUNCTION)),
        (EXECUTION, vocab.RSP_STREAMS, iri(w["stream"])),
        (EXECUTION, ex + "aggregation_start_time", text(start)),
        (EXECUTION, ex + "aggregation_end_time", text(end)),
        (EXECUTION, ex + "last_execution_time", text(executed_at, vocab.XSD_INTEGER)),
        (EXECUTION, ex + "aggregation_query", iri(query)),
        (FUNCTION, vocab.RDF_TYPE, iri(vocab.FNO + "Function")),
        (FUNCTION, vocab.FNO + "name", iri("aggregation_function")),
        (FUNCTION, vocab.DCT_DESCRIPTION,
         text(F.lit("A function that executes an aggregation function on a RDF stream of data"), lang="en")),
        (FUNCTION, vocab.FNO_HTTP + "solves", iri(problem)),
        (FUNCTION, vocab.FNO_HTTP + "expects", iri(parameters + "pod_url")),
        (FUNCTION, vocab.FNO_HTTP + "expects", iri(parameters + "aggregation_query")),
        (FUNCTION, vocab.FNO_HTTP + "expects", iri(parameters + "latest_minutes_to_monitor")),
        (FUNCTION, vocab.FNO_HTTP + "returns", iri(RESULTS)),
        (FUNCTION, vocab.FNO_HTTP + "implements", iri(implementation)),
        (RESULTS, vocab.RDF_TYPE, iri(vocab.FNO_HTTP + "OutputStream")),
        (RESULTS, vocab.RDF_TYPE, iri(vocab.SAO_STREAM_DATA)),
        (RESULTS, vocab.DCT_DESCRIPTION, text(F.lit(
            "The stream of generated aggregation data that is the result of the aggregation function"), lang="en")),
        (problem, vocab.RDF_TYPE, iri(vocab.FNO_HTTP + "Problem")),
        (parameters + "aggregation_query", vocab.RDF_TYPE, iri(vocab.FNO_HTTP + "Parameter")),
        (query, vocab.RDF_TYPE, iri(vocab.FNO_HTTP + "Query")),
        (query, "http://www.example.org/has_query_string", text(F.col("query_text"))),
        (query, "http://www.example.org/has_projection_variable", text(F.col("projection_var"))),
        (query, "http://www.example.org/has_window_name", iri(w["name"])),
        (query, "http://www.example.org/has_window_size", text(w["width_ms"], vocab.XSD_INTEGER)),
        (query, "http://www.example.org/has_window_slide", text(w["slide_ms"], vocab.XSD_INTEGER)),
        (query, "http://www.example.org/has_focus", iri(F.coalesce(F.try_element_at("focus", F.lit(-1)), F.lit("")))),
    ]
    triples = F.array(*[F.struct(
        (F.lit(s) if isinstance(s, str) else s).alias("s"), F.lit("iri").alias("s_kind"), F.lit(p).alias("p"),
        o.alias("o"), F.lit(kind).alias("o_kind"), F.lit(datatype).cast("string").alias("o_datatype"),
        F.lit(lang).cast("string").alias("o_lang")) for s, p, (o, kind, datatype, lang) in rows])
    return catalog.select("query_hash", F.explode(triples).alias("t")).select("query_hash", "t.*")
