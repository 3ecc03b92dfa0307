"""Writing members and results into time buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import vocab
from ..functions import literals, times
from ..operators import buckets as ops, graph, skew
from ..sources.triples import scoped
from ..session import cut


def append_to_buckets(members: DataFrame, path: str, ts: str = "event_time", mode: str = "append") -> None:
    """Append without dedup, laid out for time scans.

    A bucket holds about 20 rows, so a directory per bucket would mean billions of
    tiny files. Files are partitioned by day and sorted by stream, bucket and time:
    the day prunes directories and file statistics prune the rest. The range
    shuffle splits a busy day or bucket over many tasks, the hash of the row even
    one single time.
    """
    order = [c for c in ("stream", "bucket", ts) if c in members.columns]
    day = members.withColumn("day", F.to_date(ts))
    cols = [*[F.col(c) for c in ("day", *order)], F.xxhash64(*[F.col(c) for c in members.columns])]
    day.repartitionByRange(*cols).sortWithinPartitions("day", *order).write.mode(mode).partitionBy("day").parquet(path)


def publish(results: DataFrame, path: str, keys: list[str], container: str, ts: str, order: list[str],
            n: int = ops.SIZE) -> DataFrame:
    """Write full batches of ``n`` to the bucket of their last row; returns the held-back rows."""
    marked = cut(ops.mark_batches(results, keys, order, n))
    full = ops.batch_buckets(marked.where("complete").drop("complete"), keys, container, ts, order)
    append_to_buckets(full, path, ts)
    return marked.where("not complete").select(*results.columns)


def source_links(stored: DataFrame, subject: str = "s", location: str = "location") -> DataFrame:
    """(subject, dct:source, location) for every stored resource."""
    return stored.select(
        F.col(subject).alias("s"), F.lit("iri").alias("s_kind"), F.lit(vocab.DCT_SOURCE).alias("p"),
        F.col(location).alias("o"), F.lit("iri").alias("o_kind"),
        F.lit(None).cast("string").alias("o_datatype"), F.lit(None).cast("string").alias("o_lang")).distinct()


def latest_pointer(triples: DataFrame, numeric: bool = True) -> DataFrame:
    """Replace a stream's inbox pointers by the latest one.

    Numeric: the greatest epoch in the pointers' URLs, appended to the stream.
    Otherwise: the greatest pointer by text order.
    """
    is_pointer = F.col("p") == vocab.LDP_INBOX
    pointers = triples.where(is_pointer).groupBy("s")
    if numeric:
        epoch = F.try_element_at(F.split("o", "/", -1), F.lit(-2)).try_cast("bigint")
        latest = pointers.agg(F.max(epoch).alias("_t")).where(F.col("_t").isNotNull()).select(
            "s", F.concat("s", F.col("_t").cast("string"), F.lit("/")).alias("o"))
    else:
        latest = pointers.agg(F.max("o").alias("o"))
    fresh = latest.withColumn("p", F.lit(vocab.LDP_INBOX))
    return triples.where(~is_pointer).select("s", "p", "o").unionByName(fresh.select("s", "p", "o"))


def bucket_description(buckets: DataFrame, time_path: str = vocab.HAS_TIMESTAMP,
                       version_path: str = vocab.VERSION_OF) -> DataFrame:
    """Description triples: stream header, one relation per bucket, inbox (the newest bucket)."""
    def t(s: Column, s_kind: str, p: str, o: Column, o_kind: str = "iri", datatype: str | None = None) -> Column:
        return F.struct(s.alias("s"), F.lit(s_kind).alias("s_kind"), F.lit(p).alias("p"), o.alias("o"),
                        F.lit(o_kind).alias("o_kind"), F.lit(datatype).cast("string").alias("o_datatype"))

    stream, root = F.concat("stream", F.lit("#EventStream")), F.col("stream")
    node = F.md5(F.concat_ws("|", "stream", "bucket"))
    relations = buckets.select(F.explode(F.array(
        t(root, "iri", vocab.TREE_RELATION, node, "blank"),
        t(node, "blank", vocab.RDF_TYPE, F.lit(vocab.TREE_GREATER_EQ)),
        t(node, "blank", vocab.TREE_NODE, F.col("bucket")),
        t(node, "blank", vocab.TREE_PATH, F.lit(time_path)),
        t(node, "blank", vocab.TREE_VALUE, times.iso_utc("lower_ts"), "literal", vocab.XSD_DATETIME),
    )).alias("t")).select("t.*")
    header = buckets.groupBy("stream").agg(F.max_by("bucket", F.struct("lower_ts", "bucket")).alias("inbox")).select(
        F.explode(F.array(
            t(stream, "iri", vocab.RDF_TYPE, F.lit(vocab.LDES_STREAM)),
            t(stream, "iri", vocab.LDES_TIMESTAMP_PATH, F.lit(time_path)),
            t(stream, "iri", vocab.LDES_VERSION_OF_PATH, F.lit(version_path)),
            t(stream, "iri", vocab.TREE_VIEW, root),
            t(root, "iri", vocab.RDF_TYPE, F.lit(vocab.TREE_NODE_CLASS)),
            t(root, "iri", vocab.LDP_INBOX, F.col("inbox")),
        )).alias("t")).select("t.*")
    return header.unionByName(relations).withColumn("o_lang", F.lit(None).cast("string"))


def export(triples: DataFrame, prefixes: dict[str, str] | None = None, objects_per_line: int = 1000) -> DataFrame:
    """Turtle statements (s, p, part, text) with object lists, prefixes and inlined blank nodes.

    Objects of one subject and predicate are deduplicated and sorted. A list longer
    than ``objects_per_line`` goes on in a further statement, which means the same
    and keeps every task's memory bounded. A blank object becomes one ``[p o]`` per
    property it has; with a ``resource_id`` column, those that its own document states. Write with ``write_text``.
    """
    if "resource_id" in triples.columns:
        triples = scoped(triples)
    prefixes = prefixes or {}

    def short(iri: Column) -> Column:
        out = F.concat(F.lit("<"), iri, F.lit(">"))
        # Longer namespaces are tried first.
        for prefix, ns in sorted(prefixes.items(), key=lambda kv: len(kv[1])):
            local = F.substr(iri, F.lit(len(ns) + 1))
            fits = F.startswith(iri, F.lit(ns)) & local.rlike(r"^[A-Za-z_][A-Za-z0-9_\-]*$")
            out = F.when(fits, F.concat(F.lit(prefix + ":"), local)).otherwise(out)
        return out

    def term(pre: str = "") -> Column:
        kind, value = F.col(pre + "o_kind"), F.col(pre + "o")
        typed = F.when(F.col(pre + "o_datatype").isNotNull() & (F.col(pre + "o_datatype") != vocab.XSD_STRING),
                       F.concat(literals.literal_text(value), F.lit("^^"), short(F.col(pre + "o_datatype"))))
        return (F.when(kind == "iri", short(value)).when(kind == "blank", F.concat(F.lit("_:"), value))
                .otherwise(F.coalesce(typed, literals.literal_text(value, None, F.col(pre + "o_lang")))))

    distinct = graph.dedup(triples.select(*graph.TERM))
    named = distinct.where(F.col("s_kind") != "blank")
    inner = distinct.where(F.col("s_kind") == "blank").select(
        F.col("s").alias("_b"), F.concat(F.lit("["), short(F.col("p")), F.lit(" "), term(), F.lit("]")).alias("_inline"))
    plain = named.where(F.col("o_kind") != "blank").select("s", "p", term().alias("_o"))
    nested = named.where(F.col("o_kind") == "blank").join(inner, F.col("o") == F.col("_b"), "left").select(
        "s", "p", F.coalesce("_inline", F.lit("[]")).alias("_o"))
    objects = plain.unionByName(nested)
    placed = skew.positions(objects, ["s", "p"], ["_o"], "_pos")
    return (
        placed.groupBy("s", "p", F.expr(f"div(_pos - 1, {objects_per_line})").alias("part"))
        .agg(F.array_join(F.array_sort(F.collect_list("_o")), ", ").alias("_list"))
        .select("s", "p", "part", F.concat(short(F.col("s")), F.lit(" "), short(F.col("p")), F.lit(" "),
                                          "_list", F.lit(" .")).alias("text"))
    )


def write_text(statements: DataFrame, path: str, mode: str = "overwrite") -> None:
    order = ["s", "p", "part"]
    statements.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order).select(
        "text").write.mode(mode).text(path)
