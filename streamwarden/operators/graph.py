"""Set operations on triples, with RDF set semantics."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import literals
from .skew import null_safe_join

TERM = ["s", "s_kind", "p", "o", "o_kind", "o_datatype", "o_lang"]


def dedup(triples: DataFrame, within: list[str] = ()) -> DataFrame:
    """One row per distinct triple (per ``within``)."""
    return triples.dropDuplicates([*within, *[c for c in TERM if c in triples.columns]])


def union(*graphs: DataFrame) -> DataFrame:
    """Distinct triples of all graphs."""
    columns = [c for c in TERM if all(c in g.columns for g in graphs)]
    out = graphs[0].select(*columns)
    for graph in graphs[1:]:
        out = out.unionByName(graph.select(*columns))
    return out.distinct()


def union_streams(*streams: DataFrame) -> DataFrame:
    """All rows of several streams of one query."""
    out = streams[0]
    for stream in streams[1:]:
        out = out.unionByName(stream)
    return out


def insert_data(graph: DataFrame, new: DataFrame) -> DataFrame:
    return union(graph, new)


def delete_data(graph: DataFrame, gone: DataFrame) -> DataFrame:
    """Triples of ``graph`` not in ``gone``; terms compare null-safe."""
    keys = [c for c in TERM if c in graph.columns and c in gone.columns]
    return null_safe_join(graph, gone.select(*keys), keys, "left_anti")


def delete_text(triples: DataFrame) -> DataFrame:
    """Update text of each triple."""
    return triples.select(F.concat(F.lit("DELETE DATA {"), literals.triple_text(), F.lit("\n}")).alias("update"))


def insert_text(triples: DataFrame) -> DataFrame:
    return triples.select(F.concat(F.lit("INSERT DATA {"), literals.triple_text(), F.lit("\n}")).alias("update"))
