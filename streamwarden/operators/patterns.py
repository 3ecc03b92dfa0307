"""Triple patterns and their joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .. import vocab
from ..functions import times


def match(triples: DataFrame, s: str | None = None, p: str | None = None, o: str | None = None,
          graph: str | None = None) -> DataFrame:
    """Triples that agree with every bound term; None matches anything."""
    bound = {"s": s, "p": p, "o": o, "stream": graph}
    return reduce(lambda df, b: df.where(F.col(b[0]) == b[1]),
                  [(c, v) for c, v in bound.items() if v is not None], triples)


def observation_shape(triples: DataFrame, time_path: str = vocab.HAS_TIMESTAMP) -> DataFrame:
    """The value, property and time triples of a subject as one row.

    Partial aggregation happens before the shuffle, so a subject with many triples
    is no problem. With several values of a predicate the first one counts (by
    ``seq`` if present, else the smallest); use ``join`` to get all combinations.
    """
    def first(predicate: str) -> Column:
        hit = F.col("p") == predicate
        if "seq" in triples.columns:
            return F.min_by(F.when(hit, F.col("o")), F.when(hit, F.struct("seq", "o")))
        return F.min(F.when(hit, F.col("o")))

    wanted = [vocab.HAS_VALUE, vocab.RELATES_TO, time_path]
    return (
        triples.where(F.col("p").isin(wanted)).groupBy("resource_id", "stream", "s")
        .agg(first(vocab.HAS_VALUE).alias("_v"), first(vocab.RELATES_TO).alias("property"),
             first(time_path).alias("_t"))
        .select("resource_id", "stream", F.col("s").alias("subject"), "property",
                F.col("_v").try_cast("double").alias("value"), times.event_time("_t").alias("event_time"))
    )


def bindings(triples: DataFrame, pattern: tuple[str, str, str], keep: list[str] = ()) -> DataFrame:
    """Distinct variable bindings of one pattern; variables start with '?'."""
    terms = dict(zip("spo", pattern))
    df = triples
    seen: dict[str, str] = {}
    for column, term in terms.items():
        if not term.startswith("?"):
            df = df.where(F.col(column) == term)
        elif term[1:] in seen:
            df = df.where(F.col(column) == F.col(seen[term[1:]]))
        else:
            seen[term[1:]] = column
    return df.select(*keep, *[F.col(c).alias(v) for v, c in seen.items()]).distinct()


def join(triples: DataFrame, patterns: list[tuple[str, str, str]], within: list[str] = ()) -> DataFrame:
    """Basic graph pattern: equi joins on shared variables, inside equal ``within`` columns.

    Patterns are taken in an order that always shares a variable with what has
    been joined; a pattern that shares none is refused instead of crossed.
    """
    todo = [bindings(triples, p, list(within)) for p in patterns]
    result = todo.pop(0)
    while todo:
        nxt = next((d for d in todo if set(d.columns) & set(result.columns) - set(within)), None)
        if nxt is None:
            raise ValueError("patterns share no variable")
        todo.remove(nxt)
        result = result.join(nxt, [c for c in result.columns if c in nxt.columns])
    return result


def optional(left: DataFrame, right: DataFrame) -> DataFrame:
    """OPTIONAL: left rows stay, with nulls where nothing matches."""
    return left.join(right, [c for c in left.columns if c in right.columns], "left")


def minus(left: DataFrame, right: DataFrame) -> DataFrame:
    """MINUS: left rows without a partner on the shared variables."""
    shared = [c for c in left.columns if c in right.columns]
    return left.join(right, shared, "left_anti") if shared else left


def container_metadata(triples: DataFrame) -> DataFrame:
    """A container's description without its content list."""
    return triples.where(F.col("p") != vocab.LDP_CONTAINS)
