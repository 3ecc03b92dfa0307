"""Continuous queries as Python specs, compiled to DataFrame plans."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
import hashlib
import re

from pyspark.sql import Column, DataFrame, functions as F

from .. import vocab
from ..operators import events, patterns, ranges, rules as rule_ops, windows

MODES = ("RStream", "IStream", "DStream")
# Predicates an observation table holds as columns.
OBSERVATION_COLUMNS = {vocab.HAS_VALUE: "value", vocab.RELATES_TO: "property", vocab.HAS_TIMESTAMP: "event_time"}


@dataclass(frozen=True)
class WindowSpec:
    name: str
    stream: str
    width_ms: int
    slide_ms: int


@dataclass(frozen=True)
class ContinuousQuery:
    """Windows, patterns (window name, s, p, o), filters (SQL on variables), aggregates and rules.

    Variables start with '?'. ``subjects_repeat`` asks for set semantics when
    several documents may state the same triple; observations never do.
    """

    name: str
    windows: tuple[WindowSpec, ...]
    patterns: tuple[tuple[str, str, str, str], ...]
    aggregates: tuple[windows.Agg, ...]
    group_by: tuple[str, ...] = ()
    filters: tuple[str, ...] = ()
    having: str | None = None
    emit: str = "RStream"
    rules: tuple = ()
    subjects_repeat: bool = False

    def __post_init__(self):
        if self.emit not in MODES:
            raise ValueError(f"unknown emit mode {self.emit!r}")
        if not self.windows:
            raise ValueError("a continuous query needs a window")

    def text(self) -> str:
        """Query text for the catalogue and the registry."""
        def term(t: str) -> str:
            return t if t.startswith(("?", '"')) else f"<{t}>"

        def agg(a: windows.Agg) -> str:
            fn = "COUNT" if a.fn == "count_distinct" else a.fn.upper()
            inner = a.column if a.column == "*" else ("DISTINCT " if a.fn == "count_distinct" else "") + f"?{a.column}"
            return f"({fn}({inner}) AS ?{a.alias})"

        lines = [f"REGISTER {self.emit} <{self.name}> AS",
                 "SELECT " + " ".join([*(f"?{g}" for g in self.group_by), *map(agg, self.aggregates)])]
        lines += [f"FROM NAMED WINDOW <{w.name}> ON STREAM <{w.stream}> [RANGE {w.width_ms} STEP {w.slide_ms}]"
                  for w in self.windows]
        lines.append("WHERE {")
        for w in self.windows:
            body = " . ".join(" ".join(map(term, p[1:])) for p in self.patterns if p[0] == w.name)
            lines.append(f"WINDOW <{w.name}> {{ {body} }}")
        lines += [f"FILTER({f})" for f in self.filters]
        lines.append("}")
        if self.group_by:
            lines.append("GROUP BY " + " ".join(f"?{g}" for g in self.group_by))
        if self.having:
            lines.append(f"HAVING({self.having})")
        return "\n".join(lines)

    def query_hash(self) -> str:
        return hashlib.md5(re.sub(r"\s", "", self.text()).encode()).hexdigest()

    def streams(self) -> list[str]:
        return list(dict.fromkeys(w.stream for w in self.windows))

    def over_triples(self, triples: DataFrame, own_documents: bool = False) -> DataFrame:
        """Results over a triples table. A window is a graph: its patterns join across documents.

        ``own_documents`` states that all triples of a subject are in one document. Patterns that
        share their subject then join by event time, before rows are dealt to windows.
        """
        def solutions(w: WindowSpec) -> DataFrame:
            own = triples.where(F.col("stream") == w.stream)
            stated = [p[1:] for p in self.patterns if p[0] == w.name]
            if len(stated) == 1 or own_documents and len({p[0] for p in stated}) == 1 and stated[0][0].startswith("?"):
                return patterns.join(own, stated, ["event_time"])
            dealt = windows.assign(own, "event_time", w.width_ms, w.slide_ms)
            return patterns.join(dealt, stated, ["window_start", "window_end"])

        return self._finish([solutions(w) for w in self.windows])

    def over_observations(self, observations: DataFrame) -> DataFrame:
        """The same over an observation table: patterns on one subject are columns, so nothing is joined.

        Also runs on a stream (with a watermark on ``event_time``): any emit mode, and several windows of own frames.
        """
        return self._finish([self._columns(observations, w) for w in self.windows])

    def _columns(self, observations: DataFrame, w: WindowSpec) -> DataFrame:
        df = observations.where(F.col("stream") == w.stream)
        # The event time stays a bare column: on a stream it carries the watermark.
        selected: dict[str, Column] = {"event_time": F.col("event_time")}
        for name, s, p, o in self.patterns:
            if name != w.name:
                continue
            if not s.startswith("?") or p not in OBSERVATION_COLUMNS:
                raise ValueError(f"{s} {p} {o} is not about an observation: use over_triples")
            column = OBSERVATION_COLUMNS[p]
            if o.startswith("?"):
                selected[o[1:]] = F.col(column)
                df = df.where(F.col(column).isNotNull())
            else:
                df = df.where(F.col(column) == o)
            selected[s[1:]] = F.col("resource_id")
        return df.select(*[c.alias(v) if v != "event_time" else c for v, c in selected.items()])

    def _finish(self, sides: list[DataFrame]) -> DataFrame:
        first = self.windows[0]
        numeric = {a.column for a in self.aggregates if a.fn in ("avg", "sum", "min", "max")}

        def ready(df: DataFrame) -> DataFrame:
            df = reduce(lambda d, f: d.where(re.sub(r"\?(\w+)", r"\1", f)), self.filters, df)
            for v in numeric & set(df.columns):
                if df.schema[v].dataType.typeName() == "string":
                    df = df.withColumn(v, F.col(v).try_cast("double"))
            return df

        streaming = any(df.isStreaming for df in sides)
        if len(sides) == 1 and not self.subjects_repeat and "window_start" not in sides[0].columns:
            df, frame = ready(sides[0]), (first.width_ms, first.slide_ms)
            if streaming:
                out = windows.sliding_stream(df, "event_time", *frame, list(self.aggregates), list(self.group_by), timed=True)
            else:
                out = windows.sliding(df, "event_time", *frame, list(self.aggregates), list(self.group_by))
        else:
            out = self._joined_stream(sides, ready) if streaming else self._joined(sides, ready)
        if self.having:
            out = out.where(re.sub(r"\?(\w+)", r"\1", self.having))
        row = [*self.group_by, *[a.alias for a in self.aggregates]]
        if self.emit == "RStream":
            return out.drop("_end")
        if streaming:
            return windows.result_delta_stream(out, first.width_ms, first.slide_ms, row, self.emit)
        return windows.result_delta(out, first.slide_ms, row, self.emit)

    def _joined_stream(self, sides: list[DataFrame], ready) -> DataFrame:
        held = [(df, [c for c in df.columns if c != "event_time"]) for df in sides]
        both = windows.window_join_stream(held, "event_time", [(w.width_ms, w.slide_ms) for w in self.windows])
        return ready(both).groupBy("_end", "window_start", "window_end", *self.group_by).agg(
            *[windows.aggregate(a) for a in self.aggregates])

    def _joined(self, sides: list[DataFrame], ready) -> DataFrame:
        overlap = max(-(-w.width_ms // w.slide_ms) for w in self.windows)
        if overlap > windows.PANE_OVERLAP and not any(df.isStreaming or "window_start" in df.columns for df in sides):
            frames = [(w.width_ms, w.slide_ms) for w in self.windows]
            both, grid = ranges.joined([(df, "event_time") for df in sides], frames)
            found = ranges.aggregated(ready(both), list(self.group_by), list(self.aggregates), overlap)
            return ranges.expanded(found, grid, [*self.group_by, *[a.alias for a in self.aggregates]],
                                   dealt=any(a.fn == "group_concat" for a in self.aggregates))

        def solved(df: DataFrame, w: WindowSpec) -> DataFrame:
            variables = [c for c in df.columns if c not in ("event_time", "window_start", "window_end")]
            dealt = df if "window_start" in df.columns else windows.assign(df, "event_time", w.width_ms, w.slide_ms)
            return dealt.select(
                "window_end", *(["window_start"] if w is self.windows[0] else []), *variables).distinct()

        both = reduce(
            lambda a, b: a.join(b, [c for c in a.columns if c in b.columns]),
            [solved(df, w) for df, w in zip(sides, self.windows)])
        return ready(both).groupBy("window_start", "window_end", *self.group_by).agg(
            *[windows.aggregate(a) for a in self.aggregates])

    def alerts(self, results: DataFrame, value: str | None = None, generated_at: Column | None = None) -> DataFrame:
        """Aggregation events of the results with what the query's own rules derive from each."""
        made = events.construct(
            results, F.lit(self.query_hash()), value or self.aggregates[0].alias,
            F.array(*[F.lit(s) for s in self.streams()]), generated_at, by=list(self.group_by))
        return rule_ops.apply_thresholds(made, list(self.rules)) if self.rules else made
