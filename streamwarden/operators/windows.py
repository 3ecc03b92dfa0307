"""Sliding and tumbling event-time windows, panes, emit modes and window joins."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import cut
from . import ranges
from .skew import null_safe_join

PANE_OVERLAP = 8
SPOTS = 1 << 14  # of a block in one running aggregate
EXPANDED = 1 << 12  # output windows of one row before it is expanded


@dataclass(frozen=True)
class Agg:
    """One aggregate of a window: ``fn`` over ``column`` named ``alias``."""

    fn: str
    column: str
    alias: str
    separator: str = " "


def aggregate(agg: Agg) -> Column:
    """Column of a standard aggregate. Text and sample results do not depend on row order."""
    c = F.col(agg.column) if agg.column != "*" else F.lit(1)
    columns = {
        "avg": lambda: F.avg(c), "max": lambda: F.max(c), "min": lambda: F.min(c),
        "sum": lambda: F.sum(c), "count": lambda: F.count(c),
        "count_distinct": lambda: F.count_distinct(c), "sample": lambda: F.min(c),
        "group_concat": lambda: F.array_join(F.array_sort(F.collect_list(c.cast("string"))), agg.separator),
    }
    return columns[agg.fn]().alias(agg.alias)


def _interval(ms: int) -> str:
    return f"{ms} milliseconds"


def window_of(ts: str, range_ms: int, step_ms: int, align_end: bool = False) -> Column:
    """Half-open windows whose starts (or ends) are multiples of the step since the epoch."""
    if range_ms < step_ms:
        raise ValueError("range below step: use assign or windowed")
    offset = (-range_ms) % step_ms if align_end else 0
    if range_ms == step_ms and not offset:
        return F.window(ts, _interval(range_ms))
    return F.window(ts, _interval(range_ms), _interval(step_ms), _interval(offset))


def in_gapped_windows(df: DataFrame, ts: str, range_ms: int, step_ms: int) -> DataFrame:
    """Rows inside windows shorter than their step: tumbled by the step as ``_w``, the first part of each kept."""
    into = F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.col("_w.start").cast("timestamp"))
    return df.withColumn("_w", F.window(ts, _interval(step_ms))).where(into < range_ms * 1000)


def window_end(range_ms: int, step_ms: int) -> Column:
    """End of the window ``_w``, which ``in_gapped_windows`` cut by steps."""
    if range_ms >= step_ms:
        return F.col("_w.end").alias("window_end")
    return F.timestamp_micros(F.unix_micros(F.col("_w.start").cast("timestamp")) + range_ms * 1000).alias("window_end")


def assign(df: DataFrame, ts: str, range_ms: int, step_ms: int, align_end: bool = False) -> DataFrame:
    """Rows with ``window_start`` and ``window_end``, one per window a row falls into."""
    if range_ms < step_ms:
        return in_gapped_windows(df, ts, range_ms, step_ms).select(
            *df.columns, F.col("_w.start").alias("window_start"), window_end(range_ms, step_ms))
    out = df.withColumn("_w", window_of(ts, range_ms, step_ms, align_end))
    return out.select(*df.columns, F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"))


def windowed(df: DataFrame, ts: str, range_ms: int, step_ms: int, aggs: list[Agg], by: list[str] = (),
             having: Column | None = None, align_end: bool = False) -> DataFrame:
    """Aggregate per window and group; only windows with a row appear."""
    names = [a.alias for a in aggs]
    if range_ms < step_ms:  # gaps between windows
        df, window = in_gapped_windows(df, ts, range_ms, step_ms), F.col("_w")
    else:
        window = window_of(ts, range_ms, step_ms, align_end).alias("_w")
    grouped = df.groupBy(window, *by).agg(*[aggregate(a) for a in aggs])
    out = grouped.select(F.col("_w.start").alias("window_start"), window_end(range_ms, step_ms), *by, *names)
    return out.where(having) if having is not None else out


def sliding(df: DataFrame, ts: str, range_ms: int, step_ms: int, aggs: list[Agg], by: list[str] = ()) -> DataFrame:
    """``windowed``, through panes where rows would be copied more than ``PANE_OVERLAP`` times.

    Aggregates that panes cannot merge, and a RANGE that is no multiple of STEP, go through ranges of windows there.
    """
    if df.isStreaming or range_ms <= PANE_OVERLAP * step_ms:
        return windowed(df, ts, range_ms, step_ms, aggs, by)
    mergeable = all(a.fn in ("avg", "sum", "count", "min", "max") for a in aggs)
    if mergeable and range_ms % step_ms == 0:
        return windowed_by_panes(df, ts, range_ms, step_ms, aggs, by)
    return ranges.windowed(df, ts, range_ms, step_ms, aggs, by)


def _parts(aggs: list[Agg]) -> dict[str, tuple[Column, str]]:
    """Partial results needed for ``aggs``: name -> (pane expression, merge function)."""
    need: dict[str, tuple[Column, str]] = {"_rows": (F.count(F.lit(1)), "sum")}
    for a in aggs:
        c = F.col(a.column) if a.column != "*" else F.lit(1)
        if a.fn in ("avg", "sum"):
            need[f"_sum_{a.column}"] = (F.sum(c), "sum")
        if a.fn in ("avg", "count"):
            need[f"_count_{a.column}"] = (F.count(c), "sum")
        if a.fn in ("min", "max"):
            need[f"_{a.fn}_{a.column}"] = (getattr(F, a.fn)(c), a.fn)
    return need


def _final(a: Agg, value) -> Column:
    if a.fn == "avg":
        return (value(f"_sum_{a.column}") / F.nullif(value(f"_count_{a.column}"), F.lit(0))).alias(a.alias)
    if a.fn == "count":
        return F.coalesce(value(f"_count_{a.column}"), F.lit(0)).alias(a.alias)
    return value(f"_{a.fn}_{a.column}").alias(a.alias)


def windowed_by_panes(df: DataFrame, ts: str, range_ms: int, step_ms: int, aggs: list[Agg],
                      by: list[str] = ()) -> DataFrame:
    """Same rows as ``windowed``; every input row is aggregated once.

    Rows become panes of one step. A window of L panes is a tail of one block of L
    panes plus a head of the next. Both change only behind a pane that holds rows, so running
    aggregates are made at these spots alone and hold up to the next one; such a stretch of
    equal windows is expanded in pieces of ``EXPANDED``. Running aggregates go over ``SPOTS``
    consecutive spots and then over one summary row for each of these runs, so a task's group
    has at most ``SPOTS`` rows and L / ``SPOTS`` summaries, also without ``by``. Running values only ever
    grow by the next row (tails over descending spots), so work is linear in panes and results, and no array or group is
    as long as L.
    """
    if range_ms % step_ms:
        raise ValueError("panes need a range that is a multiple of the step")
    by, step_us, length = list(by), step_ms * 1000, range_ms // step_ms
    parts = _parts(aggs)
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    pane = F.expr("div(_us - pmod(_us, {0}), {0})".format(f"{step_us}L"))
    panes = df.withColumn("_us", micros).groupBy(*by, pane.alias("_pane")).agg(
        *[expr.alias(name) for name, (expr, _) in parts.items()])
    spot = F.pmod("_pane", F.lit(length))
    block = F.expr(f"div(_pane - pmod(_pane, {length}), {length})")
    # In its own block a pane serves tails ('c') of windows that start at or before it; for the block
    # before, heads ('n') of windows that start behind it. Either changes at the spot after the pane.
    placed = panes.select(*by, spot.alias("_at"), *parts, F.explode(F.array(
        F.struct(block.alias("_block"), F.lit(True).alias("_own")),
        F.struct((block - 1).alias("_block"), F.lit(False).alias("_own")))).alias("_p"))
    placed = placed.select(*by, "_p.*", (F.col("_at") + 1).alias("_at"), *parts)
    nothing = [F.lit(None).cast(placed.schema[n].dataType).alias(n) for n in parts]
    first = placed.select(*by, "_block").distinct().select(
        *by, "_block", F.lit(None).cast("boolean").alias("_own"), F.lit(0).cast("long").alias("_at"), *nothing)
    sides = [(side, own, n, how) for n, (_, how) in parts.items() for side, own in (("c", True), ("n", False))]
    merged = placed.unionByName(first).groupBy(*by, "_block", "_at").agg(
        *[getattr(F, how)(F.when(F.col("_own") == own, F.col(n))).alias(f"{side}{n}") for side, own, n, how in sides])
    ahead = (Window.unboundedPreceding, -1)  # over descending spots: Spark keeps such a frame as a running value
    if length < SPOTS:  # one run
        group = Window.partitionBy(*by, "_block")
        run = _running(merged, group, sides, ahead).withColumn("_after", F.lit(None).cast("long"))
        far = {n: F.lit(None).cast(placed.schema[n].dataType) for n in parts}
        far = {side + n: c for n, c in far.items() for side in "cn"}
    else:
        merged = cut(merged.withColumn("_run", F.expr(f"div(_at, {SPOTS})")))
        summary = merged.groupBy(*by, "_block", "_run").agg(
            F.min("_at").alias("_from"), *[getattr(F, how)(f"{side}{n}").alias(f"{side}{n}") for side, _, n, how in sides])
        runs = Window.partitionBy(*by, "_block")
        up, down = runs.orderBy("_run"), runs.orderBy(F.col("_run").desc())
        summary = summary.select(*by, "_block", "_run", F.lead("_from").over(up).alias("_after"), *[
            getattr(F, how)(f"{side}{n}").over((down if own else up).rowsBetween(*ahead)).alias(f"far{side}{n}")
            for side, own, n, how in sides])
        run = _running(merged, Window.partitionBy(*by, "_block", "_run"), sides, ahead)
        run = null_safe_join(run, summary, [*by, "_block", "_run"])
        far = {side + n: F.col(f"far{side}{n}") for side, _, n, _ in sides}

    def both(how: str, a: Column, b: Column) -> Column:
        if how == "sum":
            return F.coalesce(a + b, a, b)
        return (F.least if how == "min" else F.greatest)(a, b)

    held = run.select(*by, "_block", "_at", F.coalesce("_next", "_after", F.lit(length)).alias("_until"), *[
        both(how, both(how, F.col(f"c{n}"), far[f"c{n}"]), both(how, F.col(f"n{n}"), far[f"n{n}"])).alias(n)
        for n, (_, how) in parts.items()]).where("_rows > 0 and _at < _until")
    pieces = held.withColumn("_lo", F.explode(F.sequence("_at", F.col("_until") - 1, F.lit(EXPANDED).cast("long"))))
    if length > EXPANDED:  # a stretch may be much longer than others: its pieces go to all tasks
        pieces = pieces.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = pieces.withColumn("_at", F.explode(F.sequence("_lo", F.least(F.col("_lo") + EXPANDED, F.col("_until")) - 1)))
    start = (F.col("_block") * length + F.col("_at")) * step_us
    return rows.select(
        F.timestamp_micros(start).alias("window_start"),
        F.timestamp_micros(start + range_ms * 1000).alias("window_end"),
        *by, *[_final(a, F.col) for a in aggs])


def _running(merged: DataFrame, group, sides: list, ahead: tuple) -> DataFrame:
    """Spots of each group with ``_next`` and their running aggregates; a pane counts in tails up to its own place,
    one spot before the one it is kept at, and in heads from there on."""
    kept = [c for c in merged.columns if c not in {f"{side}{n}" for side, _, n, _ in sides}]
    up, down = group.orderBy("_at"), group.orderBy(F.col("_at").desc())
    return merged.select(*kept, F.lag("_at").over(down).alias("_next"), *[
        getattr(F, how)(f"{side}{n}").over(
            down.rowsBetween(*ahead) if own else up.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias(f"{side}{n}")
        for side, own, n, how in sides])


def sliding_stream(df: DataFrame, ts: str, range_ms: int, step_ms: int, aggs: list[Agg],
                   by: list[str] = (), timed: bool = False) -> DataFrame:
    """Streaming panes: a tumbling aggregate per step feeds the sliding one.

    State holds one row per pane and per open window instead of updating every
    overlapping window for each input row. Needs a watermark on ``ts``. ``timed`` adds ``_end``, the event time
    of each result (just before its window's end), for a further operator that needs a watermark.
    """
    def out(grouped: DataFrame, end: Column, finals: list[Column]) -> DataFrame:
        time = [F.window_time("_w").alias("_end")] if timed else []
        return grouped.select(*time, F.col("_w.start").alias("window_start"), end, *by, *finals)

    if range_ms < step_ms:
        grouped = in_gapped_windows(df, ts, range_ms, step_ms).groupBy("_w", *by).agg(*[aggregate(a) for a in aggs])
        return out(grouped, window_end(range_ms, step_ms), [F.col(a.alias) for a in aggs])
    mergeable = all(a.fn in ("avg", "sum", "count", "min", "max") for a in aggs)
    if not mergeable or range_ms % step_ms or range_ms == step_ms:
        grouped = df.groupBy(window_of(ts, range_ms, step_ms).alias("_w"), *by).agg(*[aggregate(a) for a in aggs])
        return out(grouped, F.col("_w.end").alias("window_end"), [F.col(a.alias) for a in aggs])
    parts = _parts(aggs)
    panes = df.groupBy(F.window(ts, _interval(step_ms)).alias("_pane"), *by).agg(
        *[expr.alias(n) for n, (expr, _) in parts.items()]).withColumn("_at", F.window_time("_pane"))
    merged = panes.groupBy(window_of("_at", range_ms, step_ms).alias("_w"), *by).agg(
        *[getattr(F, how)(n).alias(n) for n, (_, how) in parts.items()])
    return out(merged, F.col("_w.end").alias("window_end"), [_final(a, F.col) for a in aggs])


def rstream(df: DataFrame, ts: str, range_ms: int, step_ms: int, row: list[str]) -> DataFrame:
    """Distinct rows of each window."""
    return assign(df.select(ts, *row), ts, range_ms, step_ms).select("window_start", "window_end", *row).distinct()


def _delta(df: DataFrame, ts: str, range_ms: int, step_ms: int, row: list[str], now: int) -> DataFrame:
    # A row shifted by one step lands in the window after each of its own, so one
    # grouped pass sees "in this window" and "in the one before" together. On a
    # stream the caller sets the watermark through ``delta_input``.
    shifted = df if "_now" in df.columns else delta_input(df, ts, step_ms, row)
    grouped = shifted.groupBy(window_of(ts, range_ms, step_ms).alias("_w"), *row).agg(
        F.max("_now").alias("_now"), F.max("_before").alias("_before"))
    return grouped.where((F.col("_now") == now) & (F.col("_before") == 1 - now)).select(
        F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), *row)


def delta_input(df: DataFrame, ts: str, step_ms: int, row: list[str], watermark: str | None = None) -> DataFrame:
    """Rows doubled for ``istream``/``dstream``: as they are, and one step later."""
    later = F.timestamp_micros(F.unix_micros(F.col(ts).cast("timestamp")) + step_ms * 1000)
    out = df.select(*row, F.explode(F.array(
        F.struct(F.col(ts).cast("timestamp").alias(ts), F.lit(1).alias("_now"), F.lit(0).alias("_before")),
        F.struct(later.alias(ts), F.lit(0).alias("_now"), F.lit(1).alias("_before")))).alias("_d")
    ).select(*row, "_d.*")
    return out.withWatermark(ts, watermark) if watermark else out


def istream(df: DataFrame, ts: str, range_ms: int, step_ms: int, row: list[str]) -> DataFrame:
    """Rows of a window that the previous window did not have."""
    return _delta(df, ts, range_ms, step_ms, row, 1)


def dstream(df: DataFrame, ts: str, range_ms: int, step_ms: int, row: list[str]) -> DataFrame:
    """Rows of the previous window that a window no longer has."""
    return _delta(df, ts, range_ms, step_ms, row, 0)


def result_delta(results: DataFrame, step_ms: int, row: list[str], mode: str) -> DataFrame:
    """IStream or DStream of stored window results: one shuffle, no self join."""
    def moved(c: str) -> Column:
        return F.timestamp_micros(F.unix_micros(F.col(c).cast("timestamp")) + step_ms * 1000)

    both = results.select(*row, F.explode(F.array(
        F.struct(F.col("window_start").cast("timestamp").alias("window_start"),
                 F.col("window_end").cast("timestamp").alias("window_end"),
                 F.lit(1).alias("_now"), F.lit(0).alias("_before")),
        F.struct(moved("window_start").alias("window_start"), moved("window_end").alias("window_end"),
                 F.lit(0).alias("_now"), F.lit(1).alias("_before")))).alias("_d")).select(*row, "_d.*")
    now = {"IStream": 1, "DStream": 0}[mode]
    return (
        both.groupBy("window_start", "window_end", *row).agg(F.max("_now").alias("_now"), F.max("_before").alias("_b"))
        .where((F.col("_now") == now) & (F.col("_b") == 1 - now)).select("window_start", "window_end", *row)
    )


def result_delta_stream(results: DataFrame, range_ms: int, step_ms: int, row: list[str], mode: str) -> DataFrame:
    """IStream or DStream of closed window results on a stream, as a second event-time aggregate.

    ``results`` has ``_end`` (see ``sliding_stream``). A window of two steps over these times holds the results of one
    window of the query and of the one before, and closes a step after the first: state is two results of a row.
    """
    offset = (range_ms if range_ms >= step_ms else step_ms) % step_ms
    pair = F.window("_end", _interval(2 * step_ms), _interval(step_ms), _interval(offset))
    late = F.unix_micros("_end") - F.unix_micros("_pair.start") >= step_ms * 1000
    seen = results.select("_end", *row).withColumn("_pair", pair).withColumn("_now", late.cast("int")).groupBy("_pair", *row).agg(
        F.max("_now").alias("_now"), F.min("_now").alias("_before"))
    kept = seen.where("_before = 1" if mode == "IStream" else "_now = 0")
    end = F.unix_micros("_pair.end") - max(0, step_ms - range_ms) * 1000  # a window below its step ends before the next begins
    return kept.select(F.timestamp_micros(end - range_ms * 1000).alias("window_start"), F.timestamp_micros(end).alias("window_end"), *row)


def solutions_stream(df: DataFrame, ts: str, range_ms: int, step_ms: int, variables: list[str]) -> DataFrame:
    """Distinct solutions of each closed window, with ``_end``; needs a watermark on ``ts``."""
    held = df.groupBy(window_of(ts, range_ms, step_ms).alias("_w"), *variables).agg(F.count(F.lit(1)).alias("_n"))
    return held.select(F.window_time("_w").alias("_end"), F.col("_w.start").alias("window_start"),
                       F.col("_w.end").alias("window_end"), *variables)


def window_join_stream(sides: list[tuple[DataFrame, list[str]]], ts: str, frames: list[tuple[int, int]]) -> DataFrame:
    """Solutions of named windows that end together, joined on the variables they share; frames may differ.

    Each side is (rows, variables). Equal ends are equal event times, so both sides' watermarks clear the join's state:
    a solution waits for the window of the other frame that ends with it, and no longer. ``window_start`` is the first frame's.
    """
    def solved(i: int) -> DataFrame:
        df, variables = sides[i]
        found = solutions_stream(df, ts, *frames[i], variables)
        return found if i == 0 else found.drop("window_start", "window_end")

    out = solved(0)
    for i in range(1, len(sides)):
        other = solved(i)
        out = out.join(other, [c for c in out.columns if c in other.columns])
    return out


def window_join(left: DataFrame, right: DataFrame, shared: list[str], ts: str, left_frame: tuple[int, int],
                right_frame: tuple[int, int]) -> DataFrame:
    """Solutions of two named windows that end together and agree on all ``shared`` variables.

    Each side is reduced to its distinct solutions first: a window is a graph, and
    a graph has no duplicates, so no pair is built twice. Above ``PANE_OVERLAP`` rows are not copied into their windows.
    """
    if max(r / s for r, s in (left_frame, right_frame)) > PANE_OVERLAP:
        found = ranges.window_join(left, right, shared, ts, left_frame, right_frame)
        return found if left_frame == right_frame else found.select("window_end", *shared, "window_start")

    def side(df: DataFrame, frame: tuple[int, int]) -> DataFrame:
        return assign(df.select(ts, *shared), ts, *frame).select("window_end", "window_start", *shared).distinct()

    a = side(left, left_frame)
    b = side(right, right_frame)
    if left_frame == right_frame:
        return a.join(b, ["window_start", "window_end", *shared])
    return a.join(b.drop("window_start"), ["window_end", *shared])
