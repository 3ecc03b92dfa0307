"""Sliding windows as ranges of window numbers.

Window k starts at k * STEP, so a row is in one range of numbers, however small the STEP. What windows hold
changes only where such a range begins or ends. Joins, distinct counts and aggregates are taken from these
change points, and stretches of equal windows are expanded at the very end in pieces of bounded size. Work
follows rows and results; RANGE / STEP only bounds the results.
"""

from __future__ import annotations

from functools import reduce
from math import gcd, lcm

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..session import cut
from . import skew

EXPANDED = 1 << 12  # windows of one stretch before it is expanded
LISTED = 1 << 10  # pieces of stretches whose texts are written together
TEXT_BYTES = 1 << 23  # of texts that leave a task at once, if there is more than one


class Grid:
    """Ends of windows that all ``frames`` (range, step in ms) have in common: ``first + m * step``, in microseconds."""

    def __init__(self, frames: list[tuple[int, int]]):
        self.frames = [(r * 1000, s * 1000) for r, s in frames]
        self.first, self.step = self.frames[0][0] % self.frames[0][1], self.frames[0][1]
        self.empty = False
        for range_us, step_us in self.frames[1:]:
            apart, common = range_us - self.first, gcd(self.step, step_us)
            if apart % common:
                self.empty = True
                return
            turns = apart // common * pow(self.step // common, -1, step_us // common) % (step_us // common)
            self.first, self.step = self.first + self.step * turns, lcm(self.step, step_us)
            self.first %= self.step

    def placed(self, df: DataFrame, ts: str, frame: int = 0) -> DataFrame:
        """Adds ``_lo`` and ``_hi``: the first and last common window a row is in. Rows in none drop out."""
        range_us, _ = self.frames[frame]
        us = df.withColumn("_us", F.unix_micros(F.col(ts).cast("timestamp")))
        # A window that ends at e holds times from e - range to before e.
        low = f"_us - {self.first}L"
        high = f"_us + {range_us - self.first}L"
        step = f"{self.step}L"
        return us.withColumns({
            "_lo": F.expr(f"div({low} - pmod({low}, {step}), {step}) + 1"),
            "_hi": F.expr(f"div({high} - pmod({high}, {step}), {step})")}).drop("_us").where("_lo <= _hi")

    def bounds(self, number: Column) -> list[Column]:
        """Start and end of a window of the first frame."""
        end = number * self.step + self.first
        return [F.timestamp_micros(end - self.frames[0][0]).alias("window_start"), F.timestamp_micros(end).alias("window_end")]


def swept(changes: DataFrame, keys: list[str], values: list[str], limit: int = skew.GROUP_LIMIT) -> DataFrame:
    """Running sums of ``values`` over ``_at`` (unique within ``keys``), and ``_next``, the place after; null at the end.

    Groups above ``limit`` places go through a range shuffle, with one summary row for each chunk.
    """
    changes = cut(changes)
    normal, hot = skew.split_hot(changes, keys, limit)
    upto, parts = (Window.unboundedPreceding, Window.currentRow), []
    if normal is not None:
        group = Window.partitionBy(*keys).orderBy("_at")
        parts.append(normal.select(*keys, "_at", F.lead("_at").over(group).alias("_next"), *[
            F.sum(v).over(group.rowsBetween(*upto)).alias(v) for v in values]))
    if hot is not None:
        rows = skew.chunked(hot, keys, ["_at"], max(limit, 1))
        within = Window.partitionBy(*keys, "_chunk").orderBy("_off")
        line = Window.partitionBy(*keys).orderBy("_chunk")
        summary = rows.groupBy(*keys, "_chunk").agg(F.min("_at").alias("_head"), *[F.sum(v).alias(f"_of_{v}") for v in values])
        summary = summary.select(*keys, "_chunk", F.lead("_head").over(line).alias("_after"), *[
            F.coalesce(F.sum(f"_of_{v}").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(f"_of_{v}")
            for v in values])
        local = rows.select(*keys, "_at", "_chunk", F.lead("_at").over(within).alias("_next"), *[
            F.sum(v).over(within.rowsBetween(*upto)).alias(v) for v in values])
        parts.append(skew.null_safe_join(local, summary, [*keys, "_chunk"], small=True).select(
            *keys, "_at", F.coalesce("_next", "_after").alias("_next"), *[(F.col(v) + F.col(f"_of_{v}")).alias(v) for v in values]))
    return reduce(DataFrame.unionByName, parts)


def _changes(df: DataFrame, keys: list[str], amounts: dict[str, Column]) -> DataFrame:
    """``keys, _at`` and what each amount changes there: it counts from ``_lo`` on and no more behind ``_hi``."""
    on = F.struct(F.col("_lo").alias("_at"), *[a.alias(n) for n, a in amounts.items()])
    off = F.struct((F.col("_hi") + 1).alias("_at"), *[(-a).alias(n) for n, a in amounts.items()])
    return df.select(*keys, F.explode(F.array(on, off)).alias("_c")).select(*keys, "_c.*")


def united(df: DataFrame, keys: list[str], limit: int = skew.GROUP_LIMIT) -> DataFrame:
    """``keys, _lo, _hi``: the windows that hold a row of ``keys``, as ranges that neither meet nor touch."""
    changes = _changes(df, keys, {"_d": F.lit(1)}).groupBy(*keys, "_at").agg(F.sum("_d").alias("_d")).where("_d != 0")
    line = swept(changes, keys, ["_d"], limit)
    # Where the count is zero a range has ended, and the next place, if any, begins another. So the ends of ranges
    # and the places after them, each known in its own row, are all that a second sweep has to pair.
    begins = line.groupBy(*keys).agg(F.min("_at").alias("_at")).unionByName(
        line.where("_d = 0 and _next is not null").select(*keys, F.col("_next").alias("_at"))).withColumn("_open", F.lit(1))
    ends = line.where("_d = 0").select(*keys, "_at").withColumn("_open", F.lit(-1))
    paired = swept(begins.unionByName(ends), keys, ["_open"], limit)
    return paired.where("_open = 1").select(*keys, F.col("_at").alias("_lo"), (F.col("_next") - 1).alias("_hi"))


def met(sides: list[DataFrame], keys: list[str], limit: int = skew.GROUP_LIMIT) -> DataFrame:
    """``keys, _lo, _hi``: stretches of windows in which every side has a row of ``keys``.

    One sweep over the change points of all sides: no side is joined with another, so a key that is
    frequent in all of them costs the sum of its rows.
    """
    marks = [f"_in{i}" for i in range(len(sides))]
    each = [_changes(df, keys, {m: F.lit(int(m == mark)) for m in marks}) for df, mark in zip(sides, marks)]
    changes = reduce(DataFrame.unionByName, each).groupBy(*keys, "_at").agg(*[F.sum(m).alias(m) for m in marks])
    held = swept(changes, keys, marks, limit).where(reduce(lambda a, b: a & b, [F.col(m) > 0 for m in marks]))
    return held.select(*keys, F.col("_at").alias("_lo"), (F.col("_next") - 1).alias("_hi"))


def overlap_join(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """Pairs with equal ``on`` whose ranges overlap, with the common range. Either range begins inside the other."""
    def times(df: DataFrame, lo: str, hi: str) -> DataFrame:
        return df.withColumns({lo: F.timestamp_micros("_lo"), hi: F.timestamp_micros("_hi")}).drop("_lo", "_hi")

    a, b = cut(times(a, "_alo", "_ahi")), cut(times(b, "_blo", "_bhi"))
    inside = skew.interval_join(a, b, on, "_alo", "_blo", "_bhi")
    around = skew.interval_join(b, a, on, "_blo", "_alo", "_ahi").where("_blo > _alo")
    both = inside.unionByName(around)
    return both.withColumns({"_lo": F.unix_micros(F.greatest("_alo", "_blo")), "_hi": F.unix_micros(F.least("_ahi", "_bhi"))}).drop(
        "_alo", "_ahi", "_blo", "_bhi")


def joined(sides: list[tuple[DataFrame, str]], frames: list[tuple[int, int]], limit: int = skew.GROUP_LIMIT) -> tuple[DataFrame, Grid]:
    """(solutions of all windows that end together, with ``_lo`` and ``_hi``; their grid).

    Each side is (rows of its variables and a time, name of the time). A window is a graph, so each solution
    counts once. Sides with the same variables are swept together, others joined on the variables they share.
    """
    grid = Grid(frames)
    placed = [(grid.placed(df, ts, i) if not grid.empty else Grid([frames[i]]).placed(df, ts).limit(0)).drop(ts)
              for i, (df, ts) in enumerate(sides)]
    variables = [[c for c in df.columns if c not in ("_lo", "_hi")] for df in placed]
    if all(set(v) == set(variables[0]) for v in variables):
        return met([df.where(_known(variables[0])) for df in placed], variables[0], limit), grid

    def both(a: DataFrame, b: DataFrame) -> DataFrame:
        return overlap_join(a, b, [c for c in a.columns if c in b.columns and c not in ("_lo", "_hi")])

    return reduce(both, [united(df, v, limit) for df, v in zip(placed, variables)]), grid


def _known(columns: list[str]) -> Column:
    """Null joins with nothing."""
    return reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])


def _cells(levels: int) -> Column:
    """The power-of-two cells (level, cell) that a range of windows is made of, at most two of each level."""
    def of(j: Column) -> Column:
        low = -F.call_function("shiftright", -F.col("_lo"), j.cast("int"))
        high = F.call_function("shiftright", F.col("_hi") + 1, j.cast("int"))
        odd_low, odd_high = F.pmod(low, F.lit(2)) == 1, F.pmod(high, F.lit(2)) == 1
        after = F.when(odd_low, low + 1).otherwise(low)
        return F.array(F.when((low < high) & odd_low, F.struct(j.alias("_level"), low.alias("_cell"))),
                       F.when((low < high) & odd_high & (after < high), F.struct(j.alias("_level"), (high - 1).alias("_cell"))))

    found = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(levels)), of))
    return F.filter(found, lambda x: x.isNotNull())


def aggregated(df: DataFrame, by: list[str], aggs: list, longest: int, limit: int = skew.GROUP_LIMIT) -> DataFrame:
    """``by, _lo, _hi`` and the aggregates of each stretch of equal windows that hold a row.

    ``df`` has ``_lo`` and ``_hi``, at most ``longest`` windows apart. Counts and sums of whole numbers and decimals are running sums of
    changes. A distinct count changes with the united ranges of each value. Minima, maxima, samples and sums of
    floating numbers (of which running sums would keep the errors) are merged from power-of-two cells of windows. Texts are
    written for each stretch; with them, long stretches come in pieces.
    """
    df = cut(df)
    names = {a.alias: f"_v{i}" for i, a in enumerate(aggs)}

    def value(a) -> Column:
        return F.lit(1) if a.column == "*" else F.col(a.column)

    def floating(a) -> bool:
        return a.column != "*" and df.schema[a.column].dataType.typeName() in ("double", "float")

    running: dict[str, Column] = {"_rows": F.lit(1)}
    cells: dict[str, tuple[Column, str]] = {}
    for a in aggs:
        v = names[a.alias]
        known = F.when(value(a).isNotNull(), 1).otherwise(0)
        if a.fn in ("count", "avg", "sum"):
            running[f"{v}n"] = known
        if a.fn in ("avg", "sum"):
            if floating(a):
                cells[f"{v}s"] = (F.sum(value(a)), "sum")
            else:
                running[f"{v}s"] = F.coalesce(value(a), F.lit(0))
        if a.fn in ("min", "max", "sample"):
            cells[f"{v}m"] = (F.max(value(a)) if a.fn == "max" else F.min(value(a)), "max" if a.fn == "max" else "min")
    parts = [_changes(df, by, running)]
    distinct = [a for a in aggs if a.fn == "count_distinct"]
    for a in distinct:
        known = df.where(value(a).isNotNull()).select(*by, value(a).alias("_value"), "_lo", "_hi")
        parts.append(_changes(united(known, [*by, "_value"], limit), by, {names[a.alias] + "d": F.lit(1)}))
    amounts = [*running, *[names[a.alias] + "d" for a in distinct]]
    every = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts)
    changes = every.groupBy(*by, "_at").agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in amounts])
    out = cut(swept(changes, by, amounts, limit).where("_rows > 0").withColumn("_hi", F.col("_next") - 1).withColumnRenamed("_at", "_lo").drop("_next"))
    if cells:
        levels = max(1, longest).bit_length()
        made = df.select("*", F.explode(_cells(levels)).alias("_c")).groupBy(*by, "_c").agg(*[c.alias(n) for n, (c, _) in cells.items()])
        made = made.select(*by, F.col("_c._level").alias("_level"), F.col("_c._cell").alias("_cell"), *cells)
        asked = out.select(*by, "_lo", F.explode(F.sequence(F.lit(0), F.lit(levels))).alias("_level")).withColumn(
            "_cell", F.call_function("shiftright", F.col("_lo"), F.col("_level")))
        code = F.to_json(F.struct(*[F.col(c) for c in by])) if by else F.lit("")
        found = skew.salted_join(asked.withColumn("_k", code), made.withColumn("_k", code).drop(*by), ["_k", "_level", "_cell"], limit=max(limit, 1))
        merged = found.groupBy("_k", "_lo").agg(*[getattr(F, how)(n).alias(n) for n, (_, how) in cells.items()])
        out = out.withColumn("_k", code).join(merged, ["_k", "_lo"], "left").drop("_k")
    texts = [a for a in aggs if a.fn == "group_concat"]
    if texts:
        out = _with_texts(df, out, by, texts, names, limit)
    return out.select(*by, "_lo", "_hi", *[_final(a, names[a.alias]).alias(a.alias) for a in aggs])


def _final(a, v: str) -> Column:
    if a.fn in ("count", "avg", "sum"):
        n = F.col(f"{v}n")
        if a.fn == "count":
            return n
        return F.when(n > 0, F.col(f"{v}s") / n if a.fn == "avg" else F.col(f"{v}s"))
    return F.col(v + {"count_distinct": "d", "group_concat": "t"}.get(a.fn, "m"))


def _with_texts(df: DataFrame, out: DataFrame, by: list[str], texts: list, names: dict[str, str], limit: int) -> DataFrame:
    """Adds the sorted, joined values of each stretch, which is cut into pieces of ``EXPANDED`` windows.

    A row goes once to each block of ``LISTED`` pieces it is in, not to every piece. A block sorts its rows once and writes the
    texts of its pieces one after another; no text is shuffled.
    """
    code = F.to_json(F.struct(*[F.col(c) for c in by])) if by else F.lit("")
    cuts = out.withColumn("_first", F.explode(F.sequence("_lo", "_hi", F.lit(EXPANDED).cast("long")))).withColumns({
        "_lo": F.col("_first"), "_hi": F.least(F.col("_first") + EXPANDED - 1, F.col("_hi"))}).drop("_first")
    line = cut(skew.positions(cuts.withColumn("_k", code), ["_k"], ["_lo"], "_pos", limit=limit))
    # A row covers the pieces from the one that begins at its first window to the one that ends at its last.
    rows = df.select(code.alias("_k"), "_lo", "_hi", *[F.col(a.column).cast("string").alias(names[a.alias]) for a in texts])
    begins = line.select("_k", "_lo", F.col("_pos").alias("_from"))
    ends = line.select("_k", "_hi", F.col("_pos").alias("_to"))
    sent = skew.salted_join(skew.salted_join(rows, begins, ["_k", "_lo"], limit=max(limit, 1)), ends, ["_k", "_hi"], limit=max(limit, 1))
    both = _blocks(sent.drop("_lo", "_hi")).unionByName(
        line.withColumn("_block", F.expr(f"_pos div {LISTED}")), allowMissingColumns=True)
    # The number of parts is given, so that they are not merged for their few rows: the texts are much larger.
    dealt = both.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "_k", "_block").sortWithinPartitions("_k", "_block")
    kept = [f for f in line.schema.fields if f.name not in ("_k", "_pos")]
    schema = StructType([*[StructField(f.name, f.dataType) for f in kept], *[StructField(names[a.alias] + "t", StringType()) for a in texts]])
    return dealt.mapInArrow(_text_writer([f.name for f in kept], [(names[a.alias], a.separator) for a in texts]), schema)


def _blocks(sent: DataFrame) -> DataFrame:
    """Each row once for every block of ``LISTED`` pieces between its ``_from`` and ``_to``."""
    return sent.withColumn("_block", F.explode(F.sequence(F.expr(f"_from div {LISTED}"), F.expr(f"_to div {LISTED}"))))


def _text_writer(kept: list[str], texts: list[tuple[str, str]]):
    """A function over Arrow batches sorted by block: pieces (rows with ``_pos``) with the texts of the rows that cover them."""
    batch_bytes = TEXT_BYTES

    def sorted_rows(held, name, separator):
        """(from, to, bytes of each value with its separator, their lengths), in the order of the values."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        known = held.filter(pc.is_valid(held[name]))
        values = pc.cast(known[name], pa.large_binary()).combine_chunks()
        order = pc.sort_indices(values)
        ended = pc.binary_join_element_wise(values.take(order), pa.scalar(b"", pa.large_binary()), pa.scalar(separator.encode(), pa.large_binary()))
        offsets = np.frombuffer(ended.buffers()[1], np.int64)[ended.offset:ended.offset + len(ended) + 1] if len(ended) else np.zeros(1, np.int64)
        data = np.frombuffer(ended.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]] if len(ended) else np.zeros(0, np.uint8)
        return known["_from"].take(order).to_numpy(), known["_to"].take(order).to_numpy(), data, np.diff(offsets)

    def written(table):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        asked, held = table.filter(pc.is_valid(table["_pos"])), table.filter(pc.is_null(table["_pos"]))
        places, columns = asked["_pos"].to_numpy(), asked.select(kept)
        sides = [(*sorted_rows(held, name, separator), len(separator.encode())) for name, separator in texts]
        first, size, made = 0, 0, [[] for _ in texts]
        for i, place in enumerate(places):
            for (low, high, data, lengths, tail), out in zip(sides, made):
                found = data[np.repeat((low <= place) & (high >= place), lengths)]
                out.append(found[:max(len(found) - tail, 0)].tobytes())
                size += len(found)
            if size >= batch_bytes or i + 1 == len(places):
                part = columns.slice(first, i + 1 - first).combine_chunks()
                arrays = [c.chunk(0) for c in part.columns] + [pa.array(out, pa.binary()).cast(pa.string()) for out in made]
                yield pa.RecordBatch.from_arrays(arrays, names=[*kept, *[name + "t" for name, _ in texts]])
                first, size, made = i + 1, 0, [[] for _ in texts]

    def write(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        gathered, key = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            block, code = batch.column("_block"), batch.column("_k")
            moved = pc.or_(pc.not_equal(block[1:], block[:-1]), pc.not_equal(code[1:], code[:-1])).to_numpy(zero_copy_only=False)
            bounds = [0, *(np.flatnonzero(moved) + 1).tolist(), batch.num_rows]
            for low, high in zip(bounds, bounds[1:]):
                here = (block[low].as_py(), code[low].as_py())
                if gathered and here != key:
                    yield from written(pa.Table.from_batches(gathered))
                    gathered = []
                key = here
                gathered.append(batch.slice(low, high - low))
        if gathered:
            yield from written(pa.Table.from_batches(gathered))

    return write


def expanded(stretches: DataFrame, grid: Grid, columns: list[str], dealt: bool = False) -> DataFrame:
    """``window_start, window_end`` and ``columns``, one row for each window of a stretch. ``dealt``: they are spread in bounded pieces."""
    spark = stretches.sparkSession
    pieces = stretches.withColumn("_first", F.explode(F.sequence("_lo", "_hi", F.lit(EXPANDED).cast("long"))))
    if not dealt:
        pieces = pieces.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))  # stretches differ in length
    rows = pieces.withColumn("_number", F.explode(F.sequence("_first", F.least(F.col("_first") + EXPANDED - 1, F.col("_hi")))))
    return rows.select(*grid.bounds(F.col("_number")), *columns)


def windowed(df: DataFrame, ts: str, range_ms: int, step_ms: int, aggs: list, by: list[str] = (), limit: int = skew.GROUP_LIMIT) -> DataFrame:
    """Same rows as ``windows.windowed``, for any aggregate and any overlap."""
    grid, by = Grid([(range_ms, step_ms)]), list(by)
    needed = list(dict.fromkeys([*by, *[a.column for a in aggs if a.column != "*"]]))
    placed = grid.placed(df.select(ts, *[c for c in needed if c != ts]), ts)
    found = aggregated(placed.select(*needed, "_lo", "_hi"), by, aggs, -(-range_ms // step_ms), limit)
    return expanded(found, grid, [*by, *[a.alias for a in aggs]], dealt=any(a.fn == "group_concat" for a in aggs))


def window_join(left: DataFrame, right: DataFrame, shared: list[str], ts: str, left_frame: tuple[int, int],
                right_frame: tuple[int, int], limit: int = skew.GROUP_LIMIT) -> DataFrame:
    """Same rows as ``windows.window_join``, without copying a row into its windows."""
    sides = [(left.select(ts, *shared), ts), (right.select(ts, *shared), ts)]
    found, grid = joined(sides, [left_frame, right_frame], limit)
    return expanded(found, grid, shared)
