"""Query texts as data: hashes, windows, focus and an equivalence key.

The texts are only catalogued and compared here. Queries that run are built from
``plans.continuous.ContinuousQuery``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import vocab
from .binding import let

# Clauses of a continuous query: keywords in any case, tokens parted by any white space.
_IRI, _NAME = r"<[^<>\s]*>", r"(?:<[^<>\s]*>|[^\s\[\]{}<>()]+)"
PREFIX_FORM = rf"(?i)\bPREFIX\s+([\w.-]*)\s*:\s*<([^<>\s]*)>"
REGISTER_FORM = rf"(?i)\bREGISTER\s+(RStream|IStream|DStream)\s+<([^<>\s]+)>\s+AS\b"
WINDOW_FORM = (rf"(?i)\bFROM\s+NAMED\s+WINDOW\s+({_NAME})\s+ON\s+STREAM\s+({_NAME})\s*"
               r"\[\s*RANGE\s+([^\s\]]+)\s+STEP\s+([^\s\]]+)\s*\]")
SELECT_FORM = r"(?i)\bSELECT\b[^{]*?\(\s*(\w+)\s*\(\s*(?:DISTINCT\s+)?[?$](\w+)\s*\)\s*AS\s+[?$](\w+)\s*\)"
BLOCK_FORM = rf"(?i)\b(?:WINDOW|GRAPH)\s+({_NAME})\s*\{{([^{{}}]*)\}}"
COMMENT_FORM = r"(?m)(^|\s)#[^\n]*"
EMIT_MODES = ("RStream", "IStream", "DStream")


def query_hash(text) -> Column:
    """md5 of the text without any whitespace."""
    return F.md5(F.regexp_replace(F.col(text) if isinstance(text, str) else text, r"\s", ""))


def registration_id(text: Column, start: Column, end: Column) -> Column:
    return query_hash(F.concat(text, start.cast("string"), end.cast("string")))


def _all(lines: Column, form: str, group: int) -> Column:
    return F.regexp_extract_all(lines, F.lit(form), F.lit(group))


def _found(lines: Column, form: str, names: list[str]) -> Column:
    """Structs of the groups of all matches, by one pass over the text: groups are read from the short matches.

    For forms that end in a character of their own, so that a match alone matches in the same way.
    """
    return F.transform(_all(lines, form, 0), lambda m: F.struct(*[F.regexp_extract(m, form, i + 1).alias(n) for i, n in enumerate(names)]))


def prefix_map(lines: Column) -> Column:
    """Prefix to namespace; a repeated prefix takes its last meaning."""
    entries = _found(lines, PREFIX_FORM, ["k", "v"])
    return let(entries, lambda found: F.map_from_entries(F.filter(found, lambda e, i: ~F.exists(
        F.slice(found, i + 2, F.size(found)), lambda later: later["k"] == e["k"]))))


def unwrap(iri: Column, prefixes: Column) -> Column:
    """``<x>`` to x, ``p:local`` to namespace + local, '' for an unknown prefix."""
    def resolved(text: Column) -> Column:
        # Element 0 is the prefix; a name without a colon has no element 1.
        named = let(F.split(text, ":", -1), lambda parts: F.coalesce(F.concat(
            F.try_element_at(prefixes, parts[0]), F.coalesce(F.get(parts, F.lit(1)), F.lit(""))), F.lit("")))
        return F.when(F.startswith(text, F.lit("<")), F.substr(text, F.lit(2), F.length(text) - 2)).otherwise(named)

    return let(F.trim(iri), resolved)


def catalog(queries: DataFrame, text: str = "query_text") -> DataFrame:
    """Adds hash, prefixes, emit mode, windows, their frames as written, aggregate, variable, patterns, focus and ``remainder``.

    ``blocks`` are the window blocks as written (name, body). ``remainder`` is what no other column holds: SELECT items, filters, grouping, nested groups
    and whatever was not understood. One projection per stage, so columns nobody asks for are not computed.
    """
    plain = F.when(F.contains(F.col(text), F.lit("#")), F.regexp_replace(F.col(text), COMMENT_FORM, "$1")).otherwise(F.col(text))
    split = queries.withColumn("_text", plain).select(
        *queries.columns, "_text", query_hash(text).alias("query_hash"), prefix_map(F.col("_text")).alias("prefixes"))
    body = F.regexp_replace(F.regexp_replace("_text", REGISTER_FORM, " "), WINDOW_FORM, " ")
    lines = F.transform(F.split(body, r"\r?\n", -1), lambda x: F.trim(x))
    # Each form is looked for once; what is read from its matches is read from these columns.
    split = split.withColumns({
        "sparql": F.regexp_replace(F.array_join(F.filter(lines, lambda x: x != ""), "\n"), rf"(?i)\bWINDOW(\s+{_NAME}\s*\{{)", "GRAPH$1"),
        "_registered": F.try_element_at(_all(F.col("_text"), REGISTER_FORM, 0), F.lit(-1)),
        "_raw": _found(F.col("_text"), WINDOW_FORM, ["w", "st", "r", "sl"])})
    split = split.withColumn("blocks", _found(F.col("sparql"), BLOCK_FORM, ["w", "b"]))

    def last(group: int, default: str) -> Column:
        return F.coalesce(F.regexp_extract("_registered", REGISTER_FORM, group), F.lit(default))

    mode = F.lower(last(1, "RStream"))
    raw = F.col("_raw")
    windows = let(F.col("prefixes"), lambda prefixes: F.transform(raw, lambda w: F.struct(
        unwrap(w["w"], prefixes).alias("name"), unwrap(w["st"], prefixes).alias("stream"),
        w["r"].try_cast("bigint").alias("width_ms"), w["sl"].try_cast("bigint").alias("slide_ms"))))
    left = F.regexp_replace(F.regexp_replace("sparql", PREFIX_FORM, " "), BLOCK_FORM, " ")
    parsed = split.select(
        *[c for c in split.columns if not c.startswith("_")],
        F.coalesce(*[F.when(mode == m.lower(), F.lit(m)) for m in EMIT_MODES]).alias("r2s_operator"),
        last(2, "undefined").alias("r2s_name"), windows.alias("windows"),
        F.transform(raw, lambda w: F.concat_ws("~", w["r"], w["sl"])).alias("frames"),
        F.lower(F.regexp_extract("sparql", SELECT_FORM, 1)).alias("aggregate"),
        F.regexp_extract("sparql", SELECT_FORM, 2).alias("aggregate_var"),
        F.regexp_extract("sparql", SELECT_FORM, 3).alias("projection_var"),
        let(F.col("prefixes"), lambda prefixes: _patterns(F.col("blocks"), prefixes)).alias("patterns"),
        F.trim(F.regexp_replace(left, r"\s+", " ")).alias("remainder"))
    return parsed.withColumn("focus", F.transform(
        F.filter("patterns", lambda x: x["p"].isin([f"<{p}>" for p in vocab.FOCUS_PREDICATES])),
        lambda x: F.regexp_replace(x["o"], r"^[<?]|>$", "")))


def _patterns(blocks: Column, prefixes: Column) -> Column:
    """Triple patterns per window block, with full IRIs."""
    def full(token: Column) -> Column:
        # A name with an unknown prefix stays as written.
        known = let(unwrap(token, prefixes), lambda iri: F.when(iri == "", token).otherwise(
            F.concat(F.lit("<"), iri, F.lit(">"))))
        return (
            F.when(token == "a", F.lit(f"<{vocab.RDF_TYPE}>"))
            .when(F.startswith(token, F.lit("$")), F.concat(F.lit("?"), F.substr(token, F.lit(2))))
            .when(F.substr(token, F.lit(1), F.lit(1)).isin("<", "?", '"', "_"), token)
            .otherwise(known)
        )

    def triples(block: Column) -> Column:
        stated = F.transform(F.split(block["b"], r"\s+\.\s*|\.(?=\s|$)", -1),
                             lambda t: F.split(F.trim(F.regexp_replace(t, r"\s+", " ")), " ", 3))
        return let(unwrap(block["w"], prefixes), lambda window: F.transform(
            F.filter(stated, lambda t: F.size(t) == 3), lambda t: F.struct(
                window.alias("window"), full(t[0]).alias("s"), full(t[1]).alias("p"), full(t[2]).alias("o"))))

    return F.flatten(F.transform(blocks, triples))


KEYWORDS = ("SELECT DISTINCT REDUCED AS WHERE FILTER OPTIONAL UNION MINUS BIND GROUP BY HAVING ORDER ASC DESC LIMIT OFFSET "
            "AVG MAX MIN SUM COUNT SAMPLE GROUP_CONCAT").split()
KEYWORD_FORM = rf"(?i)(?<![\w?:<\"'/#.-])(?:{'|'.join(KEYWORDS)})(?![\w:/\"'])"


def understood(blocks: Column, remainder: Column) -> Column:
    """Whether windows, patterns and remainder together say all that the text says.

    Blocks have to stand directly in the one WHERE group and hold plain triples, and no
    literal may look as if it held a variable or a brace.
    """
    def plain(block: Column) -> Column:
        stated = F.filter(F.split(block, r"\s+\.\s*|\.(?=\s|$)", -1), lambda t: F.trim(t) != "")
        three = F.forall(stated, lambda t: F.size(F.split(F.trim(F.regexp_replace(t, r"\s+", " ")), " ", -1)) == 3)
        return three & ~block.rlike(r"""["'();,\[\]]""")

    one_group = F.size(F.split(remainder, r"\{", -1)) == 2
    quoted = F.contains(remainder, F.lit('"')) | F.contains(remainder, F.lit("'"))
    odd_literal = (quoted & remainder.rlike(r"""["'][^"']*[?${}<:#][^"']*["']""")) | F.contains(remainder, F.lit("\\"))
    return F.forall(blocks, lambda block: plain(block["b"])) & one_group & ~odd_literal & ~remainder.rlike(r"(?i)\b(WINDOW|GRAPH|REGISTER|PREFIX|BASE|STREAM)\b")


def _is_variable(term: Column) -> Column:
    return F.startswith(term, F.lit("?"))


def _holds(t: Column, v: Column) -> Column:
    return (t["s"] == v) | (t["p"] == v) | (t["o"] == v)


def _all_apart(colours: Column) -> Column:
    return F.size(F.array_distinct(F.map_values(colours))) == F.size(colours)


def _refined(colours: Column, triples: Column) -> Column:
    """Colours once all differ, or after as many rounds as there are variables: a variable's next colour is its own and those around it."""
    def once(held: Column) -> Column:
        def of(e: Column) -> Column:
            def shown(term: Column) -> Column:
                return F.when(term == e["key"], F.lit("*")).when(_is_variable(term), F.concat(F.lit("?"), F.element_at(held, term))).otherwise(term)

            around = F.transform(F.filter(triples, lambda t: _holds(t, e["key"])), lambda t: F.concat_ws(
                " ", t["place"], shown(t["s"]), shown(t["p"]), shown(t["o"])))
            return F.struct(e["key"].alias("key"), F.md5(F.concat(e["value"], F.lit("#"), F.array_join(F.sort_array(around), ";"))).alias("value"))

        return F.map_from_entries(F.transform(F.map_entries(held), of))

    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(colours), F.lit(1))), colours, lambda held, _: F.when(
        _all_apart(held), held).otherwise(once(held)))


def _tied(colours: Column) -> Column:
    """Variables of the first colour that several have; empty if all colours differ."""
    values = F.map_values(colours)
    first = F.array_min(F.filter(values, lambda c: F.size(F.filter(values, lambda d: d == c)) > 1))
    return let(first, lambda c: F.coalesce(F.transform(F.filter(F.map_entries(colours), lambda e: e["value"] == c), lambda e: e["key"]),
                                           F.array().cast("array<string>")))


def _choices(colours: Column, triples: Column) -> Column:
    """Colourings in which one of the tied variables is told apart: each of them, or any one if all could change places."""
    def swapped(a: Column, b: Column) -> Column:
        def other(term: Column) -> Column:
            return F.when(term == a, b).when(term == b, a).otherwise(term)

        return F.sort_array(F.transform(triples, lambda t: F.struct(
            t["place"].alias("place"), other(t["s"]).alias("s"), other(t["p"]).alias("p"), other(t["o"]).alias("o"))))

    def apart(tied: Column) -> Column:
        alike = F.forall(tied, lambda b: swapped(F.get(tied, F.lit(0)), b) == F.sort_array(triples))
        tried = F.when(alike, F.slice(tied, 1, 1)).otherwise(tied)
        return F.transform(tried, lambda v: let(F.map_from_entries(F.transform(F.map_entries(colours), lambda e: F.struct(
            e["key"].alias("key"), F.when(e["key"] == v, F.concat(e["value"], F.lit("!"))).otherwise(e["value"]).alias("value")))),
            lambda marked: _refined(marked, triples)))

    return let(_tied(colours), lambda tied: F.when(F.size(tied) == 0, F.array(colours)).otherwise(apart(tied)))


def _numberings(variables: Column, triples: Column, named: Column) -> Column:
    """Colourings that tell all variables apart, the same for any names: refinement, then trial of what is left tied.

    A variable in the text around the patterns starts with its places there (``named``). Of colourings tried
    only those with the least list of colours go on, so equal queries keep equal ones.
    """
    start = F.map_from_entries(F.transform(variables, lambda v: F.struct(v.alias("key"), F.array_join(F.filter(F.transform(
        named, lambda n, i: F.when(n == v, i.cast("string"))), lambda x: x.isNotNull()), ",").alias("value"))))

    def step(tried: Column) -> Column:
        grown = F.flatten(F.transform(tried, lambda colours: _choices(colours, triples)))
        shown = lambda colours: F.array_join(F.sort_array(F.map_values(colours)), ",")
        return let(grown, lambda grown: let(F.array_min(F.transform(grown, shown)), lambda least: F.filter(
            grown, lambda colours: shown(colours) == least)))

    first = let(start, lambda colours: F.array(_refined(colours, triples)))
    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(variables), F.lit(1))), first, lambda tried, _: F.when(
        _all_apart(F.get(tried, F.lit(0))), tried).otherwise(step(tried)))


def equivalence_key(windows: Column, patterns: Column, operator: Column, blocks: Column, remainder: Column,
                    prefixes: Column, text: Column) -> Column:
    """Equal only for queries that differ in variable, window or prefix names, order, spacing or case of keywords.

    Everything else the text holds is part of the key: all SELECT items, filters, groups, conditions.
    Variables are numbered by the shape of the patterns alone, so symmetric patterns get one key however they are named and
    ordered. A text that is not wholly understood is equal to the same text alone, so the error can
    only be a missed duplicate.
    """
    def place(name: Column) -> Column:
        return let(F.get(F.filter(windows, lambda x: x["name"] == name), F.lit(0)), lambda w: F.when(
            w.isNotNull(), F.concat_ws("~", w["stream"], w["frame"])).otherwise(name))

    triples = F.transform(patterns, lambda t: F.struct(place(t["window"]).alias("place"), t["s"].alias("s"), t["p"].alias("p"), t["o"].alias("o")))
    frames = F.sort_array(F.transform(windows, lambda w: F.concat_ws("~", w["stream"], w["frame"])))
    rest = F.when(F.contains(remainder, F.lit("$")), F.regexp_replace(remainder, r"\$(\w)", "?$1")).otherwise(remainder)
    # Pieces between the keywords, and the keywords in capitals: two passes for all words.
    rest = let(rest, lambda r: F.array_join(F.flatten(F.zip_with(
        F.split(r, KEYWORD_FORM, -1), F.concat(F.transform(_all(r, KEYWORD_FORM, 0), lambda word: F.upper(word)), F.array(F.lit(""))),
        lambda between, word: F.array(between, word))), ""))
    rest = F.regexp_replace(F.regexp_replace(rest, r"\s*([(){}=<>!,+*/|&-])\s*", "$1"), r"\s+", " ")
    named = F.contains(remainder, F.lit(":")) & F.regexp_replace(remainder, _IRI, " ").rlike(r"[\w-]*:[\w-]")
    spaces = F.when(named, F.array_join(F.sort_array(F.transform(
        F.map_entries(prefixes), lambda e: F.concat_ws("=", e["key"], e["value"]))), ",")).otherwise(F.lit(""))

    def whole(triples: Column, rest: Column) -> Column:
        around = F.regexp_extract_all(rest, F.lit(r"\?\w+"), F.lit(0))
        inside = F.filter(F.flatten(F.transform(triples, lambda t: F.array(t["s"], t["p"], t["o"]))), _is_variable)

        def written(colours: Column) -> Column:
            def shown(order: Column) -> Column:
                def number(term: Column) -> Column:
                    return F.when(_is_variable(term), F.concat(F.lit("?#"), F.array_position(order, F.element_at(colours, term)).cast("string"))).otherwise(term)

                lines = F.sort_array(F.transform(triples, lambda t: F.concat_ws(" ", t["place"], number(t["s"]), number(t["p"]), number(t["o"]))))
                told = F.aggregate(F.array_distinct(around), rest, lambda acc, v: F.regexp_replace(
                    acc, F.concat(F.lit(r"\?"), F.substr(v, F.lit(2)), F.lit(r"\b")), number(v)))
                return F.concat_ws(" | ", F.array_join(lines, " . "), told)

            return let(F.sort_array(F.map_values(colours)), shown)

        return let(around, lambda around: let(F.array_distinct(F.concat(inside, around)), lambda variables: F.when(
            F.size(variables) == 0, F.concat_ws(" | ", F.array_join(F.sort_array(F.transform(triples, lambda t: F.concat_ws(
                " ", t["place"], t["s"], t["p"], t["o"]))), " . "), rest)).otherwise(
            F.array_min(F.transform(_numberings(variables, triples, around), written)))))

    known = F.concat_ws(" | ", operator, F.array_join(frames, ","), let(triples, lambda t: let(rest, lambda r: whole(t, r))), spaces)
    own = F.concat(F.lit("text "), F.trim(F.regexp_replace(text, r"\s+", " ")))
    distinct_names = F.size(F.array_distinct(F.transform(windows, lambda w: w["name"]))) == F.size(windows)
    return F.sha2(F.when(understood(blocks, remainder) & distinct_names, known).otherwise(own), 256)


def with_equivalence_key(queries: DataFrame, text: str = "query_text", out: str = "query_key") -> DataFrame:
    """The input columns plus the equivalence key of the query text."""
    parsed = catalog(queries, text).withColumn("_framed", F.transform("windows", lambda w, i: F.struct(
        w["name"].alias("name"), w["stream"].alias("stream"), F.get(F.col("frames"), i).alias("frame"))))
    return parsed.withColumn(out, equivalence_key(
        F.col("_framed"), F.col("patterns"), F.col("r2s_operator"), F.col("blocks"), F.col("remainder"), F.col("prefixes"),
        F.col(text))).select(*queries.columns, out)
