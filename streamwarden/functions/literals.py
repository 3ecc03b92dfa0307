"""RDF term text: writing and reading literals, IRIs and blank nodes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

# The short escapes of N-Triples strings.
ESCAPES = (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"))

# Term shapes of the N-Triples grammar.
IRI = r"<([^<>\"{}|^`\\\x00-\x20]+)>"
BLANK = r"_:([A-Za-z0-9_][A-Za-z0-9_.\-]*)"
# Possessive and unrolled, so that long texts neither backtrack nor recurse.
STRING = r'"([^"\\\n\r]*+(?:\\[^\n\r][^"\\\n\r]*+)*+)"'
TRIPLE_LINE = (
    r"^\s*(?:" + IRI + "|" + BLANK + r")\s*" + IRI + r"\s*(?:" + IRI + "|" + BLANK + "|"
    + STRING + r"(?:\^\^" + IRI + r"|@([A-Za-z]+(?:-[A-Za-z0-9]+)*))?)\s*\.\s*(?:#.*)?$"
)


def number(literal) -> Column:
    """Lexical form to DOUBLE; null if it is not a number."""
    return F.expr(f"try_cast({literal} AS DOUBLE)") if isinstance(literal, str) else literal.try_cast("double")


def escape(text: Column) -> Column:
    return reduce(lambda c, e: F.replace(c, F.lit(e[0]), F.lit(e[1])), ESCAPES, text)


def unescape(text: Column) -> Column:
    """Undo string escapes, numeric ones included; text without a backslash is untouched."""
    def plain(part: Column) -> Column:
        # Eight-digit escapes first; what is left is a subset of JSON's escapes.
        wide = F.split(part, r"\\U", -1)
        joined = F.array_join(F.transform(wide, lambda x, i: F.when(i == 0, x).otherwise(F.concat(
            F.decode(F.unhex(F.substring(x, 1, 8)), "UTF-32"), F.substr(x, F.lit(9))))), "")
        single = F.replace(joined, F.lit("\\'"), F.lit("'"))
        return F.coalesce(F.from_json(F.concat(F.lit('["'), single, F.lit('"]')), "array<string>")[0], single)

    parts = F.split(text, r"\\\\", -1)
    return F.when(F.contains(text, F.lit("\\")), F.array_join(F.transform(parts, plain), "\\")).otherwise(text)


def literal_text(value: Column, datatype: Column | None = None, lang: Column | None = None) -> Column:
    """``"v"``, ``"v"@lang`` or ``"v"^^<datatype>``."""
    quoted = F.concat(F.lit('"'), escape(value), F.lit('"'))
    out = quoted
    if datatype is not None:
        out = F.when(datatype.isNotNull(), F.concat(quoted, F.lit("^^<"), datatype, F.lit(">"))).otherwise(out)
    if lang is not None:
        out = F.when(lang.isNotNull(), F.concat(quoted, F.lit("@"), lang)).otherwise(out)
    return out


def term_text(value: Column, kind: Column, datatype: Column | None = None,
              lang: Column | None = None) -> Column:
    return (
        F.when(kind == "iri", F.concat(F.lit("<"), value, F.lit(">")))
        .when(kind == "blank", F.concat(F.lit("_:"), value))
        .otherwise(literal_text(value, datatype, lang))
    )


def triple_text(prefix: str = "") -> Column:
    """N-Triples line of a row of the triples table."""
    c = lambda name: F.col(prefix + name)
    return F.concat(
        term_text(c("s"), c("s_kind")), F.lit(" <"), c("p"), F.lit("> "),
        term_text(c("o"), c("o_kind"), c("o_datatype"), c("o_lang")), F.lit(" ."),
    )
