"""Threshold, template and chained rules that derive facts from window results."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import urls
from ..session import cut
from .. import vocab
from . import skew

# Comparison names of the rule language and what they mean.
COMPARISONS = {
    "greaterThan": lambda a, b: a > b,
    "notGreaterThan": lambda a, b: a <= b,
    "lessThan": lambda a, b: a < b,
    "notLessThan": lambda a, b: a >= b,
    "equalTo": lambda a, b: a == b,
    "notEqualTo": lambda a, b: a != b,
}


@dataclass(frozen=True)
class Threshold:
    """``premise_p`` value within bounds => (subject, derived_p, derived_o)."""

    rule_id: str
    tests: tuple[tuple[str, float], ...]
    derived_o: str
    derived_p: str = vocab.EX + "is"
    premise_p: str = vocab.HAS_VALUE


@dataclass(frozen=True)
class Template:
    """Premise triple pattern => conclusion; terms starting with '?' are variables."""

    rule_id: str
    premise: tuple[str, str, str]
    conclusion: tuple[str, str, str]


@dataclass(frozen=True)
class Path:
    """``?a first ?b . ?b second ?c`` => ``?a derived ?c``."""

    rule_id: str
    first: str
    second: str
    derived: str


@dataclass(frozen=True)
class Body:
    """All ``premises`` hold for one binding of their variables, and so do ``tests`` on them => ``conclusion``.

    A test is (variable, comparison name, number or other variable); a variable compared with a number has
    to be one. Premises have to be connected by shared variables, and the conclusion uses theirs only.
    """

    rule_id: str
    premises: tuple[tuple[str, str, str], ...]
    conclusion: tuple[str, str, str]
    tests: tuple[tuple[str, str, float | str], ...] = ()

    def __post_init__(self):
        bound, left = {t for t in self.premises[0] if t.startswith("?")}, list(self.premises[1:])
        while left:
            near = next((p for p in left if bound & set(p)), None)
            if near is None:
                raise ValueError(f"{self.rule_id}: premises without a common variable")
            left.remove(near)
            bound |= {t for t in near if t.startswith("?")}
        used = [*self.conclusion, *(x for v, _, b in self.tests for x in (v, b) if isinstance(x, str))]
        if any(t.startswith("?") and t not in bound for t in used):
            raise ValueError(f"{self.rule_id}: a variable that no premise binds")


def threshold_rules(bounds: list[tuple[float | None, float | None, str]], **common) -> list[Threshold]:
    """Rules over (lower, upper] ranges; None leaves a side open."""
    def tests(low, high):
        return tuple(t for t, b in ((("greaterThan", low), low), (("notGreaterThan", high), high)) if b is not None)

    return [Threshold(f"r{i + 1}", tests(low, high), name, **common) for i, (low, high, name) in enumerate(bounds)]


def rule_table(spark, rule_set: str, rules: list[Threshold]) -> DataFrame:
    """Rules as rows of the ``rules`` table."""
    rows = []
    for r in rules:
        t = {name: float(bound) for name, bound in r.tests}
        low = t.get("greaterThan", t.get("notLessThan", t.get("equalTo")))
        high = t.get("lessThan", t.get("notGreaterThan", t.get("equalTo")))
        rows.append((rule_set, r.rule_id, r.premise_p, low, "greaterThan" not in t, high, "lessThan" not in t,
                     r.derived_p, r.derived_o))
    return spark.createDataFrame(
        rows, "rule_set string, rule_id string, premise_p string, lower double, lower_incl boolean, "
        "upper double, upper_incl boolean, derived_p string, derived_o string")


def apply_thresholds(df: DataFrame, rules: list[Threshold], value: str = "value") -> DataFrame:
    """Rows times matching rules, as one projection: no join and no shuffle.

    The rules are part of the plan (a client sends them with the query). Adds
    ``rule_id``, ``derived_p`` and ``derived_o``; a null or NaN value matches nothing.
    """
    known = F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))

    def hit(rule: Threshold) -> Column:
        return reduce(lambda a, t: a & COMPARISONS[t[0]](F.col(value), F.lit(t[1])), rule.tests, known)

    options = F.array(*[F.when(hit(r), F.struct(
        F.lit(r.rule_id).alias("rule_id"), F.lit(r.derived_p).alias("derived_p"),
        F.lit(r.derived_o).alias("derived_o"))) for r in rules])
    found = df.withColumn("_d", F.explode(F.filter(options, lambda x: x.isNotNull())))
    return found.select(*df.columns, "_d.*")


def match_rules(facts: DataFrame, rules: DataFrame, on: list[str] = ("rule_set", "premise_p"),
                value: str = "value") -> DataFrame:
    """The same against a table of rules: equi join on the rule set, bounds as a filter.

    The table is broadcast only if its rows and bytes are counted small; otherwise the equi keys shuffle
    and hot rule sets are split.
    """
    v = F.col(value)
    within = (
        (F.col("lower").isNull() | (v > F.col("lower")) | (F.col("lower_incl") & (v == F.col("lower"))))
        & (F.col("upper").isNull() | (v < F.col("upper")) | (F.col("upper_incl") & (v == F.col("upper"))))
        & ~F.isnan(v.cast("double"))
    )
    if facts.isStreaming:
        joined = facts.join(rules, list(on))
    elif skew.counted_small(rules):
        joined = facts.join(F.broadcast(rules), list(on))
    else:
        joined = skew.salted_join(facts, rules, list(on))
    return joined.where(v.isNotNull() & within).select(*facts.columns, "rule_id", "derived_p", "derived_o")


def derivations(derived: DataFrame, facts: DataFrame) -> DataFrame:
    """Distinct derived triples that were not among the input facts."""
    new = derived.select("s", "p", "o").distinct()
    return new.join(facts.select("s", "p", "o"), ["s", "p", "o"], "left_anti")


def apply_template(triples: DataFrame, rule: Template) -> DataFrame:
    """Distinct conclusions of a one-pattern rule."""
    made = triples.select(_conclusion(rule).alias("c"))
    return made.where(F.col("c").isNotNull()).select("c.*").distinct()


def fixpoint(facts: DataFrame, rules: list[Threshold | Template | Path | Body], max_rounds: int | None = None) -> DataFrame:
    """All triples that follow from ``facts``, the facts themselves excluded.

    Each round reads only what the last round added, and is written out, so the
    plan stays short and a lost executor costs one round. Threshold and template
    rules are one projection of a triple; path rules are equi joins of the new
    triples with all known ones. A rule with a body is joined once for each premise that may take a new triple,
    the premises before it from what was known a round earlier, so no binding is found twice. After the first round only
    derived predicates are new, so premises on others get no join of their own. Facts on predicates no rule mentions are left out.
    Rounds go on until nothing new follows; ``max_rounds`` is for callers that would rather fail.
    """
    read, made = _predicates(rules)
    wanted = facts.select("s", "p", "o")
    if read is not None and made is not None:
        wanted = wanted.where(F.col("p").isin(sorted(read | made)))
    known = cut(wanted.distinct())
    fresh, added, old = known, None, None
    for _ in count() if max_rounds is None else range(max_rounds):
        produced = _concluded(fresh, known, old, rules, made if old is not None else None).distinct()
        stated = known.where(F.col("p").isin(sorted(made))) if made is not None else known
        fresh = cut(produced.join(stated, ["s", "p", "o"], "left_anti"))
        if fresh.isEmpty():
            return added if added is not None else fresh
        old, known = known, known.unionByName(fresh)
        added = fresh if added is None else added.unionByName(fresh)
    raise RuntimeError(f"rules still derive new facts after {max_rounds} rounds")


def _predicates(rules: list) -> tuple[set[str] | None, set[str] | None]:
    """Predicates the rules read and those they derive; None if a rule leaves one open."""
    pairs = [((r.first, r.second), (r.derived,)) if isinstance(r, Path)
             else (tuple(p[1] for p in r.premises), (r.conclusion[1],)) if isinstance(r, Body)
             else ((r.premise_p,), (r.derived_p,)) if isinstance(r, Threshold)
             else ((r.premise[1],), (r.conclusion[1],)) for r in rules]

    def closed(i: int) -> set[str] | None:
        found = {p for pair in pairs for p in pair[i]}
        return None if any(p.startswith("?") for p in found) else found

    return closed(0), closed(1)


def bindings(triples: DataFrame, pattern: tuple[str, str, str]) -> DataFrame:
    """One column for each variable of the pattern, named like it without its question mark."""
    seen: dict[str, str] = {}
    for column, term in zip("spo", pattern):
        if not term.startswith("?"):
            triples = triples.where(F.col(column) == term)
        elif term in seen:
            triples = triples.where(F.col(column) == F.col(seen[term]))
        else:
            seen[term] = column
    return triples.select(*[F.col(c).alias(v[1:]) for v, c in seen.items()])


def _may_be(predicate: str, made: set[str] | None) -> bool:
    """Whether a triple on one of the predicates ``made`` (None: any) fits."""
    return made is None or predicate.startswith("?") or predicate in made


def _of_body(rule: Body, fresh: DataFrame, known: DataFrame, old: DataFrame | None, made: set[str] | None = None) -> list[DataFrame]:
    """Conclusions in which a premise takes a new triple: semi-naive, one join for each premise that a triple on ``made`` fits."""
    out = []
    for new in range(len(rule.premises) if old is not None else 1):  # at first all is new
        if not _may_be(rule.premises[new][1], made):
            continue
        sources = [old if i < new else fresh if i == new else known for i in range(len(rule.premises))]
        found, left = bindings(sources[new], rule.premises[new]), [i for i in range(len(rule.premises)) if i != new]
        while left:
            i = next(i for i in left if {t[1:] for t in rule.premises[i] if t.startswith("?")} & set(found.columns))
            left.remove(i)
            other = bindings(sources[i], rule.premises[i])
            found = found.join(other, [c for c in other.columns if c in found.columns])  # sides without repeats give none
        for variable, name, bound in rule.tests:
            if isinstance(bound, str) and bound.startswith("?"):
                found = found.where(COMPARISONS[name](F.col(variable[1:]), F.col(bound[1:])))
            else:
                found = found.where(COMPARISONS[name](F.col(variable[1:]).try_cast("double"), F.lit(bound)))
        out.append(found.select(*[(F.col(t[1:]) if t.startswith("?") else F.lit(t)).alias(c) for c, t in zip("spo", rule.conclusion)]))
    return out


def _concluded(fresh: DataFrame, known: DataFrame, old: DataFrame | None, rules: list, made: set[str] | None = None) -> DataFrame:
    """What follows with a triple of ``fresh``, which is on predicates ``made`` (None: any)."""
    local = [c for r in rules if not isinstance(r, (Path, Body)) for c in [_conclusion(r)]]
    parts = [part for r in rules if isinstance(r, Body) for part in _of_body(r, fresh, known, old, made)]
    if local:
        parts.append(fresh.select(F.explode(F.filter(F.array(*local), lambda x: x.isNotNull())).alias("c")).select("c.*"))

    def edges(df: DataFrame, predicate: str, a: str, b: str) -> DataFrame:
        return df.where(F.col("p") == predicate).select(F.col("s").alias(a), F.col("o").alias(b))

    for r in (r for r in rules if isinstance(r, Path)):
        for first, second, new in ((fresh, known, r.first), (known, fresh, r.second)):
            if not _may_be(new, made):
                continue
            pairs = edges(first, r.first, "a", "b").join(edges(second, r.second, "b", "c"), "b")
            parts.append(pairs.select(F.col("a").alias("s"), F.lit(r.derived).alias("p"), F.col("c").alias("o")))
    return reduce(DataFrame.unionByName, parts) if parts else fresh.limit(0)


def _conclusion(rule: Threshold | Template) -> Column:
    """(s, p, o) that one triple yields, or null."""
    if isinstance(rule, Threshold):
        v = F.col("o").try_cast("double")
        premise = reduce(lambda a, t: a & COMPARISONS[t[0]](v, F.lit(t[1])), rule.tests,
                         (F.col("p") == rule.premise_p) & v.isNotNull() & ~F.isnan(v))
        terms = [F.col("s"), F.lit(rule.derived_p), F.lit(rule.derived_o)]
    else:
        seen: dict[str, str] = {}
        premise = F.lit(True)
        for column, term in zip("spo", rule.premise):
            if not term.startswith("?"):
                premise = premise & (F.col(column) == term)
            elif term in seen:
                premise = premise & (F.col(column) == F.col(seen[term]))
            else:
                seen[term] = column
        terms = [F.col(seen[t]) if t.startswith("?") else F.lit(t) for t in rule.conclusion]
    return F.when(premise, F.struct(*[t.alias(c) for c, t in zip("spo", terms)]))


def rules_for_streams(queries: DataFrame, profiles: DataFrame, rules: DataFrame,
                      stream: str = "stream") -> tuple[DataFrame, DataFrame]:
    """(query rows with their rules, query rows that have none).

    The chain is stream -> owner profile -> rule location -> rules. ``profiles``
    are triples; the location is the object of the rule-location predicate.
    """
    located = queries.withColumn("profile", urls.owner_profile(stream)).join(
        profiles.where(F.col("p") == vocab.RULE_LOCATION).groupBy(F.col("s").alias("profile"))
        .agg(F.min("o").alias("rule_set")), "profile", "left")
    matched = located.join(rules, "rule_set", "left")
    return (matched.where(F.col("rule_id").isNotNull()),
            matched.where(F.col("rule_id").isNull()).select(
                *queries.columns, "profile", "rule_set", F.lit("rules not found").alias("error")))
