"""Verification: rules that drop candidates or change their severity.

A rule is a function of a Row of columns (path, raw value, structural facts) and gives a verdict: null keeps, else a struct of
action (drop or adjust), reason, severity, confidence. A drop is final; adjustments compose and the last one of a field wins.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as fn
from ..functions.dialect import translate
from . import detect, matching, structure
from .registry import BUILTIN, Pattern

# Paths of tests, markers and shapes of placeholders, prefixes of fixture variables.
TEST_PATHS = (r"(^|/)tests?/", r"(^|/)__tests__/", r"(^|/)specs?/", r"(^|/)fixtures?/", r"(^|/)mocks?/", r"\.test\.[cm]?[jt]sx?$", r"\.spec\.[cm]?[jt]sx?$", r"\.example$", r"\.sample$", r"(^|/)\.env\.example$", r"(^|/)\.env\.sample$")
PLACEHOLDER_MARKERS = ("YOUR_", "YOUR-", "MY_", "MY-", "_HERE", "-HERE", "GOES_HERE", "GOES-HERE", "REPLACE_ME", "REPLACE-ME", "CHANGEME", "CHANGE_ME", "CHANGE-ME", "PLACEHOLDER", "NOT_A_REAL", "NOT-A-REAL", "DUMMY", "SAMPLE", "EXAMPLE", "TODO", "FIXME")
PLACEHOLDER_SHAPES = ((r"^<.*>$", ""), (r"^\$\{.*\}$", ""), (r"^\{\{.*\}\}$", ""), (r"^x{8,}$", "i"), (r"^0{8,}$", ""), (r"(.)\1{7,}", ""))
FIXTURE_PREFIXES = ("MOCK", "FAKE", "TEST", "DUMMY", "SAMPLE", "EXAMPLE", "STUB")

VERDICT = "struct<rule:string,action:string,reason:string,severity:string,confidence:string>"


@dataclass(frozen=True)
class Subject:
    """What a rule sees of a candidate."""

    path: Column
    raw_value: Column
    has_tree: Column
    declared: Column
    in_access: Column
    interpolated: Column


def verdict(rule: str, action: str, reason: Column | str, severity: str | None = None, confidence: str | None = None) -> Column:
    text = reason if isinstance(reason, Column) else F.lit(reason)
    return F.struct(F.lit(rule).alias("rule"), F.lit(action).alias("action"), text.alias("reason"), F.lit(severity).cast("string").alias("severity"), F.lit(confidence).cast("string").alias("confidence"))


def is_test_path(path: Column) -> Column:
    return path.rlike("|".join(f"(?:{translate(p, 'i').regex})" for p in TEST_PATHS))


def placeholder_marker(value: Column) -> Column:
    """First marker, in the list's order, that the value contains in any case; null for none."""
    first = lambda upper: F.coalesce(*[F.when(F.contains(upper, F.lit(m)), m) for m in PLACEHOLDER_MARKERS])
    return fn.let(F.upper(fn.trimmed(value)), first)


def placeholder_shape(value: Column) -> Column:
    return fn.let(fn.trimmed(value), lambda v: reduce(lambda a, b: a | b, [v.rlike(translate(*s).regex) for s in PLACEHOLDER_SHAPES]))


def test_path(s: Subject) -> Column:
    return F.when(is_test_path(s.path), verdict("test-path", "adjust", "path of a test", severity="low"))


def placeholder_value(s: Subject) -> Column:
    by_marker = lambda m: F.when(m.isNotNull(), verdict("placeholder-value", "drop", F.concat(F.lit('a stand-in says "'), m, F.lit('"'))))
    return F.coalesce(fn.let(placeholder_marker(s.raw_value), by_marker), F.when(placeholder_shape(s.raw_value), verdict("placeholder-value", "drop", "shaped like a stand-in")))


def constant_alias(s: Subject) -> Column:
    fixture = s.declared.rlike(f"(?i)(^|_)({'|'.join(FIXTURE_PREFIXES)})(_|\\z)")
    return F.when(s.has_tree & fixture, verdict("constant-alias", "drop", F.concat(F.lit('value of the fixture "'), s.declared, F.lit('"'))))


def env_reference(s: Subject) -> Column:
    return F.when(s.has_tree & s.in_access, verdict("env-reference", "drop", "part of a look-up in the environment"))


def template_literal_value(s: Subject) -> Column:
    return F.when(s.has_tree & s.interpolated, verdict("template-literal-value", "drop", "part of an expression within a template"))


Rule = Callable[[Subject], Column]
#: The rules of a scan, in order. template_literal_value is there for callers that want it.
RULES: tuple[Rule, ...] = (test_path, placeholder_value, constant_alias, env_reference)
#: Parser: (text, extension, places) -> facts, as structure.facts.
Parser = matching.Parser


def judged(files: DataFrame, patterns: list[Pattern] | tuple[Pattern, ...] = BUILTIN, rules: tuple[Rule, ...] = RULES, parser: Parser = structure.facts, options: fn.EntropyOptions = fn.EntropyOptions(), failed: bool = False) -> DataFrame:
    """Candidates of rows of (path, content) with `verdicts`, the non-null verdicts in rule order, of which those after the first drop are
    void. A file on which matching or the parser raises has none, or, with `failed`, a row of nulls and its `failure`."""
    bearing = detect.with_candidates(files, patterns, options, parser)
    return _with_verdicts(detect.exploded(bearing, patterns, keep=("facts", *["failure"] * failed), outer=failed), rules).drop("facts", "nth")


def _with_verdicts(rows: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Rows with `verdicts`, computed once: what stands above a generator isn't pushed into it, so no test of verdicts repeats them."""
    verdicts = _verdicts(rows.sparkSession.sparkContext.applicationId, tuple(rules))
    return rows.select("*", F.inline(F.array(F.struct(verdicts.alias("verdicts")))))


def failures(files: DataFrame, patterns: list[Pattern] | tuple[Pattern, ...] = BUILTIN, parser: Parser = structure.facts, options: fn.EntropyOptions = fn.EntropyOptions()) -> DataFrame:
    """(path, reason) of the files on which matching or the parser raises."""
    return detect.with_candidates(files, patterns, options, parser).where("failure is not null").select("path", F.col("failure").alias("reason"))


def outcomes(files: DataFrame, patterns: list[Pattern] | tuple[Pattern, ...] = BUILTIN, rules: tuple[Rule, ...] = RULES, parser: Parser = structure.facts, options: fn.EntropyOptions = fn.EntropyOptions(), seconds: float = matching.SEARCH_SECONDS) -> DataFrame:
    """(file, reason, found, shown): all that a scan of (path, content, read_error) can say, a row for each file, from one pass.

    `reason` says why a file was skipped, null for most; `found` are its findings, and `shown` the masked lines that they stand in, once
    each, or null. findings_of() makes rows of findings from them.
    """
    readable = files.withColumn("content", F.when(F.col("read_error").isNull(), F.col("content")))
    scanned = detect.with_outcomes(readable, patterns, options, parser, seconds)
    kept = F.filter(F.transform("scanned.candidates", _finding(tuple(patterns), tuple(rules))), lambda c: ~c["dropped"])
    any_found = lambda f: F.when(F.size(f) > 0, F.transform(f, lambda c: F.struct(*[c[k] for k in _FOUND])))
    rows = scanned.select(F.col("path").alias("file"), F.coalesce("read_error", "scanned.failure").alias("reason"), fn.let(kept, any_found).alias("found"), F.col("scanned.shown").alias("shown"))
    return rows.withColumn("shown", F.when(F.col("found").isNotNull(), F.col("shown")))


_FOUND = ("ordinal", "line", "column", "nth_line", "severity", "confidence", "masked", "fingerprint")


def _finding(patterns: tuple[Pattern, ...], rules: tuple[Rule, ...]) -> Callable[[Column, Column], Column]:
    """A candidate within its file's array to a finding, or to one that is dropped."""
    of = lambda f, c: F.get(F.array(*[F.lit(getattr(p, f)) for p in patterns]), c["ordinal"])

    def judge(c: Column, i: Column) -> Column:
        fact, no = F.get(F.col("scanned.facts"), i), F.lit(False)
        subject = Subject(F.col("path"), c["raw_value"], F.coalesce(fact["has_tree"], no), fact["declared"], F.coalesce(fact["in_access"], no), F.coalesce(fact["interpolated"], no))
        last = lambda v, f: F.coalesce(F.get(F.reverse(F.filter(F.transform(v, lambda x: x[f]), lambda x: x.isNotNull())), F.lit(0)), of(f, c))
        said = lambda v: F.struct(
            *[c[k].alias(k) for k in _FOUND[:4]], last(v, "severity").alias("severity"), last(v, "confidence").alias("confidence"),
            fn.masked(c["raw_value"]).alias("masked"), fn.fingerprint(c["raw_value"]).alias("fingerprint"), F.exists(v, lambda x: x["action"] == "drop").alias("dropped"),
        )
        return fn.let(_said(rules, subject), said)

    return judge


def findings_of(outcomes: DataFrame, patterns: list[Pattern] | tuple[Pattern, ...] = BUILTIN) -> DataFrame:
    """Rows of findings from outcomes() with the same patterns."""
    of = lambda f: F.get(F.array(*[F.lit(getattr(p, f)) for p in patterns]), F.col("f.ordinal")).alias(f)
    rows = outcomes.where("found is not null").select("file", "shown", F.explode("found").alias("f"))
    named = rows.select(of("id").alias("patternId"), of("name").alias("patternName"), of("provider"), "f.*", "file", F.array(F.get("shown", F.col("f.nth_line"))).alias("context"))
    return named.select(*FINDING, "ordinal")


@lru_cache(maxsize=32)
def _verdicts(app: str, rules: tuple[Rule, ...]) -> Column:
    """Verdicts of the rules on a row of judged(), built once for each application."""
    fact, no = F.get(F.col("facts"), F.col("nth")), F.lit(False)
    return _said(rules, Subject(F.col("file"), F.col("raw_value"), F.coalesce(fact["has_tree"], no), fact["declared"], F.coalesce(fact["in_access"], no), F.coalesce(fact["interpolated"], no)))


def _said(rules: tuple[Rule, ...], subject: Subject) -> Column:
    """What the rules say of a candidate, in their order; silence is left out."""
    if not rules:
        return F.array().cast(f"array<{VERDICT}>")
    return F.filter(F.array(*[r(subject).cast(VERDICT) for r in rules]), lambda v: v.isNotNull())


def survivors(rows: DataFrame) -> DataFrame:
    """Findings: judged candidates without the dropped ones, severity and confidence adjusted, the raw value gone for good."""
    changed = lambda f: F.coalesce(F.get(F.reverse(F.filter(F.transform("verdicts", lambda v: v[f]), lambda x: x.isNotNull())), F.lit(0)), F.col(f))
    kept = rows.where(~F.exists("verdicts", lambda v: v["action"] == "drop"))
    return kept.withColumns({f: changed(f) for f in ("severity", "confidence")}).select(*FINDING, "ordinal")


#: Columns of a finding, in the order that reports have them; `ordinal` follows them to settle ties.
FINDING = ("patternId", "patternName", "provider", "severity", "confidence", "file", "line", "column", "masked", "context", "fingerprint")


def findings(files: DataFrame, patterns: list[Pattern] | tuple[Pattern, ...] = BUILTIN, rules: tuple[Rule, ...] = RULES, parser: Parser = structure.facts, options: fn.EntropyOptions = fn.EntropyOptions()) -> DataFrame:
    """Rows of (path, content) to findings."""
    return survivors(judged(files, patterns, rules, parser, options))
