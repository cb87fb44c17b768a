"""Column expressions of the scanner: entropy, masks, fingerprints, paths. All run in the JVM."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dialect import SPACE

# The levels of findings, worst first; the mask.
SEVERITIES = ("critical", "high", "medium", "low")
CONFIDENCES = ("high", "medium", "low")
MASK, MASK_WIDTH, MASK_EDGE, MASK_LEAST = "•", 8, 2, 12


@dataclass(frozen=True)
class EntropyOptions:
    """Thresholds of the entropy gate. Values of `relaxed_length` and more need only two character classes."""

    min_length: int = 20
    max_run: int = 4
    min_distinct: int = 8
    min_classes: int = 3
    relaxed_length: int = 30
    min_entropy: float = 3.0
    min_ratio: float = 0.85


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once even within lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def units(s: Column) -> Column:
    """Length in UTF-16 units, as scripts count: characters beyond the basic plane count twice."""
    return F.length(s) + F.length(F.regexp_replace(s, "[^\\x{10000}-\\x{10FFFF}]", ""))


def shannon_entropy(s: Column) -> Column:
    """Bits a symbol, 0 for an empty string."""
    n = units(s).cast("double")
    share = lambda c: F.try_divide(((F.length(s) - F.length(F.replace(s, c, F.lit("")))) / F.length(c)).cast("double"), n)
    total = F.aggregate(F.array_distinct(F.split(s, "")), F.lit(0.0), lambda h, c: h - share(c) * F.log2(share(c)))
    return F.when(F.length(s) == 0, F.lit(0.0)).otherwise(total)


def distinct_symbols(s: Column) -> Column:
    return F.when(F.length(s) == 0, 0).otherwise(F.size(F.array_distinct(F.split(s, ""))))


def char_classes(s: Column) -> Column:
    """How many of lower case, upper case, digits and anything else occur; ASCII."""
    return sum((s.rlike(p).cast("int") for p in ("[a-z]", "[A-Z]", "[0-9]", "(?s)[^a-zA-Z0-9]")), F.lit(0))


def runs_over(s: Column, most: int) -> Column:
    """Whether a symbol repeats more than `most` times in a row."""
    return s.rlike(f"(?s)(.)\\1{{{most},}}")


def entropy_gate(s: Column, o: EntropyOptions = EntropyOptions()) -> Column:
    """Whether a value looks random; null and empty values don't.

    No part relies on another having been checked first, as expressions may be evaluated in any order.
    """
    classes = F.when(units(s) >= o.relaxed_length, F.least(F.lit(o.min_classes), F.lit(2))).otherwise(o.min_classes)
    entropy, distinct = shannon_entropy(s), distinct_symbols(s)
    ratio = F.try_divide(entropy, F.when(distinct > 1, F.log2(distinct.cast("double"))))
    passed = (units(s) >= o.min_length) & ~runs_over(s, o.max_run) & (distinct >= o.min_distinct) & (char_classes(s) >= classes) & (entropy >= o.min_entropy) & (ratio >= o.min_ratio)
    return F.coalesce(passed, F.lit(False))


def fingerprint(s: Column) -> Column:
    """Names a value without telling it: 48 bits of its SHA-256, in hexadecimal."""
    return F.substring(F.sha2(s, 256), 1, 12)


def masked(s: Column) -> Column:
    """Fixed width, so lengths aren't told; the two edges stay for values of 12 units and more."""
    bar = MASK * MASK_WIDTH
    return F.when(F.length(s) == 0, "").when(units(s) < MASK_LEAST, bar).otherwise(F.concat(F.substring(s, 1, MASK_EDGE), F.lit(bar), F.right(s, F.lit(MASK_EDGE))))


def masked_line(line: Column, secrets: Column) -> Column:
    """line with all secrets masked, longest first, each replaced literally wherever it stands."""
    ordered = F.array_sort(F.array_distinct(secrets), lambda a, b: (units(b) - units(a)).cast("int"))
    return F.aggregate(ordered, line, lambda acc, s: F.when(F.length(s) == 0, acc).otherwise(F.replace(acc, s, masked(s))))


def trimmed(s: Column) -> Column:
    """Without Unicode white space and byte order marks at both ends."""
    return F.regexp_replace(s, f"\\A[{SPACE}]+|[{SPACE}]+\\z", "")


def severity_rank(s: Column) -> Column:
    """0 for the worst; null for what isn't a severity."""
    out = F.lit(None).cast("int")
    for k, name in reversed(list(enumerate(SEVERITIES))):
        out = F.when(s == name, k).otherwise(out)
    return out


def is_severity(s: Column) -> Column:
    return F.coalesce(s.isin(*SEVERITIES), F.lit(False))


def is_confidence(s: Column) -> Column:
    return F.coalesce(s.isin(*CONFIDENCES), F.lit(False))


def fitted(s: Column, width: Column) -> Column:
    """Padded to the width, or cut with an ellipsis."""
    return F.when(units(s) > width, F.concat(F.left(s, width - 1), F.lit("…"))).otherwise(F.rpad(s, width, F.lit(" ")))


def escaped(s: Column) -> Column:
    """Message body of a workflow command: percent signs first, then line ends."""
    return F.replace(F.replace(F.replace(s, F.lit("%"), F.lit("%25")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


def extension(path: Column) -> Column:
    """Last extension of a path, lower case, with its dot; empty for none and for dotfiles."""
    return F.lower(F.regexp_extract(path, "[^/.][^/]*(\\.[^./]*)\\z", 1))


def glob_regex(pattern: str, dot: bool = False) -> str:
    """A glob over whole relative paths, as a regular expression.

    `**/` spans any number of folders, `*` and `?` stay within one; names that start with a dot only match where the
    pattern has the dot, or with dot=True. {a,b} alternates and [a-z], [!a-z] classes are supported.
    """
    hidden = "" if dot else "(?!\\.)"
    out, i, at_start = [], 0, True
    depth = 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**", i) and at_start and (i + 2 == len(pattern) or pattern[i + 2] == "/"):
            if i + 2 == len(pattern):
                out.append(f"(?:{hidden}[^/]+(?:/{hidden}[^/]+)*)")
                i += 2
            else:
                out.append(f"(?:{hidden}[^/]+/)*")
                i += 3
            continue
        if c == "*":
            while pattern.startswith("*", i + 1):
                i += 1
            lone = at_start and (i + 1 == len(pattern) or pattern[i + 1] == "/")
            out.append((hidden if at_start else "") + ("[^/]+" if lone else "[^/]*"))
        elif c == "?":
            out.append((hidden if at_start else "") + "[^/]")
        elif c == "[" and "]" in pattern[i + 2 :]:
            end = pattern.index("]", i + 2)
            body = pattern[i + 1 : end]
            negated = body[0] in "!^"
            body = re.sub(r"([\[\]\\&])", r"\\\1", body[negated:])
            out.append((hidden if at_start else "") + f"[{'^/' if negated else ''}{body}]")
            i = end
        elif c == "{" and "}" in pattern[i:]:
            depth += 1
            out.append("(?:")
        elif c == "}" and depth:
            depth -= 1
            out.append(")")
        elif c == "," and depth:
            out.append("|")
        elif c == "\\" and i + 1 < len(pattern):
            i += 1
            out.append(re.escape(pattern[i]))
        else:
            out.append(re.escape(c) if not c.isalnum() else c)
        at_start = c == "/" or (c in "{," and depth > 0 and at_start)
        i += 1
    return "\\A" + "".join(out) + "\\z"


def matches_any(path: Column, globs: Iterable[str], dot: bool = False) -> Column:
    found = [path.rlike(glob_regex(g.removeprefix("./"), dot)) for g in globs]
    out = F.lit(False)
    for f in found:
        out = out | f
    return out


def wanted(path: Column, include: Iterable[str] = ("**/*",), ignore: Iterable[str] = (), dot: bool = False) -> Column:
    """Any include matches and no ignore does."""
    return matches_any(path, include, dot) & ~matches_any(path, ignore, True)
