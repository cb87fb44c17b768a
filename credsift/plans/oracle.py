"""DuckDB SQL that says in relational terms what the operators do, for checking them."""

from __future__ import annotations

from ..operators.registry import BUILTIN, Pattern
from ..operators.structure import EXTENSIONS
from ..operators.verify import FIXTURE_PREFIXES, PLACEHOLDER_MARKERS, TEST_PATHS

BAR = "••••••••"


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def re2(p: Pattern) -> str:
    return quoted(("(?i)" if "i" in p.flags else "") + p.regex)


def entropy(s: str) -> str:
    share = f"((length({s}) - length(replace({s}, c, '')))::double / length({s}))"
    return f"case when length({s}) = 0 then 0.0 else list_sum(list_transform(list_distinct(string_split({s}, '')), lambda c: -{share} * log2({share}))) end"


def classes(s: str) -> str:
    return " + ".join(f"regexp_matches({s}, '{p}')::int" for p in ("[a-z]", "[A-Z]", "[0-9]", "(?s)[^a-zA-Z0-9]"))


def distinct(s: str) -> str:
    return f"(case when length({s}) = 0 then 0 else len(list_distinct(string_split({s}, ''))) end)"


def long_run(s: str, most: int = 4) -> str:
    return f"(len(list_filter(list_distinct(string_split({s}, '')), lambda c: c <> '' and contains({s}, repeat(c, {most + 1})))) > 0)"


def gate(s: str) -> str:
    return f"(length({s}) >= 20 and not {long_run(s)} and {distinct(s)} >= 8 and {classes(s)} >= (case when length({s}) >= 30 then 2 else 3 end) and {entropy(s)} >= 3.0 and {entropy(s)} / log2({distinct(s)}) >= 0.85)"


def masked(s: str) -> str:
    return f"(case when length({s}) = 0 then '' when length({s}) < 12 then '{BAR}' else left({s}, 2) || '{BAR}' || right({s}, 2) end)"


def fingerprint(s: str) -> str:
    return f"substr(sha256({s}), 1, 12)"


def rank(s: str) -> str:
    return f"(case {s} when 'critical' then 0 when 'high' then 1 when 'medium' then 2 when 'low' then 3 end)"


def test_path(p: str) -> str:
    return f"regexp_matches({p}, {quoted('(?i)' + '|'.join(TEST_PATHS))})"


def placeholder(v: str) -> str:
    markers = " or ".join(f"contains(upper({v}), '{m}')" for m in PLACEHOLDER_MARKERS)
    return f"({markers} or regexp_matches({v}, '^<.*>$') or regexp_matches({v}, '^[$][{{].*[}}]$') or regexp_matches({v}, '^[{{][{{].*[}}][}}]$') or regexp_matches({v}, '(?i)^x{{8,}}$') or regexp_matches({v}, '^0{{8,}}$') or {long_run(v, 7)})"


def candidates(source: str, patterns: tuple[Pattern, ...] = BUILTIN) -> str:
    """CTEs that end in cand(path, line, text, ordinal, pos, col, secret): `source` selects (path, text of the file)."""
    parts = [f"src as ({source})", "ln as (select path, unnest(string_split(text, chr(10))) text, generate_subscripts(string_split(text, chr(10)), 1) line from src)"]
    for k, p in enumerate(patterns):
        groups = p.compiled.groups
        group = "".join(f", unnest(regexp_extract_all(text, {re2(p)}, {g})) g{g}" for g in range(1, groups + 1))
        secret = "coalesce(" + ", ".join([*[f"nullif(g{g}, '')" for g in range(groups, 0, -1)], "m"]) + ")"
        keep = f"where {gate('secret')}" if p.entropyCheck else ""
        parts.append(f"m{k} as (select path, line, text, generate_subscripts(regexp_extract_all(text, {re2(p)}, 0), 1) i, unnest(regexp_extract_all(text, {re2(p)}, 0)) m, unnest(string_split_regex(text, {re2(p)})[1:len(regexp_extract_all(text, {re2(p)}, 0))]) gap{group} from ln where regexp_matches(text, {re2(p)}))")
        parts.append(f"s{k} as (select path, line, text, {k} ordinal, (sum(length(gap) + length(m)) over (partition by path, line order by i rows unbounded preceding) - length(m))::int as pos, {secret} secret from m{k})")
        parts.append(f"c{k} as (select * from s{k} {keep})")
    return ",\n".join([*parts, "cand as (" + " union all ".join(f"select *, pos + 1 col from c{k}" for k in range(len(patterns))) + ")"])


def judged(source: str, patterns: tuple[Pattern, ...] = BUILTIN) -> str:
    """CTEs that end in jud(.., rule): the rule that drops each candidate, null for none, and adjusted severities.

    Structure is read from lines of the forms `const NAME = ..;` and `process.env.NAME = ..`, which is all that the corpus has.
    """
    rows = ", ".join(f"({k}, {quoted(p.id)}, {quoted(p.name)}, {quoted(p.provider)}, {quoted(p.severity)}, {quoted(p.confidence)})" for k, p in enumerate(patterns))
    suffix = f"regexp_extract(path, '[^/.][^/]*([.][^./]*)$', 1) in ({', '.join(map(quoted, EXTENSIONS))})"
    fixture = f"regexp_matches(regexp_extract(text, '^(?:const|let|var) ([A-Za-z_$][A-Za-z0-9_$]*) *=', 1), {quoted('(?i)(^|_)(' + '|'.join(FIXTURE_PREFIXES) + ')(_|$)')})"
    env = "(regexp_matches(text, '^process[.]env[.]') and pos < length(regexp_extract(text, '^process[.]env[.][A-Za-z0-9_$]*', 0)))"
    return f"""{candidates(source, patterns)},
pat(ordinal, id, name, provider, base, confidence) as (select * from (values {rows}) t),
ctx as (select path, line, list_reduce(list_prepend(any_value(text), list_transform(list_sort(list_transform(list_distinct(list(secret)), lambda s: (-length(s), s))), lambda p: p[2])), lambda a, s: replace(a, s, {masked('s')})) shown from cand group by path, line),
jud as (select cand.*, pat.*exclude (ordinal), trim(shown, ' ' || chr(9) || chr(13)) shown, case when {placeholder('secret')} then 'placeholder-value' when {suffix} and {fixture} then 'constant-alias' when {suffix} and {env} then 'env-reference' end as rule,
    case when {test_path('path')} then 'low' else base end as severity from cand join pat using (ordinal) join ctx using (path, line))"""


def findings(source: str, patterns: tuple[Pattern, ...] = BUILTIN) -> str:
    """CTEs that end in fin, with the columns of findings."""
    return f"""{judged(source, patterns)},
fin as (select id "patternId", name "patternName", provider, severity, confidence, path as file, line::int line, col::int "column", {masked('secret')} masked, shown, {fingerprint('secret')} fingerprint, ordinal, {rank('severity')} rank from jud where rule is null)"""
