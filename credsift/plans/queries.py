"""The registered queries: every operator over whole tables, each with its DuckDB equivalent where SQL has one.

The tables' own texts hold few secrets, so many queries run over a derived corpus: one line a customer, with keys of every
pattern, placeholders, periodic values, fixtures and environment accesses, by the same SQL text in both engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as fn
from ..operators import detect, registry, structure, summary, verify
from ..operators.registry import BUILTIN, Pattern
from ..sources import files as sources
from . import evaluate
from . import oracle as o
from .store import stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

_H, _D = "md5(c_name)", "translate(md5(c_name), 'abcdef', '123456')"
_Q = "chr(34)"
LINE = f"""case c_custkey % 20
when 0 then 'const key = ' || {_Q} || 'AKIA' || upper(substr({_H}, 1, 16)) || {_Q} || ';'
when 1 then 'token: ghp_' || {_H} || substr({_H}, 1, 4)
when 2 then 'billing sk_live_' || substr({_H}, 1, 26) || ' é'
when 3 then 'publish pk_live_' || substr({_H}, 1, 26)
when 4 then 'x github_pat_' || substr({_H}, 1, 30)
when 5 then 'sk-' || substr({_H}, 1, 22) || 'T3BlbkFJ' || substr({_H}, 5, 22)
when 6 then 'xoxb-' || substr({_D}, 1, 12) || '-' || substr({_D}, 9, 11) || '-' || substr({_H}, 1, 26)
when 7 then 'bearer eyJ' || substr({_H}, 1, 14) || '.eyJ' || substr({_H}, 3, 16) || '.' || substr({_H}, 9, 20)
when 8 then 'api_key = ' || {_Q} || {_H} || {_Q}
when 9 then 'password: ' || {_Q} || repeat(substr({_H}, 1, 3), 8) || {_Q}
when 10 then 'secret = ' || {_Q} || 'example_' || {_H} || {_Q}
when 11 then 'see the manual ' || {_H}
when 12 then 'aws_secret_access_key = ' || {_Q} || {_H} || substr({_H}, 9, 8) || {_Q}
when 13 then '  AKIA' || upper(substr({_H}, 1, 16)) || ' and ghp_' || {_H} || 'abcd and AKIA' || upper(substr({_H}, 17, 16)) || '  '
when 14 then 'const MOCK_TOKEN = ' || {_Q} || 'ghp_' || {_H} || 'abcd' || {_Q} || ';'
when 15 then 'process.env.API_KEY = ' || {_Q} || {_H} || {_Q} || ';'
when 16 then 'sk_live_' || repeat('x', 24) || substr({_H}, 1, 2)
when 17 then 'éghp_' || {_H} || 'abcd ghp_' || {_H} || 'efgh'
when 18 then 'let password = ' || {_Q} || upper(substr({_H}, 1, 10)) || substr({_H}, 11, 12) || '!' || {_Q} || ';'
else 'token=' || chr(39) || 'AKIA' || upper(substr({_H}, 1, 16)) || chr(39) || ' pwd: ' || {_Q} || substr({_H}, 1, 18) || {_Q} end"""
FOLDER = "case c_custkey % 7 when 0 then 'src/app' when 1 then 'test/unit' when 2 then 'config' when 3 then 'docs' when 4 then 'src/__tests__' when 5 then 'lib/mocks' else 'src/core' end"
NAME = "case c_custkey % 6 when 0 then '.ts' when 1 then '.yml' when 2 then '.md' when 3 then '.spec.js' when 4 then '.env.example' else '.jsx' end"
CORPUS = f"select {FOLDER} || '/f' || cast(c_custkey as varchar(20)) || {NAME} as path, {LINE} as text, c_custkey from customer"
#: As CORPUS, several lines to a file.
GROUPED = f"select {FOLDER} || '/g' || cast(c_custkey % 50 as varchar(20)) || {NAME} as path, {LINE} as text, c_custkey from customer"
VALUES = f"select c_custkey as id, case c_custkey % 5 when 0 then {_H} when 1 then upper(substr({_H}, 1, 12)) || substr({_H}, 13, 10) || '!-' when 2 then repeat(substr({_H}, 1, 4), 7) when 3 then substr({_H}, 1, cast(c_custkey % 24 as int)) else substr({_H}, 1, 9) || repeat('a', cast(c_custkey % 9 as int)) || upper(substr({_H}, 20, 10)) end as v from customer"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derived(spark: SparkSession, sf_dir: str, sql: str = CORPUS, rows_a_task: int | None = None) -> DataFrame:
    """Rows of SQL over customer; the table stands in the text by name, so no view is left behind.

    rows_a_task deals the thin rows out before the SQL makes them long: files' sizes don't tell how much text comes of them.
    """
    customer = read(spark, sf_dir, "customer")
    if rows_a_task:
        customer = customer.repartition(max(spark.sparkContext.defaultParallelism, -(-customer.count() // rows_a_task)))
    return spark.sql(sql.replace("{", "{{").replace("}", "}}").replace("from customer", "from {customer}"), customer=customer)


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir).select("path", F.col("text").alias("content"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select(F.concat(F.lit("documents/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.col("text").alias("content"))


DOCUMENTS_SQL = "select 'documents/' || doc_id || '.txt' as path, coalesce(text, '') as text from documents"
CORPUS_FINDINGS = f"with {o.findings(CORPUS)}\n"
SHOWN = ("patternId", "patternName", "provider", "severity", "confidence", "file", "line", "column", "masked", "shown", "fingerprint")
SHOWN_SQL = '"patternId", "patternName", provider, severity, confidence, file, line, "column", masked, shown, fingerprint'


def shown(findings: DataFrame) -> DataFrame:
    return findings.withColumn("shown", F.get("context", F.lit(0))).select(*SHOWN)


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify.findings(corpus(spark, sf_dir))


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


# ---- lines, matches, detection


@query("select 'documents/' || doc_id || '.txt' as path, count(*)::bigint as n_lines, sum(length(l))::bigint as n_chars from (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) l from documents) group by doc_id")
def scan_lines(spark, sf_dir):
    return detect.lines(documents(spark, sf_dir)).groupBy("path").agg(F.count("*").alias("n_lines"), F.sum(F.length("text")).cast("long").alias("n_chars"))


@query(f"with {o.findings(DOCUMENTS_SQL)} select {SHOWN_SQL} from fin")
def scan_documents(spark, sf_dir):
    return shown(verify.findings(documents(spark, sf_dir)))


TURN = "concat(coalesce(text, ''), chr(10), case when role = 'user' then concat('token: ghp_', md5(concat(cast(conv_id as varchar(20)), '/', cast(turn as varchar(20)))), 'abcd') else '' end)"


@query(f"with {o.findings(f"select 'conv/' || conv_id || '/' || turn as path, {TURN} as text from conversations")} select {SHOWN_SQL} from fin")
def scan_conversations(spark, sf_dir):
    """Whole turns; as none holds a secret, those of users get a line with one."""
    rows = read(spark, sf_dir, "conversations")
    return shown(verify.findings(rows.select(F.concat(F.lit("conv/"), F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string")).alias("path"), F.expr(TURN).alias("content"))))


@query(f"with {o.findings(CORPUS)} select {SHOWN_SQL} from fin")
def scan_corpus(spark, sf_dir):
    return shown(found(spark, sf_dir))


_CANDIDATES = ("file", "patternId", "line", "column", "masked", "fingerprint")
_CAND_SQL = f"{o.masked('secret')} masked, {o.fingerprint('secret')} fingerprint"


@query(f"with {o.judged(CORPUS)} select path as file, id \"patternId\", line::int line, col::int \"column\", {_CAND_SQL} from jud")
def detect_all_patterns(spark, sf_dir):
    return detect.candidates(corpus(spark, sf_dir)).select(*_CANDIDATES)


def _detect_one(p: Pattern) -> None:
    def run(spark, sf_dir):
        return detect.candidates(corpus(spark, sf_dir), (p,)).select(*_CANDIDATES)

    name = "detect_" + p.id.replace("-", "_")
    QUERIES[name] = run
    ORACLE[name] = f"with {o.candidates(CORPUS, (p,))} select path as file, {o.quoted(p.id)} as \"patternId\", line::int line, col::int \"column\", {_CAND_SQL} from cand"


for _p in BUILTIN:
    _detect_one(_p)

DENSE = Pattern("dense", "Words in a row", "custom", r"\b([a-z]+) (on|the|of) ([a-z]+)", "", "low", "low", False)
_CONV = "select 'conv/' || conv_id || '/' || turn as path, coalesce(text, '') as text from conversations"


@query(f"with {o.candidates(_CONV, (DENSE,))} select path, line::int line, col::int \"column\", {o.fingerprint('secret')} fingerprint from cand")
def match_positions(spark, sf_dir):
    rows = read(spark, sf_dir, "conversations").select(F.concat(F.lit("conv/"), F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string")).alias("path"), F.col("text").alias("content"))
    return detect.candidates(rows, (DENSE,)).select(F.col("file").alias("path"), "line", "column", "fingerprint")


LINKS = (Pattern("link", "Target of a link", "web", r'href="/([^" ]*)"', "i", "low", "medium", False),)


@query(f"with {o.candidates("select 'pages/' || page_id as path, coalesce(html, '') as text from pages", LINKS)} select path as file, line::int line, col::int \"column\", {_CAND_SQL} from cand")
def custom_pattern_scan(spark, sf_dir):
    rows = read(spark, sf_dir, "pages").select(F.concat(F.lit("pages/"), F.col("page_id").cast("string")).alias("path"), F.col("html").alias("content"))
    return detect.candidates(rows, LINKS).select("file", "line", "column", "masked", "fingerprint")


PROPS = (Pattern("long-number", "Number in properties", "web", r'"[a-z]+": ?"?([0-9]+)', "", "low", "low", False),)


@query(f"with {o.candidates('select event_id::varchar as path, coalesce(props, chr(32)) as text from events', PROPS)} select path as file, col::int \"column\", {o.fingerprint('secret')} fingerprint from cand")
def custom_pattern_events(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("path"), F.col("props").alias("content"))
    return detect.candidates(rows, PROPS).select("file", "column", "fingerprint")


@query(f"with {o.candidates(GROUPED)} select path, count(*)::bigint as candidates from cand group by path")
def candidate_files_only(spark, sf_dir):
    rows = derived(spark, sf_dir, GROUPED).select("path", F.col("text").alias("content"))
    return detect.with_candidates(rows).groupBy("path").agg(F.sum(F.size("candidates")).cast("long").alias("candidates"))


# ---- scalar functions


def _values(spark, sf_dir):
    return derived(spark, sf_dir, VALUES)


def _over_values(name: str, column: Callable[[str], object], sql: str) -> None:
    def run(spark, sf_dir):
        return _values(spark, sf_dir).select("id", column(F.col("v")).alias("result"))

    QUERIES[name], ORACLE[name] = run, f"with t as ({VALUES}) select id, {sql} as result from t"


_over_values("entropy_score", lambda v: F.round(fn.shannon_entropy(v), 9), f"round({o.entropy('v')}, 9)")
_over_values("entropy_gate", fn.entropy_gate, o.gate("v"))
_over_values("char_classes", fn.char_classes, f"({o.classes('v')})::int")
_over_values("distinct_symbols", fn.distinct_symbols, f"{o.distinct('v')}::int")
_over_values("max_run_filter", lambda v: fn.runs_over(v, 4), o.long_run("v"))
_over_values("fingerprint_secret", fn.fingerprint, o.fingerprint("v"))
_over_values("redact_secret", fn.masked, o.masked("v"))
_over_values("pad_or_truncate", lambda v: fn.fitted(v, F.lit(10)), "case when length(v) > 10 then left(v, 9) || '…' else rpad(v, 10, ' ') end")
_over_values("escape_data", lambda v: fn.escaped(F.concat(v, F.lit("%\r\n100%"))), "replace(replace(replace(v || '%' || chr(13) || chr(10) || '100%', '%', '%25'), chr(13), '%0D'), chr(10), '%0A')")
_over_values("trim_whitespace", lambda v: fn.trimmed(F.concat(F.lit("\t \r"), v, F.lit(" \n\f"))), "trim(chr(9) || ' ' || chr(13) || v || ' ' || chr(10) || chr(12), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")


_OWN_OPTIONS = fn.EntropyOptions(min_length=12, max_run=3, min_distinct=5, min_classes=2, relaxed_length=24, min_entropy=2.0, min_ratio=0.7)
_over_values(
    "entropy_options", lambda v: fn.entropy_gate(v, _OWN_OPTIONS),
    f"(length(v) >= 12 and not {o.long_run('v', 3)} and {o.distinct('v')} >= 5 and {o.classes('v')} >= 2 and {o.entropy('v')} >= 2.0 and {o.entropy('v')} / log2({o.distinct('v')}) >= 0.7)",
)
_LEVEL = "case id % 8 when 0 then 'critical' when 1 then 'high' when 2 then 'medium' when 3 then 'low' when 4 then 'HIGH' when 5 then '' when 6 then v end"


@query(f"with t as (select id, {_LEVEL} as level from ({VALUES})) select id, coalesce(level in ('critical', 'high', 'medium', 'low'), false) as is_severity, coalesce(level in ('high', 'medium', 'low'), false) as is_confidence, coalesce({o.rank('level')}, -1)::int as rank from t")
def severity_levels(spark, sf_dir):
    level = F.expr(_LEVEL)
    return _values(spark, sf_dir).select("id", fn.is_severity(level).alias("is_severity"), fn.is_confidence(level).alias("is_confidence"), F.coalesce(fn.severity_rank(level), F.lit(-1)).alias("rank"))


_NAMES = "select distinct case c_custkey % 2 when 0 then substr(md5(c_name), 1, 3) else upper(substr(md5(c_name), 1, 3)) end as file from customer"


@query(f"with t as ({_NAMES}) select file, row_number() over (order by lower(file), case when file = lower(file) then 0 else 1 end)::int as place from t")
def files_by_name(spark, sf_dir):
    """Names as people sort them: letters before their capitals, both before the next letter."""
    return _placed(derived(spark, sf_dir, _NAMES).orderBy(summary.by_name(F.col("file"))), "place")


@query(f"with t as ({CORPUS}) select path, regexp_extract(lower(path), '[^/.][^/]*([.][^./]*)$', 1) as extension, regexp_extract(lower(path), '[^/.][^/]*([.][^./]*)$', 1) in ('.js', '.jsx', '.mjs', '.cjs', '.ts', '.tsx', '.mts', '.cts') as supported from t")
def supported_files(spark, sf_dir):
    suffix = fn.extension(F.col("path"))
    return derived(spark, sf_dir).select("path", suffix.alias("extension"), suffix.isin(*structure.EXTENSIONS).alias("supported"))


@query(f"with t as ({CORPUS}) select path from t where (regexp_matches(path, '^src/.*[.]ts$') or regexp_matches(path, '^[^/]+/[^/]*[.]yml$')) and not regexp_matches(path, '^src/core/')")
def include_ignore_filter(spark, sf_dir):
    return derived(spark, sf_dir).where(fn.wanted(F.col("path"), ("src/**/*.ts", "*/*.yml"), ("src/core/**",))).select("path")


@query("with t as (select (case c_custkey % 6 when 0 then 'node_modules/' when 1 then 'a/node_modules/' when 2 then 'dist/x/' when 3 then '' when 4 then 'a/' else 'coverage/' end) || (case c_custkey % 4 when 0 then 'a.log' when 1 then 'yarn.lock' when 2 then 'i.ts' else 'package-lock.json' end) as path, c_custkey from customer) select path, count(*)::bigint n from t where not regexp_matches(path, '^(node_modules|[.]git|dist|build|coverage)/') and not regexp_matches(path, '^[^/]*[.]log$') and path not in ('package-lock.json', 'pnpm-lock.yaml', 'yarn.lock') group by path")
def default_ignores(spark, sf_dir):
    folder = "case c_custkey % 6 when 0 then 'node_modules/' when 1 then 'a/node_modules/' when 2 then 'dist/x/' when 3 then '' when 4 then 'a/' else 'coverage/' end"
    name = "case c_custkey % 4 when 0 then 'a.log' when 1 then 'yarn.lock' when 2 then 'i.ts' else 'package-lock.json' end"
    paths = read(spark, sf_dir, "customer").select(F.concat(F.expr(folder), F.expr(name)).alias("path"))
    return paths.where(fn.wanted(F.col("path"), ignore=sources.DEFAULT_IGNORE)).groupBy("path").agg(F.count("*").alias("n"))


# ---- rules


@query(f"with t as ({CORPUS}) select path, {o.test_path('path')} as is_test from t")
def rule_test_path(spark, sf_dir):
    return derived(spark, sf_dir).select("path", verify.is_test_path(F.col("path")).alias("is_test"))


@query(f"with t as (select id, case id % 9 when 0 then 'your_' || v when 1 then '<' || v || '>' when 2 then '$' || '{{' || v || '}}' when 3 then repeat('0', 9) when 4 then 'XxXxXxXxX' when 5 then '{{{{' || v || '}}}}' when 6 then v || 'aaaaaaaa' else v end as v from ({VALUES})) select id, {o.placeholder('v')} as placeholder from t")
def rule_placeholder(spark, sf_dir):
    v = F.expr("case id % 9 when 0 then 'your_' || v when 1 then '<' || v || '>' when 2 then '$' || '{' || v || '}' when 3 then repeat('0', 9) when 4 then 'XxXxXxXxX' when 5 then '{{' || v || '}}' when 6 then v || 'aaaaaaaa' else v end")
    return _values(spark, sf_dir).select("id", (verify.placeholder_marker(v).isNotNull() | verify.placeholder_shape(v)).alias("placeholder"))


def _judged(spark, sf_dir):
    return verify.judged(corpus(spark, sf_dir))


def _dropped_by():
    return F.get(F.filter("verdicts", lambda v: v["action"] == "drop"), F.lit(0))["rule"]


@query(f"with {o.judged(CORPUS)} select path as file, line::int line, col::int \"column\", id \"patternId\", rule, case when rule is null then severity end as severity from jud")
def rule_chain(spark, sf_dir):
    adjusted = F.get(F.filter("verdicts", lambda v: v["severity"].isNotNull()), F.lit(0))["severity"]
    return _judged(spark, sf_dir).select("file", "line", "column", "patternId", _dropped_by().alias("rule"), F.when(_dropped_by().isNull(), F.coalesce(adjusted, F.col("severity"))).alias("severity"))


@query(f"with {o.judged(CORPUS)} select path as file, line::int line, col::int \"column\" from jud where rule = 'constant-alias'")
def rule_constant_alias(spark, sf_dir):
    return _judged(spark, sf_dir).where(_dropped_by() == "constant-alias").select("file", "line", "column")


@query(f"with {o.judged(CORPUS)} select path as file, line::int line, col::int \"column\" from jud where rule = 'env-reference'")
def rule_env_reference(spark, sf_dir):
    return _judged(spark, sf_dir).where(_dropped_by() == "env-reference").select("file", "line", "column")


_TEMPLATE = f"select 'src/t' || cast(c_custkey as varchar(20)) || '.ts' as path, 'const u = ' || chr(96) || case when c_custkey % 2 = 0 then 'AKIA' || upper(substr({_H}, 1, 16)) || '-$' || '{{x}}' else '$' || '{{' || chr(34) || 'AKIA' || upper(substr({_H}, 1, 16)) || chr(34) || '}}' end || chr(96) || ';' as text, c_custkey from customer"


@query(f"with t as ({_TEMPLATE}) select path as file, 1::int as line, c_custkey % 2 = 1 as interpolated from t")
def rule_template_literal(spark, sf_dir):
    """The optional rule, on keys in the static text of templates and in interpolations."""
    rows = derived(spark, sf_dir, _TEMPLATE).select("path", F.col("text").alias("content"))
    judged = verify.judged(rows, rules=(verify.template_literal_value,))
    return judged.select("file", "line", (F.size("verdicts") > 0).alias("interpolated"))


#: Sources of several lines, with a key where @ stands, and the rule that drops each line's key.
_SOURCES = (
    (("const MOCK_PAGE = () => (", """  <Layout title="it's">Don't "{cond ? <b>{`x`}</b> : "@"}"</Layout>""", ");", 'const page = "@";'), {2: "constant-alias", 4: None}),
    (('const FAKE_URL = `a ${f(`b ${"@"}`)} c`;', "const url = `@ ${x}`;"), {1: "constant-alias", 2: None}),
    (("if (x) /[\"'`]/.test(y);", 'let TEST_KEY = "@";', 'const ratio = (a) / b / c, real = "@";'), {2: "constant-alias", 3: None}),
    (('const MOCK_A = "@;', 'const MOCK_B = "@";', 'foo(["@";', 'const STUB_C = "@";'), {1: None, 2: "constant-alias", 3: None, 4: "constant-alias"}),
    (("const a = process.env[", '  "@"', "];", 'const b = import.meta.env.X + "@";'), {2: "env-reference", 4: None}),
)
# a dollar sign and a brace together would name a variable of the session
_SOURCE_TEXTS = " ".join("when " + str(k) + " then " + " || chr(10) || ".join(o.quoted(line).replace("${", "$' || '{") for line in lines) for k, (lines, _) in enumerate(_SOURCES))
_MULTILINE = f"select 'src/m' || cast(c_custkey as varchar(20)) || '.tsx' as path, replace(case c_custkey % 5 {_SOURCE_TEXTS} end, '@', 'AKIA' || upper(substr({_H}, 1, 16))) as text, c_custkey from customer"
_DUE = ", ".join(f"({k}, {line}, {o.quoted(rule) if rule else 'null'})" for k, (_, due) in enumerate(_SOURCES) for line, rule in due.items())


@query(f"select 'src/m' || c_custkey || '.tsx' as file, line::int as line, rule from customer join (values {_DUE}) d(k, line, rule) on c_custkey % 5 = k")
def rule_multiline_sources(spark, sf_dir):
    """Markup, nested templates, regular expressions after brackets, broken statements, accesses over several lines."""
    rows = derived(spark, sf_dir, _MULTILINE).select("path", F.col("text").alias("content"))
    return verify.judged(rows).select("file", "line", _dropped_by().alias("rule"))


@query(f"with {o.judged(CORPUS)} select rule, count(*)::bigint as candidates from jud where rule is not null group by rule")
def rejections_by_rule(spark, sf_dir):
    return summary.rejections(_judged(spark, sf_dir))


@query(f"with {o.judged(CORPUS)} select distinct path, line::int line, shown from jud")
def line_context(spark, sf_dir):
    return detect.candidates(corpus(spark, sf_dir)).select(F.col("file").alias("path"), "line", F.get("context", F.lit(0)).alias("shown")).distinct()


# ---- aggregates, orders, listings


@query(CORPUS_FINDINGS + "select s.severity, count(fin.severity)::bigint as findings from (values ('critical'), ('high'), ('medium'), ('low')) s(severity) left join fin on fin.severity = s.severity group by s.severity")
def severity_summary(spark, sf_dir):
    return summary.severity_counts(found(spark, sf_dir))


@query(CORPUS_FINDINGS + "select count(*)::bigint findings, count(distinct fingerprint)::bigint unique_secrets, count(distinct file)::bigint files_with_findings, count(*) filter (severity = 'critical')::bigint critical, count(*) filter (severity = 'high')::bigint high, count(*) filter (severity = 'medium')::bigint medium, count(*) filter (severity = 'low')::bigint low from fin")
def scan_totals(spark, sf_dir):
    return summary.totals(found(spark, sf_dir))


@query("select count(*) filter (text is not null)::bigint as files_scanned, count(*) filter (text is null)::bigint as files_skipped from documents")
def files_scanned(spark, sf_dir):
    rows = sources.injected(documents(spark, sf_dir))
    return rows.agg(F.count_if(F.col("read_error").isNull()).alias("files_scanned"), F.count_if(F.col("read_error").isNotNull()).alias("files_skipped"))


@query(CORPUS_FINDINGS + "select provider, severity, count(*)::bigint findings, count(distinct fingerprint)::bigint unique_secrets from fin group by rollup (provider, severity)")
def provider_rollup(spark, sf_dir):
    return summary.provider_rollup(found(spark, sf_dir))


def _grouped(spark, sf_dir):
    """Findings with fewer, larger files, where secrets recur: the customer table's segments stand in for values."""
    sql = GROUPED.replace(_H, "md5(c_mktsegment || cast(c_custkey % 40 as varchar(20)))").replace(_D, "translate(md5(c_mktsegment || cast(c_custkey % 40 as varchar(20))), 'abcdef', '123456')")
    rows = derived(spark, sf_dir, sql)
    return verify.findings(rows.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", "text"))), lambda x: x["text"]), "\n").alias("content")))


_GROUPED_SQL = GROUPED.replace(_H, "md5(c_mktsegment || cast(c_custkey % 40 as varchar(20)))").replace(_D, "translate(md5(c_mktsegment || cast(c_custkey % 40 as varchar(20))), 'abcdef', '123456')")
_GROUPED_FINDINGS = f"with {o.findings(f'select path, string_agg(text, chr(10) order by c_custkey) as text from ({_GROUPED_SQL}) group by path')}\n"


@query(_GROUPED_FINDINGS + 'select file, line, "column", "patternId", row_number() over (order by rank, file, line, "column", ordinal)::int as place from fin')
def findings_ordered(spark, sf_dir):
    """Places by range-partitioned sorting: the paths here sort the same by bytes and by name."""
    rows = summary.ordered(_grouped(spark, sf_dir)).select("file", "line", "column", "patternId")
    return _placed(rows, "place")


def _placed(rows: DataFrame, name: str) -> DataFrame:
    """Numbers rows in their order without one task for all: ids from the sorted partitions, less the rows before each."""
    numbered = rows.withColumn("_m", F.monotonically_increasing_id()).withColumn("_p", F.shiftright("_m", 33)).withColumn("_i", F.col("_m") - F.shiftleft("_p", 33))
    numbered, _ = stored(numbered, "placed")
    sizes = {r["_p"]: r["count"] for r in numbered.groupBy("_p").count().collect()}  # one number a partition
    before, total = {}, 0
    for p in sorted(sizes):
        before[p], total = total, total + sizes[p]
    start = F.element_at(F.create_map(*[F.lit(x) for p, n in before.items() for x in (p, n)]), F.col("_p")) if before else F.lit(0)
    return numbered.select(*rows.columns, (F.col("_i") + start + 1).cast("int").alias(name))


@query(_GROUPED_FINDINGS + 'select file, line, "column", masked from fin order by file, line, "column", rank, ordinal limit 50')
def top_findings(spark, sf_dir):
    return summary.top(_grouped(spark, sf_dir), 50).select("file", "line", "column", "masked")


@query(_GROUPED_FINDINGS + 'select fingerprint, file, line, "column" from fin qualify row_number() over (partition by fingerprint order by file, line, "column", rank, ordinal) = 1')
def first_per_fingerprint(spark, sf_dir):
    return summary.firsts(_grouped(spark, sf_dir)).drop("ordinal")


@query(_GROUPED_FINDINGS + ", f as (select fingerprint, file from fin qualify row_number() over (partition by fingerprint order by file, line, \"column\", rank, ordinal) = 1) select f.fingerprint, f.file, t.other from f join (select distinct fingerprint, file as other from fin) t on t.fingerprint = f.fingerprint and t.other != f.file")
def other_files(spark, sf_dir):
    """Each secret's other files as rows."""
    return summary.other_files(_grouped(spark, sf_dir))


@query(_GROUPED_FINDINGS + ", n as (select fingerprint, list_sort(list(distinct file)) files from fin group by fingerprint having count(distinct file) > 1), r as (select *, row_number() over (partition by fingerprint order by file, line, \"column\", rank, ordinal) k from fin) select r.file, r.line, r.\"column\", r.\"patternId\", case when r.k = 1 then array_to_string(list_filter(files, lambda f: f <> r.file), ', ') end as others from r left join n using (fingerprint)")
def also_in_files(spark, sf_dir):
    return summary.also_in(_grouped(spark, sf_dir)).select("file", "line", "column", "patternId", F.array_join("others", ", ").alias("others"))


@query(_GROUPED_FINDINGS + "select fingerprint, count(distinct file)::bigint n from fin group by fingerprint having n > 1")
def shared_secrets(spark, sf_dir):
    return summary.shared_counts(_grouped(spark, sf_dir))


@query(_GROUPED_FINDINGS + "select file, count(*)::bigint n, string_agg(line || ':' || \"column\" || ':' || severity, ',' order by line, \"column\", rank, ordinal) as listed from fin group by file")
def findings_by_file(spark, sf_dir):
    one = lambda f: F.concat_ws(":", f["line"].cast("string"), f["column"].cast("string"), f["severity"])
    return summary.by_file(_grouped(spark, sf_dir)).select("file", "n", F.array_join(F.transform("findings", one), ",").alias("listed"))


@query(CORPUS_FINDINGS + "select coalesce(least(12, greatest(8, max(length(provider)))), 8)::int as width from fin")
def provider_width(spark, sf_dir):
    return summary.provider_width(found(spark, sf_dir))


@query(CORPUS_FINDINGS + "select t.fail_on, count(fin.file)::bigint as failing, (case when count(fin.file) > 0 then 1 else 0 end)::int as exit_code from (values ('critical', 0), ('high', 1), ('medium', 2), ('low', 3)) t(fail_on, k) left join fin on fin.rank <= t.k group by t.fail_on")
def exit_codes(spark, sf_dir):
    """Exit code at each threshold; the corpus has no skipped files."""
    counts = summary.severity_counts(found(spark, sf_dir)).withColumn("rank", fn.severity_rank(F.col("severity")))
    levels = F.explode(F.array(*[F.struct(F.lit(s).alias("fail_on"), F.lit(k).alias("k")) for k, s in enumerate(fn.SEVERITIES)]))
    rows = counts.select("rank", "findings", levels.alias("t")).groupBy("t.fail_on").agg(F.sum(F.when(F.col("rank") <= F.col("t.k"), F.col("findings")).otherwise(0)).alias("failing"))
    return rows.withColumn("exit_code", (F.col("failing") > 0).cast("int"))


#: As CORPUS, with files that can't be read, in projects of two files.
PARTLY = f"select path, case when c_custkey % 7 = 3 then null else text end as text, c_custkey // 2 as project from ({CORPUS})"


@query(f"select path, 'no content' as reason from ({PARTLY}) where text is null")
def skipped_files(spark, sf_dir):
    return _partly(spark, sf_dir).where("read_error is not null").select("path", F.col("read_error").alias("reason"))


def _partly(spark, sf_dir):
    files = sources.injected(derived(spark, sf_dir, PARTLY.replace("c_custkey // 2", "c_custkey div 2")), "path", "text")
    return files.withColumn("project", F.floor(F.regexp_extract("path", "/f([0-9]+)[.]", 1).cast("long") / 2))


@query(f"""with {o.findings(f"select path, coalesce(text, '') as text from ({PARTLY})")},
worst as (select project, min(rank) as rank, bool_or(text is null) as skipped from ({PARTLY}) p left join fin on fin.file = p.path group by project)
select project::bigint as project, fail_on, case when rank <= k then 1 when skipped then 2 else 0 end as exit_code from worst, (values ('critical', 0), ('high', 1), ('medium', 2), ('low', 3)) t(fail_on, k)""")
def exit_codes_of_projects(spark, sf_dir):
    """Exit code of each project at each threshold: 1 for findings, else 2 for skipped files, else 0."""
    files = _partly(spark, sf_dir)
    worst = verify.findings(files.where("read_error is null").select("path", "content")).groupBy(F.col("file").alias("path")).agg(F.min(fn.severity_rank(F.col("severity"))).alias("rank"))
    projects = files.join(worst, "path", "left").groupBy("project").agg(F.min("rank").alias("rank"), F.bool_or(F.col("read_error").isNotNull()).alias("skipped"))
    levels = F.explode(F.array(*[F.struct(F.lit(s).alias("fail_on"), F.lit(k).alias("k")) for k, s in enumerate(fn.SEVERITIES)]))
    code = F.when(F.col("rank") <= F.col("t.k"), 1).when(F.col("skipped"), 2).otherwise(0)
    return projects.select("project", "rank", "skipped", levels.alias("t")).select(F.col("project").cast("long").alias("project"), "t.fail_on", code.alias("exit_code"))


def _stumbling(text, extension, places):
    """A parser that some sources trip up."""
    if "MOCK_TOKEN" in text:
        raise RuntimeError("cannot parse")
    return structure.facts(text, extension, places)


_OUTCOME_SQL = f"""with {o.findings(f"select path, coalesce(text, '') as text from ({PARTLY})")},
src2 as (select path, text, text like '%MOCK_TOKEN%' and regexp_extract(path, '[^/.][^/]*([.][^./]*)$', 1) in ({', '.join(map(o.quoted, structure.EXTENSIONS))}) as trips from ({PARTLY})),
said as (select path, case when text is null then 'no content' when trips then 'scan failed: cannot parse' end as reason from src2),
kept as (select path as file, reason, count(fin.file)::bigint as findings from said left join fin on fin.file = path and reason is null group by path, reason)
"""


@query(_OUTCOME_SQL + "select file, reason, findings from kept where findings > 0 or reason is not null")
def scan_outcomes(spark, sf_dir):
    """What one pass says of each file: findings, or why it was skipped, be it not readable or one on which the parser raises."""
    said = verify.outcomes(_partly(spark, sf_dir), parser=_stumbling)
    return said.select("file", "reason", F.coalesce(F.size("found"), F.lit(0)).cast("long").alias("findings")).where("findings > 0 or reason is not null")


@query(_OUTCOME_SQL + "select count(*) filter (reason is null)::bigint as files_scanned, count(reason)::bigint as files_skipped, sum(findings)::bigint as findings, count(*) filter (findings > 0)::bigint as files_with_findings from kept")
def scan_summary(spark, sf_dir):
    """Counts of files and findings from the same rows."""
    n = F.when(F.col("found").isNull(), 0).otherwise(F.size("found"))
    return verify.outcomes(_partly(spark, sf_dir), parser=_stumbling).agg(F.count_if(F.col("reason").isNull()).alias("files_scanned"), F.count("reason").alias("files_skipped"), F.sum(n).cast("long").alias("findings"), F.count_if(n > 0).alias("files_with_findings"))


@query(CORPUS_FINDINGS + "select k as name, case k when 'findings' then count(fin.file) when 'unique-secrets' then count(distinct fingerprint) when 'files-scanned' then (select count(*) from customer) else 0 end::bigint as value from (values ('findings'), ('unique-secrets'), ('files-scanned'), ('files-skipped')) v(k) left join fin on true group by k")
def ci_step_outputs(spark, sf_dir):
    """What a workflow step hands on, from the outcomes of one pass."""
    said = verify.outcomes(corpus(spark, sf_dir).withColumn("read_error", F.lit(None).cast("string")))
    return summary.step_outputs(said)


_DEEP = Pattern("deep", "Repeated choice", "custom", "mark:((?:[0-9a-f]|[g-z])+);", "", "low", "low", False)
_LONG = f"select 'long/' || cast(c_custkey as varchar(20)) as path, 'mark:' || repeat(md5(c_name), cast(100 + c_custkey % 1500 as int)) || ';' as text, c_custkey from customer"


@query(f"with {o.candidates(_LONG, (_DEEP,))} select path as file, line::int line, col::int \"column\", {o.fingerprint('secret')} fingerprint from cand")
def scan_long_lines(spark, sf_dir):
    """A choice repeated over lines of up to 51,000 characters, at which matchers that recurse overflow their stack."""
    return detect.candidates(derived(spark, sf_dir, _LONG, rows_a_task=4096).select("path", F.col("text").alias("content")), (_DEEP,)).select("file", "line", "column", "fingerprint")


_DENSE_LINE = f"select 'dense/' || cast(c_custkey % 7 as varchar(20)) as path, string_agg('ghp_' || md5(c_name) || substr(md5(c_mktsegment), 1, 4), ' ' order by c_custkey) as text from customer group by c_custkey % 7"


@query(f"with t as ({_DENSE_LINE}), k as (select path, unnest(string_split(text, ' ')) as s, generate_subscripts(string_split(text, ' '), 1) as n from t) select path, count(*)::bigint as candidates, max(41 * (n - 1) + 1)::int as last_column, sha256(string_agg({o.masked('s')}, ' ' order by n)) as shown_sha256 from k group by path")
def mask_dense_lines(spark, sf_dir):
    """Lines of hundreds and thousands of values, each masked in one go."""
    keys = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", F.expr("concat('ghp_', md5(c_name), substr(md5(c_mktsegment), 1, 4))").alias("k")))), lambda x: x["k"]), " ")
    rows = read(spark, sf_dir, "customer").groupBy(F.concat(F.lit("dense/"), (F.col("c_custkey") % 7).cast("string")).alias("path")).agg(keys.alias("content"))
    found = detect.with_candidates(rows)
    return found.select("path", F.size("candidates").cast("long").alias("candidates"), F.array_max(F.transform("candidates", lambda c: c["column"])).alias("last_column"), F.sha2(F.get("shown", F.lit(0)), 256).alias("shown_sha256"))


@query(CORPUS_FINDINGS + "select file, line, \"column\", \"patternId\" from fin where rank <= 1")
def fail_on_gate(spark, sf_dir):
    return summary.failing(found(spark, sf_dir), "high").select("file", "line", "column", "patternId")


@query(CORPUS_FINDINGS + "select file, line, \"column\", '::' || case when severity in ('critical', 'high') then 'error' when severity = 'low' then 'notice' else 'warning' end || ' file=' || file || ',line=' || line || ',col=' || \"column\" || '::' || replace('[' || provider || '] ' || \"patternName\" || ' — ' || masked, '%', '%25') as command from fin")
def ci_annotations(spark, sf_dir):
    return summary.annotations(found(spark, sf_dir)).select("file", "line", "column", "command")


@query(CORPUS_FINDINGS + "select to_json({'patternId': \"patternId\", 'patternName': \"patternName\", 'provider': provider, 'severity': severity, 'confidence': confidence, 'file': file, 'line': line, 'column': \"column\", 'masked': masked, 'context': [shown], 'fingerprint': fingerprint})::varchar as json from fin")
def json_findings(spark, sf_dir):
    from .report import finding_json

    return finding_json(found(spark, sf_dir))


# ---- registry


_BUILT = "select 'p' || cast(n_nationkey as varchar(20)) as id, n_name as name, 'builtin' as source, n_nationkey as turn from nation"
_OWN = "select 'p' || cast(s_suppkey * 7 % 40 as varchar(20)) as id, s_name as name, 'custom' as source, s_suppkey as turn from supplier"


def _registry(spark, sf_dir):
    """Patterns named by nations as built-in ones, and by suppliers as custom ones, many of which share an id."""
    rest = [F.lit("x").alias("regex"), F.lit("").alias("flags"), F.lit("low").alias("confidence"), F.lit("low").alias("severity"), F.lit(False).alias("entropyCheck")]
    rows = lambda sql, name: spark.sql(sql.replace(f"from {name}", f"from {{{name}}}"), **{name: read(spark, sf_dir, name)}).select("id", "name", F.col("source").alias("provider"), *rest, F.col("turn").cast("int").alias("ordinal"))
    return rows(_BUILT, "nation"), rows(_OWN, "supplier")


_ALL = f"with t as (select id, name, source, case source when 'builtin' then turn else turn + 1048576 end as turn from ({_BUILT} union all {_OWN}))\n"


@query(_ALL + "select id, name, source, place::int as place from (select *, min(turn) over (partition by id) place from t qualify row_number() over (partition by id order by turn desc) = 1)")
def merge_patterns(spark, sf_dir):
    return registry.merged(*_registry(spark, sf_dir)).select("id", "name", "source", "place")


@query(_ALL + "select id, shadowed_name, shadowed_source, name as winner_name from (select *, lag(name) over w shadowed_name, lag(source) over w shadowed_source from t window w as (partition by id order by turn)) where source = 'custom' and shadowed_source is not null")
def pattern_conflicts(spark, sf_dir):
    return registry.conflicts(*_registry(spark, sf_dir)).drop("custom_ordinal")


@query(_ALL + "select id, case shadowed_source when 'builtin' then 'note: custom pattern \"' || id || '\" overrides the built-in' else 'note: duplicate custom pattern id \"' || id || '\", the later one is used' end as note, count(*)::bigint as n from (select *, lag(source) over (partition by id order by turn) shadowed_source from t) where source = 'custom' and shadowed_source is not null group by all")
def conflict_notices(spark, sf_dir):
    return registry.notices(registry.conflicts(*_registry(spark, sf_dir))).groupBy("id", "note").agg(F.count("*").alias("n"))


# ---- evaluation

_SPEC = f"""select path, text, c_custkey, case when c_custkey % 20 in (0, 1, 2, 3, 4, 5, 6, 7, 8, 12) then 'secret' else 'clean' end as kind,
    case c_custkey % 20 when 0 then 'aws-access-key-id' when 1 then 'github-personal-access-token' when 2 then 'stripe-live-secret-key' when 3 then 'stripe-live-publishable-key' when 4 then 'github-fine-grained-pat'
    when 5 then 'openai-api-key' when 6 then 'slack-bot-token' when 7 then 'generic-jwt' when 8 then 'generic-high-entropy-secret' when 12 then 'aws-secret-access-key' when 14 then 'constant-alias' when 15 then 'env-reference' else 'placeholder-value' end as expected
    from ({CORPUS}) where c_custkey % 20 in (0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 14, 15, 16)"""


@query(f"""with t as (select c_mktsegment as folder, c_custkey, md5(c_name) as h from customer)
select folder || '/' || c_custkey as fixture, case when c_custkey % 3 = 0 then 'clean' else 'secret' end as kind, case when c_custkey % 3 = 0 then 'rule-' || (c_custkey % 5) else 'pattern-' || substr(h, 1, 2) end as expected from t""")
def manifest_fixtures(spark, sf_dir):
    """Manifests as texts of JSON, one a segment, to rows of fixtures."""
    spec = F.expr("case when c_custkey % 3 = 0 then named_struct('expectsPatternId', null, 'rejectedBy', concat('rule-', cast(c_custkey % 5 as string))) else named_struct('expectsPatternId', concat('pattern-', substr(md5(c_name), 1, 2)), 'rejectedBy', null) end")
    named = read(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("folder"), F.concat_ws("/", "c_mktsegment", F.col("c_custkey").cast("string")).alias("fixture"), spec.alias("spec"))
    texts = named.groupBy("folder").agg(F.to_json(F.struct(F.map_from_entries(F.collect_list(F.struct("fixture", "spec"))).alias("fixtures"))).alias("text"))
    return evaluate.manifest_rows(texts, "text")


def _evaluated(spark, sf_dir):
    rows = derived(spark, sf_dir, _SPEC)
    files = rows.select("path", F.col("text").alias("content"), F.lit(None).cast("string").alias("read_error"))
    return evaluate.evaluated(rows.select(F.col("path").alias("fixture"), "kind", "expected"), verify.judged(files.select("path", "content"), failed=True), files)


_EVAL_SQL = f"""with spec as ({_SPEC}), {o.judged('select path, text from spec')},
out as (select path, count(*) candidates, count(*) filter (rule is null) findings, arg_min(id, (ordinal, line, pos)) filter (rule is null) first_pattern, arg_min(coalesce(rule, ''), (ordinal, line, pos)) rejected from jud group by path),
ev as (select spec.path fixture, kind, case when kind = 'secret' then coalesce(findings, 0) = 1 and first_pattern = expected else coalesce(candidates, 0) > 0 and coalesce(findings, 0) = 0 and rejected = expected end as passed, case when kind = 'clean' and findings = 0 then rejected end as rejected_by, coalesce(candidates, 0)::bigint candidates from spec left join out using (path))
"""


@query(_EVAL_SQL + "select fixture, kind, coalesce(passed, false) as passed, rejected_by, candidates from ev")
def corpus_evaluation(spark, sf_dir):
    return _evaluated(spark, sf_dir).select("fixture", "kind", "passed", "rejected_by", "candidates")


@query(_EVAL_SQL + "select coalesce(avg(coalesce(passed, false)::int::double) filter (kind = 'secret') * 100, 0.0) as recall, coalesce(avg(coalesce(passed, false)::int::double) filter (kind = 'clean') * 100, 0.0) as precision, count(*) filter (not coalesce(passed, false))::bigint as failed from ev")
def corpus_recall_precision(spark, sf_dir):
    return evaluate.rates(_evaluated(spark, sf_dir))
