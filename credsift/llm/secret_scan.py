"""Secret scans with corpus-wide ownership frequency, in DataFrame functions only.

Matching gives every document an array of candidates. The base kinds (assign, access, hex) are spans in any case. Two wider
kinds only become spans through the corpus: `prefixed` (a run that starts like a provider's key) and `bare` (a run of 20 or
more with upper, lower and digit). Candidate hashes are counted by distinct repositories and owners. One that
`copied_owners` owners or more hold is a widely copied example and adds no span; one that fewer hold is specific to its owner,
looks live, and adds its spans. Base spans are labelled by the same rule.

Positions are code points: `split` gives the gaps between the matches that `regexp_extract_all` gives, so running sums of
lengths are the places, with no mark put into the text.

Defined results: a null text is empty and has no spans; a null repository or owner counts as one unnamed one; repeated
rows are kept and counted once per repository and owner; rows with null or repeated ids are told apart by their text;
other columns are left alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

# The base kinds' patterns. Letters of the keyword stand in both cases, as (?i) would reach beyond ASCII in RE2.
KEYWORD = "[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]"
ASSIGN = f"({KEYWORD})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]{24,}"
WIDE = "[A-Za-z0-9+/_=-]{20,}"
PREFIXED = "^(ghp_|gho_|ghs_|github_pat_|sk_live_|rk_live_|pk_live_|sk-|xox[abprs]-|AIza|glpat-|npm_|eyJ)"
KINDS = ("assign", "access", "hex", "prefixed", "bare")
#: So many distinct owners make a value a widely copied example.
COPIED_OWNERS = 3
#: Distinct characters that a bare run needs.
BARE_DISTINCT = 10
_BLOCK = 64


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, also within lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(values: Column, size: Column, body: Callable[[Column, Column], Column]) -> Column:
    """Array of body(i, values[0] + .. + values[i]); sums over blocks keep it from being quadratic."""
    add = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)
    blocks = lambda v: F.transform(F.sequence(F.lit(0), F.floor((size - 1) / _BLOCK).cast("int")), lambda b: add(F.slice(v, b * _BLOCK + 1, F.lit(_BLOCK))))
    before = lambda s: F.transform(s, lambda _, b: add(F.slice(s, F.lit(1), b)))
    return let(
        values,
        lambda v: let(
            blocks(v),
            lambda s: let(before(s), lambda o: F.transform(v, lambda _, i: body(i, F.get(o, F.floor(i / _BLOCK).cast("int")) + add(F.slice(v, F.floor(i / _BLOCK).cast("int") * _BLOCK + 1, i % _BLOCK + 1))))),
        ),
    )


def located(text: Column, found: Column, pattern: str, body: Callable[[Column, Column, Column], Column]) -> Column:
    """Array of body(match, start, end) for the matches `found` of `pattern` in text."""
    gaps = F.split(text, pattern, -1)
    steps = let(gaps, lambda g: F.transform(found, lambda _, i: F.length(F.get(g, i)) + F.when(i == 0, 0).otherwise(F.length(F.get(found, i - 1)))))
    return running(steps, F.size(found), lambda i, start: body(F.get(found, i), start, start + F.length(F.get(found, i))))


def candidate(kind: int, start: Column, end: Column, value: Column) -> Column:
    return F.struct(start.cast("int").alias("start"), F.lit(kind).alias("kind"), end.cast("int").alias("end"), value.alias("value"))


CANDIDATES = "array<struct<start:int,kind:int,end:int,value:string>>"


def with_candidates(docs: DataFrame, text_col: str, out_col: str) -> DataFrame:
    """docs with an array of (start, kind, end, value), sorted by start and kind; kinds by their place in KINDS."""
    names = {k: common.free_name(docs, f"m_{k}") for k in ("text", "assign", "access", "hex", "wide")}
    step = docs.withColumn(names["text"], F.coalesce(F.col(text_col), F.lit("")))
    text = F.col(names["text"])
    for k, pattern in (("assign", ASSIGN), ("access", ACCESS), ("hex", HEX), ("wide", WIDE)):
        step = step.withColumn(names[k], F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    none = F.array().cast(CANDIDATES)

    def of(k: str, pattern: str, kind: int, value: Callable[[Column], Column]) -> Column:
        found = F.col(names[k])
        return F.when(F.size(found) > 0, let(found, lambda f: located(text, f, pattern, lambda m, a, b: candidate(kind, a, b, value(m))))).otherwise(none)

    assign = F.filter(of("assign", ASSIGN, 0, lambda m: F.regexp_extract(m, ASSIGN, 2)), lambda c: F.length(c["value"]) >= 6)
    access = F.filter(of("access", ACCESS, 1, lambda m: m), lambda c: F.length(c["value"]) >= 20)
    base = F.concat(assign, access, of("hex", HEX, 2, lambda m: m))
    looks = lambda v: v.rlike("[A-Z]") & v.rlike("[a-z]") & v.rlike("[0-9]") & (F.size(F.array_distinct(F.split(v, ""))) >= BARE_DISTINCT)
    wanted = F.filter(F.col(names["wide"]), lambda v: v.rlike(PREFIXED) | looks(v))
    wide = F.when(F.size(wanted) > 0, of("wide", WIDE, 4, lambda m: m)).otherwise(none)
    wide = F.filter(wide, lambda c: c["value"].rlike(PREFIXED) | looks(c["value"]))
    wide = F.transform(wide, lambda c: F.struct(c["start"].alias("start"), F.when(c["value"].rlike(PREFIXED), 3).otherwise(4).alias("kind"), c["end"].alias("end"), c["value"].alias("value")))
    both = common.free_name(docs, "m_base")
    step = step.withColumn(both, base)
    free = F.filter(wide, lambda c: ~F.exists(F.col(both), lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))
    every = F.array_sort(F.concat(F.col(both), F.when(F.size(F.col(names["wide"])) > 0, free).otherwise(none)))
    return step.withColumn(out_col, every).drop(*names.values(), both)


def ownership(candidates: DataFrame, copied_owners: int = COPIED_OWNERS) -> DataFrame:
    """(hash, repos, owners, copied) of the whole corpus from rows (hash, repo, owner).

    Rows are brought down to distinct (hash, repo, owner) before the counts, so a value that stands everywhere is counted in
    many tasks first.
    """
    distinct = candidates.select("hash", "repo", "owner").distinct()
    counts = distinct.groupBy("hash").agg(F.count_distinct("repo").alias("repos"), F.count_distinct("owner").alias("owners"))
    return counts.withColumn("copied", F.col("owners") >= copied_owners)


def scan(docs: DataFrame, text_col: str, repo: Column, owner: Column, keep: list[str], copied_owners: int = COPIED_OWNERS) -> DataFrame:
    """Columns `keep` of docs, text_hash, and `found`: every candidate (start, kind, end, hash, repos, owners, copied) of the row.

    Values leave this function only as hashes.
    """
    ids = [F.col(c).alias(f"k_{n}") for n, c in enumerate(keep)]
    own = [f"k_{n}" for n in range(len(keep))]
    read = docs.select(*ids, F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(repo.cast("string"), F.lit("")).alias("repo"), F.coalesce(owner.cast("string"), F.lit("")).alias("owner"))
    spotted = with_candidates(read, "text", "c").select(*own, F.xxhash64("text").alias("text_hash"), "repo", "owner", F.transform("c", lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end"), F.sha2(c["value"], 256).alias("hash"))).alias("c"))
    spotted = common.written(spotted.withColumn("row", F.monotonically_increasing_id()), "spotted")
    rows = spotted.where(F.size("c") > 0).select("row", "repo", "owner", F.explode("c").alias("c")).select("row", "repo", "owner", "c.*")
    known = ownership(rows, copied_owners)
    whole = rows.join(known, "hash").groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end", "hash", "repos", "owners", "copied"))).alias("found"))
    with_any = spotted.where(F.size("c") > 0).select("row", "text_hash", *own).join(whole, "row").select(*own, "text_hash", "found")
    empty = F.array().cast("array<struct<start:int,kind:int,end:int,hash:string,repos:bigint,owners:bigint,copied:boolean>>")
    without = spotted.where(F.size("c") == 0).select(*own, "text_hash", empty.alias("found"))
    return with_any.unionByName(without).select(*[F.col(o).alias(c) for o, c in zip(own, keep, strict=True)], "text_hash", "found")


def is_span(c: Column) -> Column:
    """Base kinds always, the wider kinds only where the corpus shows them to be their owner's."""
    return (c["kind"] <= 2) | ~c["copied"]


def named(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda c: F.concat_ws(":", F.get(kinds, c["kind"]), c["start"].cast("string"), c["end"].cast("string"))), ",")


def report(found: DataFrame) -> DataFrame:
    """The counts and digests of each row of scan()."""
    base = F.filter("found", lambda c: c["kind"] <= 2)
    count = lambda k: F.size(F.filter("found", lambda c: c["kind"] == k)).cast("long")
    spans = F.filter("found", is_span)
    return found.select(
        "*",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(named(base), 256).alias("base_sha256"),
        named(spans).alias("spans"),
        F.size(F.filter("found", lambda c: ~c["copied"])).cast("long").alias("n_owned"),
        F.size(F.filter("found", lambda c: c["copied"])).cast("long").alias("n_copied"),
    )


def redacted(text: Column, spans: Column, mask: str = "[secret]") -> Column:
    """text with every span (start, end), sorted by start, replaced by the mask; overlapping spans share one."""
    step = lambda acc, c: F.when(
        c["end"] <= acc["at"], acc
    ).otherwise(
        F.struct(
            F.when(c["start"] < acc["at"], acc["parts"]).otherwise(F.concat(acc["parts"], F.array(F.substring(text, acc["at"] + 1, c["start"] - acc["at"])))).alias("parts"),
            c["end"].alias("at"),
        )
    )
    start = F.struct(F.array().cast("array<string>").alias("parts"), F.lit(0).alias("at"))
    done = F.aggregate(spans, start, step, lambda acc: F.concat(F.array_join(acc["parts"], mask), F.lit(mask), F.substring(text, acc["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, done).otherwise(text)


def redact(docs: DataFrame, text_col: str, repo: Column, owner: Column, id_col: str = "doc_id", copied_owners: int = COPIED_OWNERS) -> DataFrame:
    """docs with the spans of each text masked; every row and column stays.

    Spans are joined back by id and text hash, only for rows that have any.
    """
    of, digest, marks = (common.free_name(docs, f"span_{k}") for k in ("of", "hash", "marks"))
    pairs = F.transform(F.filter("found", is_span), lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end")))
    found = scan(docs, text_col, repo, owner, [id_col], copied_owners).select(F.col(id_col).alias(of), F.col("text_hash").alias(digest), pairs.alias(marks))
    found = common.written(found.where(F.size(marks) > 0).dropDuplicates([of, digest]), "spans")
    text = F.coalesce(F.col(text_col), F.lit(""))
    joined = docs.join(found, F.col(id_col).eqNullSafe(F.col(of)) & (F.xxhash64(text) == F.col(digest)), "left")
    masked = F.when(F.col(marks).isNull(), F.col(text_col)).otherwise(redacted(text, F.col(marks)))
    return joined.select(*[masked.alias(c) if c == text_col else docs[c] for c in docs.columns])


#: DuckDB SQL for the rows of report() over `documents`, with source as owner and source/lang as repository.
SQL = """
with d as (select row_number() over () r, doc_id, coalesce(text, '') text, coalesce(source, '') as owner,
    coalesce(source || '/' || lang, '') as repo from documents),
m as (select r, repo, owner, 0 as kind, regexp_extract_all(text, '@ASSIGN@', 0) f, regexp_extract_all(text, '@ASSIGN@', 2) v, string_split_regex(text, '@ASSIGN@') g from d
    union all select r, repo, owner, 1, regexp_extract_all(text, '@ACCESS@', 0), regexp_extract_all(text, '@ACCESS@', 0), string_split_regex(text, '@ACCESS@') from d
    union all select r, repo, owner, 2, regexp_extract_all(text, '@HEX@', 0), regexp_extract_all(text, '@HEX@', 0), string_split_regex(text, '@HEX@') from d
    union all select r, repo, owner, 3, regexp_extract_all(text, '@WIDE@', 0), regexp_extract_all(text, '@WIDE@', 0), string_split_regex(text, '@WIDE@') from d),
p as (select r, repo, owner, kind, unnest(f) f, unnest(v) v, unnest(g[1:len(f)]) g, generate_subscripts(f, 1) i from m where len(f) > 0),
s as (select *, sum(length(g)) over w + sum(length(f)) over w - length(f) as a from p
    window w as (partition by r, kind order by i rows unbounded preceding)),
c as (select r, repo, owner, case when kind < 3 then kind when regexp_matches(v, '@PREFIXED@') then 3 else 4 end as kind, a::bigint a, (a + length(f))::bigint b, v from s
    where length(v) >= case kind when 0 then 6 when 1 then 20 when 2 then 24 else 20 end
      and (kind < 3 or regexp_matches(v, '@PREFIXED@') or (regexp_matches(v, '[A-Z]') and regexp_matches(v, '[a-z]') and regexp_matches(v, '[0-9]')
        and len(list_distinct(string_split(v, ''))) >= @DISTINCT@))),
free as (select * from c where kind < 3 or not exists (select 1 from c b where b.kind < 3 and b.r = c.r and b.a < c.b and c.a < b.b)),
o as (select v, count(distinct owner) >= @COPIED@ as copied from free group by v),
j as (select r, kind, a, b, copied, (['assign', 'access', 'hex', 'prefixed', 'bare'])[kind + 1] || ':' || a || ':' || b as t from free join o using (v)),
n as (select r, count(*) filter (kind = 0) n_assign, count(*) filter (kind = 1) n_access, count(*) filter (kind = 2) n_hex,
    coalesce(string_agg(t, ',' order by a, kind) filter (kind < 3), '') base, coalesce(string_agg(t, ',' order by a, kind) filter (kind < 3 or not copied), '') spans,
    count(*) filter (not copied) n_owned, count(*) filter (copied) n_copied from j group by r)
select doc_id, coalesce(n_assign, 0)::bigint n_assign, coalesce(n_access, 0)::bigint n_access, coalesce(n_hex, 0)::bigint n_hex,
    sha256(coalesce(base, '')) base_sha256, coalesce(spans, '') spans, coalesce(n_owned, 0)::bigint n_owned, coalesce(n_copied, 0)::bigint n_copied
from d left join n using (r)
"""
for _k, _v in {"ASSIGN": ASSIGN, "ACCESS": ACCESS, "HEX": HEX, "WIDE": WIDE, "PREFIXED": PREFIXED, "DISTINCT": BARE_DISTINCT, "COPIED": COPIED_OWNERS}.items():
    SQL = SQL.replace(f"@{_k}@", str(_v).replace("'", "''"))
