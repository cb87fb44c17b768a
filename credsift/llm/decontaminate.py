"""Benchmark decontamination by templates, in DataFrame functions only.

A text is brought to template tokens: numbers become <n>, units after them <u>, names (capitalised words inside a sentence)
<p>, other words lower case without punctuation. Windows of five template tokens are hash-joined with those of the benchmark
items. Windows with names match also by the names themselves, so case doesn't matter to what is verbatim. A document holds an
item if it, or one occurrence in it, has `coverage` of the item's windows and the slots are consistent: one value in the item
stands for one value in the document, so a re-parameterised question is found while texts that only share phrases are not.

The windows of the benchmark are broadcast in parts of at most PART_ROWS rows, one pass over the documents for each; the
documents' windows are never shuffled.

Defined results: null and empty texts have no windows, in documents or items; a text of one to four words has one window, of
all its words; windows of fewer than `literals` plain words match by their own words only (all-placeholder windows match anything),
and items with less than `coverage` of their words in other windows must have `coverage` of all windows; rows with
null or repeated ids are told apart by their text; repeated rows give one result each in `clean`, one together in `hits`.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

WINDOW, COVERAGE, CONSISTENCY, LITERALS = 5, 0.8, 0.8, 2
#: Rows of benchmark windows that are broadcast at once, about 100 bytes each.
PART_ROWS = 400_000
SPACE = "[ \\t\\n\\x0B\\f\\r]"
END = "\x01"
#: Hashes of placeholders; those of plain words have none of these bits.
PLACES = {"<n>": 1, "<u>": 2, "<p>": 4}
# Units of measure that count as one when they follow a number.
UNITS = tuple("mm cm m km in ft yd mi mg g kg lb oz ml l s sec min h hr hrs hour hours day days week weeks month months year years percent degrees usd eur gbp dollars euros cents kb mb gb tb hz khz mhz ghz v w kw kwh j kj cal kcal mph kmh".split())


#: An upper-case letter that may start a name: after white space that doesn't end a sentence.
NAMED = f"(?<!{END}){SPACE}[\\p{{Lu}}\\p{{Lt}}\\p{{Nl}}]"


def bare(text: Column) -> Column:
    """text without punctuation, sentence ends marked."""
    marked = F.regexp_replace(F.replace(text, F.lit(END), F.lit("")), f"{SPACE}*[.!?]+({SPACE}|\\z)", f"{END}$1")
    return F.regexp_replace(marked, f"[^\\p{{L}}\\p{{M}}\\p{{N}} \\t\\n\\x0B\\f\\r{END}]+", "")


def template(low: Column, own: Column | None = None) -> Column:
    """Template tokens of lower-cased words; with `own`, the words with case and sentence ends marked, also of names."""
    digit = lambda c: F.substring(c, 1, 1).between("0", "9")

    def token(word: Column, i: Column) -> Column:
        out = F.when(digit(word), "<n>")
        if own is not None:
            first, mine = F.substring(word, 1, 1), F.get(own, i)
            name = (F.substring(mine, 1, 1) != first) & (F.substring(word, 2, 1) != "") & (F.substring(mine, 2, 1) == F.substring(word, 2, 1)) & (i > 0)
            out = out.when(name, F.when(F.substring(F.get(own, i - 1), -1, 1) != END, "<p>").otherwise(word))
        return out.when(word.isin(*UNITS) & (i > 0), F.when(digit(F.get(low, i - 1)), "<u>").otherwise(word)).otherwise(word)

    return F.transform(low, token)


def hashed(token: Column) -> Column:
    """Hash of a token, its kind in the low bits."""
    out = F.shiftleft(F.xxhash64(token), 3)
    for place, bit in PLACES.items():
        out = F.when(token == place, F.lit(bit).cast("long")).otherwise(out)
    return out


def tokens(rows: DataFrame, text: Column, keep: list[str]) -> DataFrame:
    """keep and arrays of each text: l, the words in lower case; c, template tokens; u, those with names as they are.

    hl, hc and hu are the hashes of each token. Null are u and hu where there is no name, hl where c has no placeholder. Only
    texts with digits or capitals within sentences are brought to templates at all.
    """
    split = lambda s: F.array_remove(F.split(s, f"{SPACE}+"), "")
    hashes = lambda a: F.transform(a, hashed)
    step = rows.select(*keep, bare(text).alias("b"))
    step = step.select(*keep, split(F.lower(F.replace("b", F.lit(END), F.lit("")))).alias("l"), F.when(F.col("b").rlike(NAMED), F.array_remove(split(F.col("b")), END)).alias("t"), F.col("b").rlike("[0-9]").alias("d"))
    literal = F.when(F.col("d"), template(F.col("l"))).otherwise(F.col("l"))
    step = step.select(*keep, "l", "d", F.when(F.col("t").isNotNull(), template(F.col("l"), F.col("t"))).otherwise(literal).alias("c"))
    step = step.select(*keep, "l", "c", F.when(F.array_contains("c", "<p>"), literal).alias("u"), (F.col("d") | F.array_contains("c", "<p>")).alias("d"))
    return step.select(*keep, "l", "c", "u", hashes("c").alias("hc"), hashes("u").alias("hu"), F.when(F.col("d"), hashes("l")).alias("hl"))


def places(size: int) -> Column:
    """Places of a text's windows, none for a text without words."""
    return F.explode(F.when(F.size("c") > 0, F.sequence(F.lit(0), F.greatest(F.size("c") - size, F.lit(0)))))


def joined(array: Column, at: Column, size: int) -> Column:
    return F.array_join(F.slice(array, at + 1, F.lit(size)), " ")


def window(array: Column, at: Column, size: int) -> Column:
    return F.slice(array, at + 1, F.lit(size))


def few_plain(hashes: Column, literals: int) -> Column:
    """Whether a window, as hashes of its tokens, has too few plain words to be told by its template."""
    plain = F.size(reduce(lambda a, k: F.array_remove(a, F.lit(k).cast("long")), PLACES.values(), hashes))
    return (plain < F.size(hashes)) & (plain < literals)


def digest(hashes: Column, own: Column, literals: int) -> Column:
    """Hash of a window: of its template, or of its template and its own words where plain words are few. `own` is null if there are no placeholders."""
    return F.when(own.isNotNull() & few_plain(hashes, literals), F.xxhash64(hashes, own)).otherwise(F.xxhash64(hashes))


def item_windows(items: DataFrame, id_col: str, text_col: str, size: int = WINDOW, literals: int = LITERALS) -> DataFrame:
    """(window, item, at, place, light, hash, key, literal, template, values, own, first, of, of_light, spanned, slotted, words): the windows of each item.

    A window has a row for each form that a document may have it in: with <p> for names; with the names themselves; and, at the
    item's start, with <p> for its first word, which documents may have within a sentence (`first`: that word must be the
    same). `place` is what they have in common. `light` windows have plain words enough to be told by their template; `key`
    is the form's text, and `literal` forms match by the words as well.
    `of` and `of_light` are the numbers of distinct places, `spanned` the share of the item's words in light windows.
    """
    base = tokens(items.select(F.col(id_col).alias("item"), F.coalesce(F.col(text_col), F.lit("")).alias("text")), F.col("text"), ["item"])
    base = base.withColumn("hl", F.coalesce("hl", "hc")).withColumn("hu", F.coalesce("hu", "hc")).withColumn("u", F.coalesce("u", "c"))
    rows = base.select("*", F.size("c").alias("words"), places(size).alias("at"))
    cut, part, n = (lambda a: joined(F.col(a), F.col("at"), size)), (lambda a: window(F.col(a), F.col("at"), size)), F.least(F.lit(size), F.col("words"))
    rows = rows.select("item", "at", "words", n.alias("n"), cut("c").alias("k"), cut("u").alias("u"), cut("l").alias("values"), part("hc").alias("hc"), part("hu").alias("hu"), part("hl").alias("hl"))
    rows = rows.select("*", (~few_plain(F.col("hc"), literals)).alias("light"), digest(F.col("hc"), F.col("hl"), literals).alias("place"))
    form = lambda hashes, key, shown, mine, first: F.struct(digest(hashes, F.col("hl"), literals).alias("hash"), few_plain(hashes, literals).alias("literal"), key.alias("key"), F.col(shown).alias("template"), F.lit(mine).alias("own"), F.lit(first).alias("first"))
    began = F.concat(F.array(F.lit(PLACES["<p>"]).cast("long")), F.slice("hc", 2, size - 1)), F.concat(F.lit("<p>"), F.expr("substr(k, length(substring_index(k, ' ', 1)) + 1)"))
    rows = rows.withColumn("f", F.explode(F.array(form(F.col("hc"), F.col("k"), "k", True, False), form(F.col("hu"), F.col("u"), "u", False, False), form(*began, "k", False, True))))
    rows = rows.where("f.own or f.first or u <> k").where((~F.col("f.first")) | ((F.col("at") == 0) & ~F.col("k").startswith("<")))
    rows = rows.select("item", "at", "n", "words", "light", "place", "values", "f.*").distinct()
    counts = rows.groupBy("item").agg(
        F.count_distinct("place").alias("of"),
        F.count_distinct(F.when(F.col("light"), F.col("place"))).alias("of_light"),
        (F.size(F.array_distinct(F.flatten(F.collect_set(F.when(F.col("light"), F.sequence("at", F.col("at") + F.col("n") - 1)))))) / F.max("words")).alias("spanned"),
        F.max(F.instr("template", "<") > 0).alias("slotted"),
    )
    return rows.drop("n").join(counts, "item").withColumn("window", F.monotonically_increasing_id())


def met_windows(docs: DataFrame, wanted: DataFrame, parts: int, size: int = WINDOW, literals: int = LITERALS) -> DataFrame:
    """(id, text_hash, d_at, slots, d_own) and the columns of the item windows that the documents' windows are equal to.

    A window's hash is made of the hashes of its tokens; its text is put together for those only whose hash is found, and compared.
    What the broadcast join has to do with each window is kept small, as methods beyond 8000 bytes aren't compiled by the JVM.
    """
    base = tokens(docs, F.col("text"), ["id", "text_hash"])
    if parts > 1:  # several passes: texts are brought to tokens once
        base = common.written(base, "tokens")
    rows = base.withColumn("d_own", F.explode(F.when(F.col("hu").isNotNull(), F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(True)))))
    mine = lambda a, b: F.when(F.col("d_own"), F.col(a)).otherwise(F.col(b))
    rows = rows.select("id", "text_hash", "d_own", "l", mine("c", "u").alias("c"), mine("hc", "hu").alias("h"), F.when(~F.col("d_own"), F.col("hc")).alias("hc"), "hl").withColumn("d_at", places(size))
    part = lambda a: window(F.col(a), F.col("d_at"), size)
    # with names as they are: only windows that have any
    rows = rows.where(F.col("d_own") | F.array_contains(part("hc"), F.lit(PLACES["<p>"]).cast("long")))
    rows = rows.select("id", "text_hash", "d_own", "d_at", "l", "c", "hl", part("h").alias("h"))
    rows = rows.select("id", "text_hash", "d_own", "d_at", "l", "c", digest(F.col("h"), part("hl"), literals).alias("hash"))
    sought = wanted.select("hash", "window")
    text = lambda a: joined(F.col(a), F.col("d_at"), size)
    found = [rows.join(F.broadcast(sought.where(F.pmod("hash", F.lit(parts)) == k)), "hash") for k in range(parts)]
    met = common.written(reduce(DataFrame.union, found).select("id", "text_hash", "d_own", "d_at", text("c").alias("shown"), text("l").alias("slots"), "window"), "met")
    met = met.join(wanted, "window").where((F.col("shown") == F.col("key")) & (~F.col("literal") | (F.col("slots") == F.col("values"))))
    return met.where("not first or substring_index(slots, ' ', 1) = substring_index(values, ' ', 1)").withColumn("slots", F.when(F.instr("key", "<") > 0, F.col("slots")))


def hits(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", coverage: float = COVERAGE, consistency: float = CONSISTENCY, part_rows: int = PART_ROWS) -> DataFrame:
    """(id, text_hash, item, coverage, slots, consistency, same): one row for each document and benchmark item that it holds.

    The document as a whole may hold the item, or any one occurrence: windows of the same alignment, the place in the document
    less that in the item, give or take a quarter of the item. The figures are those
    of the document's windows by template as in SQL if these reach the limits, else those of the best of the others.

    same: whether all slots of one of them have the item's own values, so the passage is verbatim up to case and punctuation.
    """
    wanted = common.written(item_windows(items, item_id_col, item_text_col), "windows")
    parts = max(1, -(-wanted.count() // part_rows))
    text = F.coalesce(F.col(text_col), F.lit(""))
    met = met_windows(docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("text_hash"), text.alias("text")), wanted, parts)
    key, sizes = ["id", "text_hash", "item"], ["of", "of_light", "spanned"]
    met = met.select(*key, *sizes, "place", "light", "template", "values", "slots", "words", (F.col("own") & F.col("d_own") & F.col("light")).alias("strict"), F.when(F.col("slotted"), F.col("d_at") - F.col("at")).alias("align"))
    half = F.greatest(F.lit(1), F.floor(F.col("words") / 4))
    group = lambda kind, n: F.struct(F.lit(kind).alias("kind"), n.cast("long").alias("n"))
    whole = F.when(F.col("strict"), F.array(group(0, F.lit(0)), group(1, F.lit(0)))).otherwise(F.array(group(1, F.lit(0))))
    near = F.array(group(2, F.col("align")), group(3, F.floor(F.col("align") / (2 * half))), group(4, F.floor((F.col("align") + half) / (2 * half))))
    met = met.withColumn("g", F.explode(F.when(F.col("align").isNull(), whole).otherwise(F.concat(whole, near))))
    key = [*key, "g"]
    covered = met.groupBy(*key, *sizes).agg(F.count_distinct("place").alias("n"), F.count_distinct(F.when(F.col("light"), F.col("place"))).alias("n_light"))
    by_template = F.when(F.col("spanned") >= coverage, F.col("n_light") / F.nullif(F.col("of_light"), F.lit(0)))
    by_either = F.when(F.col("g.kind") > 0, F.col("n") / F.col("of"))
    covered = covered.withColumn("coverage", F.greatest(by_either, by_template)).where(F.col("coverage") >= coverage).select(*key, "coverage")
    pair = F.arrays_zip(F.split("template", " ").alias("k"), F.split("values", " ").alias("v"), F.split("slots", " ").alias("d"))
    slots = met.where("slots is not null").select(*key, F.explode(pair).alias("s")).where("s.k like '<%'").groupBy(*key, F.col("s.v").alias("v")).agg(F.min("s.d").alias("least"), F.max("s.d").alias("most"))
    slots = slots.groupBy(*key).agg(F.count("*").alias("slots"), F.avg((F.col("least") == F.col("most")).cast("double")).alias("consistency"), F.min((F.col("least") == F.col("v")) & (F.col("most") == F.col("v"))).alias("same"))
    slots = slots.select(*[F.col(c).alias(f"s_{c}") for c in slots.columns])
    both = covered.join(slots, covered["id"].eqNullSafe(slots["s_id"]) & (covered["text_hash"] == slots["s_text_hash"]) & covered["item"].eqNullSafe(slots["s_item"]) & (covered["g"] == slots["s_g"]), "left")
    held = both.select(*key[:-1], F.coalesce("s_same", F.lit(True)).alias("same"), F.struct((F.col("g.kind") == 0).alias("strict"), F.coalesce("s_consistency", F.lit(1.0)).alias("consistency"), "coverage", F.coalesce("s_slots", F.lit(0)).alias("slots")).alias("b"))
    best = held.where(F.col("b.consistency") >= consistency).groupBy(*key[:-1]).agg(F.max("b").alias("b"), F.max("same").alias("same"))
    return best.select(*key[:-1], "b.coverage", "b.slots", "b.consistency", "same")


def clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", **limits) -> DataFrame:
    """docs without the rows that hold a benchmark item."""
    of, digest = common.free_name(docs, "held_id"), common.free_name(docs, "held_hash")
    held = hits(docs, items, id_col, text_col, item_id_col, item_text_col, **limits).select(F.col("id").alias(of), F.col("text_hash").alias(digest)).distinct()
    held = common.written(held, "held")
    on = F.col(id_col).eqNullSafe(F.col(of)) & (F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))) == F.col(digest))
    return docs.join(held, on, "left_anti")


#: DuckDB SQL for hits() of `documents` and `benchmark`.
SQL = """
with raw as (select 0 as side, doc_id as id, coalesce(text, '') as text from documents group by all union all select 1, item_id, coalesce(text, '') from benchmark group by all),
b as (select side, id, row_number() over () r, regexp_replace(regexp_replace(translate(text, chr(1), ''), '@SPACE@*[.!?]+(@SPACE@|\\z)', chr(1) || '\\1', 'g'),
    '[^\\p{L}\\p{M}\\p{N} \\t\\n\\x0B\\f\\r\\x01]+', '', 'g') s from raw),
w as (select side, id, r, list_filter(string_split_regex(s, '@SPACE@+'), lambda x: x <> '' and x <> chr(1)) t,
    list_filter(string_split_regex(lower(translate(s, chr(1), '')), '@SPACE@+'), lambda x: x <> '') l from b),
c as (select side, id, r, l, list_transform(l, lambda x, i: case when x[1] between '0' and '9' then '<n>'
    when t[i][1] <> x[1] and x[2] <> '' and t[i][2] = x[2] and i > 1 then case when right(t[i - 1], 1) <> chr(1) then '<p>' else x end
    when i > 1 and list_contains([@UNITS@], x) then case when l[i - 1][1] between '0' and '9' then '<u>' else x end else x end) k from w where len(l) > 0),
p as (select side, id, r, k, l, unnest(range(1, greatest(len(k) - 4, 1) + 1)) i from c),
x as (select side, id, r, i, array_to_string(k[i:i + 4], ' ') h, array_to_string(l[i:i + 4], ' ') v, len(k[i:i + 4]) z, len(list_filter(k[i:i + 4], lambda y: y[1] <> '<')) plain from p),
items as (select id as item, i, h, v from x where side = 1 and plain >= least(@LITERALS@, z)),
total as (select item, count(distinct h) n from items group by item),
met as (select distinct d.id, d.r, items.item, d.h, items.v, d.v as dv from x d join items on d.h = items.h where d.side = 0),
cov as (select id, r, item, count(distinct h)::double / any_value(n) coverage from met join total using (item) group by all having coverage >= @COVERAGE@),
sl as (select id, r, item, unnest(string_split(h, ' ')) k, unnest(string_split(v, ' ')) v, unnest(string_split(dv, ' ')) dv from met where contains(h, '<')),
g as (select id, r, item, v, min(dv) least, max(dv) most from sl where k like '<%' group by all),
q as (select id, r, item, count(*) slots, avg((least = most)::int::double) consistency, min((least = v and most = v)::int) = 1 same from g group by all)
select cov.id as doc_id, cov.item as item_id, coverage, coalesce(slots, 0)::bigint slots, coalesce(consistency, 1.0)::double consistency, coalesce(same, true) as verbatim
from cov left join q on cov.r = q.r and cov.item = q.item where coalesce(consistency, 1.0) >= @CONSISTENCY@
"""
for _k, _v in {"SPACE": SPACE, "UNITS": ", ".join(f"'{u}'" for u in UNITS), "LITERALS": LITERALS, "COVERAGE": COVERAGE, "CONSISTENCY": CONSISTENCY}.items():
    SQL = SQL.replace(f"@{_k}@", str(_v))
