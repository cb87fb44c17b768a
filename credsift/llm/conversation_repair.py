"""Repair of conversations: the cheapest edits that give role initials `(s?(ua)+)?`, by A* on the edit lattice.

A place of the lattice is (rows read, state of the role automaton). From it a row is kept (0), given the role that the automaton
asks for (1) or deleted (2), or a turn without text is inserted (5). Blank and repeated rows have to be deleted; truncated rows
that stay cost 5 more. The heuristic is the suffix sum of what can't be avoided: 2 for each row that must go, and 2 for each
truncated one, which either goes or costs more. It is consistent, and the queue is keyed (cost + heuristic, audit): edits are
spelled D, I, K, R, no two ways of equal cost to one place are prefixes of each other, so what is taken off the queue first
for a place is its cheapest and, of these, least audit.

At scale: rows are sorted by ranges of (conversation, turn, ..), so a conversation of any length spans as many tasks as it needs.
A task reads its part in pieces of at most PIECE_ROWS rows. A conversation that lies in one piece within a task is done there.
The others give, for each piece, the cheapest audit from each state to each state; these compose in a pass that streams, and
only audits (a character for each edit) are gathered by conversation, texts never are.

Defined results: null roles and texts count as one space, null turns come first, null ids are one conversation. Rows are ordered by
turn, then role, then text, so ties have one order and equal rows stand next to each other. A row is blank if its text has only
[\\x20\\x09-\\x0D], else duplicate if role and text stood earlier in the conversation, else truncated if its last other character isn't
one of [.!?]. Role initials other than s, u, a can only be deleted or given another role. A conversation all of whose rows are `absent`
has zeros and no turns; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

#: Rows and characters of a piece at most (a longer row is a piece by itself).
PIECE_ROWS, PIECE_CHARS = 512, 4 << 20
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: States of the automaton: nothing yet, after s, after u, after a. A conversation ends in one of ENDS.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (NOTHING, ASSISTANT)
NAMES = {USER: "user", ASSISTANT: "assistant"}
BLANK = "\\A[\\x20\\x09-\\x0D]*\\z"
FINISHED = "[.!?][\\x20\\x09-\\x0D]*\\z"

COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
REPORT = f"struct<{','.join(f'{c}:bigint' for c in COUNTS)},audit:string>"
TURNS = "array<struct<edit:string,role:string,text:string>>"


def asked(state: int) -> int:
    """The state after the only turn that the automaton takes next, s aside."""
    return ASSISTANT if state == USER else USER


def kept(state: int, initial: str) -> int | None:
    """The state after a row that keeps its role; None if it can't."""
    if initial == "s" and state == NOTHING:
        return SYSTEM
    return asked(state) if initial == ("a" if state == USER else "u") else None


def unavoidable(rows: list[tuple[str, str]]) -> list[int]:
    """Suffix sums: what the rows from each place on cost at least."""
    least = [0] * (len(rows) + 1)
    for i in range(len(rows) - 1, -1, -1):
        least[i] = least[i + 1] + (min(DELETE, TRUNCATED) if rows[i][1] == "truncated" else DELETE if rows[i][1] else 0)
    return least


def cheapest(rows: list[tuple[str, str]], start: int = NOTHING, ends: tuple[int, ...] | None = ENDS) -> dict[int, tuple[int, str]]:
    """{state: (cost, audit)} of rows of (role's initial, fault): the best end of `ends`, or, with None, the best way to each state."""
    least, n = unavoidable(rows), len(rows)
    queue, closed, out = [(least[0], "", 0, start)], set(), {}
    while queue:
        f, audit, i, state = heapq.heappop(queue)
        if (i, state) in closed:
            continue
        closed.add((i, state))
        if i == n and (ends is None or state in ends):
            out[state] = f, audit
            if ends is not None or len(out) == 4:
                return out
        heapq.heappush(queue, (f + INSERT, audit + "I", i, asked(state)))
        if i == n:
            continue
        initial, fault = rows[i]
        step = f + least[i + 1] - least[i]
        heapq.heappush(queue, (step + DELETE, audit + "D", i + 1, state))
        if fault in ("", "truncated"):
            stays = step + (TRUNCATED if fault else 0)
            after = kept(state, initial)
            if after is not None:
                heapq.heappush(queue, (stays + KEEP, audit + "K", i + 1, after))
            if after != asked(state):
                heapq.heappush(queue, (stays + REROLE, audit + "R", i + 1, asked(state)))
    return out


def applied(rows: list[dict], audit: str, state: int = NOTHING) -> list[dict]:
    """The turns that an audit makes of rows of (role, text), from a state on."""
    turns, left = [], iter(rows)
    for edit in audit:
        row = None if edit == "I" else next(left)
        if edit == "D":
            continue
        if edit == "K":
            state = kept(state, row["role"][:1])
            turns.append({"edit": edit, "role": row["role"], "text": row["text"]})
        else:
            state = asked(state)
            turns.append({"edit": edit, "role": NAMES[state], "text": row["text"] if row else ""})
    return turns


def is_illegal(before: str | None, after: str) -> bool:
    return before is not None and before + after not in ("su", "ua", "au")


def summary(rows: list[dict]) -> dict:
    """What a piece adds to its conversation's counts, with what its neighbours need to know of its edges."""
    turns = [r["turn"] for r in rows if r["turn"] is not None]
    initials = [r["role"][:1] for r in rows]
    out = {f: sum(r["fault"] == f for r in rows) for f in ("blank", "duplicate", "truncated")}
    out |= {"illegal": sum(is_illegal(*x) for x in zip(initials, initials[1:], strict=False)), "distinct": len(set(turns))}
    return out | {"low": turns[0] if turns else None, "high": turns[-1] if turns else None, "first": initials[0] if initials else None, "last": initials[-1] if initials else None}


def joined(a: dict, b: dict) -> dict:
    """The summary of two pieces that follow each other."""
    if b["first"] is None:
        return a
    if a["first"] is None:
        return b
    out = {f: a[f] + b[f] for f in ("blank", "duplicate", "truncated", "distinct")}
    out["illegal"] = a["illegal"] + b["illegal"] + is_illegal(a["last"], b["first"])
    out["distinct"] -= a["high"] is not None and a["high"] == b["low"]
    return out | {"low": b["low"] if a["low"] is None else a["low"], "high": a["high"] if b["high"] is None else b["high"], "first": a["first"], "last": b["last"]}


def report(s: dict, cost: int, audit: str) -> dict:
    gaps = 0 if s["low"] is None else s["high"] - s["low"] + 1 - s["distinct"]
    return {"gaps": gaps, "blank": s["blank"], "duplicate": s["duplicate"], "truncated": s["truncated"], "illegal": s["illegal"], "cost": cost, "audit": audit}


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        yield from b.to_pylist()


def _batches(rows: Iterator[dict], schema: pa.Schema, chars=lambda r: 200) -> Iterator[pa.RecordBatch]:
    """Rows as batches of bounded size."""
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += chars(r)
        if len(held) >= common.BATCH_ROWS or size >= PIECE_CHARS:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _groups(rows: Iterator[dict]) -> Iterator[tuple[object, Iterator[dict]]]:
    """Neighbours of one conversation; a group is read as it comes, and has to be read before the next."""
    held = next(rows, None)
    while held is not None:
        conv, after = held["conv"], None

        def group(conv=conv):
            nonlocal held, after
            while held is not None and held["conv"] == conv:
                yield held
                held = next(rows, None)

        yield conv, group()


def _pieces(rows: Iterator[dict], most: int) -> Iterator[tuple[list[dict], bool]]:
    """Pieces of a conversation's rows, and whether another one follows."""
    held, chars = [], 0
    for r in rows:
        if r["absent"]:
            continue
        if held and (len(held) >= most or chars + len(r["text"]) > PIECE_CHARS):
            yield held, True
            held, chars = [], 0
        held.append(r)
        chars += len(r["text"])
    yield held, False


def _facts(rows: list[dict]) -> list[tuple[str, str]]:
    return [(r["role"][:1], r["fault"]) for r in rows]


def _ways(rows: list[dict]) -> list[dict]:
    """The cheapest ways through a piece, from each state to each state."""
    facts = _facts(rows)
    return [{"start": s, "stop": e, "cost": c, "audit": a} for s in range(4) for e, (c, a) in cheapest(facts, s, None).items()]


def _searched(schema: pa.Schema, piece_rows: int):
    """Sorted rows to done conversations and open pieces. Open are pieces at the edges of the task, whose conversation may go on in
    another, and those of conversations of several pieces."""

    def search(batches):
        part, seq = TaskContext.get().partitionId(), 0
        base = {"part": part, "report": None, "turns": None, "summary": None, "ways": None, "rows": None}

        def open_piece(conv, rows):
            return base | {"conv": conv, "seq": seq, "done": False, "summary": summary(rows), "ways": _ways(rows), "rows": [{k: r[k] for k in ("role", "text")} for r in rows]}

        def out():
            nonlocal seq
            edge = True
            waiting = None  # a conversation of one piece that is done unless the task ends with it
            for conv, rows in _groups(_rows(batches)):
                if waiting:
                    yield done(*waiting)
                    seq += 1
                    waiting = None
                for k, (piece, more) in enumerate(_pieces(rows, piece_rows)):
                    if edge or more or k:
                        yield open_piece(conv, piece)
                        seq += 1
                    else:
                        waiting = conv, piece
                edge = False
            if waiting:
                yield open_piece(*waiting)

        def done(conv, rows):
            [(cost, audit)] = cheapest(_facts(rows)).values()
            return base | {"conv": conv, "seq": seq, "done": True, "report": report(summary(rows), cost, audit), "turns": applied(rows, audit)}

        yield from _batches(out(), schema, lambda r: 300 + sum(len(x["text"]) for x in r["rows"] or r["turns"] or ()))

    return search


def _composed(schema: pa.Schema):
    """Open pieces in order to what each has to do: its first state and its part of the audit; the first has the report."""

    def compose(batches):
        def out():
            for conv, pieces in _groups(_rows(batches)):
                total, places, best = None, [], {NOTHING: (0, "", None)}
                for p in pieces:
                    total = p["summary"] if total is None else joined(total, p["summary"])
                    places.append((p["part"], p["seq"]))
                    after: dict[int, tuple] = {}
                    for w in p["ways"]:
                        if w["start"] in best:
                            cost, audit, marks = best[w["start"]]
                            way = cost + w["cost"], audit + w["audit"], (marks, len(audit), w["start"])
                            if w["stop"] not in after or way[:2] < after[w["stop"]][:2]:
                                after[w["stop"]] = way
                    best = after
                cost, audit, marks = min((best[s] for s in ENDS if s in best), key=lambda w: w[:2])
                found, stop = report(total, cost, audit), len(audit)
                for k in range(len(places) - 1, -1, -1):
                    marks, begin, state = marks
                    part, seq = places[k]
                    yield {"conv": conv, "part": part, "seq": seq, "piece": k, "last": k == len(places) - 1, "state": state, "edits": audit[begin:stop], "report": None if k else found}
                    stop = begin

        yield from _batches(out(), schema, lambda r: 300 + len(r["edits"]))

    return compose


def _edited(schema: pa.Schema):
    def edit(batches):
        for b in batches:
            rows = [{"conv": r["conv"], "piece": r["piece"], "last": r["last"], "report": r["report"], "turns": applied(r["rows"], r["edits"], r["state"])} for r in b.to_pylist()]
            yield pa.RecordBatch.from_pylist(rows, schema)

    return edit


def _arrow(spark, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def flagged(rows: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, absent: Column) -> DataFrame:
    """(conv, turn, role, text, absent, fault) of rows; fault is empty, blank, duplicate or truncated."""
    text = F.when(~absent, F.coalesce(F.col(text_col).cast("string"), F.lit(" ")))
    base = rows.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit(" ")).alias("role"), text.alias("text"), absent.alias("absent"))
    seen = F.row_number().over(W.partitionBy("conv", "absent", "role", "text").orderBy(F.col("turn").asc_nulls_first()))
    fault = F.when(F.col("text").rlike(BLANK), "blank").when(F.col("nth") > 1, "duplicate").when(~F.col("text").rlike(FINISHED), "truncated").otherwise("")
    return base.withColumn("nth", seen).withColumn("fault", F.when(F.col("absent"), "").otherwise(fault))


def repair(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", absent: Column | None = None, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """(conv, piece, last, report, turns): the repaired turns of each conversation, with what was done to each, in pieces from 0.

    Nearly all conversations are one piece; `report` (counts, cost, audit) stands on piece 0. `absent` marks rows that name their
    conversation but take no part.
    """
    spark = rows.sparkSession
    common.small_batches(spark)
    marked = flagged(rows, conv_col, turn_col, role_col, text_col, F.lit(False) if absent is None else F.coalesce(absent, F.lit(False)))
    conv = marked.schema["conv"].dataType.simpleString()
    order = [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first()]
    # the start of the text deals out rows of one turn; rows that agree on it are sorted by the whole text in one task
    dealt = marked.repartitionByRange(*order, F.left("text", F.lit(32)).asc_nulls_first()).sortWithinPartitions(*order, F.col("text").asc_nulls_first(), "nth")
    whole = f"conv {conv}, part int, seq int, done boolean, report {REPORT}, turns {TURNS}, summary struct<blank:bigint,duplicate:bigint,truncated:bigint,illegal:bigint,distinct:bigint,low:bigint,high:bigint,first:string,last:string>, ways array<struct<start:int,stop:int,cost:bigint,audit:string>>, rows array<struct<role:string,text:string>>"
    found = common.written(dealt.select("conv", "turn", "role", "text", "absent", "fault").mapInArrow(_searched(_arrow(spark, whole), piece_rows), whole), "lattice")
    steps = f"conv {conv}, part int, seq int, piece int, last boolean, state int, edits string, report {REPORT}"
    opened = found.where("not done").select("conv", "part", "seq", "summary", "ways").repartition("conv").sortWithinPartitions("conv", "part", "seq")
    composed = opened.mapInArrow(_composed(_arrow(spark, steps)), steps)
    out = f"conv {conv}, piece int, last boolean, report {REPORT}, turns {TURNS}"
    mended = composed.join(found.where("not done").select("part", "seq", "rows"), ["part", "seq"]).select("conv", "piece", "last", "report", "rows", "edits", "state").mapInArrow(_edited(_arrow(spark, out)), out)
    return found.where("done").select("conv", F.lit(0).alias("piece"), F.lit(True).alias("last"), "report", "turns").unionByName(mended)


def digests(pieces: DataFrame) -> DataFrame:
    """(conv, the report's columns, repaired_sha256) of repaired conversations: of their `role:text`, joined by line feeds.

    Conversations of several pieces are hashed as their pieces come, in order, so their texts are never together.
    """
    spark = pieces.sparkSession
    conv = pieces.schema["conv"].dataType.simpleString()
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    one = F.col("last") & (F.col("piece") == 0)
    short = pieces.where(one).select("conv", "report.*", F.sha2(said, 256).alias("repaired_sha256"))
    out = f"conv {conv}, {', '.join(f'{c} bigint' for c in COUNTS)}, audit string, repaired_sha256 string"
    schema = _arrow(spark, out)

    def hashed(batches):
        def out():
            for conv, parts in _groups(_rows(batches)):
                sha, any_yet, found = hashlib.sha256(), False, {}
                for p in parts:
                    found = p["report"] or found
                    if p["some"]:
                        sha.update(("\n" * any_yet + p["said"]).encode())
                        any_yet = True
                yield {"conv": conv, **found, "repaired_sha256": sha.hexdigest()}

        yield from _batches(out(), schema, lambda r: 300 + len(r["audit"]))

    parts = pieces.where(~one).select("conv", "piece", "report", (F.size("turns") > 0).alias("some"), said.alias("said"))
    return short.unionByName(parts.repartition("conv").sortWithinPartitions("conv", "piece").mapInArrow(hashed, out))


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, absent) of conversations with faults put in, by crc32(`conv_id:turn`) % 20.

    0 takes the row away (it stays as absent, to name its conversation), 1 empties its text, 2 takes [.!?] out of it, 3 repeats it,
    4 makes its role user. Nulls count as one space.
    """
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat_ws(":", said("conv_id"), said("turn")).cast("binary")) % 20
    marked = rows.select("conv_id", "turn", said("role").alias("role"), said("text").alias("text"), fate.alias("fate"))
    fate = F.col("fate")
    text = F.when(fate == 1, "").when(fate == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    out = marked.select("conv_id", "turn", F.when(fate == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (fate == 0).alias("absent"), F.explode(F.when(fate == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))
    return out.drop("copy")


def _sql() -> str:
    """DuckDB SQL for damaged(), repair() and digests() of `conversations`, by a table over places and states in place of a search.

    A state's best way is a text: its cost in six digits, then its audit. A fold over a conversation's rows takes the four of them on.
    """
    more = lambda key, cost, edit: f"lpad((left({key}, 6)::int + {cost})::varchar, 6, '0') || substr({key}, 7) || '{edit}'"
    k = [f"a[{n + 1}]" for n in range(4)]
    inserted = [k[0], k[1], f"least({k[2]}, {', '.join(more(k[n], INSERT, 'I') for n in (0, 1, 3))})", f"least({k[3]}, {more(k[2], INSERT, 'I')})"]
    stays = lambda n, initial: f"case when r[2] in ('', 'truncated') then case when r[1] = '{initial}' then {more(k[n], f'(case r[2] when {chr(39)}truncated{chr(39)} then {TRUNCATED} else 0 end)', 'K')} else {more(k[n], f'(case r[2] when {chr(39)}truncated{chr(39)} then {TRUNCATED} else 0 end + {REROLE})', 'R')} end end"
    system = f"case when r[1] = 's' and r[2] in ('', 'truncated') then {more(k[0], f'(case r[2] when {chr(39)}truncated{chr(39)} then {TRUNCATED} else 0 end)', 'K')} end"
    read = [more(k[0], DELETE, "D"), f"least({more(k[1], DELETE, 'D')}, {system})", f"least({more(k[2], DELETE, 'D')}, {', '.join(stays(n, 'u') for n in (0, 1, 3))})", f"least({more(k[3], DELETE, 'D')}, {stays(2, 'a')})"]
    insert = f"list_transform([a], lambda a: [{', '.join(inserted)}])[1]"
    step = f"list_transform([{insert}], lambda a: [{', '.join(read)}])[1]"
    return f"""
with keyed as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as k from conversations),
fated as (select *, xor(list_reduce(flatten(list_transform(range(1, length(k) + 1), lambda i: list_transform(range(8), lambda j: (ascii(substr(k, i::int, 1)) >> j::int)::bigint & 1))),
    lambda c, b: xor(c >> 1, 3988292384 * xor(c & 1, b)), 4294967295::bigint), 4294967295) % 20 as fate from keyed),
damaged as (select conv_id, turn, case fate when 4 then 'user' else role end as role, case fate when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text, unnest(case fate when 3 then [0, 1] else [0] end) as copy from fated where fate <> 0),
ordered as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text, copy) as i,
    case when not regexp_matches(text, '[^\\x20\\x09-\\x0D]') then 'blank' when row_number() over (partition by conv_id, role, text order by turn nulls first, copy) > 1 then 'duplicate'
    when not regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') then 'truncated' else '' end as fault from damaged),
paired as (select *, lag(left(role, 1)) over (partition by conv_id order by i) as before from ordered),
counted as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0)::bigint as gaps, count(*) filter (fault = 'blank')::bigint as blank, count(*) filter (fault = 'duplicate')::bigint as duplicate,
    count(*) filter (fault = 'truncated')::bigint as truncated, count(*) filter (before || left(role, 1) not in ('su', 'ua', 'au'))::bigint as illegal, list([left(role, 1), fault] order by i) as rows from paired group by conv_id),
ways as (select * exclude (rows), list_reduce(rows, lambda a, r: {step}, ['000000', null, null, null]) as a from counted),
best as (select * exclude (a), list_transform([{insert}], lambda b: least(b[1], b[4]))[1] as way from ways),
audits as (select conv_id, gaps, blank, duplicate, truncated, illegal, left(way, 6)::bigint as cost, substr(way, 7) as audit from best),
edits as (select conv_id, unnest(string_split(audit, '')) as e, generate_subscripts(string_split(audit, ''), 1) as j from audits where audit <> ''),
placed as (select *, sum((e <> 'I')::int) over (partition by conv_id order by j) as i, sum((e <> 'D')::int) over (partition by conv_id order by j) as n from edits),
turned as (select p.conv_id, j, e, n, o.role, o.text, first_value(e = 'K' and left(o.role, 1) = 's') over (partition by p.conv_id, e <> 'D' order by j) as led
    from placed p left join ordered o on o.conv_id is not distinct from p.conv_id and o.i = p.i and e <> 'I' where e <> 'D'),
repaired as (select conv_id, string_agg(case when e = 'K' then role when (n - led::int) % 2 = 1 then 'user' else 'assistant' end || ':' || case when e = 'I' then '' else text end, chr(10) order by j) as said from turned group by conv_id),
names as (select distinct conv_id from conversations)
select n.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal, coalesce(cost, 0) as cost, coalesce(audit, '') as audit,
    sha256(coalesce(said, '')) as repaired_sha256
from names n left join audits a on a.conv_id is not distinct from n.conv_id left join repaired r on r.conv_id is not distinct from n.conv_id
"""


SQL = _sql()
