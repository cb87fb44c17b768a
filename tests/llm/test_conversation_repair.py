"""Conversation repair against enumeration of all edits, and the whole query against a plain version."""

import hashlib
import itertools
import random
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from credsift.llm import conversation_repair as cr
from credsift.llm import queries

LEGAL = re.compile(r"(s?(ua)+)?\Z")


def enumerated(rows):
    """(cost, audit, initials) of the best of all edits of rows of (initial, fault), with up to one insertion before each row and at the end."""
    best = None
    kinds = [["D"] if fault in ("blank", "duplicate") else ["D", "K", "Ru", "Ra"] for _, fault in rows]
    for edits in itertools.product(*kinds):
        for inserted in itertools.product(["", "u", "a"], repeat=len(rows) + 1):
            cost, audit, roles = 0, "", ""
            for k, ins in enumerate(inserted):
                if ins:
                    cost, audit, roles = cost + 5, audit + "I", roles + ins
                if k < len(rows):
                    e = edits[k]
                    cost += {"D": 2, "K": 0}.get(e, 1) + (5 if e != "D" and rows[k][1] == "truncated" else 0)
                    audit += e[0]
                    roles += {"D": "", "K": rows[k][0]}.get(e, e[1:])
            if LEGAL.match(roles) and (best is None or (cost, audit) < best[:2]):
                best = cost, audit, roles
    return best


def test_the_search_finds_the_least_of_all_edits():
    rng = random.Random(5)
    for _ in range(150):
        rows = [(rng.choice("suauax"), rng.choice(["", "", "", "truncated", "blank", "duplicate"])) for _ in range(rng.randrange(0, 5))]
        [(cost, audit)] = cr.cheapest(rows).values()
        assert (cost, audit) == enumerated(rows)[:2], rows


def test_the_heuristic_never_overrates():
    rng = random.Random(6)
    for _ in range(50):
        rows = [(rng.choice("sua"), rng.choice(["", "truncated", "blank"])) for _ in range(6)]
        least = cr.unavoidable(rows)
        for k in range(7):
            assert all(least[k] <= cost for s in range(4) for cost, _ in cr.cheapest(rows[k:], s, cr.ENDS).values())


def plain(rows):
    """(conv_id -> the query's columns) of (conv_id, turn, role, text), row by row and with a table over places and states."""
    said = lambda x: " " if x is None else x
    held = {}
    for conv, turn, role, text in rows:
        rows_of = held.setdefault(conv, [])
        fate = zlib.crc32(f"{said(conv)}:{said(turn)}".encode()) % 20
        role, text = said(role), said(text)
        if fate == 0:
            continue
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        role = "user" if fate == 4 else role
        rows_of += [(turn, role, text)] * (2 if fate == 3 else 1)
    out = {}
    for conv, rows_of in held.items():
        rows_of.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, faults = set(), []
        for _, role, text in rows_of:
            core = text.strip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not core else "duplicate" if (role, text) in seen else "truncated" if core[-1] not in ".!?" else "")
            seen.add((role, text))
        best = {0: (0, "", [])}

        def insert(best):
            for s in list(best):
                c, a, t = best[s]
                to = 3 if s == 2 else 2
                way = c + 5, a + "I", [*t, ("assistant" if to == 3 else "user") + ":"]
                if to not in best or way[:2] < best[to][:2]:
                    best[to] = way

        for (_, role, text), fault in zip(rows_of, faults, strict=True):
            insert(best)
            after = {}

            def offer(to, c, a, t, after=after):
                if to not in after or (c, a) < after[to][:2]:
                    after[to] = c, a, t

            for s, (c, a, t) in best.items():
                offer(s, c + 2, a + "D", t)
                if fault in ("blank", "duplicate"):
                    continue
                extra, to = 5 * (fault == "truncated"), 3 if s == 2 else 2
                if role[:1] == ("a" if to == 3 else "u"):
                    offer(to, c + extra, a + "K", [*t, f"{role}:{text}"])
                if role[:1] == "s" and s == 0:
                    offer(1, c + extra, a + "K", [*t, f"{role}:{text}"])
                offer(to, c + 1 + extra, a + "R", [*t, ("assistant" if to == 3 else "user") + f":{text}"])
            best = after
        insert(best)
        cost, audit, turns = min((best[s] for s in (0, 3) if s in best), key=lambda w: w[:2])
        numbers = [t for t, _, _ in rows_of if t is not None]
        initials = [r[:1] for _, r, _ in rows_of]
        out[conv] = (
            max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False)), cost, audit, hashlib.sha256("\n".join(turns).encode()).hexdigest(),
        )
    return out


COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def repaired(spark, rows, **options):
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = cr.digests(cr.repair(cr.damaged(table), absent=F.col("absent"), **options)).collect()
    assert len({r["conv"] for r in found}) == len(found)
    return {r["conv"]: tuple(r[c] for c in COLUMNS) for r in found}


def test_the_query_agrees_with_the_plain_version(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    found = queries.op11_conversation_repair(spark, sf).collect()
    assert {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in found} == plain(rows)
    assert len(found) == len({r[0] for r in rows})


@pytest.mark.parametrize("piece_rows", [1, 7, 512])
def test_a_conversation_that_holds_a_third_of_all_rows_is_cut_into_pieces(spark, piece_rows):
    rng = random.Random(7)
    roles, texts = ["system", "user", "assistant", "assistant", "tool", "", None], ["Yes.", "No!", "what", "", " \t", None, "é. ", "long " * 50 + "end.", "A?"]
    many = [(1, k if rng.random() < 0.9 else None, rng.choice(roles), f"{rng.choice(texts) or ''}{rng.choice(['', str(k)])}") for k in range(400)]
    many += [(1, 5, "user", "copy."), (1, 5, "user", "copy."), (1, 5, "assistant", "copy.")]
    others = [(rng.choice([*range(2, 200), None]), rng.choice([None, *range(9)]), rng.choice(roles), rng.choice(texts)) for _ in range(800)]
    assert repaired(spark, many + others, piece_rows=piece_rows) == plain(many + others)


def test_nothing_and_rows_that_all_go(spark):
    assert repaired(spark, []) == {}
    gone = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    assert repaired(spark, [(gone, 0, "user", "Hello.")]) == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_the_repaired_turns_are_the_operators_output(spark):
    rows = spark.createDataFrame([("x", 1, "assistant", "Hello.", "b"), ("x", 2, "user", "More?", "b"), ("x", 3, "user", "More?", "c"), ("x", 4, "system", "Sure.", None)], "conv_id string, turn int, role string, text string, report string")
    [found] = cr.repair(rows).collect()
    assert (found["report"]["audit"], found["report"]["cost"]) == ("DKDR", 5)
    assert [(t["role"], t["text"]) for t in found["turns"]] == [("user", "More?"), ("assistant", "Sure.")]
    assert (found["piece"], found["last"], found["report"]["duplicate"]) == (0, True, 1)


def test_a_very_long_text_and_clashing_columns(spark):
    text = "word " * 400_000 + "end."
    rows = spark.createDataFrame([(1, 1, "user", text, 0, 1), (1, 2, "assistant", text, 0, 2)], "conv_id long, turn long, role string, text string, conv long, fault long")
    [found] = cr.repair(rows).collect()
    assert found["report"]["audit"] == "KK" and [t["text"] for t in found["turns"]] == [text, text]


def test_the_query_agrees_with_its_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{sf}/conversations.parquet'")
    found = queries.op11_conversation_repair(spark, sf)
    names = ("conv_id", *COLUMNS)
    assert sorted(tuple(r[c] for c in names) for r in found.collect()) == sorted(con.execute(f"select {', '.join(names)} from ({cr.SQL})").fetchall())
