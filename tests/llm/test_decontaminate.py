import pytest

from credsift.llm import decontaminate as dc

ITEM = "A train leaves the old station at 40 km per hour and later meets Alice near the river after 3 hours. How far did Alice walk before she met the train that morning?"


def hits(spark, docs, items=((1, ITEM),), **more):
    d = spark.createDataFrame([(i, t) for i, t in enumerate(docs)], "doc_id long, text string")
    b = spark.createDataFrame(list(items), "item_id long, text string")
    return {(r.id, r.item): r for r in dc.hits(d, b, **more).collect()}


def test_verbatim_and_reparameterised(spark):
    other = ITEM.replace("40 km", "55 km").replace("Alice", "Berta").replace("3 hours", "7 hours")
    trade = "Then the baker Alice sold 40 loaves to Bernd and later Bernd gave Alice 40 coins for the bread and 12 more."
    mixed = trade.replace("baker Alice", "baker Carla").replace("gave Alice", "gave Dora").replace("40 loaves", "50 loaves").replace("40 coins", "60 coins")
    got = hits(spark, [f"Intro words here. {ITEM} And more.", f"Something else. {other}", "Nothing like it at all, just words that go on and on for a while.", f"Before. {mixed}", ITEM.upper(), ITEM.replace(" the ", " a "), trade.replace("Alice", "Dora")], [(1, ITEM), (2, trade)])
    assert got[0, 1].same and got[0, 1].coverage == 1
    assert not got[1, 1].same and got[1, 1].consistency == 1
    assert (2, 1) not in got
    assert (3, 2) not in got, "slots with two values each"
    assert (5, 1) not in got
    assert got[6, 2].consistency == 1 and not got[6, 2].same


def test_each_occurrence_counts(spark):
    other = ITEM.replace("40 km", "55 km").replace("Alice", "Berta").replace("3 hours", "7 hours")
    third = other.replace("55", "66").replace("Berta", "Carla").replace("7", "8")
    longer = third.replace("far did", "far indeed did")
    got = hits(spark, [f"{ITEM} {other}", f"Some. {other} And more words. {third}", f"{other} Then there came. {longer}", f"Far off. {ITEM} Station at 99 km per hour. Later meets Zora near the river."])
    assert set(got) == {(0, 1), (1, 1), (2, 1), (3, 1)}
    assert got[0, 1].same and got[3, 1].same and not got[1, 1].same
    assert got[1, 1].consistency == 1


@pytest.mark.parametrize("item", ["Compute 12 34 56 78 90.", "Evaluate 3 + 4 * 5 - 6 / 2 = ?", "12 7 19 3 8 44 5", "Add 1 2 3 4 5 6 7 8 and show how it is done"])
def test_items_of_numbers(spark, item):
    changed = "".join("7" if c.isdigit() else c for c in item)
    got = hits(spark, [f"Some words. {item} More words.", f"Some words. {changed} More words.", "and show how it is done"], [(1, item)])
    assert set(got) == {(0, 1)}
    assert got[0, 1].coverage == 1 and got[0, 1].same


def test_doubtful_capitals(spark):
    item = "What is the capital city of France?"
    trip = "When Alice went home she took 4 apples"
    docs = [f"Question: {item}", f'He said "{item}"', f"Well, {item}", f"Intro words\n{item}", item.upper(), item.lower(), f"Question: {trip.replace('Alice', 'Berta')}", trip.upper().replace("4", "9"), "Question: Which is the capital city of France?"]
    got = hits(spark, docs, [(1, item), (2, trip)])
    assert {d for d, i in got if i == 1} == set(range(6))
    assert all(got[d, 1].coverage == 1 and got[d, 1].same for d in range(6))
    assert {d for d, i in got if i == 2} == {6, 7}
    got = hits(spark, [ITEM.upper(), ITEM.lower()])
    assert set(got) == {(0, 1), (1, 1)}
    assert got[0, 1].same and got[1, 1].same


def test_parts_give_the_same(spark):
    docs = [f"Intro. {ITEM}", "no", ITEM + " " + ITEM]
    key = lambda d: sorted((k, r.coverage, r.slots) for k, r in d.items())
    assert key(hits(spark, docs)) == key(hits(spark, docs, part_rows=5))


@pytest.mark.parametrize("text", [None, "", "  ", "...", "one two", "\x01 \x01."])
def test_empty_and_short(spark, text):
    got = hits(spark, [text, "one two", "One, TWO!", "one two three four five six"], [(1, "one two"), (2, None), (3, ""), (None, "zzz yyy xxx www vvv uuu")])
    assert {k for k in got if k[0] in (1, 2)} == {(1, 1), (2, 1)}
    assert not any(k[0] == 3 for k in got)


def test_clean_and_odd_rows(spark):
    rows = [(1, ITEM, "a"), (1, "a clean text of the same id that shares nothing at all", "b"), (None, f"x y. {ITEM}", "c"), (3, None, "d"), (4, "fine words only here", None), (4, "fine words only here", None), (5, ("filler words " * 4000) + ". " + ITEM, "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, held_id string")
    items = spark.createDataFrame([(9, ITEM), (9, ITEM)], "item_id long, text string")
    out = dc.clean(df, items)
    assert out.columns == df.columns
    assert sorted(str(r.held_id) for r in out.collect()) == ["None", "None", "b", "d"]
    assert dc.clean(df.limit(0), items).count() == 0
    assert dc.clean(df, items.limit(0)).count() == len(rows)


def test_every_leak_of_the_table_is_found(spark, sf):
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    got = {(r.id, r.item) for r in dc.hits(docs, items).collect()}
    exact = {(d.doc_id, b.item_id) for d in docs.collect() for b in items.collect() if d.text and b.text in d.text}
    assert exact <= got
    assert len(got) <= len(exact) + 1
