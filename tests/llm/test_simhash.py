import random

import numpy as np
import pytest
import xxhash

from credsift.llm import simhash

DOCS = "doc_id long, text string"


def plain(text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    ids, root = list(prints), {i: i for i in prints}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, a in enumerate(ids):
        for b in ids[:k]:
            if bin(prints[a] ^ prints[b]).count("1") <= 4:
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    return {i: top(i) for i in ids}


def test_fingerprints_match_the_definition():
    for text in (None, "", " \t\x0b", "One", "a b c", "Ä ä É a b c d\x0ce f", "x " * 500, "\xa0a b c d e f g h"):
        assert simhash.text_fingerprint(text) == plain(text)


@pytest.mark.parametrize("radius", [0, 1, 3, 4, 6, 7])
def test_bit_sliced_comparison_matches_popcounts(radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    prints = np.concatenate([base, base ^ np.uint64(0b111), base ^ (np.uint64(1) << rng.integers(0, 63, 40, dtype=np.uint64)), rng.integers(0, 1 << 63, 100, dtype=np.uint64)])
    rng.shuffle(prints)
    planes = simhash.bit_planes(prints)
    for shift in (1, 2, 63, 64, 65, 130):
        mask = rng.random(len(prints)) < 0.8
        mask[len(prints) - shift :] = False
        near = [i for i in np.flatnonzero(mask) if bin(int(prints[i] ^ prints[i + shift])).count("1") <= radius]
        assert sorted(simhash.within(planes, shift, simhash.lanes(mask), radius).tolist()) == near


def test_against_brute_force_on_the_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    prints = {r.doc_id: plain(r.text) for r in rows}
    want = plain_components(prints)
    got = simhash.near_duplicates(docs).collect()
    assert {r.id: r.component for r in got} == want
    assert {r.id: r.print % (1 << 64) for r in got} == prints


def test_split_buckets_lose_no_link(spark):
    random.seed(5)
    rows, prints = [], {}
    words = [f"w{i}" for i in range(400)]
    for i in range(300):
        text = list(words)
        for _ in range(random.randint(0, 3)):
            text[random.randrange(400)] = f"x{random.random()}"
        rows.append((i, " ".join(text)))
        prints[i] = plain(rows[-1][1])
    df = spark.createDataFrame(rows, DOCS)
    for two_block_rows in (0, 1000):
        got = {r.id: r.component for r in simhash.near_duplicates(df, bucket_rows=16, two_block_rows=two_block_rows).collect()}
        assert got == plain_components(prints)


def test_components_of_stars_chains_and_hubs(spark):
    random.seed(8)
    edges = [(i, i + 1) for i in range(100, 160)] + [(999, i) for i in range(300, 500)] + [(600, i) for i in range(601, 900)] + [(5, 700), (2000, 2001), (2001, 2002), (2002, 2000), (7, 7)]
    edges += [(random.randint(3000, 3080), random.randint(3000, 3080)) for _ in range(60)]
    random.shuffle(edges)
    root = {n: n for e in edges for n in e}

    def top(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in edges:
        x, y = top(a), top(b)
        root[max(x, y)] = min(x, y)
    linked = {n for a, b in edges if a != b for n in (a, b)}
    got = {(r.node, r.root) for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {(n, top(n)) for n in linked}
    assert simhash.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_odd_rows(spark):
    rows = [(1, None, "a"), (2, "", "b"), (3, " \n", "c"), (4, "same words here now and then", "d"), (4, "same words here now and then", "d"), (None, "Same words here now and THEN", "e"), (9, "alone " * 3000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, print string")
    got = sorted(((r.id, r.component) for r in simhash.near_duplicates(df).collect()), key=str)
    assert got == sorted([(1, 1), (2, 1), (3, 1), (4, 4), (4, 4), (None, 4), (9, 9)], key=str)
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 4, 9]
    empty = df.limit(0)
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.keep_one(empty).count() == 0


def test_keep_one_keeps_the_smallest_id_of_each_group(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = set(plain_components({r.doc_id: plain(r.text) for r in docs.collect()}).values())
    assert sorted(r.doc_id for r in simhash.keep_one(docs).collect()) == sorted(want)


def test_a_row_that_is_repeated_very_often_is_kept_once(spark):
    rows = spark.range(30_000).selectExpr("if(id % 3 = 0, 0, id) as doc_id", "if(id % 3 = 0, 'the same words here now and then and again', concat_ws(' ', id, id * 7, id * 13, id * 17, id * 19, md5(cast(id as string)), md5(cast(id * 3 as string)))) as text", "'x' as n")
    kept = simhash.keep_one(rows)
    ids = [r.doc_id for r in kept.collect()]
    assert len(ids) == len(set(ids)) and 0 in ids
    assert set(ids) == {r.component for r in simhash.near_duplicates(rows.select("doc_id", "text")).select("component").distinct().collect()}


def test_a_bucket_of_thousands_of_prints_that_are_all_close(spark):
    """Blocks of a large bucket are compared in pairs; no link is lost."""
    rng = random.Random(3)
    base = rng.getrandbits(64)
    prints = {base ^ sum(1 << b for b in rng.sample(range(24), rng.randrange(0, 7))) for _ in range(3000)}
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    found = simhash.links(spark.createDataFrame([(p,) for p in signed], "print long"), bucket_rows=256).collect()
    root = {p: p for p in signed}

    def top(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for r in found:
        assert bin((r.a ^ r.b) & ((1 << 64) - 1)).count("1") <= 4
        root[top(r.a)] = top(r.b)
    due = {p: p for p in signed}

    def due_top(x):
        while due[x] != x:
            due[x] = due[due[x]]
            x = due[x]
        return x

    array = np.array([p % (1 << 64) for p in signed], np.uint64)
    for k, p in enumerate(array):
        for j in np.flatnonzero(np.bitwise_count(array[k + 1 :] ^ p) <= 4):
            due[due_top(signed[k])] = due_top(signed[k + 1 + j])
    assert len({top(p) for p in signed}) == len({due_top(p) for p in signed})
    pairs = {}
    for p in signed:
        assert pairs.setdefault(due_top(p), top(p)) == top(p)
