"""SimHash near-duplicates: 64-bit fingerprints, bit-sliced comparison, connected components.

Two fingerprints that differ in at most `radius` bits agree on `match` whole blocks when the 64 bits are cut into
radius + match blocks, so every choice of `match` blocks is a bucket key and every link shows up in some bucket.
Buckets are compared with bit planes stored vertically: lane i of plane p is bit p of row i, shifting a plane by d lanes
lines every row up with its d-th successor, and carry-save counters add up the differing bits of 64 pairs per word.
Words whose lanes all exceed the radius are abandoned.

Defined results: a null or empty text, or one of white space only, has fingerprint zero and links like any other; repeated
rows keep their own output rows; null ids are kept and never name a component unless all its ids are null; an empty
table gives an empty result; other columns pass through untouched.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

SEED = 42
#: A bucket of more rows is cut into blocks that are compared pairwise in tasks of their own.
BUCKET_ROWS = 8192
#: Up to so many distinct fingerprints two blocks make a key, beyond it three, which keeps buckets small.
TWO_BLOCK_ROWS = 1 << 27
#: A node with more than one in so many of all edges has its least neighbour broadcast; there are at most so many such nodes.
HOT_NODES = 1024


def text_fingerprint(text: str | None, shingle: int = 4) -> int:
    """Unsigned fingerprint of one text: bit set where over half of the shingle hashes have it set."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(b" ".join(words), SEED)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - shingle + 1].tolist()
    hashes = np.array([digest(line[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)], np.uint64)
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(text: Column, shingle: int = 4) -> Column:
    """Column of fingerprints as signed 64-bit integers."""

    @F.pandas_udf(T.LongType())
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([text_fingerprint(t, shingle) for t in texts], np.uint64).astype(np.int64))

    return of(text)


def bit_planes(prints: np.ndarray) -> np.ndarray:
    """(64, words + 2) array: bit i of word w in row p is bit p of print 64 w + i; two zero words pad shifted reads."""
    n = len(prints)
    words = (n + 63) // 64
    bits = np.zeros((words * 64, 64), np.uint8)
    bits[:n] = np.unpackbits(prints.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    packed = np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(np.uint64)
    return np.hstack([packed, np.zeros((64, 2), np.uint64)])


def lanes(mask: np.ndarray) -> np.ndarray:
    """Booleans packed into words, low bit first."""
    padded = np.zeros((len(mask) + 63) // 64 * 64, np.uint8)
    padded[: len(mask)] = mask
    return np.packbits(padded, bitorder="little").view(np.uint64)


def within(planes: np.ndarray, shift: int, wanted: np.ndarray, radius: int) -> np.ndarray:
    """Positions i, among the lanes set in `wanted`, whose print differs from print i + shift in at most `radius` bits."""
    at = np.flatnonzero(wanted)
    if not len(at):
        return at
    skip, bit = divmod(shift, 64)
    dead = ~wanted[at]
    c0, c1, c2 = (np.zeros(len(at), np.uint64) for _ in range(3))
    low, high = np.uint64(bit), np.uint64(64 - bit)
    for p in range(0, 64, 2):
        x, y = (planes[q, at] ^ ((planes[q, at + skip] >> low) | (planes[q, at + skip + 1] << high) if bit else planes[q, at + skip]) for q in (p, p + 1))
        # carry-save: c0 takes two planes at once, the carries ripple on
        u = c0 ^ x
        carry = (c0 & x) | (u & y)
        c0 = u ^ y
        t = c1 & carry
        c1 ^= carry
        dead |= c2 & t
        c2 ^= t
        if p % 8 == 6:
            dead |= exceeds(c0, c1, c2, radius)
            live = dead != np.uint64(0xFFFFFFFFFFFFFFFF)
            if not live.any():
                return at[:0]
            if np.count_nonzero(live) * 2 < len(at):
                at, dead, c0, c1, c2 = at[live], dead[live], c0[live], c1[live], c2[live]
    found = np.unpackbits((~dead).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    w, i = np.nonzero(found)
    return at[w] * 64 + i


def exceeds(c0: np.ndarray, c1: np.ndarray, c2: np.ndarray, radius: int) -> np.ndarray:
    """Lanes whose three-bit count is over the radius."""
    if radius >= 7:
        return np.zeros_like(c0)
    above, equal = np.zeros_like(c0), ~np.zeros_like(c0)
    for k, c in ((2, c2), (1, c1), (0, c0)):
        if radius >> k & 1:
            equal = equal & c
        else:
            above |= equal & c
            equal = equal & ~c
    return above


def forest(keys: np.ndarray, prints: np.ndarray, side: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what any links within the buckets connect; rows of a bucket are adjacent.

    side: 0 compares with every row of the bucket, 1 and 2 only with each other. Lanes that are joined already are left out,
    so a bucket of m rows gives at most m - 1 links.
    """
    n = len(prints)
    planes, root = bit_planes(prints), np.arange(n)
    first = np.concatenate(([True], keys[1:] != keys[:-1]))
    longest = int(np.diff(np.concatenate((np.flatnonzero(first), [n]))).max())
    left, right = [], []

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    active = np.arange(n - 1)
    for d in range(1, longest):
        active = active[active < n - d]
        active = active[keys[active] == keys[active + d]]
        if not len(active):
            break
        use = active[(root[active] != root[active + d]) & ((side[active] == 0) | (side[active] != side[active + d]))]
        mask = np.zeros(n, bool)
        mask[use] = True
        found = within(planes, d, lanes(mask), radius)
        for i in found.tolist():
            a, b = top(i), top(i + d)
            if a != b:
                root[max(a, b)] = min(a, b)
                left.append(i)
                right.append(i + d)
        if len(found):
            while not np.array_equal(up := root[root], root):
                root = up
    return np.array(left, np.int64), np.array(right, np.int64)


def links(distinct: DataFrame, radius: int = 4, bucket_rows: int = BUCKET_ROWS, two_block_rows: int = TWO_BLOCK_ROWS) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints (column `print`) that connect all that differ in at most `radius` bits.

    Any number of blocks in a key finds all links; which one is used is a matter of bucket sizes only.
    """
    common.small_batches(distinct.sparkSession)
    match = 2 if distinct.count() <= two_block_rows else 3
    cuts = [round(64 * k / (radius + match)) for k in range(radius + match + 1)]
    keys = []
    for n, chosen in enumerate(combinations(range(radius + match), match)):
        mask = sum((1 << cuts[c + 1]) - (1 << cuts[c]) for c in chosen)
        keys.append(F.struct(F.lit(n).cast("short").alias("t"), F.col("print").bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask).cast("long")).alias("k")))
    rows = distinct.select("print", F.explode(F.array(*keys)).alias("key")).select("print", "key.t", "key.k")
    # pairs of blocks for the buckets that are too large for one task; usually there are none
    heavy = common.written(rows.groupBy("t", "k").count().where(F.col("count") > bucket_rows), "heavy")
    blocks = F.ceil(F.col("count") / (bucket_rows // 2)).cast("int")
    own = F.pmod(F.xxhash64("print"), blocks).cast("int")
    others = F.transform(F.sequence(F.lit(0), blocks - 1), lambda j: F.struct(F.least(j, own).alias("p"), F.greatest(j, own).alias("q"), F.when(j == own, 0).when(own < j, 1).otherwise(2).alias("side")))
    single = F.array(F.struct(F.lit(0).alias("p"), F.lit(0).alias("q"), F.lit(0).alias("side")))
    dealt = rows.join(heavy, ["t", "k"], "left").select("t", "k", "print", F.explode(F.when(F.col("count").isNull(), single).otherwise(others)).alias("o")).select("t", "k", "o.p", "o.q", "o.side", "print")
    # own blocks come with side 0 and are compared within themselves

    def compare(batches):
        rest = None
        for batch in batches:
            batch = batch if rest is None or not len(rest) else pd.concat([rest, batch], ignore_index=True)
            where = ["t", "k", "p", "q"]
            last = (batch[where] == batch[where].iloc[-1]).all(axis=1).to_numpy()
            rest, batch = batch[last], batch[~last]
            yield from pairs(batch, where)
        if rest is not None:
            yield from pairs(rest, where)

    def pairs(batch, where):
        if len(batch) < 2:
            return
        changed = np.zeros(len(batch), bool)
        for c in where:
            v = batch[c].to_numpy()
            changed[1:] |= v[1:] != v[:-1]
        group = np.cumsum(changed)
        sizes = np.bincount(group)
        keep = sizes[group] > 1
        if not keep.any():
            return
        prints = batch["print"].to_numpy()[keep]
        a, b = forest(group[keep], prints.astype(np.int64).view(np.uint64), batch["side"].to_numpy()[keep], radius)
        if len(a):
            yield pd.DataFrame({"a": prints[a], "b": prints[b]})

    return dealt.repartition("t", "k", "p", "q").sortWithinPartitions("t", "k", "p", "q").mapInPandas(compare, "a long, b long")


def with_least(rows: DataFrame, key: str, least: DataFrame, edges: int) -> DataFrame:
    """rows with `m`, the value that `least` (node, m) has for the node in column `key`; null for none.

    Nodes that hold more than one in HOT_NODES of the rows would bring them all to one task. Their values are broadcast instead:
    at most HOT_NODES rows, whatever the size.
    """
    hot = rows.groupBy(key).count().where(F.col("count") * HOT_NODES > edges).select(F.col(key).alias("h_node"))
    hot = hot.join(least, hot["h_node"] == least["node"], "left").select("h_node", F.struct("m").alias("h_m"))
    marked = rows.join(F.broadcast(hot), F.col(key) == F.col("h_node"), "left")
    rest = marked.where("h_m is null").drop("h_node", "h_m")
    return marked.where("h_m is not null").select(*rows.columns, "h_m.m").unionByName(rest.join(least, F.col(key) == least["node"], "left").select(*rows.columns, "m"))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root): connected components by alternating large-star and small-star steps; root is the smallest node.

    Edges go from the greater node a to the smaller b. The large-star step hangs a on the least neighbour of b, the small-star
    step hangs all smaller neighbours of a node on its least. Every step is an aggregation with partial sums and a look-up,
    written to the shared folder; nothing is collected but two sums that tell whether the edges still change.
    """
    now = common.written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    state, total = None, now.count()
    for _ in range(rounds):
        lowest = now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
        large = common.written(with_least(now, "b", lowest, total).select("a", F.coalesce("m", "b").alias("b")).distinct(), "edges")
        lowest = large.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
        small = with_least(large, "a", lowest, total).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        now = common.written(small.union(lowest.select(F.col("node").alias("a"), F.col("m").alias("b"))).distinct(), "edges")
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == state:
            break
        state, total = seen, seen[0]
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 4, shingle: int = 4, bucket_rows: int = BUCKET_ROWS, two_block_rows: int = TWO_BLOCK_ROWS) -> DataFrame:
    """(id, print, component): one row per row of docs; component is the smallest id that links reach."""
    common.small_batches(docs.sparkSession)
    prints = common.written(docs.select(F.col(id_col).alias("id"), fingerprint(F.col(text_col), shingle).alias("print")), "prints")
    distinct = common.written(prints.groupBy("print").agg(F.min("id").alias("least")), "distinct")
    joined = components(links(distinct, radius, bucket_rows, two_block_rows))
    roots = distinct.join(joined, distinct["print"] == joined["node"], "left").select("print", "least", F.coalesce("root", "print").alias("root"))
    named = common.written(roots, "roots")
    # a component's name is the smallest id of its members; only components of several prints need the aggregate
    names = named.groupBy("root").agg(F.min("least").alias("component"))
    by_print = named.join(names, "root").select("print", "component")
    return prints.join(by_print, "print").select("id", "print", "component")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 4, shingle: int = 4) -> DataFrame:
    """docs with one row of each near-duplicate group: that of the smallest id, and among repeated ids one row.

    Rows with a null id take part in links; a group of null ids only keeps one of its rows.
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    row = common.free_name(docs, "row_no")
    # the row number follows the id, so ids decide and repeated ids are told apart
    numbered = docs.select("*", F.struct(F.col(id_col).isNull().alias("n"), F.col(id_col).alias("i"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("h")).alias(row))
    classes = common.written(near_duplicates(numbered.select(F.col(row).alias("id"), F.col(text_col).alias("text")), "id", "text", radius, shingle), "classes")
    kept = classes.select(F.col("component").alias(row)).distinct()
    # repeated rows are told from counts of their keys; only where there are any do whole rows pass an aggregate, which drops them before it shuffles
    if not classes.groupBy("id").count().where("count > 1").isEmpty():
        numbered = numbered.dropDuplicates([row])
    return numbered.join(kept, row, "left_semi").select(*docs.columns)
