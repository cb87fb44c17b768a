"""Hard negatives against all scores, computed with whole numbers; brackets against distances."""

import math
import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from credsift.llm import common, queries
from credsift.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<double>, label int"


def plain(rows, every=100, positives=5, negatives=5, scale=256):
    fine = [(i, lab, x) for i, x, lab in rows if i is not None and lab is not None and x and all(c is not None and math.isfinite(c) for c in x)]
    if not fine:
        return []
    sizes = {}
    for _, _, x in fine:
        sizes[len(x)] = sizes.get(len(x), 0) + 1
    dim = min(sizes, key=lambda d: (-sizes[d], d))
    fine = [(i, lab, tuple(math.floor(scale * c) for c in x)) for i, lab, x in fine if len(x) == dim]
    out = []
    for i, lab, x in set(f for f in fine if f[0] % every == 0):
        scored = sorted((-sum(a * b for a, b in zip(x, y, strict=True)), j, m) for j, m, y in fine if j != i)
        for s, j, _ in [r for r in scored if r[2] == lab][:positives]:
            good = [(-t, k) for t, k, m in scored if m != lab and 80 * -s <= 100 * -t <= 100 * -s]
            out += [(i, j, r, k, -s, t) for r, (t, k) in enumerate(good[:negatives], 1)]
    return sorted(out)


def mined(spark, rows, **options):
    return sorted(tuple(r) for r in hn.mine(spark.createDataFrame(rows, SCHEMA), **options).collect())


def clustered(n, dim, seed, labels=3):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(6, dim))
    return [(k, (middle[k % 6] + 0.2 * rng.normal(size=dim)).tolist(), int(rng.integers(labels))) for k in range(n)]


@pytest.mark.parametrize("block_rows", [7, 512])
def test_clustered_vectors_with_copies_ties_and_rows_without_part(spark, block_rows):
    rows = clustered(300, 5, 1)
    rows += [(1000 + k, [0.5, 0.25, 0.0, -0.5, 1.0], k % 3) for k in range(150)]  # a third: one vector
    rows += [(0, rows[0][1], rows[0][2]), (0, rows[0][1], rows[0][2]), (100, [1.0] * 5, 1), (100, [1.0] * 5, 2), (7, rows[7][1], rows[7][2])]
    rows += [(None, [1.0] * 5, 1), (2000, None, 1), (2100, [], 1), (2200, [1.0] * 5, None), (2300, [1.0, None, 1.0, 1.0, 1.0], 1), (2400, [1.0, math.nan, 1.0, 1.0, 1.0], 1), (2500, [math.inf] * 5, 1), (2600, [1.0] * 4, 1), (2700, [0.0] * 5, 1)]
    assert mined(spark, rows, every=50, pivots=4, block_rows=block_rows) == plain(rows, every=50)


def test_numbers_beyond_doubles(spark):
    rng = random.Random(2)
    rows = [(k * 50, [rng.randrange(1, 1 << 22) + rng.randrange(256) / 256 for _ in range(3)], k % 2) for k in range(30)]
    rows += [(9000 + k, [rows[0][1][0] + k / 256, *rows[0][1][1:]], k % 2) for k in range(8)]
    assert mined(spark, rows, pivots=4) == plain(rows)


def test_few_rows_one_label_and_nothing(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(0, [1.0, 2.0], 1)]) == []
    assert mined(spark, [(0, [1.0, 2.0], 1), (1, [1.0, 2.0], 1)]) == []
    rows = [(0, [1.0, 2.0], 1), (1, [1.0, 2.0], 1), (2, [0.9, 1.9], 2), (3, [0.0, 0.0], 1), (4, [0.0, 0.0], 2), (5, [-1.0, 0.0], 1), (6, [-1.0, 0.0], 2)]
    assert mined(spark, rows) == plain(rows) and len(plain(rows)) == 2


def test_other_columns_are_ignored(spark):
    rows = [(0, [1.0, 2.0], 1, "x", 3), (1, [1.0, 2.0], 1, "y", 4), (2, [0.9, 1.9], 2, None, None)]
    found = hn.mine(spark.createDataFrame(rows, SCHEMA + ", id string, cell int")).collect()
    assert [tuple(r) for r in found] == plain([r[:3] for r in rows])


def test_brackets_hold_the_scores():
    rng = np.random.default_rng(3)
    v = np.floor(256 * rng.normal(size=(400, 8)))
    most = float((v**2).sum(1).max())
    pivots = hn.Pivots(v[:50], most, 6)
    d, q = pivots.distances(pivots.lifted(v, most)), v[:20]
    dq, norms = pivots.of_queries(q), (q**2).sum(1)
    for i in range(len(q)):
        at = pivots.radius(norms[i], v @ q[i])
        assert (np.abs(d - dq[i]).max(1) <= at + 2 * pivots.slack(norms[i])).all()
        assert ((d + dq[i]).min(1) >= np.sqrt(np.maximum(0, most + norms[i] - 2 * v @ q[i])) - 2 * pivots.slack(norms[i])).all()


def test_brackets_rule_out_most_rows_of_clusters():
    rng = np.random.default_rng(4)
    middle = 2000 * rng.normal(size=(12, 16))
    v = np.floor(np.repeat(middle, 100, 0) + 30 * rng.normal(size=(1200, 16))).astype(np.int64)
    most = float((v.astype(float) ** 2).sum(1).max())
    pivots = hn.Pivots(v[::10], most, 12)
    d = pivots.distances(pivots.lifted(v.astype(float), most))
    rows = pa.table({"id": np.arange(1200), "label": ["a"] * 1200, "v": v.tolist(), "d": d.tolist()})
    asked, checked = pa.RecordBatch.from_pylist([{"n": 0, "id": 5, "label": "b", "v": v[5].tolist(), "lows": [int(np.sort(v @ v[5])[-6])], "highs": [hn.LONGS[1]]}]), []
    block = hn.Block(rows, True)
    whole = block.scores
    block.scores = lambda begin, end, some, q: checked.append(len(some)) or whole(begin, end, some, q)
    best = hn.asked_of(block, pivots, asked, False, 5)
    assert sum(checked) < 300
    order = sorted((-int(s), k) for k, s in enumerate(v @ v[5]) if k != 5)[:5]
    assert [(-s, i) for _, _, i, s in best] == order


def test_blocks_hold_only_their_rows_and_queries_stream():
    rows = [{"cell": c, "part": 0, "asks": a, "x": x} for c, a, x in [(1, False, 1), (1, False, 2), (1, True, 10), (1, True, 11), (2, True, 12), (3, False, 3), (4, False, 4), (4, True, 13)]]
    for size in range(1, 9):
        batches = [pa.RecordBatch.from_pylist(rows[k : k + size]) for k in range(0, 8, size)]
        said = [(key, block, q) for answers in common.against_blocks(batches, ("cell", "part"), lambda t: tuple(t["x"].to_pylist()), lambda key, block, asks: [(key, block, q) for q in asks["x"].to_pylist()]) for key, block, q in answers]
        assert said == [((1, 0), (1, 2), 10), ((1, 0), (1, 2), 11), ((4, 0), (4,), 13)]


def test_the_query_agrees_with_its_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{sf}/embeddings.parquet'")
    assert sorted(tuple(r) for r in queries.op13_hard_negatives(spark, sf).collect()) == sorted(con.execute(hn.SQL).fetchall())
