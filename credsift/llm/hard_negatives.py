"""Hard negatives by a pivot table.

Components are scaled and rounded down, so scores are integer inner products. Each row x gets one more component, sqrt(M - |x|^2) with M the
largest |x|^2, and a query q gets a zero there: then |q' - x'|^2 = M + |q|^2 - 2 q.x, and what is near is what scores high. The table
holds the distances of every row to PIVOTS of the rows. By the triangle inequality, |d(q,p) - d(x,p)| <= d(q,x) <= d(q,p) + d(x,p) for every
pivot p, which brackets the score of x; only rows whose bracket meets the range that is asked for are checked exactly.

Rows are dealt to the cell of their nearest pivot, and cells to blocks of bounded size. A task holds one block, and the queries that its
cell's own bracket can't rule out stream past it. Each search asks a query's own cell first; the k-th best there is the least that other
cells have to reach. Positives are searched among rows of the anchor's label, then, for each of them, negatives among the others.

Memory: a block of at most BLOCK_ROWS rows in a task; pivots, and bounds of cells, on the driver and broadcast (PIVOTS of each).
Work: queries times rows where vectors have no structure; brackets and cells save what structure allows.

Defined results: rows with a null id or label, a null or empty vector, null or non-finite components, or another length than most take no
part. Ties go to the smaller id. Rows of the anchor's own id are neither its positives nor its negatives; other repeated rows are candidates
of their own; equal anchor rows are one anchor, anchors of one id that differ otherwise are anchors of their own. Scores are exact whatever
the components; what doesn't fit 64 bits is the nearest that does. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .ann import matrix

PIVOTS = 32
#: Pivots that are tried at a time, and the share of rows at which trying more is given up.
GROUP, ENOUGH = 8, 0.9
#: Rows that pivots are chosen from; rows of a block, at least and at most (between them, blocks follow the size of the table).
SAMPLE_ROWS, LEAST_BLOCK_ROWS, BLOCK_ROWS, BLOCKS = 2048, 512, 1 << 15, 64
SCALE = 256
#: Relative error that brackets allow for.
SLACK = 1e-9
#: Largest |x|^2 for which doubles hold every partial sum exactly.
EXACT = float(1 << 53)
LONGS = (-(1 << 63), (1 << 63) - 1)


def usable(rows: DataFrame, id_col: str, vec_col: str, label_col: str, scale: int) -> DataFrame:
    """(id, label, v) of the rows that take part, but for their length."""
    base = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vec_col).cast("array<double>").alias("x")).where("id is not null and label is not null and x is not null and size(x) > 0")
    fine = F.forall("x", lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) != float("inf")), F.lit(False)))
    return base.where(fine).select("id", "label", F.transform("x", lambda c: F.floor(c * scale).cast("bigint")).alias("v"))


class Pivots:
    """Pivots among a sample's rows, far from each other, and the largest |x|^2 of the table."""

    def __init__(self, sample: np.ndarray, most: float, count: int = PIVOTS):
        self.most, full = most, self.lifted(sample.astype(float), most)
        chosen, far = [0], np.full(len(full), np.inf)
        while len(chosen) < min(count, len(full)):
            far = np.minimum(far, ((full - full[chosen[-1]]) ** 2).sum(1))
            if far.max() <= 0:
                break
            chosen.append(int(far.argmax()))
        self.points = full[chosen]

    @staticmethod
    def lifted(v: np.ndarray, most: float) -> np.ndarray:
        return np.concatenate((v, np.sqrt(np.maximum(0, most - (v**2).sum(1)))[:, None]), 1)

    def distances(self, full: np.ndarray) -> np.ndarray:
        square = (full**2).sum(1)[:, None] + (self.points**2).sum(1) - 2 * full @ self.points.T
        return np.sqrt(np.maximum(0, square))

    def of_queries(self, q: np.ndarray) -> np.ndarray:
        return self.distances(np.concatenate((q.astype(float), np.zeros((len(q), 1))), 1))

    def radius(self, norms: np.ndarray | float, score) -> np.ndarray | float:
        """Distance at which the score is reached, a little more for errors of rounding."""
        return np.sqrt(np.maximum(0, self.most + norms - 2 * score) + SLACK * 1e3 * (self.most + norms))

    def slack(self, norm: float) -> float:
        """What distances to pivots may be off by."""
        return np.sqrt(SLACK * (self.most + norm)) + 1e-9


class Block:
    """Rows of a block, sorted by label, with their distances to the pivots, a row for each pivot."""

    def __init__(self, part: pa.Table, exact: bool):
        labels = np.array(part["label"].to_pylist(), object)
        order = np.argsort(labels, kind="stable")
        self.ids = part["id"].to_numpy()[order]
        v = matrix(part["v"])[order]
        self.v = v.astype(float) if exact else v.astype(object)
        self.exact = exact
        self.d = np.ascontiguousarray(matrix(part["d"])[order].T)
        labels = labels[order]
        begins = np.flatnonzero(np.r_[True, labels[1:] != labels[:-1]]) if len(labels) else np.zeros(0, int)
        self.of_label = {labels[b]: (b, e) for b, e in zip(begins, np.r_[begins[1:], len(labels)], strict=True)}

    def slices(self, label: str, same: bool) -> list[tuple[int, int]]:
        """Where the rows of the label stand, or the others."""
        begin, end = self.of_label.get(label, (0, 0))
        every = [(begin, end)] if same else [(0, begin), (end, len(self.ids))]
        return [(b, e) for b, e in every if e > b]

    def survivors(self, begin: int, end: int, d: np.ndarray, far: float, least: float | None) -> np.ndarray:
        """Places within a slice of the rows whose brackets meet (least, far), by some pivots at a time.

        Once a group of pivots rules out next to nothing the others are left out: what stays is checked exactly anyway.
        """
        some = None
        for p in range(0, len(d), GROUP):
            near, q = self.d[p : p + GROUP, begin:end], d[p : p + GROUP, None]
            near = near if some is None else near[:, some]
            keep = np.abs(near - q).max(0) <= far
            if least is not None:
                keep &= (near + q).min(0) >= least
            left = np.flatnonzero(keep)
            rest, some = len(keep), left if some is None else some[left]
            if len(left) > ENOUGH * rest or not len(some):
                break
        return some

    def scores(self, begin: int, end: int, some: np.ndarray | None, q: np.ndarray) -> np.ndarray:
        """Exact scores of places within a slice; None is all of them."""
        rows = self.v[begin:end]
        if some is not None and 2 * len(some) < end - begin:
            rows, some = rows[some], None
        if self.exact:
            found = (rows @ q.astype(float)).astype(np.int64)
        else:
            found = np.array([max(LONGS[0], min(LONGS[1], s)) for s in (rows @ q.astype(object)).tolist()], np.int64)
        return found if some is None else found[some]


def best_of(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best, ties by id."""
    if len(scores) > k:
        some = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    else:
        some = np.arange(len(scores))
    return some[np.lexsort((ids[some], -scores[some]))[:k]]


def asked_of(block: Block, pivots: Pivots, part: pa.RecordBatch, same: bool, k: int):
    """(n, window, id, score) of the best k rows of the block in each window of each query."""
    q = matrix(part["v"])
    d, norms = pivots.of_queries(q), (q.astype(float) ** 2).sum(1)
    lows, highs = part["lows"].to_pylist(), part["highs"].to_pylist()
    out = []
    for at, (n, own, label) in enumerate(zip(part["n"].to_pylist(), part["id"].to_pylist(), part["label"].to_pylist(), strict=True)):
        low, high, off = min(lows[at]), max(highs[at]), pivots.slack(norms[at])
        far = pivots.radius(norms[at], low) + 2 * off if low > LONGS[0] else np.inf
        least = np.sqrt(max(0.0, pivots.most + norms[at] - 2 * high - SLACK * 1e3 * (pivots.most + norms[at]))) - 2 * off if high < LONGS[1] else None
        parts = []
        for begin, end in block.slices(label, same):
            some = block.survivors(begin, end, d[at], far, least) if far < np.inf or least is not None else None
            if some is None or len(some):
                ids, scores = block.ids[begin:end], block.scores(begin, end, some, q[at])
                ids = ids if some is None else ids[some]
                parts.append((ids[ids != own], scores[ids != own]) if (ids == own).any() else (ids, scores))
        if not parts:
            continue
        ids, scores = (np.concatenate(x) for x in zip(*parts, strict=True))
        for w, (lo, hi) in enumerate(zip(lows[at], highs[at], strict=True)):
            inside = np.flatnonzero((scores >= lo) & (scores <= hi))
            for b in inside[best_of(ids[inside], scores[inside], k)].tolist():
                out.append((n, w, int(ids[b]), int(scores[b])))
    return out


class Cells:
    """Bounds of the distances of each cell's rows to every pivot, and the blocks that it is cut into."""

    def __init__(self, rows, block_rows: int):
        self.parts = {r["cell"]: -(-r["n"] // block_rows) for r in rows}
        self.low = {r["cell"]: np.array(r["low"]) for r in rows}
        self.high = {r["cell"]: np.array(r["high"]) for r in rows}

    def possible(self, cell: int, d: np.ndarray, far: float, off: float) -> bool:
        """Whether any row of the cell can be within `far` of a query at distances d of the pivots."""
        return max((d - self.high[cell]).max(), (self.low[cell] - d).max()) <= far + 2 * off


ASK = "n long, id long, label string, v array<bigint>, own int, lows array<bigint>, highs array<bigint>"


def mine(
    rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", every: int = 100, positives: int = 5, negatives: int = 5, least_percent: int = 80, most_percent: int = 100,
    scale: int = SCALE, pivots: int = PIVOTS, block_rows: int | None = None,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Anchors are rows whose id is divisible by `every`. Negatives of a positive score between least_percent and most_percent of it.
    """
    spark = rows.sparkSession
    common.small_batches(spark)
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    fine = usable(rows, id_col, vec_col, label_col, scale)
    norm = F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double"))
    sizes = fine.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.max(norm).alias("most")).orderBy(F.desc("n"), "d").limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], schema)
    dim, total, most = sizes[0]["d"], sizes[0]["n"], sizes[0]["most"]
    fine, exact = fine.where(F.size("v") == dim), most < EXACT
    sample = np.array([r["v"] for r in common.bounded_sample(fine, SAMPLE_ROWS, "id", total).select("v").collect()], np.int64)
    table = spark.sparkContext.broadcast(Pivots(sample, most, pivots))
    block_rows = block_rows or min(BLOCK_ROWS, max(LEAST_BLOCK_ROWS, -(-total // BLOCKS)))

    def measured(batches):
        for b in batches:
            d = table.value.distances(Pivots.lifted(matrix(b["v"]).astype(float), table.value.most))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(d) + 1) * d.shape[1], pa.int32()), pa.array(d.ravel()))
            yield pa.RecordBatch.from_arrays([b["id"], b["label"], b["v"], lists, pa.array(d.argmin(1).astype(np.int32))], ["id", "label", "v", "d", "cell"])

    stored = common.written(fine.mapInArrow(measured, "id long, label string, v array<bigint>, d array<double>, cell int"), "pivots")
    n_pivots = len(table.value.points)
    bound = lambda f: F.array(*[f(F.get("d", F.lit(p))) for p in range(n_pivots)])
    held = Cells(stored.groupBy("cell").agg(F.count("*").alias("n"), bound(F.min).alias("low"), bound(F.max).alias("high")).collect(), block_rows)  # a row for each pivot at most
    cells = spark.sparkContext.broadcast(held)
    many = F.create_map(*[F.lit(x) for pair in held.parts.items() for x in pair])
    placed = stored.select("cell", F.pmod(F.xxhash64("id"), F.element_at(many, F.col("cell"))).cast("int").alias("part"), F.lit(False).alias("asks"), "id", "label", "v", "d")

    def probing(others: bool):
        """Queries to the blocks that may hold what they ask for, of their own cell or of the others."""

        def probe(batches):
            for b in batches:
                q = matrix(b["v"])
                d, norms = table.value.of_queries(q), (q.astype(float) ** 2).sum(1)
                own, lows, place, cell, part = b["own"].to_pylist(), b["lows"].to_pylist(), [], [], []
                for i in range(len(q)):
                    low = min(lows[i])
                    far, off = table.value.radius(norms[i], low) if low > LONGS[0] else np.inf, table.value.slack(norms[i])
                    for c, parts in cells.value.parts.items():
                        if (c != own[i]) == others and (not others or cells.value.possible(c, d[i], far, off)):
                            place += [i] * parts
                            cell += [c] * parts
                            part += range(parts)
                where = [pa.array(cell, pa.int32()), pa.array(part, pa.int32()), pa.array([True] * len(place), pa.bool_())]
                for s in range(0, len(place), common.BATCH_ROWS):  # a query is sent to many blocks
                    rest = b.take(pa.array(place[s : s + common.BATCH_ROWS], pa.int64()))
                    yield pa.RecordBatch.from_arrays([*[w.slice(s, common.BATCH_ROWS) for w in where], *rest.columns], ["cell", "part", "asks", *rest.schema.names])

        return probe

    def searching(same: bool, k: int):
        out = pa.schema([("n", pa.int64()), ("w", pa.int32()), ("id", pa.int64()), ("score", pa.int64())])

        def search(batches):
            found = common.against_blocks(batches, ("cell", "part"), lambda part: Block(part, exact), lambda key, block, asks: asked_of(block, table.value, asks, same, k))
            for rows in found:
                yield pa.RecordBatch.from_pylist([dict(zip(out.names, r, strict=True)) for r in rows], out)

        return search

    def searched(asks: DataFrame, others: bool, same: bool, k: int) -> DataFrame:
        sent = asks.mapInArrow(probing(others), f"cell int, part int, asks boolean, {ASK}")
        both = placed.unionByName(sent, allowMissingColumns=True).repartition("cell", "part").sortWithinPartitions("cell", "part", "asks")
        return both.mapInArrow(searching(same, k), "n long, w int, id long, score long")

    def nearest(asks: DataFrame, same: bool, k: int, name: str) -> DataFrame:
        """(n, w, best): the k best (score, id) in each window of each query, best first."""
        asks = common.written(asks, f"{name}-asks")
        near = common.written(searched(asks, False, same, k), name)
        top = lambda rows: rows.groupBy("n", "w").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("less"), "id"))), 1, k).alias("best"))
        enough = top(near).where(F.size("best") == k).groupBy("n").agg(F.map_from_entries(F.collect_list(F.struct("w", -F.get("best", F.lit(k - 1))["less"]))).alias("reached"))
        raised = asks.join(enough, "n", "left").withColumn("lows", F.transform("lows", lambda low, w: F.greatest(low, F.coalesce(F.try_element_at("reached", w), low))))
        return top(near.union(searched(raised.select(*asks.columns), True, same, k)))

    # equal rows are one anchor
    anchors = stored.where(F.pmod("id", F.lit(every)) == 0).select("id", "label", "v", F.col("cell").alias("own")).distinct().withColumn("n", F.monotonically_increasing_id())
    anchors = common.written(anchors, "anchors")
    anything = [F.array(F.lit(x).cast("bigint")).alias(c) for c, x in zip(("lows", "highs"), LONGS, strict=True)]
    first = nearest(anchors.select("n", "id", "label", "v", "own", *anything), True, positives, "positives")
    first = common.written(first.select("n", F.transform("best", lambda b: F.struct((-b["less"]).alias("score"), b["id"].alias("id"))).alias("positives")), "positives-found")
    whole = lambda x: x.cast("decimal(38,0)")
    # the least whole number of at least so many percent, and the largest of at most so many
    least = lambda p: F.ceil(whole(p["score"]) * least_percent / 100).cast("bigint")
    most_of = lambda p: F.floor(whole(p["score"]) * most_percent / 100).cast("bigint")
    second = anchors.join(first, "n").select("n", "id", "label", "v", "own", F.transform("positives", least).alias("lows"), F.transform("positives", most_of).alias("highs"))
    found = nearest(second, False, negatives, "negatives")
    pairs = found.join(first, "n").join(anchors.select("n", F.col("id").alias("anchor_id")), "n").withColumn("p", F.get("positives", F.col("w")))
    return pairs.select("anchor_id", "p", F.posexplode("best").alias("at", "b")).select("anchor_id", F.col("p.id").alias("positive_id"), (F.col("at") + 1).cast("int").alias("rank"), F.col("b.id").alias("negative_id"), F.col("p.score").alias("positive_score"), (-F.col("b.less")).alias("negative_score"))


#: The query's rows: relabelled, scaled rows, every anchor against every row.
SQL = """
with fine as (
  select vec_id as id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, embedding from embeddings
  where label is not null and embedding is not null and vec_id is not null),
parts as (select id, label, unnest(embedding)::double as x, generate_subscripts(embedding, 1) as i from fine),
scaled as (select id, any_value(label) as label, list(floor(256 * x)::bigint order by i) as v from parts group by id having bool_and(isfinite(x)) and count(x) = count(*)),
long as (select id, label, unnest(v) as x, generate_subscripts(v, 1) as i from scaled),
pairs as (select a.id as anchor_id, b.id as id, a.label = b.label as same, sum(a.x * b.x)::bigint as score from long a join long b on a.i = b.i and a.id <> b.id where a.id % 100 = 0 group by a.id, b.id, a.label, b.label),
positives as (select anchor_id, id as positive_id, score as positive_score from pairs where same qualify row_number() over (partition by anchor_id order by score desc, id) <= 5)
select p.anchor_id, p.positive_id, row_number() over (partition by p.anchor_id, p.positive_id order by n.score desc, n.id)::int as rank, n.id as negative_id, p.positive_score, n.score as negative_score
from positives p join pairs n on n.anchor_id = p.anchor_id and not n.same and 80 * p.positive_score <= 100 * n.score and 100 * n.score <= 100 * p.positive_score
qualify row_number() over (partition by p.anchor_id, p.positive_id order by n.score desc, n.id) <= 5
"""
