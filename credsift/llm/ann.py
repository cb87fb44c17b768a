"""Approximate nearest neighbours by score-aware anisotropic quantisation.

Vectors are dealt to the list of their nearest centroid, and their residuals are cut into pairs of components that take four
bits each. Codes are chosen and codebooks fitted to a loss that weighs the part of the error along the vector (which
moves large inner products) `eta` times the part across it. A query probes the lists of the largest inner products with
its centroids, as many as a measurement on the sample asks for, scans them by tables of partial inner products (two four-bit codes a look-up), and the best candidates of every
list, with all that the error of the tables leaves undecided, are reranked exactly, in double precision on the original vectors.

Centroids and codebooks are fitted on a bounded sample (MOST_TRAIN_ROWS at most); every vector is indexed. Lists are cut into blocks of at most about
BLOCK_ROWS rows, so a list that holds a third of all vectors is many tasks. A task holds one block, and the queries that probe it stream past
in Arrow batches, however many they are.

Defined results: vectors that are null, zero, or hold null or non-finite components take no part, neither as queries nor as
candidates, nor do null ids and vectors of another length than most; ties go to the smaller id; rows with repeated
ids are candidates of their own, equal rows are one query and rows of one id with different vectors are queries of their own,
each with its ranks; a query never finds a row with its own id; fewer candidates than k give all of them;
an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Rows a list should have; rows of a block.
LIST_ROWS, BLOCK_ROWS = 1600, 20_000
#: Rows of the fitting sample: at least, for each list, and at most; the last bounds the number of lists, too.
TRAIN_ROWS, TRAIN_ROWS_A_LIST, MOST_TRAIN_ROWS = 10_000, 16, 1 << 16
#: Share of neighbours that the probed lists must hold, and the sample's queries that it is measured by. Vectors with little
#: structure need most lists for it, clustered ones few.
RECALL, MEASURED, LEAST_PROBED = 0.96, 400, 4
ETA = 4.0
#: Candidates a block that are reranked at first, in multiples of k.
RERANK = 4
#: Relative error of sums in single precision, which table scores are.
SLACK = 1e-5


def usable(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v) with v an array of doubles, of the rows that take part."""
    base = rows.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v")).where("id is not null and v is not null and size(v) > 0")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0)
    return base.where(fine)


class Index:
    """Centroids (lists, d) and codebooks (pairs, 16, 2)."""

    def __init__(self, sample: np.ndarray, lists: int, eta: float = ETA, seed: int = 0, rounds: int = 8):
        rng = np.random.default_rng(seed)
        self.dim, self.eta = sample.shape[1], eta
        self.pairs = (self.dim + 1) // 2
        self.centroids = sample[rng.choice(len(sample), min(lists, len(sample)), replace=False)].astype(np.float32).copy()
        data = sample.astype(np.float32)
        for _ in range(rounds):
            own = self.nearest(data)
            sums = np.zeros_like(self.centroids)
            np.add.at(sums, own, data)
            n = np.bincount(own, minlength=len(self.centroids))
            self.centroids[n > 0] = sums[n > 0] / n[n > 0][:, None]
        own = self.nearest(data)
        residual = self.padded(data - self.centroids[own])
        direction = self.padded(data / np.linalg.norm(data, axis=1, keepdims=True))
        parts = residual.reshape(len(data), self.pairs, 2)
        self.books = np.stack([parts[rng.choice(len(data), 16), p] for p in range(self.pairs)]).astype(np.float32)
        codes = self.codes_of(residual, direction, sweeps=1)
        for _ in range(4):
            self.refit(residual, direction, codes)
            codes = self.codes_of(residual, direction, sweeps=1, codes=codes)

    def padded(self, x: np.ndarray) -> np.ndarray:
        return np.pad(x, ((0, 0), (0, 2 * self.pairs - self.dim)))

    def nearest(self, data: np.ndarray) -> np.ndarray:
        half = 0.5 * (self.centroids**2).sum(1)
        return np.concatenate([(data[k : k + 4096] @ self.centroids.T - half).argmax(1) for k in range(0, len(data), 4096)] or [np.zeros(0, np.int64)])

    def codes_of(self, residual: np.ndarray, direction: np.ndarray, sweeps: int = 2, codes: np.ndarray | None = None) -> np.ndarray:
        """(rows, pairs): codes that lower |error|^2 + (eta - 1) (error . direction)^2, pair by pair."""
        r, u = (x.reshape(len(x), self.pairs, 2) for x in (residual, direction))
        if codes is None:
            codes = np.stack([((r[:, p, None, :] - self.books[p]) ** 2).sum(2).argmin(1) for p in range(self.pairs)], 1)
        along = np.stack([((r[:, p] - self.books[p][codes[:, p]]) * u[:, p]).sum(1) for p in range(self.pairs)], 1)
        total = along.sum(1)
        for _ in range(sweeps):
            for p in range(self.pairs):
                error = r[:, p, None, :] - self.books[p]
                part = (error * u[:, p, None, :]).sum(2)
                rest = total - along[:, p]
                codes[:, p] = ((error**2).sum(2) + (self.eta - 1) * (part + rest[:, None]) ** 2).argmin(1)
                along[:, p] = part[np.arange(len(r)), codes[:, p]]
                total = rest + along[:, p]
        return codes

    def refit(self, residual: np.ndarray, direction: np.ndarray, codes: np.ndarray) -> None:
        """Codewords that solve the weighted least squares of the rows that use them, the other pairs' errors fixed."""
        r, u = (x.reshape(len(x), self.pairs, 2) for x in (residual, direction))
        along = np.stack([((r[:, p] - self.books[p][codes[:, p]]) * u[:, p]).sum(1) for p in range(self.pairs)], 1)
        total = along.sum(1)
        for p in range(self.pairs):
            rest = total - along[:, p]
            w = self.eta - 1
            for c in range(16):
                use = codes[:, p] == c
                if not use.any():
                    continue
                x, d = r[use, p], u[use, p]
                left = use.sum() * np.eye(2) + w * d.T @ d
                right = x.sum(0) + w * (d * ((x * d).sum(1) + rest[use])[:, None]).sum(0)
                self.books[p, c] = np.linalg.solve(left, right)

    def encode(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """List of each vector, and its codes, two four-bit codes to a byte."""
        own = self.nearest(data)
        direction = data / np.linalg.norm(data, axis=1, keepdims=True)
        codes = self.codes_of(self.padded(data - self.centroids[own]), self.padded(direction)).astype(np.uint8)
        if self.pairs % 2:
            codes = np.pad(codes, ((0, 0), (0, 1)))
        return own, codes[:, ::2] | codes[:, 1::2] << 4

    def errors(self, residual: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Length of what the codes of each vector miss."""
        each = np.stack((codes & 15, codes >> 4), 2).reshape(len(codes), -1)[:, : self.pairs]
        back = self.books[np.arange(self.pairs), each].reshape(len(codes), -1)[:, : self.dim]
        return np.linalg.norm(residual - back, axis=1)

    def probes(self, queries: np.ndarray, count: int) -> np.ndarray:
        scores = queries @ self.centroids.T
        count = min(count, scores.shape[1])
        return np.argsort(-scores, axis=1)[:, :count]

    def probes_needed(self, sample: np.ndarray, k: int, recall: float = RECALL) -> int:
        """How many lists hold `recall` of the k nearest, of the sample, of some of its own vectors."""
        queries = sample[:MEASURED]
        scores = queries @ sample.T
        scores[np.arange(len(queries)), np.arange(len(queries))] = -np.inf
        k = min(k, len(sample) - 1)
        if k < 1:
            return len(self.centroids)
        near = np.argpartition(-scores, k - 1, axis=1)[:, :k]
        place = np.argsort(self.probes(queries, len(self.centroids)), axis=1)
        places = np.take_along_axis(place, self.nearest(sample.astype(np.float32))[near], 1)
        return int(np.quantile(places, recall, method="higher")) + 1

    def tables(self, query: np.ndarray) -> np.ndarray:
        """(bytes, 256): inner products of the query with what each byte of codes stands for."""
        q = np.pad(query, (0, 2 * self.pairs - self.dim)).reshape(self.pairs, 2)
        one = np.einsum("pcd,pd->pc", self.books, q)
        if self.pairs % 2:
            one = np.vstack((one, np.zeros((1, 16), one.dtype)))
        return (one[1::2, :, None] + one[::2, None, :]).reshape(len(one) // 2, 256)


def matrix(column) -> np.ndarray:
    """A column of lists of one length as rows."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def scan_block(index: Index, ids: np.ndarray, vectors: np.ndarray, codes: np.ndarray, centroid: np.ndarray, errors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, bounds: np.ndarray, k: int, rerank: int):
    """(place of the query, id, score) of the best of one block, of those that reach the query's bound: tables first, then the exact measure.

    Reranked are the k * rerank best by the tables, and then all that can reach the k-th best of these: whose table score is no
    further below than the error of their codes allows. So copies and equal scores are told apart by the exact measure.
    """
    out, take = [], min(len(ids), k * rerank + 1)
    place = 0
    columns = np.ascontiguousarray(codes.T).astype(np.intp)
    for qid, q, least in zip(query_ids, queries, bounds, strict=True):
        if take < len(ids):
            table = index.tables(q.astype(np.float32))
            rough = table[0].take(columns[0])
            for b in range(1, len(columns)):
                rough += table[b].take(columns[b])
            some = np.argpartition(-rough, take - 1)[:take]
            exact = (vectors[some] * q).sum(1)
            own = exact[ids[some] != qid]
            cut = max(least, np.partition(own, len(own) - k)[len(own) - k] if len(own) >= k else -np.inf)
            reach = rough + q @ centroid + np.linalg.norm(q) * errors
            near = reach >= cut - SLACK * (abs(cut) + np.abs(reach).max())
            near[some] = False
            more = np.flatnonzero(near)
            some, exact = np.concatenate((some, more)), np.concatenate((exact, (vectors[more] * q).sum(1)))
        else:
            some = np.arange(len(ids))
            exact = (vectors * q).sum(1)
        fine = (ids[some] != qid) & (exact >= least)
        some, exact = some[fine], exact[fine]
        best = np.lexsort((ids[some], -exact))[:k]
        out.append((np.full(len(best), place), ids[some][best], exact[best]))
        place += 1
    return [np.concatenate(x) for x in zip(*out, strict=True)]


def search(
    rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", every: int = 20, k: int = 20, probed: float | None = None, rerank: int = RERANK, train_rows: int = TRAIN_ROWS, block_rows: int = BLOCK_ROWS, list_rows: int = LIST_ROWS
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found for every row whose id is divisible by `every`.

    Queries probe so many lists as hold RECALL of the nearest in the sample, or the share `probed` of them.
    """
    spark = rows.sparkSession
    common.small_batches(spark)
    schema = "query_id long, rank int, vec_id long, score double"
    fine = usable(rows, id_col, vec_col)
    sizes = fine.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], schema)
    dim, total = sizes[0]["d"], sizes[0]["count"]
    fine = fine.where(F.size("v") == dim)
    lists = max(1, total // list_rows)
    wanted = min(max(train_rows, TRAIN_ROWS_A_LIST * lists), MOST_TRAIN_ROWS)
    sample = np.array([r.v for r in common.bounded_sample(fine, wanted, "id", total).select("v").collect()])
    built = Index(sample, int(min(lists, max(1, len(sample) // TRAIN_ROWS_A_LIST))))
    lists = len(built.centroids)
    # the sample's neighbours of the same rank are further off than the table's, which only asks for more lists
    probes = built.probes_needed(sample, max(1, round(k * len(sample) / total))) if probed is None else round(probed * lists)
    probes = min(lists, max(LEAST_PROBED, probes))
    index = spark.sparkContext.broadcast(built)

    def indexed(batches):
        for b in batches:
            if len(b):
                own, codes = index.value.encode(np.stack(b["v"].to_numpy()).astype(np.float32))
                yield pd.DataFrame({"list": own.astype(np.int32), "id": b["id"], "v": b["v"], "codes": [c.tobytes() for c in codes]})

    stored = common.written(fine.mapInPandas(indexed, "list int, id long, v array<double>, codes binary"), "index")
    counts = stored.groupBy("list").count().collect()  # a row for each list
    blocks = {r["list"]: -(-r["count"] // block_rows) for r in counts}
    many = F.create_map(*[F.lit(x) for key, n in blocks.items() for x in (key, n)]) if blocks else F.create_map()
    placed = stored.select("list", F.pmod(F.xxhash64("id"), F.element_at(many, F.col("list"))).cast("int").alias("block"), F.lit(False).alias("asks"), "id", "v", "codes")

    def probing(ranks: slice):
        """The queries, to the blocks of the lists that they probe at these ranks, nearest first."""

        def probe(batches):
            for b in batches:
                at = index.value.probes(matrix(b["v"]), probes)[:, ranks]
                pairs = [(i, own, blk) for i, row in enumerate(at) for own in row.tolist() for blk in range(blocks.get(own, 0))]
                for s in range(0, len(pairs), common.BATCH_ROWS):
                    i, own, blk = zip(*pairs[s : s + common.BATCH_ROWS], strict=True)
                    part = b.take(pa.array(i, pa.int64()))
                    yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(blk, pa.int32()), pa.array([True] * len(i)), *part.columns], ["list", "block", "asks", *part.schema.names])

        return probe

    def block_of(part: pa.Table) -> tuple:
        ids, vectors, own = part["id"].to_numpy(), matrix(part["v"]), int(part["list"][0].as_py())
        codes = np.frombuffer(b"".join(part["codes"].to_pylist()), np.uint8).reshape(len(ids), -1)
        centroid = index.value.centroids[own].astype(float)
        return ids, vectors, codes, centroid, index.value.errors(vectors - centroid, codes)

    def answers(key, block, asks: pa.RecordBatch):
        q, n = asks["id"].to_numpy(), asks["n"].to_numpy()
        at, found, score = scan_block(index.value, *block, q, matrix(asks["v"]), asks["least"].to_numpy(), k, rerank)
        return pa.RecordBatch.from_arrays([pa.array(n[at]), pa.array(q[at]), pa.array(found), pa.array(score)], ["n", "query_id", "vec_id", "score"])

    def scanned(batches):
        yield from common.against_blocks(batches, ("list", "block"), block_of, answers)

    def searched(queries: DataFrame, ranks: slice) -> DataFrame:
        """What the probed blocks have: a task holds one block, the queries to it stream past, however many they are."""
        asked = queries.select("n", "id", "v", "least").mapInArrow(probing(ranks), "list int, block int, asks boolean, n long, id long, v array<double>, least double")
        both = placed.unionByName(asked, allowMissingColumns=True).repartition("list", "block").sortWithinPartitions("list", "block", "asks")
        return both.mapInArrow(scanned, "n long, query_id long, vec_id long, score double")

    # the nearest list first: its k-th score is a bound that what other lists send on must reach, which loses nothing
    # rows of one id with different vectors are queries of their own, equal rows one query
    asking = stored.where(F.pmod("id", F.lit(every)) == 0).select("id", "v").distinct().withColumn("n", F.monotonically_increasing_id())
    asking = common.written(asking, "queries")
    near = common.written(searched(asking.withColumn("least", F.lit(float("-inf"))), slice(0, 1)), "near")
    kth = F.get(F.sort_array(F.collect_list("score"), asc=False), F.lit(k - 1))
    bound = near.groupBy("n").agg(F.coalesce(kth, F.lit(float("-inf"))).alias("least"))
    bounded = asking.join(bound, "n", "left").withColumn("least", F.coalesce("least", F.lit(float("-inf"))))
    found = near.union(searched(bounded.select("n", "id", "v", "least"), slice(1, None))) if probes > 1 else near
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))), 1, k)
    top = found.groupBy("n", "query_id").agg(best.alias("b")).select("query_id", F.posexplode("b").alias("p", "c"))
    return top.select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("c.vec_id").alias("vec_id"), (-F.col("c.s")).alias("score"))
