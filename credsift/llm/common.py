"""Helpers that the training-data operators share: the shared folder, Arrow batch limits, bounded samples."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.store import remove, shared_dir

#: Rows and bytes of one Arrow batch. Texts can be long, so a batch of Spark's 10,000 rows could be gigabytes.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20


_written: list[str] = []


def discard(spark: SparkSession) -> int:
    """Removes the intermediate tables of this process, once results that read them are stored; how many there were."""
    paths = [_written.pop() for _ in range(len(_written))]
    for path in paths:
        remove(spark, path)
    return len(paths)


def fresh_path(spark: SparkSession, name: str) -> str:
    """A folder of its own within the shared one, for discard() to remove."""
    _written.append(f"{shared_dir(spark)}/credsift-{name}-{uuid.uuid4().hex}")
    return _written[-1]


def written(df: DataFrame, name: str) -> DataFrame:
    """df after a round trip through Parquet in the shared folder.

    That cuts the lineage in a way that survives lost executors, and gives the planner real sizes to choose joins by.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Bounds what a Python worker holds at once."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def fold(id_col: str):
    """crc32(id as text) mod 3: rows where it is 1 are held out of training."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3


def learn_from(id_col: str):
    """True for rows that training may see; null ids have no fold and are left out."""
    return F.coalesce(fold(id_col) != 1, F.lit(False))


def held_out(id_col: str):
    return F.coalesce(fold(id_col) == 1, F.lit(False))


def bounded_sample(df: DataFrame, rows: int, key: str, total: int | None = None) -> DataFrame:
    """At most `rows` rows, the same ones on every run and layout: those with the smallest hash of `key`.

    With the table's size, rows whose hash can't be among the smallest are filtered first, so that what partitions send on
    doesn't grow with their number.
    """
    rank = F.pmod(F.xxhash64(F.lit("sample"), key), F.lit(1 << 40))
    if total and total > 2 * rows:
        df = df.where(rank < int((1 << 40) * (2 * rows + 50) / total))
    return df.orderBy(rank, key).limit(rows)


def free_name(df: DataFrame, wanted: str) -> str:
    """`wanted`, or with underscores before it until no column of df has that name."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = "_" + wanted
    return wanted


def _runs(batch, columns: tuple[str, ...]):
    """(values, slice) of neighbours in a batch that agree in some columns."""
    values = [batch[c].to_numpy(zero_copy_only=False) for c in columns]
    changes = np.zeros(max(0, len(batch) - 1), bool)
    for v in values:
        changes |= v[1:] != v[:-1]
    begins = [0, *(np.flatnonzero(changes) + 1).tolist()] if len(batch) else []
    for b, e in zip(begins, [*begins[1:], len(batch)], strict=True):
        yield tuple(v[b].item() for v in values), batch.slice(b, e - b)


def against_blocks(batches, keys: tuple[str, ...], make: Callable, answer: Callable, asks: str = "asks"):
    """Answers of blocks to queries that stream past them.

    Batches are sorted by keys and `asks`: the rows of a block come first, then all queries to it, however many. Only a block
    is held, as make(rows); answer(key, block, queries) gives what is said to a batch of queries. Keys without rows answer nothing.
    """
    held, parts, block = None, [], None
    for batch in batches:
        for (*key, asking), part in _runs(batch, (*keys, asks)):
            if key != held:
                held, parts, block = key, [], None
            if not asking:
                parts.append(part)
            elif parts or block is not None:
                if block is None:
                    block, parts = make(pa.Table.from_batches(parts)), []
                yield answer(tuple(key), block, part)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
