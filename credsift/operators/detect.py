"""Detection: files to candidate secrets, in one pass and without a shuffle.

Contents go to Python by Arrow, once each, where plain searches for the strings that matches need rule out most of them in no time, and
candidates, masked lines and, for languages with a parser, structural facts are found together (matching.py). Plain searches in the JVM
before that were tried; they took three times as long as sending everything.
`raw_value` exists only between here and verification; no sink takes it.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as fn
from . import matching, structure
from .registry import BUILTIN, Pattern

CANDIDATE = "struct<ordinal:int,line:int,column:int,at:int,raw_value:string,nth_line:int>"
FACT = "struct<has_tree:boolean,declared:string,in_access:boolean,interpolated:boolean>"
SCANNED = f"struct<candidates:array<{CANDIDATE}>,shown:array<string>,facts:array<{FACT}>,failure:string>"
_numbers = [pa.field(c, pa.int32()) for c in ("ordinal", "line", "column", "at")]
_fact = [pa.field(c, pa.string() if c == "declared" else pa.bool_()) for c in matching.FACTS]
SCANNED_ARROW = pa.struct(
    [
        ("candidates", pa.list_(pa.struct([*_numbers, pa.field("raw_value", pa.string()), pa.field("nth_line", pa.int32())]))),
        ("shown", pa.list_(pa.string())),
        ("facts", pa.list_(pa.struct(_fact))),
        ("failure", pa.string()),
    ]
)


def lines(files: DataFrame) -> DataFrame:
    """(path, line, text): one row for each line, counted from 1. Only line feeds end lines, and an empty file has one."""
    return files.select("path", F.posexplode(F.split(F.coalesce("content", F.lit("")), "\n", -1)).alias("n", "text")).select("path", (F.col("n") + 1).alias("line"), "text")


def scanner(patterns: tuple[Pattern, ...], options: fn.EntropyOptions, parser: matching.Parser | None, seconds: float = matching.SEARCH_SECONDS):
    """(content, path) to what matching.scanned says of it; null for null content and files without candidates."""

    def scan(contents: pa.Array, suffixes: pa.Array) -> pa.Array:
        found = matching.matcher(patterns, options, seconds)
        rows = [None if c is None else matching.scanned(c, found, parser, s) for c, s in zip((x.as_py() for x in contents.cast(pa.binary())), suffixes.to_pylist(), strict=True)]
        return pa.array(rows, SCANNED_ARROW)

    # declared so that tests of what it gives stay above it, where each file has been scanned once
    udf = F.arrow_udf(scan, SCANNED).asNondeterministic()
    suffix = fn.extension(F.col("path"))
    return lambda content: udf(content, F.when(suffix.isin(*structure.EXTENSIONS), suffix))


def with_outcomes(files: DataFrame, patterns: list[Pattern] | tuple[Pattern, ...] = BUILTIN, options: fn.EntropyOptions = fn.EntropyOptions(), parser: matching.Parser | None = None, seconds: float = matching.SEARCH_SECONDS) -> DataFrame:
    """All files with `scanned`: null where there is nothing to say, else candidates, masked lines, facts, or a failure."""
    return files.withColumn("scanned", scanner(tuple(patterns), options, parser, seconds)(F.col("content")))


def with_candidates(files: DataFrame, patterns: list[Pattern] | tuple[Pattern, ...] = BUILTIN, options: fn.EntropyOptions = fn.EntropyOptions(), parser: matching.Parser | None = None, seconds: float = matching.SEARCH_SECONDS) -> DataFrame:
    """Files that have candidates, or fail, with the array columns `candidates`, in the order patterns, then lines, then places, `shown`,
    `facts` (one for each candidate, or null) and `failure`, null for most.

    `shown` has each line with candidates once, masked; a candidate's `nth_line` is the place of its line there.
    """
    return with_outcomes(files, patterns, options, parser, seconds).where("scanned is not null").select("*", "scanned.*").drop("scanned")


def exploded(bearing: DataFrame, patterns: list[Pattern] | tuple[Pattern, ...] = BUILTIN, keep: tuple[str, ...] = (), outer: bool = False) -> DataFrame:
    """One row for each candidate, with the finding's columns, its place `nth` in the file, and raw_value; keep: columns of the file.

    With `outer`, files without candidates have a row of nulls.
    """
    each = (F.posexplode_outer if outer else F.posexplode)("candidates").alias("nth", "c")
    rows = bearing.select(F.col("path").alias("file"), *keep, "shown", each)
    column = lambda f: F.get(F.array(*[F.lit(getattr(p, f)) for p in patterns]), F.col("c.ordinal"))
    return rows.select(
        "file", *keep, column("id").alias("patternId"), column("name").alias("patternName"), column("provider").alias("provider"), column("severity").alias("severity"), column("confidence").alias("confidence"),
        F.col("c.line").alias("line"), F.col("c.column").alias("column"), fn.masked(F.col("c.raw_value")).alias("masked"), fn.fingerprint(F.col("c.raw_value")).alias("fingerprint"),
        F.array(F.get("shown", F.col("c.nth_line"))).alias("context"), F.col("c.ordinal").alias("ordinal"), F.col("c.at").alias("at"), F.col("c.raw_value").alias("raw_value"), "nth",
    )


def candidates(files: DataFrame, patterns: list[Pattern] | tuple[Pattern, ...] = BUILTIN, options: fn.EntropyOptions = fn.EntropyOptions()) -> DataFrame:
    """Rows of (path, content) to rows of candidates."""
    return exploded(with_candidates(files, patterns, options), patterns).drop("nth")
