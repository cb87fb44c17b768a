"""A scan: source, detection, verification, and the counts around them, all from one reading of each file."""

from __future__ import annotations

import time
from collections.abc import Iterable
from dataclasses import dataclass
from functools import cached_property
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import EntropyOptions
from ..operators import matching, structure, verify
from ..operators.registry import BUILTIN, Pattern
from ..sources import files
from .store import remove, stored


@dataclass
class ScanResult:
    """What a scan says: findings, skipped files, counts. files_scanned + the rows of skipped are all files that were listed.

    Whichever is asked for first runs the scan, once: its outcomes, a masked row for each file, go to a table from which everything else is
    read, so all parts agree even if files change meanwhile. Skipped are files that could not be read, and those on which matching or
    the parser raised; the latter have no findings.
    """

    outcomes: DataFrame
    patterns: tuple[Pattern, ...]
    root_dir: str
    version: str
    began: float

    @cached_property
    def _stored(self) -> tuple[DataFrame, str]:
        return stored(self.outcomes, "outcomes")

    @property
    def findings(self) -> DataFrame:
        return verify.findings_of(self._stored[0], self.patterns)

    @property
    def skipped(self) -> DataFrame:
        return self._stored[0].where("reason is not null").select(F.col("file").alias("path"), "reason")

    def counted(self) -> dict[str, int]:
        """Files scanned and skipped, clean ones included, and the milliseconds so far."""
        n = self._stored[0].agg(F.count("*").alias("listed"), F.count("reason").alias("skipped")).first()
        return {"files_scanned": n["listed"] - n["skipped"], "files_skipped": n["skipped"], "duration_ms": round(1000 * (time.perf_counter() - self.began))}

    def discard(self) -> None:
        """Removes the table of outcomes; a later question would scan again."""
        if "_stored" in self.__dict__:
            remove(self.outcomes.sparkSession, self.__dict__.pop("_stored")[1])


def scan(
    spark: SparkSession, root: str | Path = ".", patterns: list[Pattern] | tuple[Pattern, ...] = BUILTIN, source: DataFrame | None = None, ignore: Iterable[str] = (), include: Iterable[str] | None = None,
    rules: tuple[verify.Rule, ...] = verify.RULES, parser: verify.Parser = structure.facts, options: EntropyOptions = EntropyOptions(), version: str = "0.0.0", seconds: float = matching.SEARCH_SECONDS,
) -> ScanResult:
    """Scans a source of (path, content, read_error), by default the files below root. `seconds` bounds one search in one line."""
    began = time.perf_counter()
    rows = files.disk(spark, root, ignore, include) if source is None else source
    return ScanResult(verify.outcomes(rows, patterns, rules, parser, options, seconds), tuple(patterns), str(Path(root).resolve()), version, began)
