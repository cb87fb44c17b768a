"""Evaluation against a labelled corpus: recall, precision, and which rule rejected what."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import verify
from ..operators.registry import BUILTIN, Pattern
from ..sources import files

MANIFEST = "fixture string, kind string, expected string"


def read_manifest(spark: SparkSession, folder: str | Path) -> DataFrame:
    """(fixture, kind, expected) of a folder's manifest.json; a missing or broken one is an error."""
    try:
        fixtures = json.loads(Path(folder, "manifest.json").read_text(encoding="utf-8"))["fixtures"]
        rows = [(name, "secret", spec["expectsPatternId"]) if "expectsPatternId" in spec else (name, "clean", spec["rejectedBy"]) for name, spec in fixtures.items()]
    except (OSError, ValueError, KeyError, TypeError, AttributeError) as e:
        raise ValueError(f"Failed to read manifest in {folder}: {e}") from e
    return spark.createDataFrame(rows, MANIFEST)


def manifest_rows(texts: DataFrame, text: str) -> DataFrame:
    """(fixture, kind, expected) of many manifests, each a text of JSON: what expects a pattern is a secret, what names a rule is clean."""
    spec = "struct<fixtures:map<string,struct<expectsPatternId:string,rejectedBy:string>>>"
    rows = texts.select(F.explode(F.from_json(text, spec)["fixtures"]).alias("fixture", "s"))
    secret = F.col("s.expectsPatternId").isNotNull()
    return rows.select("fixture", F.when(secret, "secret").otherwise("clean").alias("kind"), F.when(secret, F.col("s.expectsPatternId")).otherwise(F.col("s.rejectedBy")).alias("expected"))


def outcomes(judged: DataFrame) -> DataFrame:
    """(file, failure, candidates, findings, pattern of the first finding, rule that rejected).

    A file's rejection is that of its first candidate, and only if no candidate before came through.
    """
    dropped = F.get(F.filter("verdicts", lambda v: v["action"] == "drop"), F.lit(0))["rule"]
    rows = judged.select("file", "failure", F.struct("ordinal", "line", "at").alias("place"), "patternId", dropped.alias("rule"))
    return rows.groupBy("file").agg(F.max("failure").alias("failure"), F.count("patternId").alias("candidates"), F.count_if(F.col("rule").isNull() & F.col("patternId").isNotNull()).alias("findings"), F.min_by("patternId", F.when(F.col("rule").isNull(), F.col("place"))).alias("first_pattern"), F.min_by("rule", "place").alias("rejected_by"))


def evaluated(manifest: DataFrame, judged: DataFrame, sources: DataFrame) -> DataFrame:
    """(fixture, kind, expected, passed, detail, rejected_by, candidates) of every fixture, unreadable ones too."""
    found = outcomes(judged)
    rows = manifest.join(sources.select(F.col("path").alias("fixture"), "read_error", F.lit(True).alias("listed")), "fixture", "left").join(found.withColumnRenamed("file", "fixture"), "fixture", "left").fillna(0, ["candidates", "findings"])
    unreadable = F.col("listed").isNull() | F.col("read_error").isNotNull() | F.col("failure").isNotNull()
    say = lambda *parts: F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])
    n = F.col("findings").cast("string")
    secret = F.when(F.col("findings") != 1, say("one finding was due, found: ", n)).when(F.col("first_pattern") != F.col("expected"), say('due pattern "', F.col("expected"), '", found "', F.col("first_pattern"), '"'))
    clean = (
        F.when(F.col("findings") > 0, say("no finding was due, found: ", n, " (first: ", F.col("first_pattern"), ")"))
        .when(F.col("candidates") == 0, F.lit("nothing for a rule to reject"))
        .when(F.col("rejected_by") != F.col("expected"), say('due rule "', F.col("expected"), '", found "', F.col("rejected_by"), '"'))
    )
    wrong = F.when(unreadable, say("unreadable: ", F.coalesce("read_error", "failure", F.lit("not found")))).otherwise(F.when(F.col("kind") == "secret", secret).otherwise(clean))
    right = F.when(F.col("kind") == "secret", say("matched ", F.col("first_pattern"))).otherwise(say("rejected by ", F.col("rejected_by")))
    counted = (F.col("kind") == "clean") & (F.col("findings") == 0)
    return rows.select("fixture", "kind", "expected", wrong.isNull().alias("passed"), F.coalesce(wrong, right).alias("detail"), F.when(counted, F.col("rejected_by")).alias("rejected_by"), "candidates")


def rates(results: DataFrame) -> DataFrame:
    """One row: recall and precision in percent, by fixtures; 0 where there are none."""
    share = lambda kind: F.coalesce(F.avg(F.when(F.col("kind") == kind, F.col("passed").cast("double"))) * 100, F.lit(0.0))
    return results.agg(share("secret").alias("recall"), share("clean").alias("precision"), F.count_if(~F.col("passed")).alias("failed"))


def rejections(results: DataFrame) -> DataFrame:
    """(rule, candidates), most first."""
    return results.where("rejected_by is not null").groupBy(F.col("rejected_by").alias("rule")).agg(F.sum("candidates").alias("candidates")).orderBy(F.desc("candidates"), "rule")


def evaluate(spark: SparkSession, folders: list[str | Path], patterns: list[Pattern] | tuple[Pattern, ...] = BUILTIN) -> tuple[DataFrame, int]:
    """Results over labelled folders, and the exit code: 1 if any fixture failed."""
    every = None
    for folder in folders:
        manifest, sources = read_manifest(spark, folder), files.disk(spark, folder)
        judged = verify.judged(sources.where("read_error is null").select("path", "content"), patterns, failed=True)
        part = evaluated(manifest, judged, sources)
        every = part if every is None else every.unionByName(part)
    return every, int(not every.where("not passed").isEmpty())
