"""Aggregates, orders and listings of findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as fn


def location(*first: Column) -> list[Column]:
    """Order of findings within a file: line, column, severity, and then as they were found."""
    return [*first, F.col("line"), F.col("column"), fn.severity_rank(F.col("severity")), F.col("ordinal")]


def by_name(path: Column) -> Column:
    """Files as people sort them, not by bytes."""
    return F.collate(path, "UNICODE")


def ordered(findings: DataFrame) -> DataFrame:
    """Worst first, then file, line, column; ties stay as found."""
    return findings.orderBy(fn.severity_rank(F.col("severity")), by_name(F.col("file")), "line", "column", "ordinal")


def ordered_by_file(findings: DataFrame) -> DataFrame:
    return findings.orderBy(by_name(F.col("file")), *location())


def top(findings: DataFrame, n: int = 50) -> DataFrame:
    """The first n in the order of files; 0 is all. A top-k plan, so no full sort for a limit."""
    rows = ordered_by_file(findings)
    return rows if n == 0 else rows.limit(n)


def severity_counts(findings: DataFrame) -> DataFrame:
    """(severity, findings): all four severities, also those without findings."""
    counts = [F.count_if(F.col("severity") == s).alias(s) for s in fn.SEVERITIES]
    pairs = F.array(*[F.struct(F.lit(s).alias("severity"), F.col(s).alias("findings")) for s in fn.SEVERITIES])
    return findings.agg(*counts).select(F.explode(pairs).alias("p")).select("p.*")


def totals(findings: DataFrame) -> DataFrame:
    """One row: findings, unique secrets (exact), files with findings, and whether any is of each severity."""
    return findings.agg(F.count("*").alias("findings"), F.count_distinct("fingerprint").alias("unique_secrets"), F.count_distinct("file").alias("files_with_findings"), *[F.count_if(F.col("severity") == s).alias(s) for s in fn.SEVERITIES])


def provider_rollup(findings: DataFrame) -> DataFrame:
    """Counts by provider and severity with subtotals."""
    return findings.rollup("provider", "severity").agg(F.count("*").alias("findings"), F.count_distinct("fingerprint").alias("unique_secrets"))


def secret_files(findings: DataFrame) -> DataFrame:
    """(fingerprint, files, n): the distinct files of each secret, by name.

    Pairs are made distinct first, so a secret that stands everywhere in one file is one row before anything is gathered.
    """
    pairs = findings.select("fingerprint", "file").distinct()
    return pairs.groupBy("fingerprint").agg(F.array_sort(F.collect_list("file")).alias("files"), F.count("*").alias("n"))


def shared_counts(findings: DataFrame) -> DataFrame:
    """(fingerprint, n): secrets that stand in more than one file."""
    return findings.groupBy("fingerprint").agg(F.count_distinct("file").alias("n")).where("n > 1")


def first_of(findings: DataFrame, key: str) -> DataFrame:
    """(key, file, line, column, ordinal) of the first finding with each value of key, in the order of files.

    A partial aggregate, so a secret that stands everywhere sends on one row a partition.
    """
    place = F.struct(by_name(F.col("file")).alias("name"), "line", "column", fn.severity_rank(F.col("severity")).alias("rank"), "ordinal", F.col("file").alias("path"))
    return findings.groupBy(key).agg(F.min(place).alias("p")).select(*[key] * (key != "file"), F.col("p.path").alias("file"), "p.line", "p.column", "p.ordinal")


def firsts(findings: DataFrame) -> DataFrame:
    """(fingerprint, file, line, column, ordinal) of each secret's first finding."""
    return first_of(findings, "fingerprint")


def listed(findings: DataFrame) -> DataFrame:
    """Findings in the order of files, with `others` and with `head`, whether a finding is its file's first."""
    heads = first_of(findings, "file").withColumn("head", F.lit(True))
    rows = also_in(findings).join(heads, ["file", "line", "column", "ordinal"], "left").withColumn("head", F.coalesce("head", F.lit(False)))
    return ordered_by_file(rows.select(*findings.columns, "others", "head"))


def other_files(findings: DataFrame) -> DataFrame:
    """(fingerprint, file, other): a row for each other file that the secret of a first finding in `file` stands in."""
    pairs = findings.select("fingerprint", F.col("file").alias("other")).distinct()
    return pairs.join(firsts(findings).select("fingerprint", "file"), "fingerprint").where("other != file").select("fingerprint", "file", "other")


def also_in(findings: DataFrame) -> DataFrame:
    """Findings with `others`, the other files of the same secret, on the first finding of each secret and null elsewhere.

    What is joined to the findings is joined by their places, of which no one is hot; other_files() has rows where arrays get too long.
    """
    others = secret_files(findings).where("n > 1").select("fingerprint", "files")
    shared = firsts(findings).join(others, "fingerprint").select("fingerprint", "file", "line", "column", "ordinal", F.array_remove("files", F.col("file")).alias("others"))
    return findings.join(shared, ["fingerprint", "file", "line", "column", "ordinal"], "left").select(*findings.columns, "others")


def by_file(findings: DataFrame) -> DataFrame:
    """(file, findings array, n): each file's findings in order."""
    rows = findings.select("file", F.struct("line", "column", fn.severity_rank(F.col("severity")).alias("rank"), "ordinal", "patternId", "provider", "severity", "masked", "fingerprint").alias("f"))
    return rows.groupBy("file").agg(F.array_sort(F.collect_list("f")).alias("findings"), F.count("*").alias("n"))


def provider_width(findings: DataFrame) -> DataFrame:
    """One row: the width of the provider column, 8 to 12."""
    return findings.agg(F.least(F.lit(12), F.greatest(F.lit(8), F.coalesce(F.max(fn.units(F.col("provider"))), F.lit(0)))).alias("width"))


def failing(findings: DataFrame, fail_on: str) -> DataFrame:
    """Findings at the threshold or worse; an unknown threshold fails nothing."""
    if fail_on not in fn.SEVERITIES:
        return findings.limit(0)
    return findings.where(fn.severity_rank(F.col("severity")) <= fn.SEVERITIES.index(fail_on))


def rejections(judged: DataFrame) -> DataFrame:
    """(rule, candidates): how many candidates each rule was the first to drop, most first."""
    dropped = F.get(F.filter("verdicts", lambda v: v["action"] == "drop"), F.lit(0))
    return judged.select(dropped["rule"].alias("rule")).where("rule is not null").groupBy("rule").agg(F.count("*").alias("candidates")).orderBy(F.desc("candidates"), "rule")


def annotations(findings: DataFrame) -> DataFrame:
    """(file, line, column, command): workflow commands."""
    level = F.when(F.col("severity").isin("critical", "high"), "error").when(F.col("severity") == "low", "notice").otherwise("warning")
    body = fn.escaped(F.concat(F.lit("["), F.col("provider"), F.lit("] "), F.col("patternName"), F.lit(" — "), F.col("masked")))
    command = F.concat(F.lit("::"), level, F.lit(" file="), F.col("file"), F.lit(",line="), F.col("line").cast("string"), F.lit(",col="), F.col("column").cast("string"), F.lit("::"), body)
    return findings.select("file", "line", "column", "ordinal", command.alias("command"))


def skip_annotations(skipped: DataFrame) -> DataFrame:
    return skipped.select("path", F.concat(F.lit("::warning::"), fn.escaped(F.concat(F.lit("Could not scan "), F.col("path"), F.lit(": "), F.col("reason")))).alias("command"))


def step_outputs(outcomes: DataFrame) -> DataFrame:
    """(name, value) of what a workflow step hands on, from verify.outcomes()."""
    rows = outcomes.select("reason", F.posexplode_outer(F.transform("found", lambda f: f["fingerprint"])).alias("nth", "fingerprint"))
    file = F.coalesce("nth", F.lit(0)) == 0
    skipped = F.count_if(file & F.col("reason").isNotNull())
    value = {"findings": F.count("fingerprint"), "unique-secrets": F.count_distinct("fingerprint"), "files-scanned": F.count_if(file) - skipped, "files-skipped": skipped}
    counts = rows.agg(*[v.cast("long").alias(k) for k, v in value.items()])
    return counts.select(F.inline(F.array(*[F.struct(F.lit(k).alias("name"), F.col(f"`{k}`").alias("value")) for k in value])))
