"""The registry of detection patterns: built-in rows, loading, validation, overrides."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass
from functools import cached_property
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dialect import Compiled, UnsupportedPattern, translate
from ..functions.text import CONFIDENCES, SEVERITIES


@dataclass(frozen=True)
class Pattern:
    id: str
    name: str
    provider: str
    regex: str
    flags: str
    confidence: str
    severity: str
    entropyCheck: bool  # noqa: N815  (the registry's own field name)

    @cached_property
    def compiled(self) -> Compiled:
        return translate(self.regex, self.flags)


FIELDS = ("id", "name", "provider", "regex", "flags", "confidence", "severity", "entropyCheck")
SCHEMA = T.StructType([*[T.StructField(f, T.BooleanType() if f == "entropyCheck" else T.StringType(), False) for f in FIELDS], T.StructField("ordinal", T.IntegerType(), False)])

# The built-in patterns.
BUILTIN = tuple(
    Pattern(*row)
    for row in (
        ("aws-access-key-id", "AWS Access Key ID", "AWS", r"(AKIA[0-9A-Z]{16})", "", "high", "critical", False),
        ("aws-secret-access-key", "AWS Secret Access Key", "AWS", r"aws(.{0,40})?['\"]([0-9a-zA-Z/+]{40})['\"]", "i", "medium", "critical", True),
        ("stripe-live-secret-key", "Stripe Live Secret Key", "Stripe", r"\bsk_live_[0-9a-zA-Z]{24,}\b", "", "high", "critical", False),
        ("stripe-live-publishable-key", "Stripe Live Publishable Key", "Stripe", r"\bpk_live_[0-9a-zA-Z]{24,}\b", "", "high", "low", False),
        ("github-personal-access-token", "GitHub Personal Access Token", "GitHub", r"\bghp_[0-9a-zA-Z]{36}\b", "", "high", "critical", False),
        ("github-fine-grained-pat", "GitHub Fine-Grained PAT", "GitHub", r"\bgithub_pat_[0-9a-zA-Z_]{22,}\b", "", "high", "critical", False),
        ("openai-api-key", "OpenAI API Key", "OpenAI", r"\bsk-[a-zA-Z0-9]{20,}T3BlbkFJ[a-zA-Z0-9]{20,}\b", "", "high", "critical", False),
        ("slack-bot-token", "Slack Bot Token", "Slack", r"\bxox[baprs]-[0-9]{10,13}-[0-9]{10,13}-[0-9a-zA-Z]{24,32}\b", "", "high", "high", False),
        ("generic-jwt", "JSON Web Token", "generic", r"\beyJ[a-zA-Z0-9_-]{10,}\.eyJ[a-zA-Z0-9_-]{10,}\.[a-zA-Z0-9_-]{10,}\b", "", "low", "medium", False),
        ("generic-high-entropy-secret", "Generic High-Entropy Secret", "generic", r"(api[_-]?key|secret|token|password|passwd|pwd)['\"]?\s*[:=]\s*['\"]([a-zA-Z0-9_\-!@#$%^&*]{16,})['\"]", "i", "low", "medium", True),
    )
)


def is_pattern(item: object) -> bool:
    """All fields there, with the right types; other fields are allowed."""
    if not isinstance(item, dict) or any(f not in item for f in FIELDS):
        return False
    texts = all(isinstance(item[f], str) for f in FIELDS[:5])
    return texts and item["confidence"] in CONFIDENCES and item["severity"] in SEVERITIES and isinstance(item["entropyCheck"], bool)


def parse_patterns(text: str, where: str) -> list[Pattern]:
    """Patterns of a JSON array; the first bad entry is an error that names its place."""
    from .matching import compiled

    try:
        items = json.loads(text)
    except ValueError as e:
        raise ValueError(f"{where}: no patterns could be read: {e}") from e
    if not isinstance(items, list):
        raise ValueError(f"{where}: a list of patterns was expected")
    out = []
    for k, item in enumerate(items):
        if not is_pattern(item):
            raise ValueError(f"{where}, entry {k}: fields are missing or of a wrong type")
        pattern = Pattern(*[item[f] for f in FIELDS])
        try:
            compiled(pattern.regex, pattern.flags)
        except UnsupportedPattern as e:
            raise ValueError(f"{where}, entry {k}: the expression does not compile: {e}") from e
        out.append(pattern)
    return out


def load_patterns(path: str | Path) -> list[Pattern]:
    try:
        text = Path(path).read_text(encoding="utf-8")
    except OSError as e:
        raise ValueError(f"{path}: no patterns could be read: {e}") from e
    return parse_patterns(text, str(path))


def patterns_frame(spark: SparkSession, patterns: list[Pattern] | tuple[Pattern, ...]) -> DataFrame:
    """The registry as rows; `ordinal` keeps its order."""
    return spark.createDataFrame([(*[asdict(p)[f] for f in FIELDS], k) for k, p in enumerate(patterns)], SCHEMA)


def merged(builtin: DataFrame, custom: DataFrame) -> DataFrame:
    """Both registries with custom rows overriding built-in ones of the same id, and later rows earlier ones.

    A pattern keeps the place where its id came first and has the value that came last.
    """
    both = builtin.withColumn("source", F.lit("builtin")).withColumn("turn", F.col("ordinal")).unionByName(custom.withColumn("source", F.lit("custom")).withColumn("turn", F.col("ordinal") + (1 << 20)))
    last = W.partitionBy("id").orderBy(F.desc("turn"))
    placed = both.withColumn("place", F.min("turn").over(W.partitionBy("id"))).withColumn("n", F.row_number().over(last)).where("n = 1")
    return placed.select(*FIELDS, "source", "place")


def conflicts(builtin: DataFrame, custom: DataFrame) -> DataFrame:
    """(id, turn, shadowed name and source, winner name): one row for each custom row that replaces another.

    Repeated built-in rows replace each other silently.
    """
    turns = builtin.select("id", "name", F.col("ordinal").alias("turn"), F.lit("builtin").alias("source")).unionByName(custom.select("id", "name", (F.col("ordinal") + (1 << 20)).alias("turn"), F.lit("custom").alias("source")))
    before = W.partitionBy("id").orderBy("turn")
    seen = turns.withColumn("shadowed_name", F.lag("name").over(before)).withColumn("shadowed_source", F.lag("source").over(before))
    return seen.where("source = 'custom' and shadowed_source is not null").select("id", "shadowed_name", "shadowed_source", F.col("name").alias("winner_name"), (F.col("turn") - (1 << 20)).alias("custom_ordinal"))


def notices(found: DataFrame) -> DataFrame:
    """conflicts() with `note`, what a scan says of each."""
    name = F.concat(F.lit('"'), F.col("id"), F.lit('"'))
    of_builtin, of_custom = F.concat(F.lit("note: custom pattern "), name, F.lit(" overrides the built-in")), F.concat(F.lit("note: duplicate custom pattern id "), name, F.lit(", the later one is used"))
    return found.withColumn("note", F.when(F.col("shadowed_source") == "builtin", of_builtin).otherwise(of_custom))


@dataclass(frozen=True)
class Conflict:
    id: str
    shadowed: Pattern
    shadowedSource: str  # noqa: N815
    winner: Pattern


def merge_patterns(builtin: list[Pattern] | tuple[Pattern, ...], custom: list[Pattern] | tuple[Pattern, ...]) -> tuple[list[Pattern], list[Conflict]]:
    """Driver-side form of merged() and conflicts(), for the few rows that a scan starts from."""
    held = {p.id: (p, "builtin") for p in builtin}
    found = []
    for p in custom:
        if p.id in held:
            found.append(Conflict(p.id, held[p.id][0], held[p.id][1], p))
        held[p.id] = p, "custom"
    return [p for p, _ in held.values()], found


def conflict_notes(found: list[Conflict]) -> list[str]:
    return [f'note: custom pattern "{c.id}" overrides the built-in' if c.shadowedSource == "builtin" else f'note: duplicate custom pattern id "{c.id}", the later one is used' for c in found]
