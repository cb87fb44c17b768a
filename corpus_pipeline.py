"""The corpus pipeline: language ID, near-duplicates, benchmark decontamination, secrets, tokens.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and all but the last return the columns of
documents. Stages are independent of each other: what one returns can be written to Parquet and read as the next one's docs.

Null and repeated rows: a null or letterless text is rejected by the first stage; of rows that repeat each other the second
keeps one; null languages and sources are allowed throughout.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from credsift.llm import bpe, common, decontaminate, language_id, secret_scan, simhash

#: The least probability of the likeliest language. Texts of one language score near 1, so only what has no language to speak of goes.
LEAST_SCORE = 0.4
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without letters and those of which no learned language is likely."""
    lang, score = common.free_name(docs, "found_lang"), common.free_name(docs, "found_score")
    found = language_id.identify(docs, language_id.train(docs), lang_out=lang, score_out=score)
    return found.where((F.col(lang) != language_id.UNKNOWN) & (F.col(score) >= LEAST_SCORE)).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints stays, that of the smallest id."""
    return simhash.keep_one(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, verbatim or re-parameterised, go."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of credentials become a mask; every document stays, and n_chars follows the text."""
    masked = secret_scan.redact(docs, "text", F.concat_ws("/", "source", "lang"), F.col("source"))
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, packed as little-endian 32-bit integers, and the digest of the bytes that they decode to."""
    both = bpe.encode(docs, RANKS, public_tokenizers.PATTERN, decoded_col="decoded")
    return both.select("doc_id", "lang", "source", (F.length("ids") / 4).cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language_id", identify_languages),
    ("simhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_benchmark_leaks),
    ("secret_scans", mask_secrets),
    ("byte_bpe", encode_tokens),
]

#: Fingerprints and the network's predictions have no SQL form; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage but the last is written to the shared folder and read again, so none is computed twice."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs if n == 0 else common.written(docs, f"stage{n}"), sf_dir)
    return docs
