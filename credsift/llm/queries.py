"""The opN_ queries: each applies one operator, with its production parameters, to a whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, conversation_repair, decontaminate, hard_negatives, html_extract, language_id, quality, secret_scan, simhash, token_count, toxicity, warc
from .common import fresh_path, held_out, table

WORDS = public_tokenizers.path("word_bpe_49k.json")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    network = language_id.train(docs)
    return language_id.identify(docs.select("doc_id", "text"), network).select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's source stands for the owner, source and language for the repository."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    found = secret_scan.scan(docs, "text", F.concat_ws("/", "source", "lang"), F.col("source"), ["doc_id"])
    return secret_scan.report(found).drop("found", "text_hash")


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    both = bpe.encode(docs, RANKS, public_tokenizers.PATTERN, decoded_col="decoded")
    return both.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    found = pages.select("page_id", "url", html_extract.main_text(spark, html_extract.train(), F.col("html")).alias("text"))
    return found.withColumn("n_chars", F.length("text").cast("long"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", held_out("doc_id").alias("held_out"), toxicity.score(spark, model, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= toxicity.THRESHOLD).cast("int"))


def op7_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", token_count.counts(WORDS, F.col("text")).alias("n"))
    return docs.select("doc_id", F.col("n.tokens").alias("n_tokens"), F.col("n.words").alias("n_words"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.hits(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return found.select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), "coverage", "slots", "consistency", F.col("same").alias("verbatim"))


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades: 0 is poor, 1 well written but toxic, 2 well written and civil. Selected is what is probably 1 or more.

    Well-written rows of which nothing is known about toxicity have no grade.
    """
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    rated = labels.where("quality in (0, 1)").select("doc_id", F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).when(F.col("toxic") == 0, 2).alias("grade"))
    model = quality.train(docs, rated)
    graded = docs.select("doc_id", held_out("doc_id").alias("held_out"), quality.grade(spark, model, F.col("text"), 1).alias("g"))
    return graded.select("doc_id", "held_out", F.col("g.expected").alias("expected_grade"), F.col("g.tail").alias("tail"), (F.col("g.tail") >= 0.5).alias("selected"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = conversation_repair.damaged(table(spark, sf_dir, "conversations"))
    return conversation_repair.digests(conversation_repair.repair(rows, absent=F.col("absent"))).withColumnRenamed("conv", "conv_id")


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The archive is written, committed, and read back; what the records say is the result."""
    path = fresh_path(spark, "warc")
    warc.write(table(spark, sf_dir, "pages").select("page_id", "url", "html"), path)
    return warc.read(spark, path, payloads=False).select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose id is divisible by 7 get the next label first."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"))
    return hard_negatives.mine(rows)


def queries() -> dict:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op2_secret_scan": secret_scan.SQL, "op8_decontaminate": decontaminate.SQL, "op11_conversation_repair": conversation_repair.SQL, "op12_warc": warc.SQL, "op13_hard_negatives": hard_negatives.SQL}
