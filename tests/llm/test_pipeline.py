import hashlib
import re

import public_tokenizers

import corpus_pipeline as pipeline
from credsift.llm import bpe, decontaminate, language_id, secret_scan
from tests.llm.test_simhash import plain, plain_components


def test_stages_keep_the_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [name for name, _ in pipeline.STAGES] == ["language_id", "simhash_near_dedup", "benchmark_decontamination", "secret_scans", "byte_bpe"]
    for _, stage in pipeline.STAGES[1:-1]:
        assert stage(spark, docs, sf).schema.simpleString() == docs.schema.simpleString()


def test_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    rows = sorted(docs.collect(), key=lambda r: r.doc_id)
    network = language_id.train(docs)
    kept = []
    for r in rows:
        lang, score = network.predict([r.text])
        if lang[0] != language_id.UNKNOWN and score[0] >= pipeline.LEAST_SCORE:
            kept.append(r)
    roots = plain_components({r.doc_id: plain(r.text) for r in kept})
    kept = [r for r in kept if roots[r.doc_id] == r.doc_id]
    kept = [r for r in kept if not any(i in r.text for i in items)]
    codec = bpe.Codec.of(pipeline.RANKS, public_tokenizers.PATTERN)
    want = {}
    patterns = [re.compile(p, re.A) for p in (secret_scan.ASSIGN, secret_scan.ACCESS, secret_scan.HEX)]
    wide = {}
    for r in kept:
        spans = [(m.start(), m.end()) for p in patterns for m in p.finditer(r.text) if len(m[2] if p is patterns[0] else m[0]) >= (6 if p is patterns[0] else 20)]
        wide[r.doc_id] = any(re.search("[A-Z]", m) and re.search("[a-z]", m) and re.search("[0-9]", m) for m in re.findall(secret_scan.WIDE, r.text))
        text, at, out = r.text, 0, []
        for a, b in sorted(spans):
            if a >= at:
                out += [text[at:a], "[secret]"]
            at = max(at, b)
        text = "".join(out) + text[at:]
        ids = codec.encode(text)
        want[r.doc_id] = (len(ids) // 4, ids, hashlib.sha256(text.encode()).hexdigest())
    got = {r.doc_id: (r.n_tokens, bytes(r.ids), r.decoded_sha256) for r in pipeline.run(spark, sf).collect()}
    assert set(got) == set(want)
    assert {i for i in got if got[i] != want[i]} <= {i for i, w in wide.items() if w}


def test_decisions_of_the_middle_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(30)
    item = spark.read.parquet(f"{sf}/benchmark.parquet").orderBy("item_id").first().text
    planted = spark.createDataFrame([(10_001, f"Words before. {item} Words after.", "en", "src1", 10), (10_002, "some words token=abcdef123456 more words", "en", "src1", 10), (10_003, "12 34", "en", "src1", 5)], docs.schema)
    every = docs.union(planted)
    assert 10_001 not in {r.doc_id for r in pipeline.drop_benchmark_leaks(spark, every, sf).collect()}
    masked = {r.doc_id: r for r in pipeline.mask_secrets(spark, every, sf).collect()}
    assert masked[10_002].text == "some words [secret] more words"
    assert masked[10_002].n_chars == len(masked[10_002].text)
    assert len(masked) == 33
    assert 10_003 not in {r.doc_id for r in pipeline.identify_languages(spark, every, sf).collect()}
    assert decontaminate.COVERAGE == 0.8


EXTRA = ", ids string, decoded string, lang_pred string, score string, print string, component string, hash string, window string, spans string"


def through(spark, docs, sf):
    """What each stage leaves, and the last one's rows."""
    counts = []
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, sf)
        counts.append(docs.count())
    return counts, docs


def test_extra_columns_of_clashing_names_and_repeated_rows_pass_all_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    some = docs.where("doc_id < 60")
    more = docs.schema.simpleString()[len("struct<") : -1].replace(":", " ").replace(",", ", ") + EXTRA
    rows = [(*r, *[f"x{k}" for k in range(EXTRA.count(","))]) for r in some.collect()]
    rows += [*rows[:10], (None, None, None, None, None, *[None] * EXTRA.count(",")), (rows[0][0], "", "en", "s", 0, *[""] * EXTRA.count(","))]
    wide, plainly = spark.createDataFrame(rows, more), spark.createDataFrame([r[: len(docs.columns)] for r in rows], docs.schema)
    counts, last = through(spark, wide, sf)
    expected, other = through(spark, plainly, sf)
    assert counts == expected and counts[1] <= 60
    assert sorted((r.doc_id, r.n_tokens, bytes(r.ids), r.decoded_sha256) for r in last.collect()) == sorted((r.doc_id, r.n_tokens, bytes(r.ids), r.decoded_sha256) for r in other.collect())


def test_no_rows_pass_all_stages(spark, sf):
    counts, last = through(spark, spark.read.parquet(f"{sf}/documents.parquet").limit(0), sf)
    assert counts == [0] * 5 and "n_tokens" in last.columns


def test_columns_of_the_outputs_names_are_replaced(spark):
    docs = spark.createDataFrame([(1, "some words here", "old", "old", "old", "old")], "doc_id long, text string, ids string, Decoded string, lang_pred string, score string")
    [row] = bpe.encode(docs, pipeline.RANKS, public_tokenizers.PATTERN, decoded_col="decoded").collect()
    assert bytes(row.decoded) == b"some words here" and row.ids != "old" and row.score == "old"
    [row] = language_id.identify(docs, None).collect()
    assert (row.lang_pred, row.score, row.ids) == (language_id.UNKNOWN, 0.0, "old")
