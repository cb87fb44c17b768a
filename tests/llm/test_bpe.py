import base64
import hashlib
import random
import time

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from credsift.llm import bpe, queries

PATH = queries.RANKS


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec.of(PATH, public_tokenizers.PATTERN)


def test_every_character_class(codec, library):
    for cp in [*range(0x300), *range(0x2000, 0x2070), 0x3000, 0xFEFF, 0x1F600, 0x10FFFF, *range(0x600, 0x700)]:
        for text in (f"a{chr(cp)}b", f"1{chr(cp)}1", f".{chr(cp)} {chr(cp)}."):
            assert bpe.unpack(codec.encode(text)) == library.encode_ordinary(text)


def test_stitched_chunks_equal_the_whole(codec, library):
    random.seed(2)
    for _ in range(3000):
        text = "".join(random.choice("ab  \n\t'séñ1.9% 　日") for _ in range(random.randint(0, 70)))
        chunk, overlap = random.choice([(5, 2), (8, 4), (16, 3), (3, 3)])
        parts = bpe.chunks(text, chunk, overlap)
        scans = [bpe.scan(codec, t, chunk, overlap) for t in parts]
        whole = bpe.stitch(codec, parts, *map(list, zip(*scans, strict=True)), chunk)
        assert bpe.unpack(whole) == library.encode_ordinary(text)
        assert codec.decode(whole) == text.encode()


def test_long_pieces(codec, library):
    random.seed(3)
    for n in (64, 65, 300, 20_000):
        text = "".join(random.choice("etaoinsh") for _ in range(n))
        assert bpe.unpack(codec.encode(text)) == library.encode_ordinary(text)


def test_one_piece_over_many_chunks(codec, library):
    random.seed(4)
    for _ in range(400):
        text = "".join(random.choice(("a", " ", "xyz ", "1", "é")) * random.choice((1, 2, 40)) for _ in range(random.randint(1, 12)))
        chunk, overlap = random.choice([(5, 2), (8, 4), (16, 3)])
        parts = bpe.chunks(text, chunk, overlap)
        whole = bpe.stitch(codec, parts, *map(list, zip(*[bpe.scan(codec, t, chunk, overlap) for t in parts], strict=True)), chunk)
        assert bpe.unpack(whole) == library.encode_ordinary(text)


def test_stitching_takes_linear_time(codec):
    took = []
    for n in (1 << 17, 1 << 19):
        text = "e" * n
        parts = bpe.chunks(text, 1 << 13, 1 << 8)
        scans = [bpe.scan(codec, t, 1 << 13, 1 << 8) for t in parts]
        began = time.process_time()
        whole = bpe.stitch(codec, parts, *map(list, zip(*scans, strict=True)), 1 << 13)
        took.append(time.process_time() - began)
        assert codec.decode(whole) == text.encode()
    assert took[1] < 12 * took[0]


def test_long_merges_equal_short_ones(codec):
    random.seed(6)
    for _ in range(1500):
        raw = bytes(random.choice(b"aeinst \xc3\xa9\xe6") for _ in range(random.randint(2, 60)))
        if raw not in codec.ranks:
            assert codec.merge_long(raw) == codec.merge(raw)


def test_query_matches_the_library(spark, sf, library):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in queries.op3_byte_bpe(spark, sf).collect()}
    assert len(got) == len(rows)
    for r in rows:
        ids = library.encode_ordinary(r.text or "")
        g = got[r.doc_id]
        assert g.n_tokens == len(ids)
        assert g.ids_sha256 == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()
        assert g.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()


def test_odd_rows(spark, library):
    long = ("word " * 30 + "x" * 90 + "\n\n  ") * 20
    rows = [(1, None, "a"), (None, "", "b"), (3, long, None), (3, long, None), (4, "y" * 3000, "c"), (5, " " * 700, "d")]
    df = spark.createDataFrame(rows, "doc_id long, text string, row string")
    out = bpe.encode(df, PATH, public_tokenizers.PATTERN, chunk=256, overlap=32)
    assert out.columns == [*df.columns, "ids"]
    both = bpe.encode(df, PATH, public_tokenizers.PATTERN, decoded_col="back", chunk=256, overlap=32).withColumn("again", bpe.decode(PATH, public_tokenizers.PATTERN, F.col("ids")))
    assert all(bytes(r.back) == bytes(r.again) == (r.text or "").encode() for r in both.collect())
    got = sorted(out.collect(), key=lambda r: str(r[:3]))
    assert [r[:3] for r in got] == sorted(rows, key=str)
    for r in got:
        assert bpe.unpack(bytes(r.ids)) == library.encode_ordinary(r.text or "")
    assert bpe.encode(df.limit(0), PATH, public_tokenizers.PATTERN).count() == 0
