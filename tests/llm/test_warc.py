"""The archive's round trip, its bytes' independence of layout, what a lost task leaves, and damaged files."""

import base64
import gzip
import hashlib
import random
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from credsift.llm import queries, warc

SCHEMA = "page_id long, url string, html string"


def told(records):
    return sorted((r["id"] if r["id"] is not None else -1, r["record_type"], r["refers_to"], r["payload_bytes"], r["payload_digest"]) for r in records)


def plain(rows):
    """Records of (page_id, url, html) by a dictionary of payloads."""
    held = {}
    for doc, _, body in rows:
        held.setdefault(body or "", []).append(-1 if doc is None else doc)
    out = []
    for body, ids in held.items():
        raw = body.encode()
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        ids = sorted(ids, reverse=True)
        best = None if ids[0] < 0 else ids[0]
        out += [(i, "revisit" if k else "response", best if k else None, len(raw), digest) for k, i in enumerate(ids)]
    return sorted(out)


def archive(folder):
    return {p.name: p.read_bytes() for p in sorted(Path(folder).glob("*.warc.gz"))}


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    rows = [(k, f"http://a.example/{k}", f"<p>page {k} é</p>" * rng.randrange(1, 200)) for k in range(300)]
    rows += [(1000 + k, f"http://copy.example/{k}", "<p>the same everywhere</p>") for k in range(200)]  # two fifths of all rows
    rows += [(2000, None, None), (2001, "http://b.example/ä b\r\nX: 1", ""), (None, None, "<p>the same everywhere</p>"), (2002, "u", "only"), (2002, "u", "only"), (2002, "v", "only"), (2002, "v", "other")]
    return rows


def test_round_trip(spark, rows, tmp_path):
    table = spark.createDataFrame(rows, SCHEMA).repartition(7)
    manifest = warc.write(table, f"{tmp_path}/a", shard_bytes=100_000, roll_bytes=3000)
    listed = manifest.collect()
    assert len(listed) > len({r["shard"] for r in listed}) > 3
    assert {r["name"] for r in listed} == set(archive(f"{tmp_path}/a")) and sum(r["records"] for r in listed) == len(rows)
    for r in listed:
        data = Path(tmp_path, "a", r["name"]).read_bytes()
        assert (len(data), hashlib.sha256(data).hexdigest()) == (r["bytes"], r["sha256"])
        assert gzip.decompress(data).startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n")
    found = warc.read(spark, f"{tmp_path}/a").collect()
    assert told(found) == plain(rows)
    bodies = {r["record_id"]: bytes(r["payload"]) for r in found if r["payload"] is not None}
    assert sorted(bodies.values()) == sorted({(b or "").encode() for _, _, b in rows})
    assert len({r["record_id"] for r in found}) == len(rows)
    assert not any("\n" in r["url"] for r in found)
    with pytest.raises(FileExistsError):
        warc.write(table, f"{tmp_path}/a")


def test_the_same_rows_give_the_same_bytes(spark, rows, tmp_path):
    shuffled = random.Random(4).sample(rows, len(rows))
    for name, part, n in (("a", rows, 1), ("b", shuffled, 9)):
        warc.write(spark.createDataFrame(part, SCHEMA).repartition(n), f"{tmp_path}/{name}", shard_bytes=100_000, roll_bytes=3000)
    assert archive(f"{tmp_path}/a") == archive(f"{tmp_path}/b")


def test_what_no_manifest_names_is_not_read(spark, rows, tmp_path):
    with pytest.raises(FileNotFoundError):
        warc.read(spark, f"{tmp_path}/none")
    warc.write(spark.createDataFrame(rows[:20], SCHEMA), f"{tmp_path}/a")
    Path(tmp_path, "a", "part-000009-0000.warc.gz").write_bytes(b"left by an attempt that was lost")
    assert warc.read(spark, f"{tmp_path}/a").count() == 20
    assert not list(Path(tmp_path, "a", "_temporary").iterdir())


def test_moving_can_be_repeated(spark, rows, tmp_path):
    warc.write(spark.createDataFrame(rows[:20], SCHEMA), f"{tmp_path}/a")
    before, uri = archive(f"{tmp_path}/a"), warc.qualified(spark, f"{tmp_path}/a")
    staged = spark.read.parquet(f"{uri}/manifest.parquet").withColumn("staged", F.concat(F.lit(f"{tmp_path}/a/_temporary/x/"), "name"))
    warc.commit(spark, uri, staged, f"{uri}/_temporary/x")
    assert archive(f"{tmp_path}/a") == before and warc.read(spark, f"{tmp_path}/a").count() == 20


@pytest.mark.parametrize("how", ["cut", "changed"])
def test_damage_is_an_error(spark, rows, tmp_path, how):
    warc.write(spark.createDataFrame(rows[:20], SCHEMA), f"{tmp_path}/a")
    [path] = Path(tmp_path, "a").glob("*.warc.gz")
    data = path.read_bytes()
    if how == "cut":
        path.write_bytes(data[:-20])
    else:
        content = gzip.decompress(data).replace(b"page 3", b"page 4")
        path.write_bytes(gzip.compress(content))
    with pytest.raises(Exception, match="cut short|not one whole record|digest"):
        warc.read(spark, f"{tmp_path}/a").count()


def test_records_that_span_chunks(monkeypatch):
    import io

    data = warc.member([("WARC-Type", "response")], random.Random(1).randbytes(5000)) + warc.member([("WARC-Type", "response")], b"x")
    monkeypatch.setattr(warc, "CHUNK", 7)
    found = list(warc.members(io.BytesIO(data)))
    assert [len(warc.parsed(c)[1]) for _, c in found] == [5000, 1] and found[0][0] == 0
    assert data[found[1][0] :][:2] == b"\x1f\x8b"


def test_small_payloads_can_stay_responses(spark, tmp_path):
    rows = [(1, "a", "xy"), (2, "b", "xy"), (3, "c", "long enough"), (4, "d", "long enough")]
    warc.write(spark.createDataFrame(rows, SCHEMA), f"{tmp_path}/a", least_bytes=5)
    assert {r["id"]: (r["record_type"], r["refers_to"]) for r in warc.read(spark, f"{tmp_path}/a").collect()} == {1: ("response", None), 2: ("response", None), 3: ("revisit", 4), 4: ("response", None)}


def test_empty_table_clashing_columns_and_long_pages(spark, tmp_path):
    warc.write(spark.createDataFrame([], SCHEMA), f"{tmp_path}/a")
    assert warc.read(spark, f"{tmp_path}/a").collect() == []
    rows = spark.createDataFrame([(1, "u", "x" * 20_000_000, "s", 5)], SCHEMA + ", sha string, shard int")
    warc.write(rows, f"{tmp_path}/b")
    [found] = warc.read(spark, f"{tmp_path}/b").collect()
    assert (found["payload_bytes"], len(found["payload"])) == (20_000_000, 20_000_000)


def test_the_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html").collect()]
    found = queries.op12_warc(spark, sf).collect()
    assert sorted((r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"], r["payload_digest"]) for r in found) == plain(rows)


def test_the_query_agrees_with_its_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{sf}/pages.parquet'")
    names = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    found = queries.op12_warc(spark, sf).collect()
    assert sorted(tuple(r[c] for c in names) for r in found) == sorted(con.execute(f"select {', '.join(names)} from ({warc.SQL})").fetchall())
