"""WARC archives: a deterministic sharded writer, and a reader that checks every digest.

Writing. Records are sorted by (id, address, digest of the payload) and cut into shards where the running sum of their sizes passes
multiples of SHARD_BYTES. The cuts follow from the rows alone, so the same rows give the same files, however they were laid out. A task
writes a shard as files that roll once ROLL_BYTES of compressed records are in them; each record is a gzip member with headers and
digests made anew. Of equal payloads the record of the largest id is a response, the others are revisits without payload (by the
profile for identical payload digests), so copies cost a header.

Committing. Tasks write to names of their own below `_temporary`; only files that a finished task reports are moved to their
names (which can be repeated), and then `manifest.parquet` is written. What isn't in it was never written: lost or repeated tasks leave
nothing that a reader sees. Folders with a manifest aren't written to again.

Memory: a task holds one record, the driver one id for each shard. A payload passes one shuffle; the search for copies and cuts
moves digests and sizes.

Defined results: null payloads are empty ones, null ids sort first (a copy with an id is preferred to answer for them), null addresses
become `urn:page:ID`, other characters than printable ASCII are percent-encoded in addresses. Of rows that are equal in all three columns the
first is the response and the others revisit it. Equal ids with different payloads are records of their own. An empty table gives a manifest
without rows. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

#: Sizes, uncompressed, after which a new shard begins, and, compressed, after which a file is closed.
SHARD_BYTES, ROLL_BYTES = 64 << 20, 16 << 20
#: What headers add to a payload, about.
HEADER_BYTES = 700
#: A digest that stands in more than this share of the records is looked up by a broadcast, so at most as many rows as 1 by it.
HOT_SHARE = 1 / 1024
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Compressed bytes that are read at once.
CHUNK = 1 << 20

MANIFEST = "name string, shard int, records long, bytes long, sha256 string, first_id long, last_id long, staged string"
RECORDS = "file string, at long, record_type string, record_id string, url string, id long, refers_to long, payload_bytes long, payload_digest string, payload binary"


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def record_id(doc, url, sha: str, copy: int) -> str:
    """The same for the same record, whoever writes it."""
    return uuid.UUID(bytes=hashlib.sha256(f"{doc}|{url}|{sha}|{copy}".encode()).digest()[:16], version=5).urn


def address(url, doc) -> str:
    return f"urn:page:{'' if doc is None else doc}" if url is None else quote(url, safe="!#$%&'()*+,-./:;=?@[]~_")


def member(headers: list[tuple[str, object]], block: bytes) -> bytes:
    """A record as one gzip member; nothing in it tells when or where it was made."""
    head = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("WARC-Block-Digest", "sha1:" + base32(hashlib.sha1(block).digest())), ("Content-Length", len(block))])
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(b"WARC/1.1\r\n" + head.encode() + b"\r\n") + packer.compress(block) + packer.compress(b"\r\n\r\n") + packer.flush()


def info(name: str, date: str) -> bytes:
    made = uuid.UUID(bytes=hashlib.sha256(name.encode()).digest()[:16], version=5).urn
    return member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<{made}>"), ("WARC-Date", date), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")


def record(row: dict, copy: int, date: str) -> bytes:
    """A response, or a revisit if the row has an owner (of the same payload) that isn't the row itself."""
    revisit = row["revisit"]
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['size']}\r\n\r\n".encode()
    headers = [
        ("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<{record_id(row['id'], row['url'], row['sha'], copy)}>"), ("WARC-Date", date),
        ("WARC-Target-URI", address(row["url"], row["id"])), ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", "sha1:" + base32(bytes.fromhex(row["sha1"]))),
    ]
    if row["id"] is not None:
        headers.append(("X-Id", row["id"]))
    if revisit:
        headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{record_id(row['owner_id'], row['owner_url'], row['sha'], 0)}>"), ("WARC-Refers-To-Target-URI", address(row["owner_url"], row["owner_id"])), ("WARC-Refers-To-Date", date)]
        if row["owner_id"] is not None:
            headers.append(("X-Refers-To-Id", row["owner_id"]))
    return member(headers, block if revisit else block + row["payload"])


class _File:
    """A file under a name of this attempt alone."""

    def __init__(self, fs, folder: str, shard: int, number: int, date: str):
        self.name, self.shard = f"part-{shard:06d}-{number:04d}.warc.gz", shard
        self.staged = f"{folder}/{self.name}.{uuid.uuid4().hex}"
        self.out, self.sha, self.bytes, self.records, self.first, self.last = fs.open_output_stream(self.staged), hashlib.sha256(), 0, 0, None, None
        self.add(info(self.name, date))

    def add(self, data: bytes) -> None:
        self.out.write(data)
        self.sha.update(data)
        self.bytes += len(data)

    def put(self, data: bytes, doc) -> None:
        self.add(data)
        self.first = doc if self.records == 0 else self.first
        self.last, self.records = doc, self.records + 1

    def close(self) -> dict:
        self.out.close()
        return {"name": self.name, "shard": self.shard, "records": self.records, "bytes": self.bytes, "sha256": self.sha.hexdigest(), "first_id": self.first, "last_id": self.last, "staged": self.staged}


def _written(uri: str, roll_bytes: int, date: str, schema: pa.Schema):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = pyarrow.fs.FileSystem.from_uri(uri)
        fs.create_dir(folder, recursive=True)
        done, file, number, before, copy = [], None, 0, None, 0
        for b in batches:
            for row in b.to_pylist():
                if file and (file.shard != row["shard"] or file.bytes >= roll_bytes):
                    number = number + 1 if file.shard == row["shard"] else 0
                    done.append(file.close())
                    file = None
                same = (row["id"], row["url"], row["sha"])
                before, copy = same, copy + 1 if same == before else 0
                row["revisit"] = row["revisit"] or copy > 0 and row["owned"]
                file = file or _File(fs, folder, row["shard"], number, date)
                file.put(record(row, copy, date), row["id"])
        if file:
            done.append(file.close())
        yield pa.RecordBatch.from_pylist(done, schema)

    return write


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its scheme, by the cluster's own file systems."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toString()


def cuts(meta: DataFrame, shard_bytes: int) -> list[int]:
    """The ids that begin a shard, of (id, size): one for each shard_bytes at most."""
    each = meta.where("id is not null").groupBy("id").agg(F.sum(F.col("size") + HEADER_BYTES).alias("size"))
    placed = common.written(each.repartitionByRange("id").withColumn("part", F.spark_partition_id()), "places")
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # a row for each partition of the sort
    parts = placed.groupBy("part").agg(F.sum("size").alias("all")).withColumn("offset", F.coalesce(F.sum("all").over(before), F.lit(0)))
    run = F.sum("size").over(W.partitionBy("part").orderBy("id")) - F.col("size")
    shards = placed.withColumn("run", run).join(F.broadcast(parts.select("part", "offset")), "part").groupBy(F.floor((F.col("run") + F.col("offset")) / shard_bytes).alias("shard")).agg(F.min("id").alias("id"))
    return sorted(r["id"] for r in shards.collect())[1:]


def owners(meta: DataFrame, least_bytes: int) -> DataFrame:
    """(sha, owner_id, owner_url, n) of payloads that more than one record has."""
    return meta.where(F.col("size") >= least_bytes).groupBy("sha").agg(F.max(F.struct("id", "url")).alias("owner"), F.count("*").alias("n")).where("n > 1").select("sha", F.col("owner.id").alias("owner_id"), F.col("owner.url").alias("owner_url"), "n")


def write(rows: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 0, shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES, date: str = DATE) -> DataFrame:
    """Writes a record for each row below path and gives the manifest. Payloads of fewer than least_bytes are never revisits.

    A payload column of text is written in UTF-8.
    """
    spark = rows.sparkSession
    common.small_batches(spark)
    uri = qualified(spark, path)
    if is_committed(spark, uri):
        raise FileExistsError(f"{path} holds a committed archive")
    payload = F.col(payload_col) if dict(rows.dtypes)[payload_col] == "binary" else F.encode(payload_col, "UTF-8")
    base = rows.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(payload, F.lit(b"")).alias("payload"))
    base = base.withColumn("size", F.octet_length("payload").cast("long")).withColumn("sha", F.sha2("payload", 256))
    meta = common.written(base.select("id", "url", "size", "sha"), "digests")
    total = meta.count()
    own = common.written(owners(meta, least_bytes), "owners")
    begins = np.array(cuts(meta, shard_bytes), np.int64)
    ids = spark.sparkContext.broadcast(begins)

    @F.pandas_udf("int")
    def shard_of(doc: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(ids.value, doc.to_numpy(), "right").astype(np.int32))

    hot = own.where(F.col("n") > total * HOT_SHARE).drop("n")
    rest = own.where(F.col("n") <= total * HOT_SHARE).drop("n")
    # a hot digest is found by the broadcast, and its rows don't go through the join by digest, which gathers them
    marked = base.join(F.broadcast(hot.withColumn("met", F.lit(True))), "sha", "left")
    cold = F.when(F.col("met").isNull(), F.col("sha")).otherwise(F.concat(F.lit("-"), F.xxhash64("id", "url").cast("string")))
    marked = marked.withColumn("key", cold).join(rest.select(F.col("sha").alias("key"), F.col("owner_id").alias("_id"), F.col("owner_url").alias("_url"), F.lit(True).alias("_met")), "key", "left")
    marked = marked.select("id", "url", "sha", "size", "payload", F.coalesce("met", "_met", F.lit(False)).alias("owned"), F.when(F.col("met"), F.col("owner_id")).otherwise(F.col("_id")).alias("owner_id"), F.when(F.col("met"), F.col("owner_url")).otherwise(F.col("_url")).alias("owner_url"))
    revisit = F.col("owned") & ~(F.col("id").eqNullSafe(F.col("owner_id")) & F.col("url").eqNullSafe(F.col("owner_url")))
    lean = marked.withColumn("revisit", revisit).withColumn("sha1", F.sha1("payload")).withColumn("payload", F.when(~F.col("revisit"), F.col("payload"))).withColumn("shard", shard_of(F.coalesce("id", F.lit(-(1 << 63)))))
    order = [F.col(c).asc_nulls_first() for c in ("shard", "id", "url", "sha")]
    sorted_rows = lean.repartitionById(len(begins) + 1, F.col("shard")).sortWithinPartitions(*order)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(MANIFEST))
    staging = f"{uri}/_temporary/{uuid.uuid4().hex}"
    staged = common.written(sorted_rows.mapInArrow(_written(staging, roll_bytes, date, schema), MANIFEST), "staged")
    return commit(spark, uri, staged, staging)


def commit(spark: SparkSession, uri: str, staged: DataFrame, staging: str) -> DataFrame:
    """Moves what the tasks have reported to its names, then writes the manifest, then removes what was left."""

    def move(batches):
        fs, folder = pyarrow.fs.FileSystem.from_uri(uri)
        for b in batches:
            for name, source in zip(b["name"], b["staged"], strict=True):
                if fs.get_file_info(source).type != pyarrow.fs.FileType.NotFound:  # moved by an attempt before
                    fs.move(source, f"{folder}/{name}")
            yield b.drop(columns="staged")

    kept = ", ".join(x for x in MANIFEST.split(", ") if not x.startswith("staged"))
    manifest = f"{uri}/manifest.parquet"
    moved = common.written(staged.mapInPandas(move, kept), "moved")
    moved.write.mode("overwrite").parquet(manifest)
    jvm = spark.sparkContext._jvm
    left = jvm.org.apache.hadoop.fs.Path(staging)
    left.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(left, True)
    return spark.read.schema(kept).parquet(manifest)


def is_committed(spark: SparkSession, path: str) -> bool:
    mark = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest.parquet/_SUCCESS")
    return mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(mark)


class BadRecord(ValueError):
    pass


def members(stream) -> Iterator[tuple[int, bytes]]:
    """(place in the file, content) of each gzip member, read by chunks."""
    unpacker, parts, data = zlib.decompressobj(31), [], stream.read(CHUNK)
    read, begin = len(data), 0
    while data:
        parts.append(unpacker.decompress(data))
        if unpacker.eof:
            yield begin, b"".join(parts)
            data = unpacker.unused_data
            begin, unpacker, parts = read - len(data), zlib.decompressobj(31), []
            if not data:
                data = stream.read(CHUNK)
                read += len(data)
        else:
            data = stream.read(CHUNK)
            read += len(data)
    if begin != read:
        raise BadRecord(f"the member at {begin} is cut short")


def parsed(content: bytes) -> tuple[dict[str, str], bytes]:
    """Headers, by names in lower case, and block of a record whose block digest holds."""
    head, _, rest = content.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    headers = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}
    block = rest[: int(headers["content-length"])]
    if not first.startswith("WARC/") or len(rest) != len(block) + 4:
        raise BadRecord("not one whole record")
    if headers.get("warc-block-digest", "") != "sha1:" + base32(hashlib.sha1(block).digest()):
        raise BadRecord(f"block digest of {headers.get('warc-record-id')}")
    return headers, block


def unpacked(name: str, at: int, content: bytes, payloads: bool) -> dict | None:
    headers, block = parsed(content)
    if headers["warc-type"] not in ("response", "revisit"):
        return None
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(next(x for x in http.decode().split("\r\n") if x.startswith("Content-Length: "))[16:])
    digest = headers["warc-payload-digest"].removeprefix("sha1:")
    whole = headers["warc-type"] == "response"
    if whole and (len(payload) != size or base32(hashlib.sha1(payload).digest()) != digest):
        raise BadRecord(f"payload digest of {headers['warc-record-id']}")
    number = lambda k: int(headers[k]) if k in headers else None
    return {
        "file": name, "at": at, "record_type": headers["warc-type"], "record_id": headers["warc-record-id"], "url": headers["warc-target-uri"], "id": number("x-id"), "refers_to": number("x-refers-to-id"),
        "payload_bytes": size, "payload_digest": digest, "payload": payload if whole and payloads else None,
    }


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Records of a committed archive, with the payloads of responses; a digest that doesn't hold is an error."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    common.small_batches(spark)
    uri, schema = qualified(spark, path), to_arrow_schema(StructType.fromDDL(RECORDS))
    if not is_committed(spark, uri):
        raise FileNotFoundError(f"{path} holds no committed archive")
    manifest = spark.read.parquet(f"{uri}/manifest.parquet").select("name", "bytes", "records")

    def records(batches):
        fs, folder = pyarrow.fs.FileSystem.from_uri(uri)
        for b in batches:
            for name, due in zip(b["name"].to_pylist(), b["records"].to_pylist(), strict=True):
                held, size, n = [], 0, 0
                with fs.open_input_stream(f"{folder}/{name}", compression=None) as stream:
                    for at, content in members(stream):
                        row = unpacked(name, at, content, payloads)
                        if row is None:
                            continue
                        held.append(row)
                        size, n = size + len(row["payload"] or b"") + 300, n + 1
                        if size >= common.BATCH_BYTES or len(held) >= common.BATCH_ROWS:
                            yield pa.RecordBatch.from_pylist(held, schema)
                            held, size = [], 0
                if n != due:
                    raise BadRecord(f"{name} has {n} records, its manifest {due}")
                yield pa.RecordBatch.from_pylist(held, schema)

    files = max(1, min(manifest.count(), 1 << 16))
    return manifest.repartition(files, "name").mapInArrow(records, RECORDS)


#: The rules of write() and read() for the query: digests, and which of equal payloads answers for the others.
_BASE32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(h, {1 + 10 * group}, 10))::bigint >> {35 - 5 * k}) & 31) + 1)::int, 1)" for group in range(4) for k in range(8)
)
SQL = f"""
with p as (select page_id, coalesce(html, '') as body from pages),
d as (select page_id, strlen(body)::bigint as payload_bytes, sha1(body) as h, max(page_id) over (partition by body) as owner, row_number() over (partition by body order by page_id desc nulls last) as nth from p)
select page_id, payload_bytes, {_BASE32} as payload_digest, case when nth = 1 then 'response' else 'revisit' end as record_type, case when nth > 1 then owner end as refers_to from d
"""
