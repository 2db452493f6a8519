"""WARC archives: a deterministic sharded writer with a manifest, and a reader.

``write`` range-sorts records by id. Shard bounds are exact: running totals of the payload sizes in id order are cut
every ``shard_bytes``, so they depend on the records alone, not on partitions. Marks (which record repeats which) travel
through the same shuffle as the records, in front of them, so payloads are shuffled once. A task streams its shard into
files of its own temporary folder and starts a new file when the compressed size reaches ``roll_bytes``; every record is
one gzip member with regenerated headers and digests and no time stamp, so equal input gives equal files. The tasks'
rows form the manifest; only files named there are moved to their final names, and moving twice does no harm.

Paths are opened through Arrow's file systems (local or shared folders, S3, GCS, HDFS with its client libraries).

Defined cases: null html is an empty payload; null urls become ``about:blank``; of records with one id and payload all
have the same type; records without id come first and refer to others only if some record of the group has an id; an
empty table gives an empty manifest and no rows; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scorelake.llm.common import stored, text_bytes
from scorelake.session import scratch_path

LEAST_BYTES = 100                 # smaller payloads are never replaced by a reference
SHARD_BYTES = 64 << 20            # of payload
ROLL_BYTES = 16 << 20             # of a compressed file
HEADER_BYTES = 400                # what a record weighs besides its payload when shards are cut
DATE = "1970-01-01T00:00:00Z"

MANIFEST = "shard int, number int, name string, temporary string, records long, bytes long, sha256 string"
RECORDS = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary"


def _record_id(page_id, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{page_id} {digest}')}>"


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to, revisit: bool) -> bytes:
    """One uncompressed record."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m.group()):02X}", url or "about:blank")
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_record_id(page_id, digest)}",
            f"WARC-Date: {DATE}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha256:{digest}",
            f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
            "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if page_id is not None:
        head.append(f"WARC-Page-ID: {page_id}")
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                 f"WARC-Refers-To: {_record_id(refers_to, digest)}", f"WARC-Refers-To-Page-ID: {refers_to}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)      # gzip without name or time
    return packer.compress(data) + packer.flush()


class _Roller:
    """Files of one shard, written one after the other."""

    def __init__(self, root: str, folder: str, shard: int, roll_bytes: int):
        self.fs, self.base = arrow_fs.FileSystem.from_uri(root)
        self.folder, self.shard, self.roll_bytes = f"{self.base}/{folder}", shard, roll_bytes
        self.fs.create_dir(self.folder, recursive=True)
        self.number, self.out, self.rows = 0, None, []

    def add(self, data: bytes) -> None:
        if self.out is None:
            self.name = f"shard-{self.shard:07d}-{self.number:04d}.warc.gz"
            self.out = self.fs.open_output_stream(f"{self.folder}/{self.name}", compression=None)
            self.sha, self.bytes, self.records = hashlib.sha256(), 0, 0
        member = gzip_member(data)
        self.out.write(member)
        self.sha.update(member)
        self.bytes += len(member)
        self.records += 1
        if self.bytes >= self.roll_bytes:
            self.close()

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.rows.append((self.shard, self.number, self.name, f"{self.folder}/{self.name}", self.records, self.bytes,
                              self.sha.hexdigest()))
            self.number, self.out = self.number + 1, None


def _cuts(narrow: DataFrame, shard_bytes: int) -> list:
    """First ids of the shards after the first, from exact running totals; one per shard comes to the driver."""
    placed = stored(narrow.repartitionByRange("id").select(
        F.spark_partition_id().alias("part"), "id", (F.col("n") + HEADER_BYTES).alias("weight")), "warc-sizes")
    ordered = Window.partitionBy("part").orderBy(F.col("id").asc_nulls_first(), "weight").rowsBetween(Window.unboundedPreceding, -1)
    before = (placed.groupBy("part").agg(F.sum("weight").alias("total"))
              .withColumn("before", F.sum("total").over(Window.orderBy("part")) - F.col("total")).drop("total"))
    shard = F.floor((F.col("before") + F.coalesce(F.sum("weight").over(ordered), F.lit(0))) / shard_bytes)
    firsts = placed.join(before, "part").select("id", shard.alias("shard")).groupBy("shard").agg(F.min("id").alias("id"))
    return sorted(r.id for r in firsts.where("shard > 0 and id is not null").collect())


def write(pages: DataFrame, root: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
          least_bytes: int = LEAST_BYTES, shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Write archives below ``root`` (a URI); returns the committed manifest, which is stored there too."""
    spark = pages.sparkSession
    chosen = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), text_bytes(html_col).alias("payload"))
    digest = F.unhex(F.sha2("payload", 256))
    narrow = stored(chosen.select("id", digest.alias("digest"), F.length("payload").cast("long").alias("n")), "warc-digests")
    cuts = np.array(_cuts(narrow, shard_bytes), np.int64)

    @F.pandas_udf("int")
    def shard_of(ids: pd.Series) -> pd.Series:
        found = np.searchsorted(cuts, ids.fillna(np.iinfo(np.int64).min).astype(np.int64), side="right")
        return pd.Series(found.astype(np.int32))

    large = narrow.where(F.col("n") >= least_bytes)
    firsts = large.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("copies")).where("copies > 1 and first is not null")
    marks = large.join(firsts, "digest").where(~F.col("id").eqNullSafe(F.col("first"))).select("id", "digest", "first").distinct()
    rows = chosen.select("id", digest.alias("digest"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("first"), "url", "payload").unionByName(
        marks.withColumn("kind", F.lit(0)), allowMissingColumns=True).withColumn("shard", shard_of("id"))
    dealt = rows.repartition(2 * (len(cuts) + 1), "shard").sortWithinPartitions(
        "shard", F.col("id").asc_nulls_first(), "digest", "kind", F.col("url").asc_nulls_first())

    def pack(batches):
        folder, roller, mark, first = f"_temporary/{uuid.uuid4().hex}", None, None, None
        for batch in batches:
            columns = [batch.column(name) for name in ("shard", "id", "digest", "kind", "first", "url", "payload")]
            for shard, page, sha, kind, ref, url, payload in zip(*columns, strict=True):
                key = (page.as_py(), sha.as_py())
                if kind.as_py() == 0:
                    mark, first = key, ref.as_py()
                    continue
                if roller is None or roller.shard != shard.as_py():
                    if roller:
                        roller.close()
                        yield from _manifest_rows(roller)
                    roller = _Roller(root, folder, shard.as_py(), roll_bytes)
                again = key == mark
                roller.add(record(key[0], url.as_py(), payload.as_py(), key[1].hex(), first if again else None, again))
        if roller:
            roller.close()
            yield from _manifest_rows(roller)

    planned = stored(dealt.select("shard", "id", "digest", "kind", "first", "url", "payload").mapInArrow(pack, MANIFEST), "warc-planned")

    def move(batches):
        fs, base = arrow_fs.FileSystem.from_uri(root)
        for batch in batches:
            for name, temporary, size in zip(*(batch.column(k).to_pylist() for k in ("name", "temporary", "bytes")), strict=True):
                final = fs.get_file_info(f"{base}/{name}")
                if final.type != arrow_fs.FileType.File or final.size != size:
                    fs.move(temporary, f"{base}/{name}")
            yield batch

    planned.mapInArrow(move, MANIFEST).drop("temporary").write.parquet(f"{root}/manifest")
    fs, base = arrow_fs.FileSystem.from_uri(root)
    if fs.get_file_info(f"{base}/_temporary").type == arrow_fs.FileType.Directory:
        fs.delete_dir(f"{base}/_temporary")                  # what lost tasks have left
    return manifest(spark, root)


def _manifest_rows(roller: _Roller):
    if roller.rows:
        names = [part.split()[0] for part in MANIFEST.split(", ")]
        types = [pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*roller.rows, strict=True), types, strict=True)], names)


def manifest(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(MANIFEST.replace("temporary string, ", "")).parquet(f"{root}/manifest")


def members(stream, chunk: int = 1 << 20):
    """Uncompressed gzip members of a stream, one at a time."""
    unpacker, parts, data = zlib.decompressobj(31), [], b""
    while True:
        data = data or stream.read(chunk)
        if not data:
            if parts:
                raise ValueError("archive ends within a record")
            return
        parts.append(unpacker.decompress(data))
        data = unpacker.unused_data
        if unpacker.eof:
            yield b"".join(parts)
            unpacker, parts = zlib.decompressobj(31), []


def parse(data: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Headers, HTTP head and payload of a record; its block digest is checked."""
    head, _, rest = data.partition(b"\r\n\r\n")
    headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[:int(headers["Content-Length"])]
    if headers["WARC-Block-Digest"] != f"sha256:{hashlib.sha256(block).hexdigest()}":
        raise ValueError(f"damaged record {headers['WARC-Record-ID']}")
    http, _, payload = block.partition(b"\r\n\r\n")
    return headers, http, payload


def read(spark: SparkSession, root: str, payloads: bool = True) -> DataFrame:
    """Records of the files in the manifest; a revisit has the size and digest of the payload that it stands for."""
    def unpack(batches):
        fs, base = arrow_fs.FileSystem.from_uri(root)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows = []
                with fs.open_input_stream(f"{base}/{name}", compression=None) as stream:
                    for data in members(stream):
                        headers, http, payload = parse(data)
                        revisit = headers["WARC-Type"] == "revisit"
                        digest = headers["WARC-Payload-Digest"].removeprefix("sha256:")
                        size = int(re.search(rb"Content-Length: (\d+)", http).group(1)) if revisit else len(payload)
                        if not revisit and digest != hashlib.sha256(payload).hexdigest():
                            raise ValueError(f"damaged payload {headers['WARC-Record-ID']}")
                        own, other = headers.get("WARC-Page-ID"), headers.get("WARC-Refers-To-Page-ID")
                        rows.append((own and int(own), headers["WARC-Target-URI"], headers["WARC-Type"], other and int(other),
                                     digest, size, None if revisit or not payloads else payload))
                        if len(rows) >= 256:
                            yield _record_rows(rows)
                            rows = []
                if rows:
                    yield _record_rows(rows)

    names = manifest(spark, root).select("name")
    return names.repartition(max(1, names.count())).mapInArrow(unpack, RECORDS)


def _record_rows(rows: list[tuple]) -> pa.RecordBatch:
    names = [part.split()[0] for part in RECORDS.split(", ")]
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)


def roundtrip(pages: DataFrame, **options) -> DataFrame:
    """Write archives into the shared scratch folder and read them back, without payloads."""
    root = scratch_path(pages.sparkSession, "warc")
    if "://" not in root:
        root = f"file://{root.removeprefix('file:')}"
    write(pages, root, **options)
    return read(pages.sparkSession, root, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
