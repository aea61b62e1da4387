"""WARC archives: a Python data source that prunes records by their headers, and a writer.

``WarcDataSource`` ("sparkrag_warc") plans partitions of files: an archive that has an index of record offsets beside it
(``<archive>.idx``, which ``write`` makes) is split between records, about every ``SPLIT_BYTES``; others are one partition
each. It takes predicates (=, <=>, IN, prefixes, comparisons, IS [NOT] NULL) on columns that headers decide and on single
headers, reads the headers of a record first and leaves its payload compressed when a predicate rejects it or when option
``payload`` is "false". It can do that because the writer gives each gzip member the "sl" extra field of the WARC standard
(annex on compression), which tells the member's length; members without it are inflated to find their end. Spark asks a
Python source for predicates only while "spark.sql.python.filterPushdown.enabled" is set, which ``read`` does.

``write`` makes one archive a task: a ``response`` record for each payload, or a ``revisit`` record (headers
only) where another row with the same payload of at least ``least`` bytes has a larger id.

Fixed results: a null payload is an empty one; a null url is left out of the headers; rows that repeat a page_id
are records of their own, and those that share the largest id of their payload are all responses; a null
page_id never becomes the one referred to unless all are null (then all are responses); an empty table gives no
archive; further columns are ignored.
"""

from __future__ import annotations

import base64
import json
import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, StringStartsWith

from .common import cut, lean, open_fs, work_dir, write_file

SCHEMA = "record_type string, record_id string, target_uri string, date string, content_type string, content_length long, headers map<string,string>, payload binary"
#: Columns on which predicates are decided from the headers alone.
HEADER_OF = {"record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "date": "warc-date", "content_type": "content-type"}
FILE_BYTES = 1 << 30
SPLIT_BYTES = 64 << 20
#: Repeated digests (about 50 bytes each) that are broadcast to the payloads; above this, rows meet them in a shuffle.
MOST_REPEATED = 200_000
DATE = "2024-01-01T00:00:00Z"


def gzip_member(data: bytes, level: int = 6) -> bytes:
    """One gzip member with its own compressed and full length in an "sl" extra field."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    size = 10 + 2 + 12 + len(body) + 8
    extra = b"sl" + struct.pack("<HII", 8, size & 0xFFFFFFFF, len(data) & 0xFFFFFFFF)
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", len(extra)) + extra + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def parse_headers(raw: bytes) -> dict[str, str]:
    lines = raw.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"no WARC record begins with {lines[0][:40]!r}")
    out: dict[str, str] = {}
    for line in lines[1:]:
        if line[:1] in " \t" and out:  # a folded line goes on with the last header
            last = next(reversed(out))
            out[last] += " " + line.strip()
        elif ":" in line:
            k, _, v = line.partition(":")
            out[k.strip().lower()] = v.strip()
    return out


def http_body(block: bytes) -> bytes:
    return block.partition(b"\r\n\r\n")[2]


class _File:
    """Forward reading of a file from ``start`` to ``end``, with a little read ahead."""

    def __init__(self, uri: str, start: int = 0, end: int | None = None):
        where, path = open_fs(uri)
        self.file, self.held, self.at = where.open_input_file(path), b"", 0
        self.file.seek(start)
        self.left = 1 << 62 if end is None else end - start

    def peek(self, n: int) -> bytes:
        while len(self.held) - self.at < n and (got := self.file.read(min(max(n, 1 << 18), self.left))):
            self.left -= len(got)
            self.held, self.at = self.held[self.at :] + got, 0
        return self.held[self.at : self.at + n]

    def take(self, n: int) -> bytes:
        got = self.peek(n)
        self.at += len(got)
        return got

    def give_back(self, rest: bytes) -> None:
        self.held, self.at = rest + self.held[self.at :], 0


def records(uri: str, wanted, start: int = 0, end: int | None = None) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """(headers, block) of each record between two offsets; ``wanted(headers)`` says True for the block, False for headers
    only, None to skip."""
    file = _File(uri, start, end)
    while head := file.peek(24):
        if head[:2] == b"\x1f\x8b":
            sized = len(head) == 24 and head[3] == 4 and head[12:14] == b"sl"
            if sized:
                member = file.take(struct.unpack_from("<I", head, 16)[0])
                inflate = zlib.decompressobj(-15)
                top, rest = b"", member[24:-8]
                while b"\r\n\r\n" not in top and rest:
                    top += inflate.decompress(rest, 2048)
                    rest = inflate.unconsumed_tail
                headers = parse_headers(top.partition(b"\r\n\r\n")[0])
                want = wanted(headers)
                if want is None:
                    continue
                block = None
                if want:
                    block = top.partition(b"\r\n\r\n")[2] + inflate.decompress(rest) + inflate.flush()
            else:
                inflate, whole = zlib.decompressobj(31), b""
                while not inflate.eof and (part := file.take(1 << 16)):
                    whole += inflate.decompress(part)
                file.give_back(inflate.unused_data)
                top, _, block = whole.partition(b"\r\n\r\n")
                headers = parse_headers(top)
                if (want := wanted(headers)) is None:
                    continue
        else:
            n = 1 << 12
            while b"\r\n\r\n" not in (got := file.peek(n)) and len(got) == n:
                n *= 2
            top, mark, _ = got.partition(b"\r\n\r\n")
            if not mark:
                if got.strip():
                    raise ValueError(f"{uri} ends within the headers of a record")
                return
            file.take(len(top) + 4)
            headers = parse_headers(top)
            block = file.take(int(headers.get("content-length", 0)) + 4)
            if (want := wanted(headers)) is None:
                continue
        yield headers, block[: int(headers.get("content-length", 0))] if want else None


class WarcDataSource(DataSource):
    """Options: ``files`` (a JSON list of URIs) or ``path`` (a folder), ``payload`` ("true"). A partition is a file or a part of one; each a file or a part of one."""

    @classmethod
    def name(cls) -> str:
        return "sparkrag_warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(dict(self.options))


#: What a predicate says about a header's value (None: the header is absent, which is null).
_TESTS = {
    EqualTo: lambda f, x: x is not None and x == f.value,
    EqualNullSafe: lambda f, x: x == f.value,
    In: lambda f, x: x is not None and x in f.value,
    IsNull: lambda f, x: x is None,
    IsNotNull: lambda f, x: x is not None,
    StringStartsWith: lambda f, x: x is not None and x.startswith(f.value),
    GreaterThan: lambda f, x: x is not None and x.encode() > f.value.encode(),
    GreaterThanOrEqual: lambda f, x: x is not None and x.encode() >= f.value.encode(),
    LessThan: lambda f, x: x is not None and x.encode() < f.value.encode(),
    LessThanOrEqual: lambda f, x: x is not None and x.encode() <= f.value.encode(),
}


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options, self.tests = options, []

    def pushFilters(self, filters):
        for f in filters:
            own = len(f.attribute) == 1 and f.attribute[0] in HEADER_OF or len(f.attribute) == 2 and f.attribute[0] == "headers" if hasattr(f, "attribute") else False
            if own and type(f) in _TESTS and (not hasattr(f, "value") or f.value is not None):
                self.tests.append((HEADER_OF.get(f.attribute[0], f.attribute[-1]), f))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        if "files" in self.options:
            files = json.loads(self.options["files"])
        else:
            from pyarrow import fs

            where, path = open_fs(self.options["path"])
            prefix = self.options["path"][: -len(path)] if self.options["path"].endswith(path) else "file://"
            files = sorted(prefix + x.path for x in where.get_file_info(fs.FileSelector(path)) if x.base_name.endswith((".warc", ".warc.gz")))
        out = []
        for uri in files:
            at = split_points(uri)
            out += [InputPartition((uri, a, b)) for a, b in zip([0, *at], [*at, None], strict=True)]
        return out

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        payloads = self.options.get("payload", "true").lower() != "false"

        def wanted(headers: dict[str, str]) -> bool | None:
            return payloads if all(_TESTS[type(f)](f, headers.get(k)) for k, f in self.tests) else None

        schema = pa.schema([("record_type", pa.string()), ("record_id", pa.string()), ("target_uri", pa.string()), ("date", pa.string()), ("content_type", pa.string()), ("content_length", pa.int64()), ("headers", pa.map_(pa.string(), pa.string())), ("payload", pa.binary())])
        rows, held = [], 0
        for uri, start, end in [partition.value] if partition else []:
            for h, block in records(uri, wanted, start, end):
                payload = block
                if block is not None and h.get("content-type", "").startswith("application/http"):
                    payload = http_body(block)
                rows.append({"record_type": h.get("warc-type"), "record_id": h.get("warc-record-id"), "target_uri": h.get("warc-target-uri"), "date": h.get("warc-date"), "content_type": h.get("content-type"), "content_length": int(h.get("content-length", 0)), "headers": list(h.items()), "payload": payload})
                held += 512 + len(payload or b"")
                if held > 8 << 20:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)


def split_points(uri: str) -> list[int]:
    """Offsets from the archive's index; none without one."""
    where, path = open_fs(uri + ".idx")
    try:
        with where.open_input_stream(path) as f:
            return json.loads(f.read())
    except FileNotFoundError:
        return []


def urn(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def plan_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 1000, most: int = MOST_REPEATED) -> DataFrame:
    """Each row with its payload's digest and, for revisits, the id of the response it refers to.

    Repeated digests and their largest ids are found on narrow rows (an aggregation that combines before its shuffle).
    Up to ``most`` of them are broadcast, so payloads stay where they are; more meet the payloads in a shuffled join, whose
    hot digests adaptive execution splits. Both ways give the same rows.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    same = rows.where(F.octet_length("payload") >= least).groupBy("digest").agg(F.max("page_id").alias("last_id"), F.count("*").alias("copies")).where("copies > 1").select("digest", "last_id")
    same = cut(pages.sparkSession, same, "repeated")
    joined = rows.join(F.broadcast(same) if same.count() <= most else same.hint("merge"), "digest", "left")
    return joined.select("page_id", "url", "payload", "digest", F.when(F.col("last_id") != F.coalesce("page_id", F.col("last_id") - 1), F.col("last_id")).alias("refers_to"))


def write(pages: DataFrame, folder: str, split: int = SPLIT_BYTES, **columns) -> list[str]:
    """Write archives below ``folder``, each with its index, and return their URIs (one or a few a task)."""
    spark = pages.sparkSession

    def archive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, out, size, at = TaskContext.get().partitionId(), [], None, 0, []

        def close() -> None:
            out.close()
            write_file(made[-1] + ".idx", json.dumps(at).encode())

        for batch in batches:
            for i in range(batch.num_rows):
                page_id, url, payload, digest, refers = (batch.column(k)[i].as_py() for k in range(5))
                if out is None or size > FILE_BYTES:
                    if out is not None:
                        close()
                    uri = f"{folder}/part-{part:05d}-{len(made):03d}-{os.urandom(4).hex()}.warc.gz"
                    where, local = open_fs(uri)
                    where.create_dir(local.rpartition("/")[0], recursive=True)
                    out, size, at = where.open_output_stream(local, compression=None), 0, []  # members are compressed one by one
                    made.append(uri)
                head = [("WARC-Type", "response" if refers is None else "revisit"), ("WARC-Record-ID", urn(page_id)), ("WARC-Date", DATE)]
                head += [("WARC-Target-URI", "".join(url.splitlines()))] if url is not None else []
                head += [("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()), ("Sparkrag-Payload-Sha1", digest), ("WARC-Page-Id", "" if page_id is None else str(page_id))]
                block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
                if refers is None:
                    block += payload
                else:
                    head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", urn(refers)), ("WARC-Refers-To-Page-Id", str(refers)), ("WARC-Payload-Length", str(len(payload)))]
                member = gzip_member(record([*head, ("Content-Type", "application/http; msgtype=response")], block))
                if size >= (at[-1] if at else 0) + split:
                    at.append(size)
                out.write(member)
                size += len(member)
        if out is not None:
            close()
        yield pa.record_batch([pa.array(made, pa.string())], names=["uri"])

    plan_records(pages, **columns).mapInArrow(lean(archive), "uri string").write.mode("overwrite").parquet(f"{folder}/manifest")
    return sorted(r.uri for r in spark.read.schema("uri string").parquet(f"{folder}/manifest").collect())


def read(spark: SparkSession, files: list[str], payload: bool = True) -> DataFrame:
    """All records of the archives; a filter on the result is pushed into the source."""
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    if not files:
        return spark.createDataFrame([], SCHEMA)
    return spark.read.format("sparkrag_warc").option("files", json.dumps(files)).option("payload", str(payload).lower()).load()


def sha1_hex(base32: str) -> str:
    return base64.b32decode(base32.removeprefix("sha1:")).hex()


def op9_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses are read with their payloads, whose digests are checked; of revisits, the headers only."""
    files = write(spark.read.parquet(f"{sf_dir}/pages.parquet"), work_dir(spark, "warc"))
    responses = read(spark, files).where("record_type = 'response'")
    revisits = read(spark, files, payload=False).where("record_type = 'revisit'")
    header = lambda name: F.col("headers")[name]
    stored = F.col("payload_digest")
    digest = F.lower(F.hex(F.unhex(header("sparkrag-payload-sha1"))))
    told = [F.expr("CAST(nullif(headers['warc-page-id'], '') AS LONG)").alias("page_id"), digest.alias("payload_digest"), "record_type", header("warc-refers-to-page-id").cast("long").alias("refers_to")]
    whole = responses.select(F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("own"), *told)
    whole = whole.withColumn("payload_digest", F.when(F.col("own") == stored, stored).otherwise(F.raise_error(F.lit("a payload doesn't have its record's digest")))).drop("own")
    short = revisits.select(header("warc-payload-length").cast("long").alias("payload_bytes"), *told)
    return whole.unionByName(short).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP9_SQL = """
WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
r AS (SELECT payload_digest, max(page_id) AS last_id FROM p WHERE payload_bytes >= 1000 GROUP BY 1 HAVING count(*) > 1)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN last_id IS NOT NULL AND last_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN last_id <> page_id THEN last_id END AS refers_to
FROM p LEFT JOIN r USING (payload_digest)
"""
