"""WARC archives as a PySpark Python data source, written and read.

Writing: a task writes its records to one new file per `max_file_bytes`, under a temporary name; the commit on the driver gives
the files of successful tasks their names, so lost or repeated tasks leave nothing behind. A record is a gzip member whose
extra field states the member's length.

Reading: files are packed into partitions by size. A reader inflates a record's headers first. Predicates on `record_type` and
on the columns that come from headers are pushed down and judged there; what fails, and payloads when the asked schema has no
`payload`, is skipped by seeking to the next member without inflating. Members without a length and plain .warc files are
read through as well.

Predicates are pushed by `read_archive(predicates=...)`, each call its own relation. With the option sparkFilters=true (and
spark.sql.python.filterPushdown.enabled) Spark's own filters are pushed down, too; that is no default, as Spark 4.1 keeps the last
pushed filters with the relation, so that two differently filtered uses of one DataFrame both get the filters of one.

With the option verify=true (`read_archive(verify=True)`) payloads are inflated, measured and hashed, whether the schema asks for
them or not: `payload_bytes` and `payload_digest` of responses are then those of the bytes read, and a record whose headers state
others fails the read. A record that ends early always does.

Repeated payloads: of the records with equal payloads of at least `min_payload_bytes` bytes the one with the smallest page_id is the
response, the others are revisits of it that hold no payload. Digests alone are grouped. If no more than `broadcast_rows` of them
repeat they go to the pages, which then aren't shuffled; else pages, with their payloads, are shuffled to them once.

Defined cases: a null html is an empty payload. A null url has no WARC-Target-URI and reads back as null; control characters
in urls are percent-encoded. A null page_id never is the smallest; a group of null ids only has responses only. Rows that repeat
the smallest page_id are responses too, so a payload shared by a third of all rows has one response and no ties. Payloads may be of
any length (one at a time is in memory). An empty table makes an empty archive. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    LessThan,
    LessThanOrEqual,
    StringStartsWith,
    WriterCommitMessage,
)
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from treeloom.llm.common import materialize, table, work_path

HEADER_COLUMNS = "record_type string, record_id string, page_id long, target_uri string, payload_bytes long, payload_digest string, refers_to long"
SCHEMA = f"{HEADER_COLUMNS}, payload binary"
HEADER_NAMES = tuple(x.split()[0] for x in HEADER_COLUMNS.split(", "))
#: Predicates that the headers decide.
KINDS = {EqualTo: "=", In: "in", StringStartsWith: "starts", IsNotNull: "there", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}
BROADCAST_ROWS = 1 << 20
MAX_FILE_BYTES = 256 << 20
PARTITION_BYTES = 64 << 20
LEVEL = 4
_GZIP = struct.Struct("<2sBBIBBH2sHII")
_SL = b"SL"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_control = re.compile(r"[\x00-\x20\x7f]")


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}')}>"


def record_bytes(page_id, url: str | None, payload: bytes, refers_to=None) -> bytes:
    """One WARC record; a revisit if refers_to is given."""
    digest = base32_sha1(payload)
    revisit = refers_to is not None
    http = _HTTP + f"Content-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id, digest)}", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append("WARC-Target-URI: " + _control.sub(lambda m: f"%{ord(m[0]):02X}", url))
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}"]
    if revisit:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "WARC/1.1\r\n".encode() + "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(record: bytes) -> bytes:
    """A gzip member that states its own length in an extra field (zero: too long to state)."""
    deflate = zlib.compressobj(LEVEL, zlib.DEFLATED, -15)
    body = deflate.compress(record) + deflate.flush()
    size = _GZIP.size + len(body) + 8
    stated = (size, len(record)) if max(size, len(record)) < 1 << 32 else (0, 0)
    head = _GZIP.pack(b"\x1f\x8b", 8, 4, 0, 0, 255, 12, _SL, 8, *stated)
    return head + body + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)


def parse_headers(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:]) if k}


def header_row(h: dict[str, str]) -> dict:
    number = lambda k: int(h[k]) if k in h else None
    digest = h.get("warc-payload-digest")
    return {
        "record_type": h.get("warc-type"),
        "record_id": h.get("warc-record-id"),
        "page_id": number("x-page-id"),
        "target_uri": h.get("warc-target-uri"),
        "payload_bytes": number("x-payload-length"),
        "payload_digest": digest.removeprefix("sha1:") if digest else None,
        "refers_to": number("x-refers-to-page"),
    }


def _payload(block: bytes, row: dict, n: int) -> bytes | None:
    if len(block) < n:
        raise ValueError(f"a record of {n} bytes ends after {len(block)}: {row['record_id']}")
    if row["record_type"] == "revisit":
        return None
    return block.partition(b"\r\n\r\n")[2] if block.startswith(b"HTTP/") else block


def verified(row: dict) -> dict:
    """The row with size and digest of its payload, which have to be those that its headers state."""
    if (payload := row["payload"]) is not None:
        found = {"payload_bytes": len(payload), "payload_digest": base32_sha1(payload)}
        for name, value in found.items():
            if row[name] is not None and row[name] != value:
                raise ValueError(f"{name} is {value}, the headers say {row[name]}: {row['record_id']}")
        row |= found
    return row


class _Plain:
    """A stream's bytes with a small buffer, so that headers can be read without what follows."""

    def __init__(self, read):
        self.read_more, self.buffer = read, b""

    def until(self, mark: bytes) -> bytes | None:
        while mark not in self.buffer:
            more = self.read_more()
            if not more:
                return None
            self.buffer += more
        found, _, self.buffer = self.buffer.partition(mark)
        return found

    def take(self, n: int) -> bytes:
        parts = [self.buffer[:n]]
        self.buffer, left = self.buffer[n:], n - len(parts[0])
        while left > 0:
            more = self.read_more()
            if not more:
                break
            parts.append(more[:left])
            self.buffer, left = more[left:], left - len(parts[-1])
        return b"".join(parts)


def _gzip_records(f, size: int, wanted, with_payload: bool) -> Iterator[dict]:
    at = 0
    while at < size:
        f.seek(at)
        start = f.read(_GZIP.size)
        stated = 0
        if len(start) == _GZIP.size and start[3] & 4 and start[12:14] == _SL:
            stated = _GZIP.unpack(start)[9]
        if stated:
            inflate, skip = zlib.decompressobj(-15), _GZIP.size
        else:
            inflate, skip = zlib.decompressobj(31), 0
        f.seek(at + skip)
        left = {"n": size - at - skip}

        def more(inflate=inflate, left=left):
            while not inflate.eof:
                raw = inflate.unconsumed_tail
                if not raw:
                    raw = f.read(min(left["n"], 2048 if not with_payload else 65536))
                    left["n"] -= len(raw)
                    if not raw:
                        return b""
                out = inflate.decompress(raw, 65536)
                if out:
                    return out
            return b""

        stream = _Plain(more)
        head = stream.until(b"\r\n\r\n")
        if head is None:
            raise ValueError(f"a broken record at byte {at}")
        headers = parse_headers(head)
        row = header_row(headers)
        if wanted(row):
            if with_payload:
                n = int(headers.get("content-length", 0))
                row["payload"] = _payload(stream.take(n), row, n)
            yield row
        if stated:
            at += stated
            if at > size:
                raise ValueError(f"a record ends after the file, at byte {at}")
        else:
            while more():
                pass
            at = size - left["n"] - len(inflate.unused_data)


def _plain_records(f, size: int, wanted, with_payload: bool) -> Iterator[dict]:
    at = 0
    while at < size:
        f.seek(at)
        stream = _Plain(lambda: f.read(4096))
        head = stream.until(b"\r\n\r\n")
        if head is None:
            if not stream.buffer.strip():
                return
            raise ValueError(f"a broken record at byte {at}")
        headers = parse_headers(head)
        row, n, body = header_row(headers), int(headers.get("content-length", 0)), at + len(head) + 4
        if wanted(row):
            if with_payload:
                f.seek(body)
                row["payload"] = _payload(f.read(n), row, n)
            yield row
        at = body + n + 4
        if body + n > size:
            raise ValueError(f"a record ends after the file, at byte {body + n}")


@dataclass
class _Files(InputPartition):
    files: list[tuple[str, int]]


@dataclass
class _Written(WriterCommitMessage):
    files: list[str]


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


class WarcReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.schema, self.path = schema, options["path"]
        self.verify = options.get("verify") == "true"
        self.partition_bytes = int(options.get("partitionBytes", PARTITION_BYTES))
        self.tests: list[tuple[str, str, object]] = [tuple(t) for t in json.loads(options.get("predicates", "[]"))]
        for name, kind, _ in self.tests:
            if name not in HEADER_NAMES or kind not in KINDS.values():
                raise ValueError(f"no predicate: {name} {kind}")

    def wanted(self, row: dict) -> bool:
        for name, kind, value in self.tests:
            v = row[name]
            if v is None:
                return False
            if kind == "in":
                ok = v in value
            elif kind == "starts":
                ok = v.startswith(value)
            else:
                ok = {"=": lambda: v == value, "there": lambda: True, ">": lambda: v > value, ">=": lambda: v >= value, "<": lambda: v < value, "<=": lambda: v <= value}[kind]()
            if not ok:
                return False
        return True

    def partitions(self):
        fs, root = _open(self.path)
        infos = fs.get_file_info(pafs.FileSelector(root, recursive=True))
        files = sorted(((i.path, i.size) for i in infos if i.is_file and not i.base_name.startswith(("_", "."))), key=lambda x: (-x[1], x[0]))
        packed: list[_Files] = []
        room = 0
        for path, size in files:  # the largest first
            if not packed or room < size:
                packed.append(_Files([]))
                room = self.partition_bytes
            packed[-1].files.append((path, size))
            room -= size
        return packed or [_Files([])]

    def read(self, partition):
        fs, _ = _open(self.path)
        schema = to_arrow_schema(self.schema)
        with_payload = self.verify or "payload" in self.schema.fieldNames()
        rows, held = [], 0
        for path, size in partition.files:
            with fs.open_input_file(path) as f:
                records = _gzip_records if path.endswith(".gz") else _plain_records
                for row in records(f, size, self.wanted, with_payload):
                    if self.verify:
                        row = verified(row)
                        row = {n: row[n] for n in schema.names}
                    rows.append(row)
                    held += 200 + len(row.get("payload") or b"")
                    if len(rows) >= 4096 or held > 16 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)


class FilteringWarcReader(WarcReader):
    """Takes Spark's own filters, too."""

    def pushFilters(self, filters):  # noqa: N802
        for x in filters:
            name = ".".join(x.attribute) if getattr(x, "attribute", None) else ""
            if type(x) in KINDS and name in HEADER_NAMES:
                self.tests.append((name, KINDS[type(x)], getattr(x, "value", None)))
            else:
                yield x


class WarcWriter(DataSourceArrowWriter):
    """Takes page_id, url, html and refers_to (null: a response)."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        self.max_bytes = int(options.get("maxFileBytes", MAX_FILE_BYTES))

    def write(self, iterator):
        fs, root = _open(self.path)
        fs.create_dir(f"{root}/_temporary", recursive=True)
        names, out, written = [], None, 0
        for batch in iterator:
            for row in batch.to_pylist():
                if out is None:
                    names.append(f"part-{uuid.uuid4().hex}.warc.gz")
                    out, written = fs.open_output_stream(f"{root}/_temporary/{names[-1]}", compression=None), 0
                data = member(record_bytes(row["page_id"], row["url"], (row["html"] or "").encode("utf-8", "surrogatepass"), row["refers_to"]))
                out.write(data)
                written += len(data)
                if written >= self.max_bytes:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        return _Written(names)

    def commit(self, messages):
        fs, root = _open(self.path)
        fs.create_dir(root, recursive=True)
        if self.overwrite:
            for i in fs.get_file_info(pafs.FileSelector(root)):
                if i.is_file:
                    fs.delete_file(i.path)
        for m in messages:
            for name in m.files if m else []:
                fs.move(f"{root}/_temporary/{name}", f"{root}/{name}")
        self._clean(fs, root)

    def abort(self, messages):
        self._clean(*_open(self.path))

    def _clean(self, fs, root):
        if fs.get_file_info(f"{root}/_temporary").type == pafs.FileType.Directory:
            fs.delete_dir(f"{root}/_temporary")


class WarcDataSource(DataSource):
    """format("warc"): options path, partitionBytes, predicates (JSON), verify and sparkFilters (reading), maxFileBytes (writing)."""

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        kind = FilteringWarcReader if self.options.get("sparkFilters") == "true" else WarcReader
        return kind(schema, self.options)

    def writer(self, schema, overwrite):
        return WarcWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcDataSource)


def write_archive(
    pages: DataFrame,
    path: str,
    *,
    min_payload_bytes: int = 0,
    broadcast_rows: int = BROADCAST_ROWS,
) -> None:
    """Appends a record per row of pages (page_id, url, html) to the archive at path."""
    spark = pages.sparkSession
    register(spark)
    html = F.coalesce("html", F.lit(""))
    digest = F.when(F.octet_length(html) >= min_payload_bytes, F.sha1(html.cast("binary")))
    keyed = pages.select("page_id", "url", "html", digest.alias("digest"))
    firsts = keyed.where("digest IS NOT NULL").groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    firsts = materialize(firsts.where("n > 1").select("digest", "first"), "warc-repeated")
    # small payloads get keys of their own, so that they don't meet in one task
    keyed = keyed.withColumn("digest", F.coalesce("digest", F.concat(F.lit("-"), F.xxhash64("page_id", "url").cast("string"))))
    if firsts.agg(F.count("*")).first()[0] <= broadcast_rows:
        firsts = F.broadcast(firsts)
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    out = keyed.join(firsts, "digest", "left").select("page_id", "url", "html", refers.alias("refers_to"))
    out.write.format("warc").option("path", path).mode("append").save()


def read_archive(
    spark: SparkSession, path: str, payload: bool = False, predicates: Sequence[tuple[str, str, object]] = (), verify: bool = False
) -> DataFrame:
    """The archive's records; without payload and verify no payload is inflated.

    predicates: (header column, one of = in starts there > >= < <=, value), all of which a record has to fulfil; nulls fulfil none.
    """
    register(spark)
    reader = spark.read.format("warc").schema(SCHEMA if payload else HEADER_COLUMNS)
    return reader.option("predicates", json.dumps(list(predicates))).option("verify", str(verify).lower()).load(path)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_path(spark, "warc")
    write_archive(table(spark, sf_dir, "pages"), path)
    # responses by their payloads, which are decoded and hashed; of revisits, which have none, only headers
    responses = read_archive(spark, path, predicates=[("record_type", "=", "response")], verify=True)
    revisits = read_archive(spark, path, predicates=[("record_type", "=", "revisit")])
    return responses.unionByName(revisits).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: SQL has no base32: the hexadecimal digest is dealt out five bits at a time.
OP10_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha1(h) AS x, min(page_id) OVER (PARTITION BY sha1(h)) AS first FROM p),
b AS (SELECT *, list_reduce(list_transform(string_split(regexp_replace(x, '(.)', '\\1 ', 'g'), ' ')[1:40], lambda c: list_extract(
  ['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101','1110','1111'], strpos('0123456789abcdef', c))), lambda a, c: a || c) AS bits FROM d)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[
    (16 * bits[5*i+1]::INT + 8 * bits[5*i+2]::INT + 4 * bits[5*i+3]::INT + 2 * bits[5*i+4]::INT + bits[5*i+5]::INT + 1)::INT]), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM b
"""
