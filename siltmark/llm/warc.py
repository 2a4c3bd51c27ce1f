"""WARC archives: a native writer, and a Python data source that plans files and skips what the filters rule out.

The writer is Spark's text writer with record separators as line ends, so archives land in any
file system that Spark writes to and are committed as its output is: a lost executor leaves no half archive behind.
The reader parses headers first; records whose type or headers do not match are skipped by their length, their
payload is neither read into memory nor decoded.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from siltmark.llm.common import has_columns, materialise, new_path

BREAK = "\r\n"
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "
DATE = "2024-01-01T00:00:00Z"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Digests with several pages whose table may be broadcast; a row is 60 bytes or so.
BROADCAST_ROWS = 100_000
SCHEMA = "record_type string, record_id string, page_id long, refers_to long, target_uri string, payload_digest string, payload_bytes long, digest_ok boolean, payload string, source_file string, source_offset long"
_NAMES = [c.split()[0] for c in SCHEMA.split(", ")]
_HEADER_OF = {"record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "payload_digest": "warc-payload-digest", "page_id": "x-page-id"}


def sha1_base32(data: Column) -> Column:
    """Bare upper-case base32 of the SHA-1 digest: 20 bits at a time from its hex digits."""
    digest = F.sha1(data)
    chars = []
    for i in range(8):
        v = F.conv(F.substring(digest, 1 + 5 * i, 5), 16, 10).cast("int")
        chars += [F.substring(F.lit(BASE32), F.shiftright(v, 15 - 5 * j).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for j in range(4)]
    return F.concat(*chars)


def plan_records(pages: DataFrame) -> DataFrame:
    """page_id, url, html, digest, bytes, and refers_to: null for responses, else the response's page_id.

    Of records with equal payloads, the one with the largest page_id is the response; rows that repeat that page_id are responses too.
    A null page_id never answers for others unless all of its payload's are null, and then all are responses. Null html is an empty payload.
    """
    has_columns(pages, "page_id", "url", "html")
    html = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"), sha1_base32(html).alias("digest"), F.octet_length(html).cast("long").alias("bytes"))
    groups = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("c"), F.max("page_id").alias("response")).where("c > 1").select("digest", "response")
    groups = materialise(groups, "groups")  # small or large, it is written once and counted from its footers
    other = F.when((F.col("response") != F.col("page_id")) | (F.col("page_id").isNull() & F.col("response").isNotNull()), F.col("response"))
    if groups.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(groups), "digest", "left").withColumn("refers_to", other).drop("response")
    # payloads are not dealt by digest, as one may be that of a third of all pages: ids and digests are, in a join that adaptive execution can split
    ids = materialise(rows.select("page_id", "digest"), "ids")
    marks = ids.join(groups, "digest").withColumn("refers_to", other).where("refers_to IS NOT NULL").select(F.col("page_id").alias("_page"), F.col("digest").alias("_digest"), "refers_to").distinct()
    return rows.join(marks, F.col("page_id").eqNullSafe(F.col("_page")) & (F.col("digest") == F.col("_digest")), "left").drop("_page", "_digest")


def _clean(c: Column) -> Column:
    return F.regexp_replace(c, r"[\r\n\t ]", "%20")


def _urn(c: Column) -> Column:
    h = F.md5(c.cast("string").cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-"), F.substring(h, 13, 4), F.lit("-"), F.substring(h, 17, 4), F.lit("-"), F.substring(h, 21, 12), F.lit(">"))


def write_warc(pages: DataFrame, path: str) -> None:
    """Write one record for each row of `pages` (page_id, url, html); the payload of revisits is not stored again."""
    rows = plan_records(pages)
    revisit = F.col("refers_to").isNotNull()
    http = F.concat(F.lit(HTTP_HEAD).cast("binary"), F.col("bytes").cast("string").cast("binary"), F.lit(BREAK + BREAK).cast("binary"))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("html")))
    line = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(BREAK)), F.lit(""))
    head = F.concat(
        F.lit("WARC/1.1" + BREAK),
        F.when(revisit, F.lit("WARC-Type: revisit" + BREAK)).otherwise(F.lit("WARC-Type: response" + BREAK)),
        line("WARC-Record-ID", _urn(F.coalesce(F.col("page_id").cast("string"), F.lit("none")))),
        F.lit(f"WARC-Date: {DATE}{BREAK}"),
        line("WARC-Target-URI", _clean(F.col("url"))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" + BREAK)).otherwise(F.lit("")),
        line("WARC-Refers-To", _urn(F.col("refers_to"))),
        line("X-Refers-To-Page-ID", F.col("refers_to").cast("string")),
        line("X-Page-ID", F.col("page_id").cast("string")),
        line("X-Payload-Length", F.col("bytes").cast("string")),
        F.lit("Content-Type: application/http;msgtype=response" + BREAK),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit(BREAK),
    )
    record = F.concat(head.cast("binary"), block).cast("string")
    rows.select(record.alias("value")).write.option("lineSep", BREAK + BREAK).text(path)


@dataclass
class WarcFile(InputPartition):
    path: str

    def __init__(self, path: str) -> None:
        self.path = path


def _fs(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


class WarcReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path = options["path"]
        self.payload = options.get("payload", "full")
        if self.payload not in ("full", "verify", "none"):
            raise ValueError("payload is full, verify or none")
        self.types: set[str] | None = None
        self.headers: list[tuple[str, set[str]]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Take equality and membership of the record type and of columns that are plain headers; Spark keeps the rest."""
        for f in filters:
            column = f.attribute[0] if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 else None
            if column not in _HEADER_OF:
                yield f
                continue
            values = {str(v) for v in (f.value if isinstance(f, In) else [f.value])}
            if column == "record_type":
                self.types = values if self.types is None else self.types & values
            else:
                prefix = "sha1:" if column == "payload_digest" else ""
                self.headers.append((_HEADER_OF[column], {prefix + v for v in values}))

    def partitions(self) -> list[InputPartition]:
        fs, path = _fs(self.path)
        info = fs.get_file_info(path)
        found = [info] if info.is_file else fs.get_file_info(pafs.FileSelector(path, recursive=True))
        name = lambda i: i.path.rsplit("/", 1)[-1]
        files = [i for i in found if i.is_file and i.size and name(i)[0] not in "._"]
        prefix = self.path[: len(self.path) - len(path)] if self.path.endswith(path) else ""
        # Spark reads one partition at least
        return [WarcFile(prefix + i.path) for i in sorted(files, key=lambda i: -i.size)] or [WarcFile("")]

    def read(self, partition: WarcFile) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0
        for row in read_records(partition.path, self.types, self.headers, self.payload) if partition.path else ():
            rows.append(row)
            held += len(row[8] or "")
            if len(rows) >= 2000 or held > 8 << 20:
                yield _batch(rows)
                rows, held = [], 0
        if rows:
            yield _batch(rows)


_TYPES = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_(), pa.string(), pa.string(), pa.int64()]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], _NAMES)


def read_records(path: str, types: set[str] | None = None, headers: list[tuple[str, set[str]]] | tuple = (), payload: str = "full") -> Iterator[tuple]:
    """Records of one archive (plain or gzip members) as tuples of the source's columns."""
    fs, local = _fs(path)
    with fs.open_input_file(local) as raw:
        f = io.BufferedReader(raw, 1 << 20)
        if f.peek(2)[:2] == b"\x1f\x8b":
            f = io.BufferedReader(gzip.GzipFile(fileobj=f), 1 << 20)
        at = 0
        while line := f.readline():
            begin, at = at, at + len(line)
            if not line.strip():
                continue
            if not line.startswith(b"WARC/"):
                raise ValueError(f"{path}: no record at byte {begin}")
            head = {}
            while (line := f.readline()).strip():
                at += len(line)
                k, _, v = line.partition(b":")
                head[k.strip().lower().decode()] = v.strip().decode("utf-8", "replace")
            at += len(line)
            size = int(head.get("content-length", 0))
            at += size
            kind = head.get("warc-type")
            if (types is not None and kind not in types) or any(head.get(h) not in want for h, want in headers):
                _skip(f, size)
                continue
            ok, text, length = None, None, head.get("x-payload-length")
            digest = head.get("warc-payload-digest", "").removeprefix("sha1:") or None
            if payload == "none" or kind != "response":
                _skip(f, size)
            else:
                body = f.read(size)
                if head.get("content-type", "").startswith("application/http"):
                    body = body.partition(b"\r\n\r\n")[2]
                length = len(body)
                ok = digest is not None and base64.b32encode(hashlib.sha1(body).digest()).decode() == digest
                text = body.decode("utf-8", "replace") if payload == "full" else None
            number = lambda v: int(v) if v not in (None, "") else None
            yield (kind, head.get("warc-record-id"), number(head.get("x-page-id")), number(head.get("x-refers-to-page-id")), head.get("warc-target-uri"), digest, number(length), ok, text, path, begin)


def _skip(f: io.BufferedReader, size: int) -> None:
    """Past a payload: by seeking where it is not in the buffer, which a plain file does without reading."""
    if size > 0:
        f.seek(size, io.SEEK_CUR)


class WarcSource(DataSource):
    """`spark.read.format("warc").load(path)`; option payload: full, verify (length and digest only) or none."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:  # noqa: ANN001
        return WarcReader(self.options)


def read_warc(spark: SparkSession, path: str, payload: str = "full") -> DataFrame:
    """Records of the archives under `path`, of which there may be none. Filters on record_type, record_id, target_uri, payload_digest and page_id are pushed into the reader.

    Turns on the session's switch for pushdown into Python data sources, which is read when the query is planned.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").option("payload", payload).load(path)


def warc_round_trip(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to and digest_ok of each row of `pages` (page_id, url, html), written and read back.

    Two scans, each of which skips the other's records by their headers: payloads of responses are read and hold their digests, or the query ends
    with an error; those of revisits are not. Defined cases: a null html is an empty payload; a null url leaves its header out; a null page_id stays
    null; repeated rows come back repeated, with the response's page_id all as responses; other columns are ignored; no pages give no rows.
    """
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write_warc(pages, path)
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "digest_ok"]
    broken = F.raise_error(F.concat(F.lit("payload and digest differ in "), "source_file", F.lit(" at "), F.col("source_offset").cast("string"))).cast("string")
    responses = read_warc(spark, path, "verify").where("record_type = 'response'").withColumn("payload_digest", F.when(F.col("digest_ok"), F.col("payload_digest")).otherwise(broken))
    revisits = read_warc(spark, path, "none").where("record_type = 'revisit'")
    return responses.select(*columns).unionByName(revisits.select(*columns))
