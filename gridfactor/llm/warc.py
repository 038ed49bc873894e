"""WARC archives: written by Spark's text sink, read by a PySpark Python data source.

A record ends with two CRLFs, so archives are text files with that line separator: any store that Spark
can write to will do.  Records of equal payloads are written once as `response`; the others are
`revisit` records, which name the response and have its digest but no payload.

Only ids, digests, targets and sizes are shuffled to find the revisits; payloads stay where they were read
as long as the revisits' keys are few enough to be broadcast (they are counted).

The reader plans one partition for about `split_mb` MB of whole files (records can't be found from the
middle of a file).  It parses header blocks first; the predicates that Spark pushes down (record type and
page id, equal or in a list) and the options decide whether a payload is decoded or skipped by its
Content-Length (a compressed one is inflated, but neither decoded nor verified).  Records of other writers
have their id in `record_id` and no page_id; a digest other than a SHA-1 isn't verified.  Spark asks a Python
source for its filters only with spark.sql.python.filterPushdown.enabled, which read_warc() sets.

Nulls: a null html is an empty payload, a null url is written as an empty target; line breaks in a URL
are percent-encoded.  A null page_id is kept as null; it comes after all others when the smallest is
looked for.  If several rows have the smallest page_id of a payload, each of them is a response.
Empty tables give archives without records.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition

from .common import counted, shared_dir

END = "\r\n\r\n"
PAGE = "urn:page:"
SCHEMA = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload string, record_id string"
#: The digits of base 32, by value, and those of F.conv().  Fixed values of RFC 4648 and of Spark.
BASE32, CONV32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "0123456789ABCDEFGHIJKLMNOPQRSTUV"


def sha1_base32(data: Column) -> Column:
    """The bare upper-case base32 SHA-1 of binary data: 8 groups of 20 bits."""
    digits = F.sha1(data)
    groups = [F.lpad(F.conv(F.substring(digits, 5 * k + 1, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*groups), CONV32, BASE32)


def warc_records(pages: DataFrame) -> DataFrame:
    """pages(page_id, url, html): page_id, record_type and `record`, the text of its WARC record."""
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", F.regexp_replace(F.regexp_replace(F.coalesce("url", F.lit("")), "\r", "%0D"), "\n", "%0A").alias("url"), html.alias("html"), sha1_base32(html.cast("binary")).alias("digest"))
    light = rows.select("page_id", "url", "digest", F.octet_length("html").alias("size"))
    shared = counted(light.groupBy(F.col("digest").alias("d")).agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("d", "first"))
    revisits = light.join(shared, F.col("digest") == F.col("d")).where(~F.col("page_id").eqNullSafe(F.col("first")))
    again = counted(revisits.select(F.col("page_id").alias("p"), F.col("digest").alias("q")).distinct())
    responses = rows.join(again, F.col("page_id").eqNullSafe(F.col("p")) & (F.col("digest") == F.col("q")), "left_anti").withColumn("size", F.octet_length("html"))
    return _records(responses, "response").unionByName(_records(revisits, "revisit"))


def _records(rows: DataFrame, kind: str) -> DataFrame:
    """rows(page_id, url, digest, size), responses with html, revisits with the first page's id."""
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit(END))
    block = F.concat(http, F.col("html")) if kind == "response" else http
    first = F.concat(F.lit(f"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: <{PAGE}"), F.coalesce(F.col("first").cast("string"), F.lit("")), F.lit(">\r\n")) if kind == "revisit" else F.lit("")
    head = F.concat(
        F.lit(f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <{PAGE}"),
        F.coalesce(F.col("page_id").cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Date: 1970-01-01T00:00:00Z\r\nWARC-Target-URI: "),
        F.col("url"),
        F.lit("\r\nWARC-Payload-Digest: sha1:"),
        F.col("digest"),
        F.lit("\r\n"),
        first,
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "),
        F.octet_length(block).cast("string"),
        F.lit(END),
    )
    return rows.select("page_id", F.lit(kind).alias("record_type"), F.concat(head, block).alias("record"))


def write_warc(pages: DataFrame, path: str, per_file: int = 20_000) -> None:
    """Write pages as gzipped WARC files of at most per_file records."""
    warc_records(pages).select("record").write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", per_file).text(path)


class Files(InputPartition):
    def __init__(self, files: list[str]):
        self.files = files


def _opened(path: str) -> io.BufferedIOBase:
    import pyarrow.fs as fs

    store, name = fs.FileSystem.from_uri(path)
    raw = io.BufferedReader(store.open_input_stream(name, compression=None), 1 << 20)
    return gzip.GzipFile(fileobj=raw) if name.endswith(".gz") else raw


def _head(file: io.BufferedIOBase, limit: int | None = None) -> tuple[str, dict[str, str], int]:
    """A header block: its first line, its fields by lower-case name, its bytes.  At the file's end the first line is empty."""
    first, fields, size = "", {}, 0
    while limit is None or size < limit:
        line = file.readline()
        size += len(line)
        text = line.decode("utf-8").rstrip("\r\n")
        if not first:
            if not line:
                break
            first = text
        elif not text:
            break
        else:
            name, _, value = text.partition(":")
            fields[name.strip().lower()] = value.strip()
    return first, fields, size


def _id(field: str | None) -> int | None:
    """The page id in a record id of write_warc(); None for others."""
    inside = (field or "").strip("<>")
    digits = inside.removeprefix(PAGE)
    return int(digits) if inside.startswith(PAGE) and digits.lstrip("-").isdecimal() else None


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.files = json.loads(options["files"])  # (path, bytes)
        self.split = int(options.get("split_mb", 64)) << 20
        self.payload = options.get("payload", "true") == "true"
        self.verify = options.get("verify", "true") == "true"
        self.types: set[str] | None = None
        self.pages: set[int] | None = None

    def pushFilters(self, filters):
        for f in filters:
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if values is not None and f.attribute == ("record_type",):
                self.types = values if self.types is None else self.types & values
            elif values is not None and f.attribute == ("page_id",):
                self.pages = values if self.pages is None else self.pages & values
            else:
                yield f

    def partitions(self):
        out, size = [[]], 0
        for path, n in sorted(self.files):
            if size and size + n > self.split:
                out.append([])
                size = 0
            out[-1].append(path)
            size += n
        return [Files(x) for x in out]

    def read(self, partition) -> Iterator[tuple]:
        for path in partition.files:
            with _opened(path) as file:
                yield from self.records(file)

    def records(self, file: io.BufferedIOBase) -> Iterator[tuple]:
        while True:
            first, fields, _ = _head(file)
            if not first:
                return
            if not first.startswith("WARC/"):
                raise ValueError(f"no WARC record where one should start: {first[:60]!r}")
            left, kind, page = int(fields["content-length"]), fields.get("warc-type"), _id(fields.get("warc-record-id"))
            if (self.types is not None and kind not in self.types) or (self.pages is not None and page not in self.pages):
                self.skip(file, left + 4)
                continue
            http, n = {}, 0
            if fields.get("content-type", "").startswith("application/http"):
                _, http, n = _head(file, left)
            left -= n
            size, text = int(http.get("content-length", left)), None
            algorithm, _, digest = fields.get("warc-payload-digest", "").rpartition(":")
            if kind != "revisit" and (self.payload or self.verify):
                data = file.read(left)
                if self.verify and algorithm == "sha1":
                    have = base64.b32encode(hashlib.sha1(data).digest()).decode()
                    if have != digest or len(data) != size:
                        raise ValueError(f"record {fields.get('warc-record-id')}: the payload has digest {have} and {len(data)} bytes, its header says {digest} and {size}")
                text = data.decode("utf-8", "replace") if self.payload else None
                left = 0
            self.skip(file, left + 4)
            yield page, fields.get("warc-target-uri") or None, kind, size, digest, _id(fields.get("warc-refers-to")), text, fields.get("warc-record-id")

    @staticmethod
    def skip(file: io.BufferedIOBase, n: int) -> None:
        while n > 0 and (got := len(file.read(min(n, 1 << 20)))):
            n -= got


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options)


def read_warc(spark: SparkSession, path: str, payload: bool = True, verify: bool = True, split_mb: int = 64) -> DataFrame:
    """The records of the WARC files in a folder.  payload: decode the text of responses; verify: compare digests with the stored payloads."""
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "length").collect()  # a row per file
    files = json.dumps([[r.path if "://" in r.path else r.path.replace("file:", "file://", 1), r.length] for r in listed])
    return spark.read.format("warc").option("files", files).option("payload", str(payload).lower()).option("verify", str(verify).lower()).option("split_mb", split_mb).load()


def op6_warc(pages: DataFrame) -> DataFrame:
    spark = pages.sparkSession
    path = shared_dir(spark)
    write_warc(pages, path)
    return read_warc(spark, path, payload=False, split_mb=16).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")
