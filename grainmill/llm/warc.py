"""WARC archives: written by Spark's text sink, read from whole files, and assembled into one nested row per capture.

Each page makes a request, a response (or revisit) and a metadata record, which name the response in WARC-Concurrent-To.
The sink writes a record as one row and closes it by the two line breaks that the format asks for, so archives can be
written to any store Spark knows, and a lost task's files are never committed. The reader follows Content-Length, so a
payload may hold anything, and takes plain and gzip files of any number of members. A file is read as one row: files
have to stay within the 2 GB that a row may hold. The writer starts a new one after ``per_file`` records, and writes pages of more
than ``PAGE_BYTES`` apart, by classes of size, of which each step has ``STEP`` times fewer records in a file.

Of captures with equal payloads (of ``least`` bytes at least) that of the smallest page id is the response, others revisit
it. Defined results: a null html is an empty payload, very long ones are one record like others; a null url leaves its header
out, line breaks in one are escaped; null ids come last in their group and are written as no id; rows repeated in full are
captures of their own, with record ids of their own, and all responses where they are the first of their group; other columns
are ignored, whatever their names; an empty table gives an empty archive and result.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import lean, new_path, written

CRLF = "\r\n"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
CAPTURES = ("response", "revisit", "resource")
PAGE_BYTES, STEP = 1 << 16, 8


def sha1_base32(data: Column) -> Column:
    """The form of WARC digests: 160 bits as 32 letters, from 8 groups of 5 hexadecimal digits."""
    digits = F.sha1(data)
    letter = lambda v, shift: F.substring(F.lit(BASE32), F.shiftright(v, shift).bitwiseAND(F.lit(31)) + 1, F.lit(1))
    group = lambda v: F.concat(*[letter(v, s) for s in (15, 10, 5, 0)])
    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: group(F.conv(F.substring(digits, i * 5 + 1, F.lit(5)), 16, 10).cast("int"))), "")


def _record(kind: str | Column, headers: list[tuple[str, Column]], block: Column) -> Column:
    """A whole record without the line breaks at its end; headers that are null are left out."""
    lines = F.concat_ws(CRLF, F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), F.lit(kind) if isinstance(kind, str) else kind), *[F.concat(F.lit(f"{name}: "), value) for name, value in headers], F.concat(F.lit("Content-Length: "), F.octet_length(block)))
    return F.concat(lines, F.lit(CRLF * 2), block)


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 0, date: str = "2024-01-01T00:00:00Z", per_file: int = 30_000, compression: str = "gzip") -> None:
    """Write ``pages`` to archives under ``path``."""
    page = pages.select(F.col(id_col).alias("id"), F.regexp_replace(F.regexp_replace(F.col(url_col), "\r", "%0D"), "\n", "%0A").alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    page = page.withColumn("digest", sha1_base32(F.col("html").cast("binary"))).withColumn("bytes", F.octet_length("html"))
    order = F.struct(F.col("id").isNull().alias("none"), "id", F.coalesce("url", F.lit("")).alias("url"))
    page = page.withColumn("o", order)
    size = F.greatest(F.lit(0), F.ceil(F.log(float(STEP), F.col("bytes") / PAGE_BYTES))).cast("int")
    page = page.withColumn("size", F.when(F.col("bytes") > PAGE_BYTES, size).otherwise(0))
    # of payloads that occur more than once or are large; equal payloads have equal sizes
    groups = page.groupBy("digest", "o").agg(F.count("*").alias("k"), F.max("size").alias("size"), F.max("bytes").alias("bytes"))
    groups = groups.groupBy("digest").agg(F.min("o").alias("first"), F.sum("k").alias("n"), F.max("k").alias("k"), F.max("size").alias("size"), F.max("bytes").alias("bytes"))
    groups = written(groups.where("n > 1 OR size > 0"), "payloads")
    sizes = sorted({0} | {r["size"] for r in groups.select("size").distinct().collect()})
    shared = groups.where((F.col("n") > 1) & (F.col("bytes") >= least))
    page = page.join(shared.select("digest", "first"), "digest", "left")
    if groups.where("k > 1").isEmpty():
        page = page.withColumn("no", F.lit(1))
    else:  # rows repeated in full are numbered, for their record ids
        again = groups.where("k > 1").select("digest")
        number = F.row_number().over(Window.partitionBy("digest", "o").orderBy("digest"))
        page = page.join(again, "digest", "left_anti").withColumn("no", F.lit(1)).unionByName(page.join(again, "digest", "left_semi").withColumn("no", number))

    name = lambda kind, o, no: F.concat(F.lit("<urn:uuid:"), F.regexp_replace(F.md5(F.concat_ws("|", F.lit(kind), o["id"].cast("string"), o["url"], F.col("digest"), F.when(no > 1, no.cast("string"))).cast("binary")), "^(.{8})(.{4})(.{4})(.{4})", "$1-$2-$3-$4-"), F.lit(">"))
    revisit = F.col("first").isNotNull() & (F.col("o") != F.col("first"))
    own = lambda kind: name(kind, F.col("o"), F.col("no"))
    capture = own("capture")
    uri, on = ("WARC-Target-URI", F.col("url")), ("WARC-Date", F.lit(date))
    only = lambda c: F.when(revisit, c)
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("bytes"), F.lit(CRLF * 2))
    where = F.regexp_extract("url", r"(?s)^.*?://[^/?#]*(/[^#]*)", 1)
    request = F.concat(F.lit("GET "), F.coalesce(F.when(where == "", "/").otherwise(where), F.lit("/")), F.lit(f" HTTP/1.1{CRLF}Host: "), F.coalesce(F.regexp_extract("url", r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), F.lit(CRLF * 2))
    field = lambda key, value: F.concat(F.lit(f"{key}: "), value.cast("string"), F.lit(CRLF))
    fields = F.concat_ws("", field("page-id", F.col("id")), field("payload-length", F.col("bytes")), field("refers-to-page", only(F.col("first.id"))))
    records = F.array(
        _record("request", [("WARC-Record-ID", own("request")), ("WARC-Concurrent-To", capture), uri, on, ("Content-Type", F.lit("application/http; msgtype=request"))], request),
        _record(
            F.when(revisit, "revisit").otherwise("response"),
            [("WARC-Record-ID", capture), uri, on, ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))), ("WARC-Refers-To", only(name("capture", F.col("first"), F.lit(1)))), ("WARC-Profile", only(F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))), ("Content-Type", F.lit("application/http; msgtype=response"))],
            F.concat(head, F.when(revisit, "").otherwise(F.col("html"))),
        ),
        _record("metadata", [("WARC-Record-ID", own("metadata")), ("WARC-Concurrent-To", capture), uri, on, ("Content-Type", F.lit("application/warc-fields"))], fields),
    )
    for k in sizes:
        rows = page.where(F.col("size") == k) if len(sizes) > 1 else page
        rows.select(F.explode(records).alias("value")).write.mode("append").option("maxRecordsPerFile", max(3, per_file // STEP**k)).text(path, compression=compression, lineSep=CRLF * 2)


class _Plain:
    """The bytes of an archive, unpacked a piece at a time."""

    def __init__(self, raw: bytes):
        self.raw, self.at, self.gz = raw, 0, None
        self.packed, self.buffer, self.start = raw[:2] == b"\x1f\x8b", bytearray(), 0

    def _more(self) -> bool:
        if self.at >= len(self.raw):
            return False
        piece = self.raw[self.at : self.at + (1 << 18)]
        if not self.packed:
            self.at += len(piece)
            self.buffer += piece
            return True
        if self.gz is None:
            self.gz = zlib.decompressobj(31)
        self.buffer += self.gz.decompress(piece)
        self.at += len(piece) - len(self.gz.unused_data)
        if self.gz.eof:
            self.gz = None
        return True

    def _trim(self) -> None:
        if self.start > 1 << 20:
            del self.buffer[: self.start]
            self.start = 0

    def until(self, end: bytes) -> bytes | None:
        """What stands before ``end``, which is passed over."""
        self._trim()
        at = self.start
        while (i := self.buffer.find(end, at)) < 0:
            at = max(self.start, len(self.buffer) - len(end) + 1)
            if not self._more():
                return None
        out, self.start = bytes(self.buffer[self.start : i]), i + len(end)
        return out

    def take(self, n: int) -> bytes:
        while len(self.buffer) - self.start < n and self._more():
            pass
        out, self.start = bytes(self.buffer[self.start : self.start + n]), self.start + n
        return out


def parse_records(raw: bytes) -> Iterator[tuple[list[tuple[str, str]], bytes]]:
    """(headers, block) of each record; names are in lower case."""
    data = _Plain(raw)
    while (head := data.until(b"\r\n\r\n")) is not None:
        lines = [x for x in head.decode("utf-8", "replace").split(CRLF) if x]
        if not lines or not lines[0].startswith("WARC/"):
            continue
        headers = [(k.strip().lower(), v.strip()) for k, _, v in (x.partition(":") for x in lines[1:])]
        yield headers, data.take(int(dict(headers).get("content-length") or 0))


_SCHEMA = "record_id string, type string, target_uri string, date string, concurrent_to array<string>, refers_to string, payload_digest string, content_type string, http_head string, payload_bytes bigint, computed_digest string, fields map<string,string>, payload binary"
_ARROW = pa.schema([("record_id", pa.string()), ("type", pa.string()), ("target_uri", pa.string()), ("date", pa.string()), ("concurrent_to", pa.list_(pa.string())), ("refers_to", pa.string()), ("payload_digest", pa.string()), ("content_type", pa.string()), ("http_head", pa.string()), ("payload_bytes", pa.int64()), ("computed_digest", pa.string()), ("fields", pa.map_(pa.string(), pa.string())), ("payload", pa.binary())])


def _row(headers: list[tuple[str, str]], block: bytes, payload: bool) -> tuple:
    h = dict(headers)
    http, body, fields = None, block, None
    if h.get("content-type", "").startswith("application/http"):
        head, _, body = block.partition(b"\r\n\r\n")
        http = head.decode("utf-8", "replace")
    elif h.get("content-type") == "application/warc-fields":
        fields = [(k.strip(), v.strip()) for k, _, v in (x.partition(":") for x in block.decode("utf-8", "replace").split(CRLF) if x)]
        fields = list(dict(fields).items())
    digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
    declared = h.get("warc-payload-digest")
    return (h.get("warc-record-id"), h.get("warc-type"), h.get("warc-target-uri"), h.get("warc-date"), [v for k, v in headers if k == "warc-concurrent-to"], h.get("warc-refers-to"), declared.partition(":")[2] if declared else None, h.get("content-type"), http, len(body), digest, fields, body if payload else None)


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """A row for each record of the archives under ``path``; without ``payload`` the bodies are measured and left."""

    @lean
    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0

        def out() -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True)) or [[] for _ in _ARROW]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _ARROW, strict=True)], schema=_ARROW)

        for batch in batches:
            for raw in batch.column(0):
                for headers, block in parse_records(raw.as_py()):
                    rows.append(_row(headers, block, payload))
                    held += len(block) if payload else 0
                    if len(rows) >= 5000 or held > 1 << 22:
                        yield out()
                        rows, held = [], 0
        yield out()

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(parse, _SCHEMA)


def transactions(records: DataFrame) -> DataFrame:
    """One nested row per capture: the capture, and the request and metadata records that concurrent-to ties to it, whichever side names the other."""
    is_capture = F.col("type").isin(*CAPTURES)
    captures, others = records.where(is_capture), records.where(~is_capture)
    tie = lambda x, own, other: x.select(F.col("record_id").alias(own), F.explode("concurrent_to").alias(other))
    ties = tie(others, "other", "capture").unionByName(tie(captures, "capture", "other")).distinct()
    nested = F.struct("record_id", "target_uri", "date", "content_type", "http_head", "fields", "payload_bytes")
    tied = ties.join(others.select(F.col("record_id").alias("other"), "type", nested.alias("r")), "other")
    by_id = lambda a, b: F.when(a["record_id"] < b["record_id"], -1).when(a["record_id"] > b["record_id"], 1).otherwise(0)
    of = lambda kind: F.array_sort(F.collect_list(F.when(F.col("type") == kind, F.col("r"))), by_id)
    found = tied.groupBy(F.col("capture").alias("record_id")).agg(of("request").alias("requests"), of("metadata").alias("metadata"))
    whole = captures.join(found, "record_id", "left")
    return whole.select(F.struct(*[F.col(c) for c in records.columns]).alias("capture"), "requests", "metadata")


def archive_round_trip(pages: DataFrame, path: str | None = None, least: int = 0) -> DataFrame:
    """Write ``pages``, read the archives back and give a row for each capture."""
    spark = pages.sparkSession
    path = path or new_path(spark, "warc")
    write_warc(pages, path, least=least)
    whole = transactions(written(read_warc(spark, path, payload=False).drop("payload"), "records"))
    field = lambda key: F.try_element_at(F.try_element_at("metadata", F.lit(1))["fields"], F.lit(key)).cast("bigint")
    revisit = F.col("capture.type") == "revisit"
    return whole.select(
        field("page-id").alias("page_id"),
        F.when(revisit, field("payload-length")).otherwise(F.col("capture.payload_bytes")).alias("payload_bytes"),
        F.when(revisit, F.col("capture.payload_digest")).otherwise(F.col("capture.computed_digest")).alias("payload_digest"),
        F.col("capture.type").alias("record_type"),
        field("refers-to-page").alias("refers_to"),
        F.col("capture.target_uri").alias("target_uri"),
    )
