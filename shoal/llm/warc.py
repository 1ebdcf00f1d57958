"""WARC archives: writing page captures as transactions and assembling them again.

``write_archives`` writes for each row of pages a request, a response (or revisit) and a metadata record into WARC 1.1 files in
a folder that every executor reaches, each record a gzip member of its own. Files are bounded by bytes, not by records. Spark's
text writer does it, so it works on any file system and a lost task just writes its file again: a row is a file's members, and
the separator behind a row is a member's last byte (see ``_archive``). Of records with equal payloads the one with the largest
page_id is the response; the others are revisits of it. ``read_records`` parses archives member by member and checks payload
digests; ``assemble`` joins request, response or revisit and metadata through WARC-Concurrent-To and gives one nested row per
capture; ``resolve`` finds the response record that each revisit refers to and holds its digest and length against it.

A null html is an empty payload, a null url is left out. Every row is a capture of its own, also rows that repeat others; of
equal payloads with the same largest page_id one is the response. Null page ids come after all others. Requests or metadata
without their response come out with a null response. An empty table gives no rows. Extra columns are ignored. A record longer
than a file's bound is a file of its own.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
import zlib
from base64 import b32encode
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, release_memory, shared_dir

VERSION = "WARC/1.1"
CRLF = "\r\n"
#: Bytes of compressed members after which a file ends.
FILE_BYTES = 16 << 20
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

RECORD_SCHEMA = "record_id string, type string, concurrent_to string, refers_to string, target_uri string, date string, payload_digest string, http_length long, payload binary, fields map<string,string>"


def base32(hexed: Column) -> Column:
    """RFC 4648 base32 of 40 hexadecimal digits."""
    out = []
    for g in range(8):
        n = F.conv(F.substring(hexed, 5 * g + 1, 5), 16, 10).cast("int")
        out += [F.substring(F.lit(BASE32), F.shiftright(n, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*out)


def _uuid(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("\x00")) for p in parts)))
    return F.concat(F.lit("<urn:uuid:"), F.substring(h, 1, 8), *(x for a, n in ((9, 4), (13, 4), (17, 4), (21, 12)) for x in (F.lit("-"), F.substring(h, a, n))), F.lit(">"))


def _head(fields: list[tuple[str, Column]], block: Column) -> Column:
    """The text of a record without its end: version, named fields (null ones left out), length, block."""
    lines = [F.lit(VERSION + CRLF)]
    lines += [F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)), F.lit("")) for name, value in fields]
    return F.concat(*lines, F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit(CRLF + CRLF), block)


def _with_row(pages: DataFrame) -> DataFrame:
    """pages(page_id, url, html) with a text for each row that no other row has and that is the same in every run: of files their name
    and the row's number there, of other sources a number that is stored with them."""
    try:
        where = F.concat_ws(":", F.col("_metadata.file_path"), F.col("_metadata.row_index").cast("string"))
        return pages.select("page_id", "url", "html", where.alias("row"))
    except AnalysisException:  # not the plain scan of a table
        return materialise(pages.select("page_id", "url", "html", F.monotonically_increasing_id().cast("string").alias("row")), "pages")


def records(pages: DataFrame) -> DataFrame:
    """The records of pages(page_id, url, html), a string each."""
    clean = F.regexp_replace("url", "[\r\n\t ]", "%20")
    # both sides of the join are plain scans, so that a digest that a third of the rows share can be split
    p = _with_row(pages).select(F.col("page_id").cast("long").alias("page_id"), clean.alias("url"), F.coalesce("html", F.lit("")).alias("html"), "row")
    p = p.withColumn("sha1", F.sha1("html")).withColumn("bytes", F.octet_length("html").cast("long"))
    best = materialise(p.groupBy("sha1", "bytes").agg(F.max(F.struct("page_id", "row", "url")).alias("best")), "payloads")
    p = p.join(best.select("sha1", "bytes", "best"), ["sha1", "bytes"], "left")
    revisit = F.col("row") != F.col("best.row")
    digest = base32(F.col("sha1"))
    main = _uuid(F.lit("capture"), F.col("row"), F.col("sha1"))
    target = _uuid(F.lit("capture"), F.col("best.row"), F.col("sha1"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("bytes").cast("string"), F.lit(CRLF + CRLF))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("html")))
    when_revisit = lambda c: F.when(revisit, c)
    response = _head(
        [
            ("WARC-Type", F.when(revisit, "revisit").otherwise(F.lit("response"))),
            ("WARC-Record-ID", F.col("main")),
            ("WARC-Date", F.lit(DATE)),
            ("WARC-Target-URI", F.col("url")),
            ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), digest)),
            ("WARC-Profile", when_revisit(F.lit(PROFILE))),
            ("WARC-Refers-To", when_revisit(target)),
            ("WARC-Refers-To-Target-URI", when_revisit(F.col("best.url"))),
            ("Content-Type", F.lit("application/http; msgtype=response")),
        ],
        block,
    )
    host = F.regexp_extract(F.coalesce("url", F.lit("")), "^[a-zA-Z]+://([^/]*)", 1)
    asked = F.concat(F.lit("GET "), F.coalesce("url", F.lit("/")), F.lit(f" HTTP/1.1{CRLF}Host: "), host, F.lit(CRLF + CRLF))
    request = _head(
        [
            ("WARC-Type", F.lit("request")),
            ("WARC-Record-ID", _uuid(F.lit("request"), F.col("main"))),
            ("WARC-Concurrent-To", F.col("main")),
            ("WARC-Date", F.lit(DATE)),
            ("WARC-Target-URI", F.col("url")),
            ("Content-Type", F.lit("application/http; msgtype=request")),
        ],
        asked,
    )
    fields = F.coalesce(F.concat(F.lit("page-id: "), F.col("page_id").cast("string"), F.lit(CRLF)), F.lit(""))
    metadata = _head(
        [
            ("WARC-Type", F.lit("metadata")),
            ("WARC-Record-ID", _uuid(F.lit("metadata"), F.col("main"))),
            ("WARC-Concurrent-To", F.col("main")),
            ("WARC-Date", F.lit(DATE)),
            ("WARC-Target-URI", F.col("url")),
            ("Content-Type", F.lit("application/warc-fields")),
        ],
        fields,
    )
    return p.withColumn("main", main).select(F.explode(F.array(request, response, metadata)).alias("value"))


_EMPTY = gzip.compress(b"", 1, mtime=0)


def _archive(members: list[bytes]) -> bytes:
    """A file of members without its last byte, which is the zero that the writer puts behind every row: the highest byte of the
    last member's size. Where that is another one (16 MB and more), an empty member follows."""
    if members[-1][-1]:
        members = [*members, _EMPTY]
    return b"".join(members)[:-1]


def write_archives(pages: DataFrame, path: str, file_bytes: int = FILE_BYTES) -> str:
    """Write pages as archives into a folder; a file ends once its members reach the bytes."""
    end = (CRLF + CRLF).encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            for x in b.column("value"):
                held.append(gzip.compress(x.as_buffer().to_pybytes() + end, 1, mtime=0))
                size += len(held[-1])
                if size >= file_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([_archive(held)], pa.binary())], names=["value"])
                    held, size = [], 0
            release_memory()
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([_archive(held)], pa.binary())], names=["value"])

    files = records(pages).mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value"))
    files.write.option("lineSep", "\x00").option("compression", "none").option("maxRecordsPerFile", 1).text(path)
    return path


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(named fields in lower case, block) of each record of uncompressed archive bytes."""
    at, n = 0, len(data)
    while at < n:
        end = data.find(b"\r\n\r\n", at)
        if end < 0 or not data.startswith(b"WARC/", at):
            raise ValueError(f"no WARC record at byte {at}")
        fields = {}
        for line in data[at:end].split(b"\r\n")[1:]:
            name, _, value = line.partition(b":")
            fields[name.strip().lower().decode()] = value.strip().decode("utf-8", "replace")
        size = int(fields["content-length"])
        block = data[end + 4 : end + 4 + size]
        if len(block) != size:
            raise ValueError(f"the record at byte {at} is cut off")
        yield fields, block
        at = end + 4 + size + 4


def members(data: bytes) -> Iterator[bytes]:
    """The members of a gzip file, one at a time."""
    view = memoryview(data)
    at = 0
    while at < len(view):
        d = zlib.decompressobj(31)
        parts, step = [], 1 << 16
        while not d.eof and at < len(view):
            parts.append(d.decompress(view[at : at + step]))
            at += step
        if not d.eof:
            raise ValueError("the archive is cut off")
        at = min(at, len(view)) - len(d.unused_data)
        yield b"".join(parts)


def _row(fields: dict[str, str], block: bytes, with_payload: bool) -> tuple:
    kind = fields.get("warc-type", "")
    length, payload, named = None, None, {}
    if kind in ("response", "revisit"):
        head, _, body = block.partition(b"\r\n\r\n")
        for line in head.split(b"\r\n")[1:]:
            name, _, value = line.partition(b":")
            if name.strip().lower() == b"content-length":
                length = int(value)
        if kind == "response":
            got = b32encode(hashlib.sha1(body).digest()).decode()
            if "warc-payload-digest" in fields and fields["warc-payload-digest"] != f"sha1:{got}":
                raise ValueError(f"{fields.get('warc-record-id')}: the payload does not have the digest {fields['warc-payload-digest']}")
            payload = body if with_payload else None
            length = len(body)
    elif fields.get("content-type") == "application/warc-fields":
        for line in block.split(b"\r\n"):
            name, sep, value = line.partition(b":")
            if sep:
                named[name.strip().decode()] = value.strip().decode("utf-8", "replace")
    get = fields.get
    return (get("warc-record-id"), kind, get("warc-concurrent-to"), get("warc-refers-to"), get("warc-target-uri"), get("warc-date"), get("warc-payload-digest", "").removeprefix("sha1:") or None, length, payload, list(named.items()))


def read_records(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """A row for each record of the archives in a folder, whether a record a member or several."""
    types = [pa.string()] * 7 + [pa.int64(), pa.binary(), pa.map_(pa.string(), pa.string())]
    names = ["record_id", "type", "concurrent_to", "refers_to", "target_uri", "date", "payload_digest", "http_length", "payload", "fields"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
        for b in batches:
            for x in b.column("content"):
                rows, size = [], 0
                for member in members(x.as_buffer().to_pybytes()):
                    for fields, block in parse(member):
                        rows.append(_row(fields, block, with_payload))
                        size += len(block) if with_payload else 0
                        if len(rows) == 2000 or size > 4 << 20:
                            yield batch(rows)
                            rows, size = [], 0
                if rows:
                    yield batch(rows)
            release_memory()

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(run, RECORD_SCHEMA)


def assemble(found: DataFrame) -> DataFrame:
    """One nested row per capture: its id, request, response (or revisit) and metadata, joined by concurrent-to."""
    plain = ["record_id", "target_uri", "date"]
    shapes = {
        "request": (F.col("type") == "request", plain),
        "response": (F.col("type").isin("response", "revisit"), [*plain, "type", "refers_to", "payload_digest", "http_length", "payload"]),
        "metadata": (F.col("type") == "metadata", ["record_id", "date", "fields"]),
    }
    picks = [F.first(F.when(cond, F.struct(*cols)), ignorenulls=True).alias(name) for name, (cond, cols) in shapes.items()]
    return found.groupBy(F.coalesce("concurrent_to", "record_id").alias("capture_id")).agg(*picks)


def resolve(captures: DataFrame) -> DataFrame:
    """captures with ``origin`` (capture_id, fields of its metadata, payload_digest, http_length): the capture whose response a revisit
    refers to, found by WARC-Refers-To; null for responses. A revisit whose response is missing or has another digest or
    length is an error."""
    captures = materialise(captures, "captures")
    targets = captures.where("response.type = 'response'").select(F.col("response.record_id").alias("_target"), F.struct("capture_id", "metadata.fields", "response.payload_digest", "response.http_length").alias("origin"))
    out = captures.join(targets, captures["response.refers_to"] == targets["_target"], "left").drop("_target")
    same = F.col("response.payload_digest").eqNullSafe(F.col("origin.payload_digest")) & F.col("response.http_length").eqNullSafe(F.col("origin.http_length"))
    wrong = (F.col("response.type") == "revisit") & ~same
    broken = F.raise_error(F.concat(F.lit("a revisit does not match the response it refers to: "), F.col("capture_id")))
    return out.withColumn("origin", F.when(wrong, broken.cast(out.schema["origin"].dataType)).otherwise(F.col("origin")))


def round_trip(pages: DataFrame, with_payload: bool = False) -> DataFrame:
    """Write pages to archives in the shared folder, read these, assemble the captures, and resolve their revisits."""
    spark = pages.sparkSession
    path = write_archives(pages, f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}")
    return resolve(assemble(read_records(spark, path, with_payload)))
