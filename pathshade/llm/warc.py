"""WARC archives with revisit resolution.

Records are written by Spark's text writer (a record ends with two CRLFs, its
line separator) into gzip files of bounded size in the shared folder, and read
back from ``binaryFile`` by a streaming parser. Deduplication shuffles the
headers by payload digest, elects one original per digest, joins the revisits to
it, and writes a new archive with fresh headers in which revisits carry no
payload, but the page and the length of the one they stand for.

Payloads too short to be revisited take no part in that join, and digests that more than
1 in HOT headers carry are joined by broadcast: there are fewer than HOT of these.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pathshade.session import new_path, written

CRLF = "\r\n"
END = CRLF * 2
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FILE_BYTES = 32 << 20
#: Of gzip: little more than half the time of the default for 4 % more bytes.
LEVEL = "FOUR"
#: Pages of more than LARGE times the mean are laid out in files of their own, so that no
#: file of several records exceeds LARGE * FILE_BYTES.
LARGE = 16
HOT = 1024
BATCH_BYTES = 8 << 20


def uuid_of(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("\x1f", *parts))
    return F.concat_ws("-", *[F.substring(h, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def record(kind: Column, record_id: Column, page_id: Column, url: Column, payload: Column, digest: Column, refers: Column | None = None, date: str = DATE) -> Column:
    """The text of a WARC/1.1 record without the closing CRLFs. Revisits keep
    the HTTP head but no payload; null fields get no header. refers: the id, url, page and
    bytes of the record that a revisit stands for."""
    refers = refers if refers is not None else F.lit(None).cast("struct<id:string,url:string,page:bigint,bytes:bigint>")
    safe = lambda c: F.replace(F.replace(c, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    line = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)), F.lit(""))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{END}"))
    block = F.concat(http, F.when(kind == "revisit", F.lit("")).otherwise(payload))
    return F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        line("WARC-Type", kind),
        line("WARC-Record-ID", F.concat(F.lit("<urn:uuid:"), record_id, F.lit(">"))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", safe(url)),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), digest)),
        line("WARC-Profile", F.when(kind == "revisit", F.lit(PROFILE))),
        line("WARC-Refers-To", F.concat(F.lit("<urn:uuid:"), refers["id"], F.lit(">"))),
        line("WARC-Refers-To-Target-URI", safe(refers["url"])),
        line("X-Refers-To-Page-ID", refers["page"].cast("string")),
        line("X-Refers-To-Payload-Length", refers["bytes"].cast("string")),
        line("X-Page-ID", page_id.cast("string")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit(CRLF),
        block,
    )


def write_archive(records: DataFrame, path: str, per_file: int) -> str:
    """``records`` has the one string column ``record``."""
    records.write.options(**{"lineSep": END, "compression": "gzip", "zlib.compress.level": LEVEL, "maxRecordsPerFile": per_file}).text(path)
    return path


def parse(stream):
    """(headers, block) of each record of a decompressed WARC stream."""
    while True:
        line = stream.readline()
        if not line:
            return
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:60]!r}")
        headers = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode().partition(":")
            headers[name.lower()] = value.strip()
        yield headers, stream.read(int(headers["content-length"]))


FIELDS = "record_id string, page_id long, url string, record_type string, refers_id string, refers_page long, payload_digest string, payload_bytes long"


def read_archive(spark: SparkSession, path: str, payload: bool = False) -> DataFrame:
    """The records below ``path``: FIELDS and, if asked for, payload. Digest and
    length of a response are those of the payload read; of a revisit, those that its
    header names (null where it has none)."""
    names = [x.split()[0] for x in FIELDS.split(", ")] + ["payload"] * payload
    schema = pa.schema([(n, pa.int64() if n in ("page_id", "refers_page", "payload_bytes") else pa.string()) for n in names])

    def run(batches):
        for batch in batches:
            for content in batch.column("content"):
                rows, held = [], 0
                for h, block in parse(gzip.GzipFile(fileobj=io.BytesIO(content.as_buffer()))):
                    _, _, body = block.partition(b"\r\n\r\n")
                    own = h["warc-type"] != "revisit"
                    urn = lambda x: x[10:-1] if x else None
                    number = lambda x: int(x) if x else None
                    row = [urn(h["warc-record-id"]), number(h.get("x-page-id")), h.get("warc-target-uri"), h["warc-type"], urn(h.get("warc-refers-to")), number(h.get("x-refers-to-page-id"))]
                    row += [hashlib.sha256(body).hexdigest(), len(body)] if own else [h["warc-payload-digest"].partition(":")[2], number(h.get("x-refers-to-payload-length"))]
                    rows.append(row + [body.decode()] * payload)
                    held += len(body) if payload else 300
                    if held > BATCH_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").option("recursiveFileLookup", True).load(path).select("content")
    return files.mapInArrow(run, FIELDS + ", payload string" * payload)


def resolve(headers: DataFrame, least_bytes: int = 100) -> DataFrame:
    """record_id, record_type, refers (id, url, page and bytes of its original). Of equal payloads of
    at least ``least_bytes`` the smallest page_id is the original (null ids last,
    then by record id). ``headers`` is read several times: a written table."""
    long = headers.where(F.col("payload_bytes") >= least_bytes)
    rank = F.struct(F.col("page_id").isNull().alias("last"), "page_id", "record_id", "url", "payload_bytes")
    originals = long.groupBy("payload_digest").agg(F.min(rank).alias("o"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    originals = written(originals, "warc-originals")
    many = math.ceil((originals.agg(F.sum("copies")).first()[0] or 0) / HOT)
    hot = F.broadcast(originals.where(F.col("copies") > many).drop("copies"))  # fewer than HOT rows
    rest = originals.where(F.col("copies") <= many).drop("copies")
    joined = long.join(hot, "payload_digest").unionByName(long.join(hot, "payload_digest", "left_anti").join(rest, "payload_digest", "left"), allowMissingColumns=True)
    revisit = F.coalesce(F.col("o.record_id") != F.col("record_id"), F.lit(False))
    refers = F.struct(F.col("o.record_id").alias("id"), F.col("o.url").alias("url"), F.col("o.page_id").alias("page"), F.col("o.payload_bytes").alias("bytes"))
    found = joined.select("record_id", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, refers).alias("refers"))
    short = headers.where(F.col("payload_bytes") < least_bytes).select("record_id", F.lit("response").alias("record_type"))
    return found.unionByName(short, allowMissingColumns=True)


def archive_pages(pages: DataFrame, path: str) -> str:
    """One response record per row of (page_id, url, html); a null html is an
    empty payload."""
    html = F.coalesce("html", F.lit(""))
    total, rows, most = pages.agg(F.sum(F.octet_length(html)), F.count(F.lit(1)), F.max(F.octet_length(html))).first()
    mean = (total or 0) / max(rows, 1) + 500
    own = pages.select("page_id", "url", html.alias("html"), F.expr("uuid()").alias("id"))  # fixed once written
    text = record(F.lit("response"), F.col("id"), F.col("page_id"), F.col("url"), F.col("html"), F.sha2("html", 256)).alias("record")
    if (most or 0) <= LARGE * mean:
        return write_archive(own.select(text), path, max(1, int(FILE_BYTES / mean)))
    large = F.octet_length("html") > LARGE * mean
    write_archive(own.where(~large).select(text), f"{path}/part=0", max(1, int(FILE_BYTES / mean)))
    write_archive(own.where(large).select(text), f"{path}/part=1", max(1, int(LARGE * FILE_BYTES / most)))
    return path


def deduplicate_archive(spark: SparkSession, source: str, path: str, least_bytes: int = 100) -> str:
    """Write the archive ``source`` again with repeated payloads as revisits and
    fresh record ids. Its records come in the order of a hash, so that large ones do not
    meet in a file."""
    headers = written(read_archive(spark, source), "warc-headers")
    found = resolve(headers, least_bytes)
    total, rows = headers.agg(F.sum("payload_bytes"), F.count(F.lit(1))).first()
    per_file = max(1, int(FILE_BYTES / ((total or 0) / max(rows, 1) + 500)))
    full = read_archive(spark, source, payload=True).select("record_id", "page_id", "url", "payload_digest", "payload").join(found, "record_id")
    fresh = lambda c: F.when(c.isNotNull(), uuid_of(F.lit("fresh"), c))
    refers = F.col("refers").withField("id", fresh(F.col("refers.id")))
    text = record(F.col("record_type"), fresh(F.col("record_id")), F.col("page_id"), F.col("url"), F.col("payload"), F.col("payload_digest"), refers)
    return write_archive(full.select(text.alias("record")), path, per_file)


def deduplicated_pages(pages: DataFrame, least_bytes: int = 100) -> DataFrame:
    """Archive the pages, resolve revisits, read the archive back: page_id, url,
    payload_bytes, payload_digest, record_type, refers_to (page_id of the
    response that a revisit stands for).

    Null html is an empty payload; a null url or page_id has no header. Rows with
    equal page_id are records of their own. Line breaks in a URL are escaped.
    Pages of any length are kept whole; other columns are not looked at, whatever their
    names. An empty table gives no rows.
    """
    spark = pages.sparkSession
    raw = archive_pages(pages.select("page_id", "url", "html"), new_path(spark, "warc-raw"))
    records = read_archive(spark, deduplicate_archive(spark, raw, new_path(spark, "warc"), least_bytes))
    return records.select("page_id", "url", "payload_bytes", "payload_digest", "record_type", F.col("refers_page").alias("refers_to"))
