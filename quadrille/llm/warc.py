"""WARC archives: writing captures, reading them back, and assembling transactions.

``write_captures`` writes a request, a response (or revisit) and a metadata record per page; the
records of a capture are tied by WARC-Concurrent-To, and Spark's own text writer makes the files
(gzip, records ended by CRLF CRLF, at most CAPTURES_PER_FILE captures each), so any file system
that Spark knows will do. ``read_records`` parses archives by Content-Length, one record at a time.
``assemble`` brings the records that name the same capture together in one shuffle and gives one
nested row each.

Of pages with equal payloads of at least MIN_REVISIT_BYTES bytes, the one with the smallest page_id
is written in full and the others as revisits. Defined results: null html is an empty payload; a
null url is an empty target; line ends in urls become spaces, and blanks around
urls go; a page without a page_id is a
response unless an equal payload has an id; repeated rows are captures of their own, and rows that
share the smallest page_id are all responses (revisits then name the page, not one of its records); a capture whose request or metadata is missing has
null there; of several records of a kind in one capture the smallest by id is kept; an empty table
gives no archive rows.
"""

from __future__ import annotations

import gzip
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pages, shared_folder, small_or_shuffled

MIN_REVISIT_BYTES = 100
CAPTURES_PER_FILE = 2000
DATE = "2024-01-01T00:00:00Z"
RECORD = "warc_type string, record_id string, concurrent_to string, target_uri string, refers_to string, content_type string, http_head string, payload_bytes long, payload_digest string, payload binary"


def first_holders(captures: DataFrame) -> DataFrame:
    """(digest, first_page, alone): payloads that several pages hold, with the smallest of their ids, and whether one row has it."""
    ids = captures.where(F.col("_bytes") >= MIN_REVISIT_BYTES).groupBy("_digest", "page_id").agg(F.count(F.lit(1)).alias("n"))
    held = ids.groupBy(F.col("_digest").alias("digest")).agg(F.min("page_id").alias("first_page"), F.min_by("n", "page_id").alias("first_n"), F.sum("n").alias("n"))
    return held.where("n > 1 and first_page is not null").select("digest", "first_page", (F.col("first_n") == 1).alias("alone"))


def _record(kind: str, headers: list, block) -> F.Column:
    parts = [F.lit(f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Date: {DATE}\r\n")]
    for name, value in headers:
        parts += [F.lit(f"{name}: "), value, F.lit("\r\n")]
    return F.concat(*parts, F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit("\r\n\r\n"), block)


def write_captures(pages_: DataFrame, path: str) -> None:
    """Archives of the pages (page_id, url, html) below ``path``."""
    page = pages_.select("page_id", F.regexp_replace(F.coalesce("url", F.lit("")), "[\r\n]", " ").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    page = page.withColumns({"_bytes": F.octet_length("html").cast("long"), "_digest": F.sha2("html", 256)})
    held = small_or_shuffled(first_holders(page))
    revisit = F.col("first_page").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_page"))
    number = F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("null")))
    page = page.withColumn("number", F.monotonically_increasing_id()).join(held, (F.col("_digest") == F.col("digest")) & (F.col("_bytes") >= MIN_REVISIT_BYTES), "left")
    # a response that revisits refer to has the id that they name
    named_so = F.col("alone") & F.col("page_id").eqNullSafe(F.col("first_page"))
    page = page.withColumn("id", F.when(named_so, F.concat(number, F.lit(">"))).otherwise(F.concat(number, F.lit(":"), F.col("number").cast("string"), F.lit(">"))))
    named = lambda kind: F.concat(F.lit(f"<urn:{kind}:"), F.substring_index("id", "<urn:", -1))
    uri = ("WARC-Target-URI", F.col("url"))
    digest = ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("_digest")))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("_bytes").cast("string"), F.lit("\r\n\r\n"))
    asked = ("Content-Type", F.lit("application/http; msgtype=request"))
    answered = ("Content-Type", F.lit("application/http; msgtype=response"))
    together = ("WARC-Concurrent-To", F.col("id"))
    host = F.regexp_extract("url", "://([^/?#]*)", 1)
    capture = F.concat_ws(
        "\r\n\r\n",
        _record("request", [("WARC-Record-ID", named("request")), together, uri, asked], F.concat(F.lit("GET "), F.col("url"), F.lit(" HTTP/1.1\r\nHost: "), host, F.lit("\r\n\r\n"))),
        F.when(
            revisit,
            _record("revisit", [("WARC-Record-ID", F.col("id")), uri, ("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), ("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("first_page").cast("string"), F.lit(">"))), digest, answered], http),
        ).otherwise(_record("response", [("WARC-Record-ID", F.col("id")), uri, digest, answered], F.concat(http, F.col("html")))),
        _record("metadata", [("WARC-Record-ID", named("metadata")), together, uri, ("Content-Type", F.lit("application/warc-fields"))], F.concat(F.lit("page-id: "), F.coalesce(F.col("page_id").cast("string"), F.lit("null")), F.lit("\r\n"))),
    )
    page.select(capture.alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", CAPTURES_PER_FILE).text(path)


def parse(archive: bytes) -> Iterator[tuple]:
    """The records of one archive, gzipped or not, in the order of RECORD."""
    stream = io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(archive)), 1 << 20) if archive[:2] == b"\x1f\x8b" else io.BytesIO(archive)
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            continue  # the blank lines that end a record
        head: dict[str, str] = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            head[name.strip().lower()] = value.strip(" \t\r\n")
        block = stream.read(int(head.get("content-length", 0)))
        http, payload = b"", block
        if head.get("content-type", "").startswith("application/http"):
            http, _, payload = block.partition(b"\r\n\r\n")
        size, digest = len(payload), None
        if head.get("warc-type") == "revisit":
            lengths = [int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
            size, digest = (lengths or [0])[0], head.get("warc-payload-digest", "").removeprefix("sha256:")
        elif head.get("warc-type") == "response":
            digest = hashlib.sha256(payload).hexdigest()
        yield head.get("warc-type"), head.get("warc-record-id"), head.get("warc-concurrent-to"), head.get("warc-target-uri"), head.get("warc-refers-to"), head.get("content-type"), http.decode("utf-8", "replace"), size, digest, payload


def read_records(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row per record of the archives below ``path``; without ``payloads`` those of responses are null."""
    spec = [x.split(" ") for x in RECORD.split(", ")]
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    schema = pa.schema([(n, kinds[t]) for n, t in spec])

    def rows(batches):
        for batch in batches:
            for archive in batch.column("content"):
                part, held = [], 0
                for rec in parse(archive.as_py()):
                    part.append(rec if payloads or rec[0] == "metadata" else (*rec[:-1], None))
                    held += len(part[-1][-1] or b"") + 500
                    if held > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part), schema.types)], schema=schema)
                        part, held = [], 0
                if part:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part), schema.types)], schema=schema)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{gz,warc,txt}").load(path)
    return files.select("content").mapInArrow(rows, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One row per capture: its id and the nested request, response (or revisit) and metadata.

    All records are keyed by the capture's main record, which requests and metadata name in
    concurrent_to; grouping by that key is the three-way join in one shuffle.
    """
    rec = F.struct("record_id", *[c for c in records.columns if c not in ("record_id", "concurrent_to")])
    main = F.col("warc_type").isin("response", "revisit")
    return records.groupBy(F.coalesce("concurrent_to", "record_id").alias("capture_id")).agg(
        F.min(F.when(F.col("warc_type") == "request", rec)).alias("request"),
        F.min(F.when(main, rec)).alias("response"),
        F.min(F.when(F.col("warc_type") == "metadata", rec)).alias("metadata"),
    ).where("response is not null")


def page_number(urn) -> F.Column:
    return F.nullif(F.regexp_extract(urn, r"^<urn:page:(-?\d+)", 1), F.lit("")).cast("long")


def op2(spark, sf_dir: str) -> DataFrame:
    path = shared_folder(spark)
    write_captures(pages(spark, sf_dir).select("page_id", "url", "html"), path)
    captures = assemble(read_records(spark, path, payloads=False))
    return captures.select(
        page_number("capture_id").alias("page_id"),
        F.col("response.payload_bytes").alias("payload_bytes"),
        F.col("response.payload_digest").alias("payload_digest"),
        F.col("response.warc_type").alias("record_type"),
        page_number("response.refers_to").alias("refers_to"),
        F.col("request.target_uri").alias("url"),
    )


SQL = f"""
with p as (select page_id, trim(regexp_replace(coalesce(url, ''), '[\\r\\n]', ' ', 'g'), ' ' || chr(9)) url, strlen(coalesce(html, ''))::bigint payload_bytes, sha256(coalesce(html, '')) payload_digest from pages),
q as (select *, case when payload_bytes >= {MIN_REVISIT_BYTES} then min(page_id) over (partition by payload_digest) end f from p)
select page_id, url, payload_bytes, payload_digest, case when f is not null and page_id is distinct from f then 'revisit' else 'response' end record_type,
       case when page_id is distinct from f then f end refers_to from q
"""
