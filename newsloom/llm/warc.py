"""WARC archives of page captures: written, read back and assembled into transactions.

Each capture is a response (or a revisit, where an equal payload is stored already), a
request and a metadata record; the last two name the first in ``WARC-Concurrent-To``.
Archives are gzip files written and read by Spark's text source, cut at the version
line of each record, so any store Spark reaches will do and a task holds one record at
a time. A gzip file is read by one task from its start, which lets the reader put
records together again that hold the version line in their payload.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm.common import importable, saved
from newsloom.session import fresh_path

VERSION = "WARC/1.1\r\n"
#: Shorter payloads are always stored; most records in an archive.
LEAST_REVISIT, ARCHIVE_RECORDS = 1000, 30_000
#: Bytes of payloads that the reader hands on at once.
_CHUNK = 8 * 2**20


def _record(kind: str, rid: Column, headers: list[tuple[str, Column | str]], block: Column) -> Column:
    """One record without the two line ends behind it."""
    parts: list[Column] = [F.lit(f"{VERSION}WARC-Type: {kind}\r\nWARC-Record-ID: <"), rid, F.lit(">\r\n")]
    for name, value in headers:
        value = F.lit(value) if isinstance(value, str) else value
        line = F.concat(F.lit(f"{name}: "), F.regexp_replace(value, r"[\r\n]+", " "), F.lit("\r\n"))
        parts.append(F.coalesce(line, F.lit("")))
    parts += [F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit("\r\n\r\n"), block]
    return F.concat(*parts)


def captures(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """Pages with payload, its digest and, for a revisit, the page it refers to.

    Of payloads that are equal and have ``least`` bytes or more, the rows of the largest
    ``page_id`` are responses and all others revisits of it. Null html is empty. A null
    id is smaller than any other. Equal digests are counted before rows move; only
    digests of several pages are joined back.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        payload.alias("payload"),
        F.octet_length(payload).cast("long").alias("payload_bytes"),
        F.sha1(payload.cast("binary")).alias("payload_digest"),
    )
    shared = (
        rows.where(F.col("payload_bytes") >= least)
        .groupBy("payload_digest")
        .agg(F.max("page_id").alias("first_id"), F.max_by("url", "page_id").alias("first_url"), F.count("*").alias("n"))
        .where("n > 1").drop("n")
    )
    joined = rows.join(shared, "payload_digest", "left")
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return joined.withColumn("revisit", revisit)


def record_rows(captured: DataFrame, date: str) -> DataFrame:
    """One row ``value`` per record; the records of a capture come from one row."""
    number = F.monotonically_increasing_id().cast("string")
    named = captured.withColumn("run", number)
    # Ids are unique in the archive, also where rows repeat a page.
    rid = F.concat(F.lit("urn:capture:"), "run")
    http = lambda length, body: F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        length.cast("string"), F.lit("\r\n\r\n"), body,
    )
    target = F.coalesce("url", F.lit(""))
    digest = F.concat(F.lit("sha1:"), "payload_digest")
    common: list[tuple[str, Column | str]] = [("WARC-Date", date), ("WARC-Target-URI", target)]
    http_type = ("Content-Type", "application/http; msgtype=response")
    response = _record(
        "response", rid, [*common, ("WARC-Payload-Digest", digest), http_type],
        http(F.col("payload_bytes"), F.col("payload")),
    )
    revisit = _record(
        "revisit", rid,
        [
            *common, ("WARC-Payload-Digest", digest), http_type,
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            ("WARC-Refers-To-Target-URI", F.col("first_url")), ("WARC-Refers-To-Date", date),
        ],
        http(F.col("payload_bytes"), F.lit("")),
    )
    to = ("WARC-Concurrent-To", F.concat(F.lit("<"), rid, F.lit(">")))
    request = _record(
        "request", F.concat(rid, F.lit(":request")),
        [*common, to, ("Content-Type", "application/http; msgtype=request")],
        F.concat(F.lit("GET "), F.regexp_replace(target, r"\s+", "%20"), F.lit(" HTTP/1.1\r\n\r\n")),
    )
    fields = F.concat(F.coalesce(F.concat(F.lit("page-id: "), F.col("page_id").cast("string"), F.lit("\r\n")), F.lit("")), F.lit("via: crawl\r\n"))
    metadata = _record("metadata", F.concat(rid, F.lit(":metadata")), [*common, to, ("Content-Type", "application/warc-fields")], fields)
    main = F.when(F.col("revisit"), revisit).otherwise(response)
    return named.select(F.explode(F.array(main, request, metadata)).alias("value"))


def write_archives(pages: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", least: int = LEAST_REVISIT, most: int = ARCHIVE_RECORDS) -> None:
    """Archives of all pages as gzip files in a new folder; no pages, no records."""
    rows = record_rows(captures(pages, least), date)
    options = {"compression": "gzip", "lineSep": "\r\n\r\n", "maxRecordsPerFile": most}
    rows.write.options(**options).text(path)


def _parse(segment: bytes) -> tuple[dict[str, str], int, int] | None:
    """Headers by lower-case name, start and length of the block; None without them."""
    end = segment.find(b"\r\n\r\n")
    if end < 0:
        return None
    headers: dict[str, str] = {}
    for line in segment[:end].decode("utf-8", "replace").split("\r\n"):
        name, colon, value = line.partition(":")
        if colon:
            headers.setdefault(name.strip().lower(), value.strip())
    size = headers.get("content-length", "")
    return (headers, end + 4, int(size)) if size.isdecimal() else None


def records_of(segments: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Records of one archive from what stands between its version lines.

    A record that is shorter than it says held the version line itself, and goes on
    with the next segment. What is no record, or is cut off at the end, is left out.
    """
    version, held = VERSION.encode(), None
    for segment in segments:
        held = segment if held is None else held + version + segment
        got = _parse(held)
        if got is None:
            held = None
        elif len(held) >= got[1] + got[2]:
            yield got[0], held[got[1] : got[1] + got[2]]
            held = None


_RECORD = (
    "type string, record_id string, concurrent_to string, target_uri string, date string, "
    "refers_to_uri string, payload_digest string, payload_bytes long, payload binary, fields string"
)


def _row(headers: dict[str, str], block: bytes) -> tuple:
    kind = headers.get("warc-type", "")
    link = lambda name: headers[name].strip("<>") if name in headers else None
    digest = headers.get("warc-payload-digest", "").removeprefix("sha1:") or None
    size = payload = fields = None
    if kind == "response":
        payload = block.partition(b"\r\n\r\n")[2]
        digest, size = hashlib.sha1(payload).hexdigest(), len(payload)
    elif kind != "revisit":
        fields = block.decode("utf-8", "replace")
    return (
        kind, link("warc-record-id"), link("warc-concurrent-to"), headers.get("warc-target-uri"),
        headers.get("warc-date"), headers.get("warc-refers-to-target-uri"), digest, size, payload, fields,
    )


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """All records of the gzip archives in a folder.

    ``payload`` is the body of a response; ``payload_digest`` (bare hex) and
    ``payload_bytes`` are computed from it, for a revisit the digest is the stated one.
    ``fields`` is the block of a request or metadata record.
    """
    importable(spark)
    names = [c.split()[0] for c in _RECORD.split(", ")]
    lines = spark.read.option("lineSep", VERSION).text(path)
    lines = lines.select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("value"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def rows():
            for batch in batches:
                yield from zip(batch["file"], batch["value"])

        chunk, size = [], 0
        for _, one in groupby(rows(), lambda r: r[0]):
            for headers, block in records_of(v for _, v in one):
                chunk.append(_row(headers, block))
                size += len(block)
                if size > _CHUNK:
                    yield pd.DataFrame(chunk, columns=names).astype({"payload_bytes": "Int64"})
                    chunk, size = [], 0
        if chunk:
            yield pd.DataFrame(chunk, columns=names).astype({"payload_bytes": "Int64"})

    return lines.mapInPandas(run, _RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: ``record_id, capture, request, metadata``.

    Request and metadata records join the response or revisit that their concurrent-to
    names. Where several do, the one with the least record id; where none does, null.
    Records that name no capture are left out. ``page_id`` comes from the metadata.
    """
    side = F.col("concurrent_to").isNotNull()
    requests = (
        records.where(side & (F.col("type") == "request")).groupBy("concurrent_to")
        .agg(F.min(F.struct("record_id", "date", "target_uri", "fields")).alias("request"))
    )
    page = F.regexp_extract("fields", r"(?m)^page-id: (-?\d+)\r?$", 1)
    metadata = (
        records.where(side & (F.col("type") == "metadata"))
        .withColumn("page_id", F.when(page != "", page.cast("long"))).groupBy("concurrent_to")
        .agg(F.min(F.struct("record_id", "date", "page_id", "fields")).alias("metadata"))
    )
    # Only the columns that ``records`` has: without ``payload`` it never moves.
    nested = [c for c in records.columns if c not in ("record_id", "concurrent_to", "fields")]
    main = records.where(F.col("type").isin("response", "revisit")).select("record_id", F.struct(*nested).alias("capture"))
    return (
        main.join(requests.withColumnRenamed("concurrent_to", "record_id"), "record_id", "left")
        .join(metadata.withColumnRenamed("concurrent_to", "record_id"), "record_id", "left")
    )


def resolve(transactions: DataFrame) -> DataFrame:
    """Transactions of ``assemble`` with the response that a revisit refers to.

    Adds ``page_id``, ``refers_to`` (its page, null for responses) and ``full_bytes``
    (bytes of the full payload; null if the archive holds no such response).
    """
    rows = transactions.withColumn("digest", F.col("capture.payload_digest")).withColumn("page_id", F.col("metadata.page_id"))
    stored = (
        rows.where("capture.type = 'response'").groupBy("digest")
        .agg(F.max("page_id").alias("stored_id"), F.max("capture.payload_bytes").alias("stored_bytes"))
    )
    wanted = F.when(F.col("capture.type") == "revisit", F.col("digest"))
    joined = rows.withColumn("wanted", wanted).join(stored.withColumnRenamed("digest", "wanted"), "wanted", "left")
    return joined.select(
        "record_id", "page_id", "capture", "request", "metadata",
        F.col("stored_id").alias("refers_to"),
        F.coalesce("capture.payload_bytes", "stored_bytes").alias("full_bytes"),
    )


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Write all pages to archives, read them back and resolve their transactions."""
    spark = pages.sparkSession
    path = fresh_path(spark, "warc")
    write_archives(pages, path)
    records = read_archives(spark, path).drop("payload")
    return resolve(saved(assemble(records), "transactions"))
