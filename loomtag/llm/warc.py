"""Deduplicated WARC archives with revisit resolution.

Headers (page id, payload digest, length) go to a table of their own and are
grouped by digest; in each set of equal payloads of at least ``min_bytes``
bytes, the record with the largest page id is the *response* and every other
one a *revisit* that names it. Only the digests that several records have, and
then only the revisits, come back to the pages, by page id and digest: payloads
stay where they are unless there are more revisits than may be broadcast.
Records are then written with fresh headers as WARC/1.1 archives by Spark's
text sink, so any file system that Spark reaches will do, and read back by
Content-Length. Larger payloads go to archives of fewer records, so that none
outgrows what a reader takes at once.

A null html is an empty payload. A null page_id is never the one others
revisit unless all of its set are null, and then all are responses; of rows
that repeat a page id and payload, all are responses or all revisits. A null
url leaves out the target header. An empty table writes archives without
records.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, written

#: Fixed value: the alphabet of RFC 4648 base32.
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_CRLF = "\r\n"


def payload_digest(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a binary column: five hex digits are four base32 digits."""
    h = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substr(h, F.lit(1 + 5 * i), F.lit(5)), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.upper(F.concat(*groups)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", _BASE32)


def headers(pages: DataFrame) -> DataFrame:
    """``pages(page_id, html)`` -> page_id, payload_digest, payload_bytes."""
    payload = F.coalesce("html", F.lit("")).cast("binary")
    return pages.select("page_id", payload_digest(payload).alias("payload_digest"), F.octet_length(payload).cast("long").alias("payload_bytes"))


def revisits(heads: DataFrame, min_bytes: int = 0, broadcast_rows: int = 500_000) -> DataFrame:
    """Of ``headers`` those that revisit another: page_id, payload_digest, refers_to, each once."""
    sets = heads.where(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n"))
    sets = written(sets.where("n > 1 AND refers_to IS NOT NULL").drop("n"), "originals")
    sets = F.broadcast(sets) if sets.count() <= broadcast_rows else sets
    again = ~F.col("page_id").eqNullSafe(F.col("refers_to"))
    return heads.select("page_id", "payload_digest").join(sets, "payload_digest").where(again).distinct()


def resolve_revisits(pages: DataFrame, heads: DataFrame, min_bytes: int = 0, broadcast_rows: int = 500_000) -> DataFrame:
    """``pages(page_id, url, html)`` and their ``headers`` -> page_id, url, payload, payload_bytes, payload_digest,
    record_type, refers_to."""
    again = revisits(heads, min_bytes, broadcast_rows).select(F.col("page_id").alias("again_id"), F.col("payload_digest").alias("again_digest"), "refers_to")
    again = written(again, "revisits")
    again = F.broadcast(again) if again.count() <= broadcast_rows else again
    own = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("payload"))
    own = own.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", payload_digest(F.col("payload").cast("binary")))
    both = own.join(again, F.col("page_id").eqNullSafe(F.col("again_id")) & (F.col("payload_digest") == F.col("again_digest")), "left")
    kind = F.when(F.col("refers_to").isNotNull(), "revisit").otherwise("response")
    return both.select("page_id", "url", "payload", "payload_bytes", "payload_digest", kind.alias("record_type"), "refers_to")


def _record_id(page: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("none")), F.lit(">"))


def records(resolved: DataFrame, date: str = "2026-01-01T00:00:00Z") -> DataFrame:
    """One string column: each record's header and block, without the last of its two closing line ends."""
    revisit = F.col("record_type") == "revisit"
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{_CRLF}Content-Type: text/html; charset=utf-8{_CRLF}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(_CRLF * 2))
    length = F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("payload_bytes"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(_CRLF))
    head = F.concat(
        F.lit(f"WARC/1.1{_CRLF}"),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", _record_id(F.col("page_id"))),
        line("WARC-Date", F.lit(date)),
        F.coalesce(line("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]+", "%0D%0A")), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), line("WARC-Refers-To", _record_id(F.col("refers_to"))))).otherwise(""),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", length.cast("string")),
        F.lit(_CRLF),
    )
    return resolved.select(F.concat(head, http, F.when(revisit, "").otherwise(F.col("payload")), F.lit(_CRLF)).alias("value"))


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, records_per_archive: int = 1024, archive_bytes: int = 1 << 30, compression: str = "gzip") -> None:
    """Write the archives of ``pages`` under ``path``; each holds at most ``records_per_archive`` records, and
    payloads of ``archive_bytes`` in all, or a single larger one."""
    heads = written(headers(pages), "headers")
    resolved = resolve_revisits(pages, heads, min_bytes)
    largest, least, most = heads.agg(F.max("payload_bytes")).first()[0] or 0, -1, records_per_archive
    while least < largest or least < 0:
        upto = archive_bytes // most
        own = records(resolved.where((F.col("payload_bytes") > least) & (F.col("payload_bytes") <= upto) if most > 1 else F.col("payload_bytes") > least))
        out = own.write.mode("append").option("lineSep", _CRLF).option("compression", compression).option("maxRecordsPerFile", most)
        out.text(path)
        if most == 1:
            break
        least, most = upto, max(1, most // 32)


def _page(value: str) -> int | None:
    name = value.strip("<>").rpartition(":")[2]
    return None if name == "none" else int(name)


def parse_archive(data: bytes, with_payload: bool = True) -> Iterator[dict]:
    """The records of one archive, plain or gzip, each read by its Content-Length."""
    stream = gzip.GzipFile(fileobj=io.BytesIO(data)) if data[:2] == b"\x1f\x8b" else io.BytesIO(data)
    while version := stream.readline():
        if not version.strip():
            continue
        if not version.startswith(b"WARC/"):
            raise ValueError(f"no WARC record: {version[:40]!r}")
        head: dict[str, str] = {}
        while (line := stream.readline().strip()) != b"":
            name, _, value = line.decode("utf-8").partition(":")
            head[name.lower()] = value.strip()
        block = stream.read(int(head["content-length"]))
        http, _, payload = block.partition(b"\r\n\r\n")
        full = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
        kind = head["warc-type"]
        stated = head["warc-payload-digest"].partition(":")[2]
        if kind == "response":
            found = base64.b32encode(hashlib.sha1(payload).digest()).decode()
            if found != stated or len(payload) != full:
                raise ValueError(f"{head['warc-record-id']}: its payload is not the one it states")
        yield {
            "page_id": _page(head["warc-record-id"]),
            "url": head.get("warc-target-uri"),
            "payload_bytes": full,
            "payload_digest": stated,
            "record_type": kind,
            "refers_to": _page(head["warc-refers-to"]) if kind == "revisit" else None,
            "payload": payload if with_payload and kind == "response" else None,
        }


READ_SCHEMA = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """All records of the archives under ``path``; one archive at a time is in a task's memory."""
    names = [x.split()[0] for x in READ_SCHEMA.split(", ")]
    types = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    schema = pa.schema([(x.split()[0], types[x.split()[1]]) for x in READ_SCHEMA.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                rows = []
                for r in parse_archive(batch.column(0)[i].as_py(), with_payload):
                    rows.append(r)
                    if len(rows) == 256:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(run, READ_SCHEMA).select(*names)


def archive_folder(spark: SparkSession) -> str:
    """A new folder for archives in the shared folder."""
    return f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
