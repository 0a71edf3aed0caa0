"""Legacy ARC archives to WARC, and back to rows.

An ARC file starts with a version block (``filedesc://``) that says the version, 1 or 2, and so the fields of
the header line before each document: URL, address, date, type and length, and for version 2 also result code,
checksum, location, offset and file name between type and length.  The converter walks a file by the declared
lengths and makes a WARC record of each document: a record id from archive name and offset (the same when a
lost task runs again), the ISO form of the 14-digit date, the type (``warcinfo`` for the version block,
``response`` for HTTP, else ``resource``), and SHA-256 digests of block and payload.

Records with equal payloads of ``min_revisit`` bytes or more: the one with the smallest page id (then record
id) stays ``response``, the others become ``revisit`` records that refer to it and hold the HTTP header alone.
The first record per payload is found from digests alone; only groups of two and more are joined back, on
(digest, salt), so that one payload's copies are dealt over ``SALTS`` tasks.

Archives are written and read with Spark's own sources, one gzip file per partition, so any shared store
works; a file is as large as the partition that wrote it, and is walked as a stream.

Defined results: null html is an empty payload; null ids sort last and read back as null; null URLs are
``urn:unknown``; white space in URLs is percent-encoded.  Repeated rows are separate records.  An empty table
makes no page records.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from busguard.llm.common import col, text_or_empty

MIN_REVISIT = 100
SALTS = 32
ROWS_AT_ONCE = 256

# The header fields of the two ARC versions, in order.
ARC_FIELDS = {
    1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    2: ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset",
        "Filename", "Archive-length"],
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NO_DATE = "19700101000000"
# half the work of zlib's default level for a few per cent more bytes
GZIP = {"compression": "gzip", "zlib.compress.level": "THREE"}
ID_HEADER = "X-Page-Id"

CONVERTED = ("record_id string, kind string, url string, ip string, date string, media string, page_id long, "
             "head string, n_bytes long, digest string, payload binary")
READ_BACK = ("record_id string, kind string, url string, page_id long, n_bytes long, digest string, refers_to string, "
             "sound boolean")


# ---- pages to ARC -----------------------------------------------------------------------------------------------

def arc_records(pages: DataFrame, id: str, url: str, html: str, date: str, version: int) -> DataFrame:
    """One ARC document per page: header line and HTTP response, as ``value``."""
    body = text_or_empty(col(pages, html))
    link = F.regexp_replace(F.coalesce(col(pages, url), F.lit("urn:unknown")), r"\s", "%20")
    link = F.when(link == "", "urn:unknown").otherwise(link)
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: "),
                    F.octet_length(body).cast("string"),
                    F.coalesce(F.concat(F.lit(f"\r\n{ID_HEADER}: "), col(pages, id).cast("string")), F.lit("")),
                    F.lit("\r\n\r\n"))
    size = (F.octet_length(head) + F.octet_length(body)).cast("string")
    fields = {"URL": link, "IP-address": F.lit("0.0.0.0"), "Archive-date": F.lit(date),
              "Content-type": F.lit("text/html"), "Result-code": F.lit("200"), "Checksum": F.lit("-"),
              "Location": F.lit("-"), "Offset": F.lit("0"), "Filename": F.lit("pages.arc"), "Archive-length": size}
    line = F.concat_ws(" ", *(fields[f] for f in ARC_FIELDS[version]))
    return pages.select(F.concat(line, F.lit("\n"), head, body).alias("value"))


def version_block(version: int, date: str) -> str:
    body = f"{version} 0 pages\n{' '.join(ARC_FIELDS[version])}\n"
    given = {"URL": "filedesc://pages.arc", "IP-address": "0.0.0.0", "Archive-date": date, "Content-type": "text/plain",
             "Result-code": "200", "Checksum": "-", "Location": "-", "Offset": "0", "Filename": "pages.arc",
             "Archive-length": str(len(body))}
    return " ".join(given[f] for f in ARC_FIELDS[version]) + "\n" + body


def write_arc(pages: DataFrame, path: str, id: str = "page_id", url: str = "url", html: str = "html",
              date: str = "20240101000000", version: int = 1) -> None:
    """An ARC file per partition of ``pages``, each with its version block."""
    first = version_block(version, date)

    def with_block(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fresh = True
        for batch in batches:
            if fresh and len(batch):
                yield pd.DataFrame({"value": [first]})
                fresh = False
            yield batch

    records = arc_records(pages, id, url, html, date, version)
    records.mapInPandas(with_block, "value string").write.options(**GZIP).text(path)


# ---- ARC to WARC records ----------------------------------------------------------------------------------------

def opened(content: bytes) -> io.BufferedReader:
    raw = io.BytesIO(content)
    return io.BufferedReader(gzip.GzipFile(fileobj=raw), 1 << 20) if content[:2] == b"\x1f\x8b" else raw


def iso_date(digits: str) -> str:
    """ISO 8601 form of an ARC date of 14 digits; older archives have 12 or 8."""
    d = (digits if digits.isdigit() else "").ljust(14, "0") if len(digits) >= 8 else NO_DATE
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def read_arc(name: str, content: bytes) -> Iterator[dict]:
    """The documents of one ARC file as WARC records."""
    stream = opened(content)
    version = None
    at = 0
    while line := stream.readline():
        offset, at = at, at + len(line)
        text = line.decode("utf-8", "replace").rstrip("\r\n")
        if not text:
            continue  # between documents
        is_block = version is None  # the first record of a file; later ones may have any address
        if is_block and not text.startswith("filedesc://"):
            raise ValueError(f"{name}: no version block before {text[:80]!r}")
        n = int(text.rpartition(" ")[2])
        doc = stream.read(n)
        at += len(doc)
        if len(doc) < n:
            raise ValueError(f"{name}: {n} bytes declared at {offset}, {len(doc)} there")
        if is_block:
            version = int(doc.split(b" ", 1)[0])
        names = ARC_FIELDS[version]
        field = dict(zip(names, text.rsplit(" ", len(names) - 1)))
        head, payload = "", doc
        if is_block:
            kind = "warcinfo"
        elif doc.startswith(b"HTTP/"):
            kind = "response"
            before, _, payload = doc.partition(b"\r\n\r\n")
            head = before.decode("latin-1")
        else:
            kind = "resource"
        page = re.search(rf"^{ID_HEADER}: (-?\d+)\r?$", head, re.MULTILINE)
        yield {"record_id": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{name}#{offset}')}>", "kind": kind,
               "url": field["URL"], "ip": field["IP-address"], "date": iso_date(field["Archive-date"]),
               "media": field["Content-type"], "page_id": int(page[1]) if page else None, "head": head,
               "n_bytes": len(payload), "digest": hashlib.sha256(payload).hexdigest(), "payload": payload}


def in_frames(rows: Iterator[dict], schema: str) -> Iterator[pd.DataFrame]:
    names = [f.split()[0] for f in schema.split(", ")]
    batch: list[dict] = []
    size = 0

    def frame() -> pd.DataFrame:
        out = pd.DataFrame(batch, columns=names, dtype=object)  # as objects, ids next to nulls stay exact
        return out.astype({"n_bytes": "int64"})

    for row in rows:
        batch.append(row)
        size += row["n_bytes"]
        if len(batch) >= ROWS_AT_ONCE or size > 8 << 20:
            yield frame()
            batch, size = [], 0
    if batch:
        yield frame()


def archive_files(spark: SparkSession, path: str) -> DataFrame:
    return (spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
            .select("path", "content"))


def converted(spark: SparkSession, arc_path: str, payloads: bool = True) -> DataFrame:
    """The records of all ARC files below a folder; without payloads where digests are enough."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def rows():
            for batch in batches:
                for path, content in batch.itertuples(index=False):
                    for row in read_arc(path.rpartition("/")[2], content):
                        yield row if payloads else {**row, "payload": None}
        return in_frames(rows(), CONVERTED)

    return archive_files(spark, arc_path).mapInPandas(run, CONVERTED)


def mark_revisits(records: DataFrame, narrow: DataFrame, min_revisit: int) -> DataFrame:
    """``records`` with, for revisits, the record id, URL and date of the response they refer to."""
    order = F.struct(F.col("page_id").isNull().alias("last"), F.col("page_id"), F.col("record_id"), F.col("url"),
                     F.col("date"))
    same = (narrow.filter((F.col("kind") == "response") & (F.col("n_bytes") >= min_revisit))
            .groupBy("digest").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("copies"))
            .filter("copies > 1")
            .select(F.col("digest").alias("of"), F.col("first.record_id").alias("to_id"),
                    F.col("first.url").alias("to_url"), F.col("first.date").alias("to_date"),
                    F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")))
    dealt = F.pmod(F.xxhash64("record_id"), F.lit(SALTS)).cast("int")
    out = records.withColumn("dealt", dealt).join(
        same, (F.col("digest") == F.col("of")) & (F.col("dealt") == F.col("salt")) & (F.col("kind") == "response"), "left")
    again = F.col("to_id").isNotNull() & (F.col("to_id") != F.col("record_id"))
    return out.withColumn("kind", F.when(again, "revisit").otherwise(F.col("kind"))).drop("of", "salt", "dealt", "copies")


def warc_text(records: DataFrame) -> DataFrame:
    """Each record as it stands in the archive, without its last line feed (the text writer adds it)."""
    payload = F.col("payload").cast("string")
    end = F.lit("\r\n")
    block = (F.when(F.col("kind") == "response", F.concat("head", F.lit("\r\n\r\n"), payload))
             .when(F.col("kind") == "revisit", F.concat("head", F.lit("\r\n\r\n"))).otherwise(payload))
    media = (F.when(F.col("kind").isin("response", "revisit"), F.lit("application/http; msgtype=response"))
             .when(F.col("kind") == "warcinfo", F.lit("text/plain")).otherwise(F.col("media")))
    is_revisit = F.col("kind") == "revisit"

    def line(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"{name}: "), value, end)

    header = F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.col("kind")), line("WARC-Record-ID", F.col("record_id")),
        line("WARC-Date", F.col("date")),
        F.when(F.col("kind") == "warcinfo", F.lit("")).otherwise(
            F.concat(line("WARC-Target-URI", F.col("url")), line("WARC-IP-Address", F.col("ip")),
                     line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))))),
        F.when(is_revisit, F.concat(line("WARC-Profile", F.lit(REVISIT_PROFILE)), line("WARC-Refers-To", F.col("to_id")),
                                    line("WARC-Refers-To-Target-URI", F.col("to_url")),
                                    line("WARC-Refers-To-Date", F.col("to_date")))).otherwise(F.lit("")),
        line("WARC-Block-Digest", F.concat(F.lit("sha256:"), F.sha2(block.cast("binary"), 256))),
        line("Content-Type", media), line("Content-Length", F.octet_length(block).cast("string")), end)
    return records.select(F.concat(header, block, F.lit("\r\n\r")).alias("value"))


def convert_arc(spark: SparkSession, arc_path: str, warc_path: str, min_revisit: int = MIN_REVISIT) -> None:
    """Convert all ARC files below ``arc_path`` to WARC files below ``warc_path``."""
    records = mark_revisits(converted(spark, arc_path), converted(spark, arc_path, payloads=False), min_revisit)
    warc_text(records).write.options(**GZIP).text(warc_path)


# ---- WARC to rows -----------------------------------------------------------------------------------------------

def read_warc(content: bytes) -> Iterator[dict]:
    """The records of one WARC file, by their declared lengths; digests are computed anew where the payload is there."""
    stream = opened(content)
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record starts with {line[:80]!r}")
        field = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            field[name.lower()] = value.strip()
        block = stream.read(int(field["content-length"]))
        kind = field["warc-type"]
        stated = field.get("warc-payload-digest", "").removeprefix("sha256:")
        head, _, payload = block.partition(b"\r\n\r\n") if kind in ("response", "revisit") else (b"", b"", block)
        http = dict(h.partition(": ")[::2] for h in head.decode("latin-1").split("\r\n")[1:])
        n = int(http.get("Content-Length", len(payload))) if kind == "revisit" else len(payload)
        digest = stated if kind == "revisit" else hashlib.sha256(payload).hexdigest()
        sound = (field["warc-block-digest"] == "sha256:" + hashlib.sha256(block).hexdigest()
                 and (not stated or stated == digest))
        page = http.get(ID_HEADER)
        yield {"record_id": field["warc-record-id"], "kind": kind, "url": field.get("warc-target-uri"),
               "page_id": int(page) if page else None, "n_bytes": n, "digest": digest,
               "refers_to": field.get("warc-refers-to"), "sound": sound}


def read_archives(spark: SparkSession, warc_path: str) -> DataFrame:
    """All records of the WARC files below a folder."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return in_frames((row for batch in batches for content in batch["content"] for row in read_warc(content)),
                         READ_BACK)

    return archive_files(spark, warc_path).mapInPandas(run, READ_BACK)


def page_records(spark: SparkSession, warc_path: str) -> DataFrame:
    """The pages' records, with the page id of the response that a revisit refers to."""
    records = read_archives(spark, warc_path).filter(F.col("kind").isin("response", "revisit"))
    targets = records.filter("kind = 'response'").select(F.col("record_id").alias("refers_to"),
                                                         F.col("page_id").alias("refers_to_page"))
    firsts = targets.join(records.filter("kind = 'revisit'").select("refers_to").distinct(), "refers_to", "left_semi")
    salted = firsts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = records.withColumn("salt", F.pmod(F.xxhash64("record_id"), F.lit(SALTS)).cast("int"))
    return dealt.join(salted, ["refers_to", "salt"], "left").drop("salt")
