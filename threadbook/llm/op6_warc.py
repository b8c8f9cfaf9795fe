"""Legacy archive converter: ARC records of version 1 or 2 become WARC records, and WARC archives are read back.

Archives are rows (name, data) of a table in the shared folder, so no task depends on a folder of its own; ``export``
writes them out as files. Every record is a gzip member of its own, as usual for these formats.
"""

from __future__ import annotations

import base64
import hashlib
import math
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shuffle_partitions, written

#: Payload bytes from which equal payloads become revisits, and bytes of one archive before compression.
REVISIT_BYTES = 1000
ARCHIVE_BYTES = 8 << 20
SALTS = 32
#: Archives that meet their decisions in one task, on average.
TASK_ARCHIVES = 4

# The header lines of the two versions of the format, and names of the record fields.
ARC_FIELDS = {
    "1": "URL IP-address Archive-date Content-type Archive-length",
    "2": "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PAGE, OF_PAGE = "Page-Id", "Refers-To-Page-Id"
ARCHIVES = "name string, data binary"


def packed(record: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(record) + z.flush()


def unpacked(data: bytes, step: int = 1 << 15) -> Iterator[bytes]:
    """The gzip members of an archive, read on in small steps: what is left over of a step is copied."""
    at, view = 0, memoryview(data)
    while at < len(data):
        z, parts = zlib.decompressobj(31), []
        while not z.eof:
            if at >= len(data):
                raise ValueError("the archive ends within a record")
            parts.append(z.decompress(view[at : at + step]))
            at = min(at + step, len(data)) - len(z.unused_data)
        yield b"".join(parts)


# ---------------------------------------------------------------- ARC


def arc_file_header(name: str, version: str, date: str) -> bytes:
    body = f"{version} 0 threadbook\n{ARC_FIELDS[version]}\n".encode()
    head = {"1": f"filedesc://{name} 0.0.0.0 {date} text/plain {len(body)}", "2": f"filedesc://{name} 0.0.0.0 {date} text/plain 200 - - 0 {name} {len(body)}"}[version]
    return head.encode() + b"\n" + body + b"\n"


def arc_record(name: str, version: str, offset: int, url: str, ip: str, date: str, mime: str, document: bytes) -> bytes:
    url = re.sub(r"\s", lambda m: f"%{ord(m[0]):02X}", url) or "-"
    middle = "" if version == "1" else f" 200 - - {offset} {name}"
    return f"{url} {ip} {date} {mime}{middle} {len(document)}".encode() + b"\n" + document + b"\n"


def read_arc(data: bytes) -> Iterator[dict]:
    """The records of an archive, by the header line that its first record declares and by declared lengths."""
    fields: list[str] = []
    for member in unpacked(data):
        at = 0
        while at < len(member):
            end = member.index(b"\n", at)
            line = member[at:end].decode().split(" ")
            length = int(line[-1])
            document = member[end + 1 : end + 1 + length]
            at = end + 1 + length + 1
            if not fields:
                version, _, names = document.decode().partition("\n")
                fields = names.split("\n")[0].split(" ")
                if ARC_FIELDS.get(version.split(" ")[0]) != " ".join(fields):
                    raise ValueError(f"unknown archive version: {version}")
                continue
            if len(line) != len(fields):
                raise ValueError(f"{len(line)} fields where {len(fields)} are declared")
            yield dict(zip(fields, line, strict=True)) | {"document": document}


def http_parts(document: bytes) -> tuple[bytes, dict[str, str], bytes]:
    """Head, fields and payload of an HTTP response."""
    head, gap, payload = document.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:] if ": " in x)
    return head + gap, fields, payload


def arc_archives(pages: DataFrame) -> DataFrame:
    """Legacy archives that hold the pages, version 1 and 2 by turns; payload is the html in UTF-8 (null: empty)."""

    def run(batches):
        part, count, held, offset, name, version, date = TaskContext.get().partitionId(), 0, [], 0, "", "", "20240215000000"
        for b in batches:
            for page, url, html in zip(b["page_id"], b["url"], b["html"], strict=True):
                if not held:
                    name, version = f"legacy-{part:06d}-{count:05d}.arc.gz", "12"[(part + count) % 2]
                    head = arc_file_header(name, version, date)
                    held, offset, count = [packed(head)], len(head), count + 1
                payload = (html or "").encode()
                about = f"{PAGE}: {int(page)}\r\n" if not pd.isna(page) else ""
                document = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n{about}\r\n".encode() + payload
                record = arc_record(name, version, offset, url or "", "0.0.0.0", date, "text/html", document)
                held.append(packed(record))
                offset += len(record)
                if offset >= ARCHIVE_BYTES:
                    yield pd.DataFrame({"name": [name], "data": [b"".join(held)]})
                    held = []
        if held:
            yield pd.DataFrame({"name": [name], "data": [b"".join(held)]})

    return pages.select(F.col("page_id").cast("long").cast("string").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInPandas(run, ARCHIVES)


# ---------------------------------------------------------------- WARC


def record_id(name: str, i: int) -> str:
    """Of the i-th record of a legacy archive: names of archives differ, so ids do, whatever the records hold."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{name}:{i}')}>"


def warc_date(arc: str) -> str:
    return datetime.strptime(arc, "%Y%m%d%H%M%S").replace(tzinfo=UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


def b32(digest: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()


def warc_record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("WARC-Block-Digest", b32(hashlib.sha1(block).hexdigest())), ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def read_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Fields and block of each record, by declared lengths; block digests are verified."""
    for member in unpacked(data):
        at = 0
        while at < len(member):
            end = member.index(b"\r\n\r\n", at) + 4
            version, *lines = member[at : end - 4].decode().split("\r\n")
            if not version.startswith("WARC/1."):
                raise ValueError(f"unknown record version: {version}")
            fields = dict(x.split(": ", 1) for x in lines)
            block = member[end : end + int(fields["Content-Length"])]
            if fields.get("WARC-Block-Digest") not in (None, b32(hashlib.sha1(block).hexdigest())):
                raise ValueError("block digest does not match")
            at = end + len(block) + 4
            yield fields, block


def _digests(archives: DataFrame) -> DataFrame:
    def run(batches):
        for b in batches:
            rows = []
            for name, data in zip(b["name"], b["data"], strict=True):
                for i, r in enumerate(read_arc(data)):
                    _, fields, payload = http_parts(r["document"])
                    rows.append((name, i, fields.get(PAGE), r["URL"], warc_date(r["Archive-date"]), len(payload), hashlib.sha1(payload).hexdigest()))
            yield pd.DataFrame(rows, columns=["name", "i", "page", "url", "date", "size", "digest"])

    return archives.mapInPandas(run, "name string, i int, page string, url string, date string, size long, digest string")


def _revisits(archives: DataFrame, least: int) -> DataFrame:
    """Records whose payload a record of a larger page has too: name, i, and best, what is known of that record. Salted by record, as one
    payload may hold a third of them.
    """
    rows = written(_digests(archives)).where(F.col("size") >= least).withColumn("page", F.col("page").cast("long"))
    best = rows.groupBy("digest").agg(F.max(F.struct("page", "name", "i", "url", "date")).alias("best"), F.count("*").alias("n")).where("n > 1 and best.page is not null").drop("n")
    best = best.select("digest", "best", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    rows = rows.select("name", "i", "page", "digest", F.pmod(F.xxhash64("name", "i"), F.lit(SALTS)).cast("int").alias("salt"))
    return rows.join(best, ["digest", "salt"]).where("page is null or page < best.page").select("name", "i", "best")


def convert(archives: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """WARC archives with one record for each record of the legacy archives."""

    def run(key, table, decided):
        best, out_rows = dict(zip(decided["i"], decided["best"], strict=True)), []
        for name, data in zip(table["name"], table["data"], strict=True):
            target = re.sub(r"\.arc\.gz$", ".warc.gz", name)
            made = [packed(warc_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(target, -1)), ("WARC-Date", "2024-02-15T00:00:00Z"), ("WARC-Filename", target), ("Content-Type", "application/warc-fields")], b"software: threadbook\r\nformat: WARC File Format 1.1\r\n"))]
            for i, r in enumerate(read_arc(data)):
                head, _, payload = http_parts(r["document"])
                digest = hashlib.sha1(payload).hexdigest()
                out = [("WARC-Type", "revisit" if i in best else "response"), ("WARC-Record-ID", record_id(name, i)), ("WARC-Date", warc_date(r["Archive-date"])), ("WARC-Target-URI", r["URL"]), ("WARC-IP-Address", r["IP-address"]), ("WARC-Payload-Digest", b32(digest)), ("Content-Type", "application/http; msgtype=response")]
                if i in best:
                    of = best[i]
                    out += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(of["name"], of["i"])), ("WARC-Refers-To-Target-URI", of["url"]), ("WARC-Refers-To-Date", of["date"]), (OF_PAGE, str(int(of["page"])))]
                made.append(packed(warc_record(out, head if i in best else head + payload)))
            out_rows.append((target, b"".join(made)))
        return pd.DataFrame(out_rows, columns=["name", "data"])

    tasks = max(shuffle_partitions(archives.sparkSession), math.ceil(archives.count() / TASK_ARCHIVES))
    dealt = lambda df: df.repartition(tasks, "name").groupBy("name")
    return dealt(archives).cogroup(dealt(_revisits(archives, least))).applyInPandas(run, ARCHIVES)


RECORDS = "page_id long, record_type string, record_id string, url string, date string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def read_archives(archives: DataFrame) -> DataFrame:
    """The response and revisit records of WARC archives; a revisit has no payload, but its size and digest."""

    def run(batches):
        for b in batches:
            for data in b["data"]:
                rows = []
                for fields, block in read_warc(data):
                    kind = fields["WARC-Type"]
                    if kind not in ("response", "revisit"):
                        continue
                    _, http, payload = http_parts(block)
                    if kind == "response":
                        size, digest = len(payload), hashlib.sha1(payload).hexdigest()
                    else:
                        size, digest, payload = int(http["Content-Length"]), base64.b32decode(fields["WARC-Payload-Digest"][5:]).hex(), None
                    page, of = http.get(PAGE), fields.get(OF_PAGE)
                    rows.append((page and int(page), kind, fields["WARC-Record-ID"], fields["WARC-Target-URI"], fields["WARC-Date"], size, digest, of and int(of), payload))
                made = pd.DataFrame(rows, columns=[x.split(" ")[0] for x in RECORDS.split(", ")])
                yield made.astype({"page_id": "Int64", "refers_to": "Int64"})

    return archives.mapInPandas(run, RECORDS)


def export(archives: DataFrame, directory: str) -> None:
    """Write each archive as a file of a folder that all executors share: under a name of its own, then renamed."""
    from pyarrow import fs

    def run(rows):
        store, root = fs.FileSystem.from_uri(directory)
        store.create_dir(root)
        for r in rows:
            own = f"{root}/.{r['name']}-{uuid.uuid4().hex}"
            with store.open_output_stream(own, compression=None) as f:
                f.write(bytes(r["data"]))
            store.move(own, f"{root}/{r['name']}")

    archives.foreachPartition(run)


def archive_pages(pages: DataFrame, least: int = REVISIT_BYTES) -> tuple[DataFrame, DataFrame]:
    """Legacy archives of the pages and the WARC archives converted from them, both in the shared folder.

    Null html is an empty payload, a null url is "-"; a very long html is one record, whole. Every record has an identifier of its own. Of records with equal payloads of ``least`` bytes or more, those with the
    largest page_id are responses and the others revisits of that page; a null page_id is smaller than any, and
    records without any page_id among their copies are all responses. Repeated rows are records of their own. An
    empty table gives no archives. Other columns are ignored.
    """
    legacy = written(arc_archives(pages))
    return legacy, written(convert(legacy, least))


def op6_warc(spark, sf_dir: str) -> DataFrame:
    _, archives = archive_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return read_archives(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
q AS (SELECT page_id, octet_length(body) AS payload_bytes, sha1(body) AS payload_digest FROM p),
r AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS best FROM q)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id < best THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id < best THEN best END AS refers_to
FROM r
"""
