"""WARC archives: a writer that deduplicates payloads, and a splittable reader.

The writer makes one archive per task in a folder that all executors share; every record is a gzip member of its own.
Of pages with equal payloads (by SHA-1) the one with the largest page_id is a response, the others are revisit records
that name it. A row of the result names each archive with its size, so files of tasks that failed are never read.

The reader cuts archives into byte ranges. A task looks for the gzip magic from the start of its range, takes a place as
a member only if decoding it yields a WARC header, and owns the members that start inside its range, to their ends
wherever those lie. A damaged member is skipped up to the next valid one.

Null html is an empty payload; a null url an empty target. A null page_id never answers for others, and its record has
no number. Rows that repeat page_id and payload are all responses if they are the largest. A long payload is one record;
its reader holds it whole. Columns other than page_id, url and html are not read, whatever their names. No pages, no
records.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, shared_dir, staged

# Gzip and WARC formats.
MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1.1"
BREAK = b"\r\n\r\n"

RANGE = 4 << 20
RANGES = 8
STEP = 256 << 10
DATE = "1970-01-01T00:00:00Z"
URN = "urn:page:"
SIZE = "WARC-Payload-Bytes"  # an extension: the size of the payload that a revisit record leaves out


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()  # noqa: S324


def member(fields: dict[str, str], block: bytes) -> bytes:
    """A record as one gzip member."""
    head = "".join(f"{k}: {v}\r\n" for k, v in fields.items())
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(VERSION + b"\r\n" + head.encode() + f"Content-Length: {len(block)}\r\n\r\n".encode() + block + BREAK) + z.flush()


def page_record(page_id: object, url: str | None, payload: bytes, refers_to: object, date: str) -> bytes:
    name = lambda x: f"<{URN}{'' if x is None else x}>"
    fields = {"WARC-Type": "response" if refers_to is None else "revisit", "WARC-Record-ID": name(page_id), "WARC-Date": date, "WARC-Target-URI": quote(url or "", safe="%/:=&?~#+!$,;'@()*[]"), "WARC-Payload-Digest": f"sha1:{digest(payload)}", SIZE: str(len(payload)), "Content-Type": "application/http; msgtype=response"}
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if refers_to is None:
        return member(fields, http + f"Content-Length: {len(payload)}\r\n\r\n".encode() + payload)
    return member(fields | {"WARC-Refers-To": name(refers_to), "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"}, http + b"\r\n")


def write_warc(pages: DataFrame, folder: str, min_revisit_bytes: int = 0, date: str = DATE) -> DataFrame:
    """Write pages (page_id, url, html) to archives below folder. Returns one row per archive: path, bytes, records."""
    bounded(pages.sparkSession)
    slim = pages.select("page_id", F.sha1(F.coalesce("html", F.lit("")).cast("binary")).alias("sha"), F.octet_length(F.coalesce("html", F.lit(""))).alias("n"))
    owners = slim.where(F.col("n") >= min_revisit_bytes).groupBy("sha").agg(F.max("page_id").alias("owner"), F.count("*").alias("k")).where("k > 1").select("sha", "owner")
    # The owners are written first: joined to a plain table, a hot payload's pages can be split among tasks.
    owners = staged(owners, f"{folder}/owners")
    rows = pages.select("page_id", "url", "html", F.sha1(F.coalesce("html", F.lit("")).cast("binary")).alias("sha")).join(owners, "sha", "left").select("page_id", "url", "html", F.when(F.col("owner") != F.coalesce("page_id", F.lit(-1)), F.col("owner")).alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        path, out, size, n = f"{base}/archives/part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.warc.gz", None, 0, 0

        def put(data: bytes) -> int:
            out.write(data)
            return len(data)

        for batch in batches:
            for page_id, url, html, refers_to in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if out is None:
                    store.create_dir(f"{base}/archives", recursive=True)
                    out = store.open_output_stream(path, compression=None)
                    size = put(member({"WARC-Type": "warcinfo", "WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>", "WARC-Date": date, "Content-Type": "application/warc-fields"}, b"format: WARC File Format 1.1\r\n"))
                size += put(page_record(page_id, url, (html or "").encode(), refers_to, date))
                n += 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([size]), pa.array([n])], ["path", "bytes", "records"])

    return staged(rows.mapInArrow(run, "path string, bytes long, records long"), f"{folder}/written")


class Members:
    """The gzip members of an open file, from any place on."""

    def __init__(self, file: pa.NativeFile, size: int):
        self.file, self.size, self.at, self.data = file, size, 0, b""

    def bytes_from(self, place: int, n: int) -> bytes:
        """n bytes from place on, fewer at the end of the file; reads on in steps."""
        if not self.at <= place <= self.at + len(self.data):
            self.at, self.data = place, b""
        if place > self.at:
            self.data, self.at = self.data[place - self.at :], place
        while len(self.data) < n and self.at + len(self.data) < self.size:
            more = self.file.read_at(min(STEP, self.size - self.at - len(self.data)), self.at + len(self.data))
            if not more:  # the file is shorter than was said
                break
            self.data += more
        return self.data[:n]

    def find(self, place: int, end: int) -> int | None:
        """The first magic in [place, end)."""
        while place < end:
            data = self.bytes_from(place, STEP)
            hit = data.find(MAGIC)
            if hit >= 0:
                return place + hit if place + hit < end else None
            if len(data) < STEP:
                return None
            place += len(data) - len(MAGIC) + 1
        return None

    def decode(self, place: int) -> tuple[bytes, int] | None:
        """(content, end) of the member at place; None unless it opens with a WARC header and is whole."""
        z, out, got, at = zlib.decompressobj(31), [], 0, place
        head = b""
        while not z.eof:
            data = self.bytes_from(at, STEP)
            if not data:
                return None
            try:
                part = z.decompress(data)
            except zlib.error:
                return None
            at += len(data)
            out.append(part)
            got += len(part)
            if len(head) < 5:
                head = b"".join(out)[:5]
                if head != b"WARC/"[: len(head)]:
                    return None
        return (b"".join(out), at - len(z.unused_data)) if len(head) == 5 else None


def records_in(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields by lower-case name, block) of the records in a member."""
    at = 0
    while content.startswith(b"WARC/", at) and (stop := content.find(BREAK, at)) >= 0:
        fields = {}
        for line in content[at:stop].decode("utf-8", "replace").split("\r\n")[1:]:
            k, _, v = line.partition(":")
            fields[k.strip().lower()] = v.strip()
        n = int(fields["content-length"]) if fields.get("content-length", "").isdigit() else 0
        yield fields, content[stop + 4 : stop + 4 + n]
        at = stop + 4 + n
        while content[at : at + 2] == b"\r\n":
            at += 2


def range_records(file: pa.NativeFile, size: int, start: int, end: int) -> Iterator[tuple[dict[str, str], bytes]]:
    """Records of the members that start in [start, end)."""
    members, place = Members(file, size), start
    while (at := members.find(place, end)) is not None:
        if (found := members.decode(at)) is None:
            place = at + 1
            continue
        yield from records_in(found[0])
        place = found[1]


def read_warc(archives: DataFrame, range_bytes: int = RANGE, payloads: bool = True) -> DataFrame:
    """Records of archives (path, bytes): record_id, type, url, payload_bytes, payload_digest, refers_to, payload."""
    bounded(archives.sparkSession)
    ranges = archives.where("bytes > 0").select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(range_bytes).cast("long"))).alias("start"))
    n = archives.agg(F.sum(F.ceil(F.col("bytes") / range_bytes))).first()[0] or 0
    # A task reads RANGES ranges, however much there is to read: a lost executor costs little.
    tasks = max(2 * archives.sparkSession.sparkContext.defaultParallelism, -(-n // RANGES))
    ranges = ranges.withColumn("end", F.least(F.col("start") + range_bytes, "bytes")).repartition(tasks)
    names = ["record_id", "type", "url", "payload_bytes", "payload_digest", "refers_to", "payload"]

    def rows(path: str, size: int, start: int, end: int) -> Iterator[tuple]:
        store, name = fs.FileSystem.from_uri(path) if re.match(r"\w+://", path) else (fs.LocalFileSystem(), path)
        with store.open_input_file(name) as file:
            for fields, block in range_records(file, size, start, end):
                kind = fields.get("warc-type")
                payload = block.partition(BREAK)[2] if fields.get("content-type", "").startswith("application/http") else block
                whole = kind != "revisit"
                n = len(payload) if whole else int(fields.get(SIZE.lower(), 0))
                yield fields.get("warc-record-id"), kind, fields.get("warc-target-uri"), n, digest(payload) if whole else fields.get("warc-payload-digest", "").partition(":")[2], fields.get("warc-refers-to"), payload if whole and payloads else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(list(zip(names, [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary()], strict=True)))
        for batch in batches:
            for r in batch.to_pylist():
                held, n = [], 0
                for x in rows(r["path"], r["bytes"], r["start"], r["end"]):
                    held.append(x)
                    n += x[3]
                    if len(held) >= 1000 or n > 16 << 20:
                        yield pa.RecordBatch.from_pylist([dict(zip(names, y, strict=True)) for y in held], schema)
                        held, n = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist([dict(zip(names, y, strict=True)) for y in held], schema)

    return ranges.mapInArrow(run, "record_id string, type string, url string, payload_bytes long, payload_digest string, refers_to string, payload binary")


def page_number(record_id: F.Column, kind: str) -> F.Column:
    """The page_id in a record's name."""
    return F.regexp_extract(record_id, f"{URN}([^>]+)", 1).try_cast(kind)


def warc_round_trip(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """Write pages to archives in the shared folder and read their records back, without payloads."""
    folder = shared_dir(pages.sparkSession)
    written = write_warc(pages, folder, min_revisit_bytes)
    if "://" in folder:
        scheme = folder.partition("://")[0]
        written = written.withColumn("path", F.when(F.col("path").contains("://"), F.col("path")).otherwise(F.concat(F.lit(f"{scheme}://"), "path")))
    kind = pages.schema["page_id"].dataType.simpleString()
    back = read_warc(written, payloads=False).where(F.col("type").isin("response", "revisit"))
    return back.select(page_number(F.col("record_id"), kind).alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), page_number(F.col("refers_to"), kind).alias("refers_to"))
