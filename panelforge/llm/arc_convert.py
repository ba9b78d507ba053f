"""Legacy archive converter: ARC to WARC.

An ARC file begins with a version block, whose body names the fields of the record lines; each
record is such a line, the declared number of bytes, and a line feed.  Version 1 has five
fields (URL, IP, date, type, length), version 2 ten (with result code, checksum, location,
offset and file name between type and length).  ``parse_arc`` reads the version from the file's
own header, takes the lengths as declared (a payload may hold anything, also lines that look
like headers) and ``to_warc`` makes the WARC record that is equivalent: identifier (a name-based
UUID of URL, date and the record's key), WARC date, type and digests.  The version block becomes
a ``warcinfo`` record; a block with an HTTP header a ``response``, one without (name look-ups,
old servers' bare bodies) a ``resource``.  Records whose payload is that of another are revisits
of the one with the smallest key; among equal keys, of the first in the archives.

Archives are cut at about ``ARC_BYTES``; a WARC file holds at most ``WARC_RECORDS`` records, each a
gzip member of its own, and is read member by member.  Bytes are written as they are: a payload
need not be text.

Defined results: a null html is an empty payload; a null url is ``urn:page:<id>``; rows with
equal ids and payloads: exactly one of them is the response; a null page_id never is smallest,
and is response only where all of its payload are null; an empty table gives no record.  An ARC
or WARC file that is cut off or not as long as declared is an error.  Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, dropped, map_batches, shared_dir, written

ARC_BYTES = 1 << 20
WARC_RECORDS = 20_000
ARC_DATE = "20240102030405"
#: The field lists of the two versions of the format.
FIELDS = {
    1: b"URL IP-address Archive-date Content-type Archive-length",
    2: b"URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:arc-record")


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def http_block(key: str | None, html: bytes) -> bytes:
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n" % len(html)
    if key is not None:
        head += f"X-Record-Key: {key}\r\n".encode()
    return head + b"\r\n" + html


def arc_file(name: str, version: int, records: list[tuple[str, bytes]]) -> bytes:
    """An ARC file of (url, block) records."""
    body = b"%d 0 panelforge\n%s\n" % (version, FIELDS[version])
    tail = b"200 - - 0 %s " % name.encode() if version == 2 else b""
    out = [b"filedesc://%s 0.0.0.0 %s text/plain %s%d\n%s\n" % (name.encode(), ARC_DATE.encode(), tail, len(body), body)]
    at = len(out[0])
    for url, block in records:
        safe = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url).encode()
        if version == 2:
            sum_ = hashlib.md5(block).hexdigest().encode()
            tail = b"200 %s - %d %s " % (sum_, at, name.encode())
        out.append(b"%s 0.0.0.0 %s text/html %s%d\n%s\n" % (safe, ARC_DATE.encode(), tail, len(block), block))
        at += len(out[-1])
    return b"".join(out)


def parse_arc(data: bytes) -> Iterator[dict[str, object]]:
    """Version block and records of an ARC file (gzip or not), as its header line's version and
    declared lengths say."""
    if data[:2] == b"\x1f\x8b":
        data = b"".join(inflate(data))
    at, names = 0, None
    while at < len(data):
        eol = data.find(b"\n", at)
        line = data[at : max(eol, at)].split(b" ")
        if not line[-1].isdigit():
            raise ValueError(f"no record line at {at}")
        size = int(line[-1])
        body = data[eol + 1 : eol + 1 + size]
        if len(body) != size or data[eol + 1 + size : eol + 2 + size] != b"\n":
            raise ValueError(f"the record at {at} is not as long as declared")
        if names is None:
            version_line, fields = body.split(b"\n")[:2]
            version = int(version_line.split(b" ")[0])
            names = [f.decode() for f in fields.split(b" ")]
            if not line[0].startswith(b"filedesc://") or len(names) != len(FIELDS[version].split(b" ")):
                raise ValueError("no version block")
            yield {"url": line[0].decode("utf-8", "replace"), "ip": "0.0.0.0", "date": line[2].decode(), "type": "version", "block": body}
        else:
            if len(line) != len(names):
                raise ValueError(f"the record line at {at} has {len(line)} fields")
            r = dict(zip(names, (x.decode("utf-8", "replace") for x in line), strict=True))
            if "Checksum" in r and hashlib.md5(body).hexdigest() != r["Checksum"]:
                raise ValueError(f"the record at {at} has another checksum")
            yield {"url": r["URL"], "ip": r["IP-address"], "date": r["Archive-date"], "type": r["Content-type"], "block": body}
        at = eol + 2 + size


def split_http(block: bytes) -> tuple[bytes, dict[str, str], bytes]:
    """(header bytes with the empty line, header fields in lower case, payload); a block that is no
    HTTP response is payload altogether."""
    cut = block.find(b"\r\n\r\n") + 4
    if not block.startswith(b"HTTP/") or cut < 4:
        return b"", {}, block
    fields = (x.partition(":") for x in block[:cut].decode("latin-1").split("\r\n")[1:] if x)
    return block[:cut], {k.lower(): v.strip() for k, _, v in fields}, block[cut:]


def record_id(url: str, date: str, key: str | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{url} {date} {key}')}>"


def to_warc(arc: dict, refers: tuple[str, str, str] | None = None) -> bytes:
    """The WARC record equivalent to an ARC record.  ``refers``: (key, url, date) of the record that
    it revisits; the payload is then left out."""
    head, fields, payload = split_http(arc["block"])
    date = lambda d: f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"
    block = head if refers else arc["block"]
    info = arc["type"] == "version"
    kind = "warcinfo" if info else "revisit" if refers else "response" if head else "resource"
    content = "application/x-arc-version-block" if info else "application/http; msgtype=response" if head else arc["type"]
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {record_id(arc['url'], arc['date'], fields.get('x-record-key'))}",
        f"WARC-Date: {date(arc['date'])}",
        f"WARC-Filename: {arc['url'].removeprefix('filedesc://')}" if info else f"WARC-Target-URI: {arc['url']}",
        f"WARC-IP-Address: {arc['ip']}",
        f"WARC-Payload-Digest: sha1:{sha1_base32(payload)}",
        f"WARC-Payload-Length: {len(payload)}",
        f"WARC-Block-Digest: sha1:{sha1_base32(block)}",
    ]
    if refers:
        lines += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: {record_id(refers[1], refers[2], refers[0])}",
            f"WARC-Refers-To-Target-URI: {refers[1]}",
            f"WARC-Refers-To-Date: {date(refers[2])}",
            f"WARC-Refers-To-Key: {refers[0] or ''}",
        ]
    lines += [f"Content-Type: {content}", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def member(record: bytes) -> bytes:
    """A gzip member without its last byte, which is 0: the writer's separator supplies it.  (The
    byte is the highest of the record's length; where it is not 0, an empty member follows.)"""
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    out = z.compress(record) + z.flush()
    if out[-1]:
        z = zlib.compressobj(6, zlib.DEFLATED, 31)
        out += z.flush()
    return out[:-1]


def pages_to_arc(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Rows (archive, content): ARC files of about ``ARC_BYTES``, of both versions in turn."""
    p = pages.select(F.col(id_col).cast("string").alias("key"), F.coalesce(F.col(url_col), F.concat(F.lit("urn:page:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        part = TaskContext.get().partitionId()
        for b in blocks(batches, "html", ARC_BYTES):
            html = b.column("html").cast(pa.binary()).to_pylist()
            records = [(u, http_block(k, h)) for k, u, h in zip(b.column("key").to_pylist(), b.column("url").to_pylist(), html, strict=True)]
            name = f"{part:06d}-{n:06d}.arc"
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([arc_file(name, 1 + n % 2, records)], pa.binary())], ["archive", "content"])
            n += 1

    return map_batches(p, run, "archive string, content binary")


def arc_records(archives: DataFrame) -> DataFrame:
    """Records of the ARC files in a table (archive, content): place in the archives, key, url,
    date, ip, type, block, and the payload's digest and size."""
    schema = "archive string, at long, key string, url string, date string, ip string, type string, block binary, digest string, size long"
    kinds = [pa.string(), pa.int64()] + [pa.string()] * 5 + [pa.binary(), pa.string(), pa.int64()]
    names = [c.split(" ")[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column("archive").to_pylist(), b.column("content"), strict=True):
                out: list[tuple] = []
                held = 0
                for at, r in enumerate(parse_arc(content.as_py())):
                    _, fields, payload = split_http(r["block"])
                    out.append((name, at, fields.get("x-record-key"), r["url"], r["date"], r["ip"], r["type"], r["block"], sha1_base32(payload), len(payload)))
                    held += len(r["block"])
                    if held > 4 * ARC_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)
                        out, held = [], 0
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return map_batches(archives, run, schema)


def convert(archives: DataFrame, path: str, least_bytes: int = 0) -> None:
    """Convert ARC files to WARC files in ``path``.  The archives are written to the shared folder
    first, so that a record's place in them stays what it is.  Only keys and digests are grouped
    to find the responses; blocks are dealt once, by digest, where a hot one is split."""
    kept = written(archives.select("archive", "content"), "arc", "zstd")
    r = arc_records(kept)
    key = F.expr("try_cast(key as bigint)")
    page = F.col("type") != "version"
    first = r.where(page & (F.col("size") >= least_bytes)).groupBy("digest").agg(F.min_by(F.struct("key", "url", "date", "archive", "at"), F.struct(key.isNull(), key, "key", "url", "archive", "at")).alias("first"), F.count("*").alias("copies")).where("copies > 1").select("digest", "first")
    j = r.join(first, "digest", "left").select("archive", "at", "key", "url", "date", "ip", "type", "block", F.when(page, F.col("first")).alias("first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, "block"):
            out = []
            for row in b.to_pylist():
                f = row["first"]
                mine = f is None or (f["archive"], f["at"]) == (row["archive"], row["at"])
                out.append(member(to_warc(row, None if mine else (f["key"], f["url"], f["date"]))))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    # The text writer puts a string's bytes down as they are, and the separator after each.
    members = map_batches(j, run, "value binary").select(F.col("value").cast("string").alias("value"))
    members.write.option("lineSep", "\0").option("maxRecordsPerFile", WARC_RECORDS).text(path)
    dropped(kept)


def parse_warc(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of the records in a stream of bytes."""
    buf = bytearray()
    fields: dict[str, str] | None = None
    need = 0
    for c in chunks:
        buf += c
        at = 0
        while True:
            if fields is None:
                cut = buf.find(b"\r\n\r\n", at)
                if cut < 0:
                    break
                head = buf[at:cut].decode("utf-8", "replace").split("\r\n")
                if not head[0].startswith("WARC/"):
                    raise ValueError(f"no record at {at}: {head[0][:40]}")
                fields = {k: v.strip() for k, _, v in (x.partition(":") for x in head[1:])}
                need, at = int(fields["Content-Length"]), cut + 4
            if len(buf) - at < need + 4:
                break
            block = bytes(buf[at : at + need])
            if buf[at + need : at + need + 4] != b"\r\n\r\n":
                raise ValueError("a record is not as long as declared")
            yield fields, block
            at += need + 4
            fields = None
        del buf[:at]
    if buf or fields is not None:
        raise ValueError("the last record is cut off")


def inflate(data: bytes, step: int = 1 << 20) -> Iterator[bytes]:
    """The content of all gzip members, piece by piece."""
    at = 0
    while at < len(data):
        z = zlib.decompressobj(31)
        while not z.eof:
            feed = z.unconsumed_tail
            if not feed:
                feed = data[at : at + step]
                at += len(feed)
            part = z.decompress(feed, step)
            if part:
                yield part
            elif not feed and not z.eof:
                raise ValueError("the last gzip member is cut off")
        at -= len(z.unused_data)


def read_warc(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """Records of the WARC files in a folder, each checked against its block digest."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    schema = "key string, url string, record_id string, record_type string, payload_digest string, payload_bytes long, refers_to string, refers_to_id string" + (", payload binary" if with_payload else "")
    kinds = [pa.string()] * 5 + [pa.int64(), pa.string(), pa.string()] + [pa.binary()] * with_payload
    names = [x.split(" ")[0] for x in schema.split(", ")]

    def rows(content: bytes) -> Iterator[tuple]:
        for f, block in parse_warc(inflate(content)):
            if f["WARC-Block-Digest"] != f"sha1:{sha1_base32(block)}":
                raise ValueError(f"{f['WARC-Record-ID']} is damaged")
            _, http, payload = split_http(block)
            kind = f["WARC-Type"]
            if kind != "revisit" and f["WARC-Payload-Digest"] != f"sha1:{sha1_base32(payload)}":
                raise ValueError(f"{f['WARC-Record-ID']} has another payload")
            row = (http.get("x-record-key"), f.get("WARC-Target-URI"), f["WARC-Record-ID"], kind, f["WARC-Payload-Digest"][5:], int(f["WARC-Payload-Length"]), f.get("WARC-Refers-To-Key"), f.get("WARC-Refers-To"))
            yield row + ((payload,) if with_payload else ())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column("content"):
                every = rows(content.as_py())
                while out := list(islice(every, 512)):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return map_batches(files, run, schema)


def op4_arc_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "warc")
    convert(pages_to_arc(spark.read.parquet(f"{sf_dir}/pages.parquet")), path)
    r = read_warc(spark, path).where("record_type <> 'warcinfo'")
    return r.select(F.expr("try_cast(key as bigint)").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.expr("try_cast(refers_to as bigint)").alias("refers_to"), "record_id", "refers_to_id")


QUERIES = {"op4_arc_convert": op4_arc_convert}
