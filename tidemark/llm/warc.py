"""Legacy archive converter: ARC records of versions 1 and 2 to WARC/1.1, and a reader of what it wrote.

An ARC file begins with a version block (``filedesc://``) whose second line names the version and whose third line
names the fields of a record's header line: version 1 has URL, IP, date, content type and length; version 2 has also
result code, checksum, location, offset and file name between content type and length. The length is that of what
follows the header line, and only it ends a record. The converter makes of each ARC record a WARC record: identifier
(a name-based UUID of URL, date and digest), ISO timestamp, type, block and payload digests; the version block becomes
a warcinfo record.

Records that repeat a payload are written as revisits of the record with the largest id. Archives are written by
Spark's text writer, whose line separator is the end of a WARC record, so that the files are gzipped WARC (one member a
file) and a lost executor's attempt is written anew. They are read by Spark's text reader as a stream: a task holds one
record at a time, by its declared length, and ``RECORDS_PER_FILE`` only sets how many tasks there are. Archives of ARC
records, plain or gzipped with any number of members, are read by ``convert_archives``: a task holds one file as it is
stored and one record unpacked.

Defined results: a null payload is empty; payloads of fewer than ``least`` bytes are always responses; rows without an
id take part as a null id (never referred to unless no other row of the payload has an id); rows that repeat an id with
an equal payload are responses both, as each holds the largest id; a null URL is written as ``urn:page:<id>``; an empty
table gives no records. Pages may be of any length. Extra columns are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Iterator
from typing import BinaryIO

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, new_path

# Fixed values of the two formats.
ARC_FIELDS = {
    1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    2: ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"],
}
END = b"\r\n\r\n"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORDS_PER_FILE = 1_000


def sha1_32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def arc_version_block(version: int, name: str, date: str) -> bytes:
    body = f"{version} 0 tidemark\n{' '.join(ARC_FIELDS[version])}\n".encode()
    head = [f"filedesc://{name}", "0.0.0.0", date, "text/plain", *(["200", "-", "-", "0", name] if version == 2 else []), str(len(body))]
    return " ".join(head).encode() + b"\n" + body + b"\n"


def clean(url: str) -> str:
    """White space would end a field."""
    return re.sub(r"\s", "%20", url)


def arc_record(version: int, url: str, date: str, content: bytes, ip: str = "0.0.0.0", mime: str = "text/html", name: str = "-", offset: int = 0) -> bytes:
    """``content``: status line, headers, an empty line and the payload."""
    middle = ["200", sha1_32(content), "-", str(offset), name] if version == 2 else []
    return " ".join([clean(url), ip, date, mime, *middle, str(len(content))]).encode("utf-8", "replace") + b"\n" + content + b"\n"


def parse_arc(data: bytes | BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields by lower-case name, content) of each record, the version block first; gzip is unpacked."""
    stream = io.BufferedReader(io.BytesIO(data)) if isinstance(data, bytes) else io.BufferedReader(data)
    if stream.peek(2)[:2] == b"\x1f\x8b":
        stream = gzip.GzipFile(fileobj=stream)
    fields, version = None, 1
    while line := stream.readline():
        if line == b"\n":  # what stands between records
            continue
        if not line.endswith(b"\n"):
            raise ValueError("an ARC header line has no end")
        parts = line[:-1].decode("utf-8", "replace").split(" ")
        content = stream.read(int(parts[-1]))
        if len(content) < int(parts[-1]):
            raise ValueError("an ARC record is shorter than declared")
        if fields is None:
            if not parts[0].startswith("filedesc://"):
                raise ValueError("no ARC version block")
            first, names = content.decode("utf-8", "replace").split("\n")[:2]
            version, fields = int(first.split(" ")[0]), [x.lower() for x in names.split(" ")]
            if version not in ARC_FIELDS or len(fields) != len(ARC_FIELDS[version]):
                raise ValueError(f"unknown ARC version {version}")
        if len(parts) < len(fields):
            raise ValueError("an ARC header line has too few fields")
        # A URL that holds spaces makes the line longer: the other fields count from its end.
        extra = len(parts) - len(fields)
        yield dict(zip(fields, [" ".join(parts[: extra + 1]), *parts[extra + 1 :]], strict=True)) | {"version": str(version)}, content


def iso(date: str) -> str:
    """An ARC date of 8 to 14 digits as a WARC timestamp; what is missing is the least possible."""
    d = (date if date.isdigit() else "") + "19700101000000"[min(len(date), 14) if date.isdigit() else 0 :]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def split_http(content: bytes) -> tuple[bytes, bytes]:
    """Headers with their empty line, and payload."""
    if not content.startswith(b"HTTP/"):
        return b"", content
    at = content.find(END)
    return (content[: at + 4], content[at + 4 :]) if at >= 0 else (content, b"")


def warc_record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """Without the two line ends that follow each record."""
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers).encode("utf-8", "replace") + f"Content-Length: {len(block)}\r\n\r\n".encode() + block


def record_id(url: str, date: str, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{url} {date} {digest}')}>"


def convert(fields: dict[str, str], content: bytes, refers_to: str | None = None, extra: list[tuple[str, str]] = ()) -> bytes:
    """A WARC record of one ARC record. With ``refers_to``: a revisit, whose block has the HTTP headers only."""
    url, date = fields["url"], iso(fields["archive-date"])
    if url.startswith("filedesc://"):
        return warc_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(url, date, "")), ("WARC-Date", date), ("WARC-Filename", url[11:]), ("Content-Type", "application/warc-fields")], content)
    http, payload = split_http(content)
    digest = sha1_32(payload)
    block = http if refers_to is not None else content
    kind = "revisit" if refers_to is not None else "response" if http else "resource"
    head = [("WARC-Type", kind), ("WARC-Record-ID", record_id(url, date, digest)), ("WARC-Date", date), ("WARC-Target-URI", url), ("WARC-IP-Address", fields["ip-address"]),
            ("Content-Type", "application/http; msgtype=response" if http else fields["content-type"]), ("WARC-Block-Digest", f"sha1:{sha1_32(block)}"), ("WARC-Payload-Digest", f"sha1:{digest}")]
    if refers_to is not None:
        head += [("WARC-Profile", REVISIT), ("WARC-Refers-To", refers_to), ("WARC-Truncated", "length")]
    return warc_record([*head, *extra], block)


class Records:
    """Records of a WARC that comes in pieces, each as (header fields by lower-case name, block) once it is whole."""

    def __init__(self):
        self.kept, self.size = [], 0
        self.need = 0  # bytes without which nothing can be said

    def feed(self, piece: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
        self.kept.append(piece)
        self.size += len(piece)
        if self.size < self.need:
            return
        data, at = b"".join(self.kept), 0
        while True:
            self.need = 0
            stop = data.find(END, at)
            if not data.startswith(b"WARC/"[: len(data) - at], at):
                raise ValueError("no WARC record where one should begin")
            if stop < 0:
                break
            head = dict(((k.strip().lower(), v.strip()) for k, _, v in (x.partition(":") for x in data[at:stop].decode("utf-8", "replace").split("\r\n")[1:])))
            begin = stop + 4
            end = begin + int(head["content-length"])
            if len(data) < end + 4:
                self.need = end + 4 - at
                break
            if data[end : end + 4] != END:
                raise ValueError("a WARC record does not end where it declares")
            yield head, data[begin:end]
            at = end + 4
        self.kept, self.size = [data[at:]], len(data) - at

    def close(self) -> None:
        if self.size:
            raise ValueError("a WARC record has no end")


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields by lower-case name, block) of each record; declared lengths end them."""
    records = Records()
    yield from records.feed(gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data)
    records.close()


def convert_archives(spark, path: str) -> DataFrame:
    """(file, record, kind, url, warc) of each record of the ARC files under ``path``: the WARC record made of it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for file, data in zip(pdf["path"], pdf["content"], strict=True):
                for no, (fields, content) in enumerate(parse_arc(data)):
                    made = convert(fields, content) + END
                    ((head, _),) = parse_warc(made)
                    yield pd.DataFrame({"file": [file], "record": [no], "kind": [head["warc-type"]], "url": [fields["url"]], "warc": [made]})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(F.col("path").rlike(r"\.arc(\.gz)?$")).select("path", "content")
    return files.mapInPandas(run, "file string, record long, kind string, url string, warc binary")


def write_archives(pages: DataFrame, path: str, least: int = 0, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> None:
    """Write ARC records of ``pages``, converted to WARC, one record a row, under ``path``."""
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("string"), F.lit("")).alias("html"))
    keyed = rows.withColumn("sha", F.sha1(F.encode("html", "UTF-8")))
    # The largest id of each payload: minima meet before the shuffle, and the join's large keys are split.
    last = keyed.groupBy("sha").agg(F.max(F.struct("id", "url")).alias("last"))
    joined = keyed.join(last, "sha", "left").select("id", "url", "html", F.col("last.id").alias("last"), F.col("last.url").alias("last_url"))

    def when(own: int | None) -> str:
        return f"{2001 + (own or 0) % 8}{1 + (own or 0) % 12:02d}01000000"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for a, b in chunks([x or "" for x in pdf["html"]]):
                part, out = pdf.iloc[a:b], []
                arcs = {v: (io.BytesIO(), []) for v in (1, 2)}  # both versions of the format occur
                for i, url, html, last, last_url in zip(part["id"], part["url"], part["html"], part["last"], part["last_url"], strict=True):
                    payload = html.encode("utf-8", "replace")
                    own, last = None if pd.isna(i) else int(i), None if pd.isna(last) else int(last)
                    version = 1 + (own or 0) % 2
                    arc, facts = arcs[version]
                    if not facts:
                        arc.write(arc_version_block(version, "pages.arc", when(own)))
                    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
                    arc.write(arc_record(version, url or f"urn:page:{own}", when(own), http + payload, name="pages.arc", offset=arc.tell()))
                    facts.append((own, last, last_url, last is not None and own != last and len(payload) >= least, sha1_32(payload)))
                for arc, facts in arcs.values():
                    if not facts:
                        continue
                    arc.seek(0)
                    records = parse_arc(arc)
                    next(records)  # the version block
                    for (fields, content), (own, last, last_url, again, digest) in zip(records, facts, strict=True):
                        extra = [("WARC-Page-ID", "" if own is None else str(own)), ("WARC-Refers-To-Page-ID", str(last))][: 1 + again]
                        target = record_id(clean(last_url or f"urn:page:{last}"), iso(when(last)), digest) if again else None
                        out.append(convert(fields, content, target, extra).decode("utf-8"))
                yield pd.DataFrame({"value": pd.Series(out, dtype=object)})

    joined.mapInPandas(run, "value string").write.option("lineSep", END.decode()).option("maxRecordsPerFile", RECORDS_PER_FILE).option("compression", "gzip").text(path)


def read_archives(spark, path: str) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to) of each record under ``path``.

    Lines end where a WARC record may end; what they hold is a stream of bytes again, from file to file.
    """

    def fact(head: dict[str, str], block: bytes) -> tuple:
        http, payload = split_http(block)
        digest = head["warc-payload-digest"].removeprefix("sha1:")
        if head["warc-type"] == "revisit":  # the payload isn't there: its length stands in the HTTP headers
            size = int(re.search(rb"(?i)\r\ncontent-length: *(\d+)", http)[1])
        else:
            size = len(payload)
            if sha1_32(payload) != digest:
                raise ValueError(f"{head['warc-record-id']}: the payload's digest is another")
        return int(head["warc-page-id"]) if head.get("warc-page-id") else None, head["warc-target-uri"], size, digest, head["warc-type"], int(head["warc-refers-to-page-id"]) if "warc-refers-to-page-id" in head else None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        records = Records()
        for pdf in batches:
            out = [fact(*r) for line in pdf["value"] for r in records.feed(line.encode("utf-8") + END) if r[0]["warc-type"] in ("response", "revisit", "resource")]
            frame = pd.DataFrame(out, columns=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"], dtype=object)
            yield frame.astype({"page_id": "Int64", "payload_bytes": "int64", "refers_to": "Int64"})
        records.close()

    lines = spark.read.option("lineSep", END.decode()).option("recursiveFileLookup", "true").text(path)
    return lines.mapInPandas(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long")


def round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """``pages`` written as archives in the shared folder and read back."""
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write_archives(pages, path, least)
    return read_archives(spark, path)
