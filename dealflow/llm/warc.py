"""WARC archives of pages, compressed record by record with a dictionary of their own.

An archive starts with a skippable Zstandard frame that holds a dictionary, built from records
of this archive; each record is a frame of its own, compressed with it. Any such frame can be
read without the others, given the dictionary.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dealflow.llm.common import chunks, columns, joined, scratch, stored, text_or_empty

#: Fixed values of the formats: the frame that holds a dictionary, and the revisit profile.
DICTIONARY_FRAME = 0x184D2A5D
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


@dataclass(frozen=True)
class Settings:
    """An archive holds about ``archive_bytes`` of records, or one larger record. Its dictionary
    of ``dictionary_bytes`` is built from records spread over the archive, up to
    ``training_bytes`` of them and ``sample_bytes`` of each; records themselves are compressed
    whole. Payloads below ``least_bytes`` are never revisits."""

    date: str = "2024-01-01T00:00:00Z"
    archive_bytes: int = 24 << 20
    dictionary_bytes: int = 64 << 10
    training_bytes: int = 4 << 20
    sample_bytes: int = 64 << 10
    least_bytes: int = 0
    level: int = 3


def base32_sha1(data: Column) -> Column:
    """Bare upper-case base32 SHA-1 of a binary column: five hex digits make four characters."""
    digest = F.sha1(data)
    parts = [
        F.lpad(F.conv(F.substring(digest, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)
    ]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)


def revisits(pages: DataFrame, settings: Settings) -> DataFrame:
    """page_id, digest, refers_to of the pages that repeat the payload of a smaller page_id."""
    narrow = pages.filter(f"page_id is not null and payload_bytes >= {settings.least_bytes}")
    narrow = stored(narrow.select("page_id", "digest"), "digests")
    first = narrow.groupBy("digest").agg(
        F.min("page_id").alias("refers_to"), F.max("page_id").alias("last"), F.count("*").alias("rows")
    )
    first = stored(first.filter("last > refers_to").drop("last"), "repeated")
    again = joined(narrow, first, "digest", "rows", narrow.count()).filter("page_id > refers_to")
    return stored(again.select("page_id", "digest", "refers_to").distinct(), "revisits")


def record(page: dict, settings: Settings) -> bytes:
    """One WARC record; that of a revisit has the head of the response only."""
    payload, revisit = page["payload"], page["refers_to"] is not None
    head = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        f"Content-Length: {len(payload)}\r\n\r\n"
    ).encode()
    block = head if revisit else head + payload
    address = page["url"] or f"urn:page:{page['page_id']}"
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<urn:page:{page['page_id']}>"),
        ("WARC-Target-URI", "".join(c if c.isprintable() else "%20" for c in address)),
        ("WARC-Date", settings.date),
        ("WARC-Payload-Digest", f"sha1:{page['digest']}"),
        ("WARC-Block-Digest", f"sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}"),
        ("Content-Type", "application/http;msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if revisit:
        fields[2:2] = [
            ("WARC-Profile", REVISIT),
            ("WARC-Refers-To", f"<urn:page:{page['refers_to']}>"),
        ]
    lines = "".join(f"{name}: {value}\r\n" for name, value in fields)
    return f"WARC/1.1\r\n{lines}\r\n".encode() + block + b"\r\n\r\n"


def dictionary(records: list[bytes], settings: Settings) -> bytes:
    """A dictionary from records spread evenly over the list; empty if they are too few."""
    step = -(-sum(map(len, records)) // settings.training_bytes)
    samples = [r[: settings.sample_bytes] for r in records[:: max(1, step)]]
    try:
        return zstandard.train_dictionary(
            settings.dictionary_bytes, samples, k=512, d=8, level=settings.level
        ).as_bytes()
    except zstandard.ZstdError:
        return b""


def archive(records: list[bytes], settings: Settings) -> Iterator[bytes]:
    """The frames of an archive; without a dictionary frame if none can be built."""
    data = dictionary(records, settings)
    if data:
        yield struct.pack("<II", DICTIONARY_FRAME, len(data)) + data
    known = zstandard.ZstdCompressionDict(data) if data else None
    packer = zstandard.ZstdCompressor(level=settings.level, dict_data=known, write_checksum=True)
    for one in records:
        yield packer.compress(one)


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def write(pages: DataFrame, folder: str, settings: Settings = Settings()) -> DataFrame:
    """Write ``pages`` (page_id, url, payload, digest, refers_to) as archives below ``folder``.

    Returns the stored list of archives: path, records, bytes. Each attempt of a task writes
    files of its own, and only those of the attempt that counts are listed, so a lost executor
    leaves nothing that is read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flushed(records: list[bytes]) -> pa.RecordBatch:
            where, base = opened(folder)
            where.create_dir(base, recursive=True)
            name, size = f"pages-{uuid.uuid4()}.warc.zst", 0
            with where.open_output_stream(f"{base}/{name}") as out:
                for frame in archive(records, settings):
                    size += out.write(frame)
            return pa.record_batch(
                {"path": [f"{folder}/{name}"], "records": [len(records)], "bytes": [size]}
            )

        records, size = [], 0
        for batch in batches:
            for part in chunks(batch, "payload", settings.archive_bytes):
                for page in part.to_pylist():
                    records.append(record(page, settings))
                    size += len(records[-1])
                    if size >= settings.archive_bytes:
                        yield flushed(records)
                        records, size = [], 0
        if records:
            yield flushed(records)

    return stored(pages.mapInArrow(run, "path string, records long, bytes long"), "archives")


def parsed(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record in a stream of bytes."""
    buffer, at = b"", 0

    def more() -> bool:
        nonlocal buffer, at
        data = stream.read(1 << 20)
        buffer, at = buffer[at:] + data, 0
        return bool(data)

    while True:
        while (end := buffer.find(b"\r\n\r\n", at)) < 0:
            if not more():
                if buffer[at:].strip():
                    raise ValueError("the archive ends within a record")
                return
        lines = buffer[at:end].decode().split("\r\n")
        fields = dict(line.split(": ", 1) for line in lines[1:])
        size = int(fields["Content-Length"])
        at = end + 4
        if len(buffer) - at < size + 4:
            rest = [buffer[at:]]
            while (have := sum(map(len, rest))) < size + 4:
                data = stream.read(max(1 << 20, size + 4 - have))
                if not data:
                    raise ValueError("the archive ends within a record")
                rest.append(data)
            buffer, at = b"".join(rest), 0
        yield fields, buffer[at : at + size]
        at += size + 4


def records(path: str) -> Iterable[tuple[dict[str, str], bytes]]:
    """The records of one archive, read in pieces."""
    where, name = opened(path)
    with where.open_input_stream(name) as source:
        start, known = source.read(8), None
        if len(start) == 8 and struct.unpack("<I", start[:4])[0] == DICTIONARY_FRAME:
            known = zstandard.ZstdCompressionDict(source.read(struct.unpack("<I", start[4:])[0]))
            start = b""

        class Rest:
            def read(self, n: int = -1) -> bytes:
                nonlocal start
                given, start = start, b""
                return given or source.read(n)

        unpacker = zstandard.ZstdDecompressor(dict_data=known)
        with unpacker.stream_reader(Rest(), read_across_frames=True) as stream:
            yield from parsed(stream)


def identifier(field: str | None) -> int | None:
    """The page_id in a record's name."""
    own = field.removeprefix("<urn:page:").removesuffix(">") if field else "None"
    return None if own == "None" else int(own)


def read(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """Every record of the listed archives: page_id, uri, record_type, refers_to, payload_bytes,
    payload_digest and, if asked for, payload (null for revisits).

    The payload of a response is hashed again; a digest that differs is an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows, size = [], 0
                for fields, block in records(path):
                    head, _, payload = block.partition(b"\r\n\r\n")
                    kind = fields["WARC-Type"]
                    told = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    if kind == "response":
                        found = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                        if found != told:
                            raise ValueError(f"{fields['WARC-Record-ID']} in {path} is damaged")
                    rows.append(
                        {
                            "page_id": identifier(fields["WARC-Record-ID"]),
                            "uri": fields["WARC-Target-URI"],
                            "record_type": kind,
                            "refers_to": identifier(fields.get("WARC-Refers-To")),
                            "payload_bytes": int(head.split(b"Content-Length: ")[1].split(b"\r")[0]),
                            "payload_digest": told,
                        }
                    )
                    if payloads:
                        rows[-1]["payload"] = payload if kind == "response" else None
                        size += len(payload)
                    if len(rows) >= 5000 or size >= 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    fields = [
        ("page_id", pa.int64(), "long"),
        ("uri", pa.string(), "string"),
        ("record_type", pa.string(), "string"),
        ("refers_to", pa.int64(), "long"),
        ("payload_bytes", pa.int64(), "long"),
        ("payload_digest", pa.string(), "string"),
        ("payload", pa.binary(), "binary"),
    ][: 7 if payloads else 6]
    schema = pa.schema([(n, t) for n, t, _ in fields])
    spread = int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    paths = archives.select("path").repartition(spread, "path")
    return paths.mapInArrow(run, ", ".join(f"{n} {t}" for n, _, t in fields))


def archived(
    pages: DataFrame,
    folder: str | None = None,
    page_id: str = "page_id",
    url: str = "url",
    html: str = "html",
    settings: Settings = Settings(),
) -> DataFrame:
    """Write one record per row of ``pages`` and return the list of archives.

    The payload is the html in UTF-8, empty for null. Of rows with equal payloads those with the
    smallest page_id are responses (all of them, if rows are repeated) and the others revisit
    it. Rows without page_id are responses to which nothing refers; a null url gives the page's
    own name as address. No rows give no archives.
    """
    rows = columns(pages, page_id=page_id, url=url, html=html)
    rows = rows.withColumn("payload", F.encode(text_or_empty("html"), "utf-8")).select(
        F.col("page_id").cast("long").alias("page_id"),
        "url",
        "payload",
        base32_sha1(F.col("payload")).alias("digest"),
        F.octet_length("payload").alias("payload_bytes"),
    )
    again = revisits(rows, settings)
    full = rows.drop("payload_bytes").join(again, ["page_id", "digest"], "left")
    return write(full, folder or scratch(pages.sparkSession, "warc"), settings)
