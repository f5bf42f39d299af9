"""Zstandard-compressed WARC archives: a frame per record and the dictionary in front."""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
from base64 import b16decode, b32decode, b32encode
from collections.abc import Iterable, Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moodtide.llm.frames import stored
from moodtide.session import fresh_dir

# Fixed values of the two formats.
DICTIONARY_FRAME = 0x184D2A5D
ZSTD_MAGIC = b"\x28\xb5\x2f\xfd"
VERSION = b"WARC/1.1\r\n"
RECORD_END = b"\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

ID_PREFIX = "urn:page:"
SAMPLE_BYTES = 2 << 20
DICTIONARY_BYTES = 64 << 10
READ_BYTES = 1 << 20
BATCH_BYTES = 4 << 20

MANIFEST_SCHEMA = "archive string, records long, bytes long"
RECORD_FIELDS = [
    ("archive", pa.string()), ("offset", pa.int64()), ("record_type", pa.string()),
    ("page_id", pa.int64()), ("target_uri", pa.string()), ("payload_bytes", pa.int64()),
    ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()),
    ("error", pa.string()),
]
RECORD_SCHEMA = (
    "archive string, offset long, record_type string, page_id long, target_uri string, "
    "payload_bytes long, payload_digest string, refers_to long, payload binary, error string"
)


def with_revisits(pages: DataFrame, min_bytes: int, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """page_id, url, payload, digest and refers_to (null for responses).

    Of payloads equal in digest and length and of at least ``min_bytes``, the one with the largest
    page_id is the response. Rows that repeat that page_id are responses too; rows without an id
    come after all others and are responses only where no row of the group has one.
    """
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload")
    ).withColumn("digest", F.sha1("payload")).withColumn("length", F.octet_length("payload"))
    largest = (
        rows.where(F.col("length") >= min_bytes)
        .groupBy("digest", "length")
        .agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .drop("n")
    )
    refers = F.when(F.col("page_id").eqNullSafe(F.col("last")), F.lit(None)).otherwise(F.col("last"))
    return rows.join(largest, ["digest", "length"], "left").select(
        "page_id", "url", "payload", "digest", refers.alias("refers_to")
    )


def build_record(page_id, url, payload: bytes, digest: str, refers_to, date: str) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<{ID_PREFIX}{'' if page_id is None else page_id}>"),
        ("WARC-Date", date),
        ("Content-Type", "application/http;msgtype=response"),
        ("WARC-Payload-Digest", "sha1:" + b32encode(b16decode(digest, casefold=True)).decode()),
    ]
    if url is not None:
        head.append(("WARC-Target-URI", quote(url, safe="%/:?#[]@!$&'()*+,;=~")))
    if refers_to is not None:
        head += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<{ID_PREFIX}{refers_to}>")]
    head.append(("Content-Length", str(len(block))))
    return VERSION + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + RECORD_END


def files_at(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path in it.

    Spark's names of S3 (``s3a``, ``s3n``) become Arrow's. Keys and endpoint are then those of the
    environment, not of Spark's settings.
    """
    return fs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", path))


def train(samples: list[bytes]) -> bytes | None:
    """A dictionary from the first payloads of the archive; none where they are too few."""
    size = min(DICTIONARY_BYTES, sum(map(len, samples)) // 8)
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return None


class Archive:
    """One archive being written; nobody sees it before its name is in a manifest."""

    def __init__(self, folder: str, samples: list[bytes]) -> None:
        self.name = f"{folder}/{uuid.uuid4().hex}.warc.zst"
        files, path = files_at(self.name)
        self.out = files.open_output_stream(path, compression=None)
        self.records = self.bytes = 0
        dictionary = train(samples)
        if dictionary:
            self.put(struct.pack("<II", DICTIONARY_FRAME, len(dictionary)) + dictionary)
            self.press = zstandard.ZstdCompressor(3, zstandard.ZstdCompressionDict(dictionary), write_checksum=True)
        else:
            self.press = zstandard.ZstdCompressor(3, write_checksum=True)

    def put(self, data: bytes) -> None:
        self.out.write(data)
        self.bytes += len(data)

    def add(self, record: bytes) -> None:
        self.put(self.press.compress(record))
        self.records += 1

    def close(self) -> tuple[str, int, int]:
        self.out.close()
        return self.name, self.records, self.bytes


def writer(folder: str, archive_bytes: int, date: str):
    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, archive, waiting, samples, sampled = [], None, [], [], 0

        def begin() -> Archive:
            opened = Archive(folder, samples)
            for record in waiting:
                opened.add(record)
            waiting.clear()
            samples.clear()
            return opened

        for batch in batches:
            columns = [batch.column(c) for c in ("page_id", "url", "payload", "digest", "refers_to")]
            for row in zip(*columns):
                page_id, url, payload, digest, refers_to = (x.as_py() for x in row)
                record = build_record(page_id, url, payload.encode(), digest, refers_to, date)
                if archive:
                    archive.add(record)
                else:
                    waiting.append(record)
                    samples.append(record)
                    sampled += len(record)
                    if sampled >= SAMPLE_BYTES:
                        archive, sampled = begin(), 0
                if archive and archive.bytes >= archive_bytes:
                    done.append(archive.close())
                    archive = None
        if waiting:
            archive = begin()
        if archive:
            done.append(archive.close())
        names, records, sizes = (list(x) for x in zip(*done)) if done else ([], [], [])
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), pa.array(records, pa.int64()), pa.array(sizes, pa.int64())],
            ["archive", "records", "bytes"],
        )

    return write


def write_archives(
    pages: DataFrame,
    min_bytes: int = 1000,
    archive_bytes: int = 256 << 20,
    date: str = "2024-01-01T00:00:00Z",
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    folder: str | None = None,
) -> DataFrame:
    """Write a record per page into archives below ``folder`` and return their manifest.

    The manifest has archive, records, bytes. Every task writes files of its own with names never
    used before and closes one at ``archive_bytes`` compressed; a file counts once its name is in
    the manifest, so what lost or repeated tasks leave behind is never read. The dictionary is
    trained on the archive's first records, up to SAMPLE_BYTES, and leads the file in a skippable
    frame; archives of few records have none. A null url leaves out the header.
    """
    spark = pages.sparkSession
    folder = folder or fresh_dir(spark, "llm-warc")
    if ":/" not in folder:
        folder = f"file://{folder}"
    files, path = files_at(folder)
    files.create_dir(path, recursive=True)
    rows = with_revisits(pages, min_bytes, id_col, url_col, html_col)
    return stored(rows.mapInArrow(writer(folder, archive_bytes, date), MANIFEST_SCHEMA), "manifest")


def frames(stream) -> Iterator[tuple[int, bytes]]:
    """Offset and content of each frame after the dictionary; only one frame is held at a time."""
    data, offset, dictionary = stream.read(8), 0, None
    if len(data) == 8 and struct.unpack("<I", data[:4])[0] == DICTIONARY_FRAME:
        size = struct.unpack("<I", data[4:])[0]
        dictionary = stream.read(size)
        if len(dictionary) < size:
            raise ValueError("the dictionary frame is cut off")
        if dictionary[:4] == ZSTD_MAGIC:
            dictionary = zstandard.ZstdDecompressor().decompress(dictionary)
        offset, data = 8 + size, b""
    context = zstandard.ZstdDecompressor(zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
    data = data or stream.read(READ_BYTES)
    while data:
        frame, parts, used = context.decompressobj(), [], 0
        while data:
            parts.append(frame.decompress(data))
            if frame.eof:
                used += len(data) - len(frame.unused_data)
                data = frame.unused_data
                break
            used += len(data)
            data = stream.read(READ_BYTES)
        if not frame.eof:
            raise ValueError("the last frame is cut off")
        yield offset, b"".join(parts)
        offset += used
        data = data or stream.read(READ_BYTES)


def parse_head(lines: list[bytes]) -> dict[str, str]:
    fields = {}
    for line in lines:
        name, colon, value = line.partition(b":")
        if not colon or not re.fullmatch(rb"[!#$%&'*+.^_`|~0-9A-Za-z-]+", name):
            raise ValueError(f"bad header line {line[:40]!r}")
        fields[name.decode().lower()] = value.strip().decode()
    return fields


def number_in(record_id: str) -> int | None:
    inner = re.fullmatch(rf"<{ID_PREFIX}(-?\d*)>", record_id)
    if not inner:
        raise ValueError(f"unknown record id {record_id[:60]!r}")
    return int(inner[1]) if inner[1] else None


def parse_record(data: bytes) -> dict:
    """Check one record and take it apart; ValueError says what is wrong."""
    if not data.startswith(VERSION):
        raise ValueError("no WARC version line")
    head, gap, rest = data[len(VERSION):].partition(b"\r\n\r\n")
    if not gap:
        raise ValueError("no end of headers")
    fields = parse_head(head.split(b"\r\n"))
    if missing := {"warc-type", "warc-record-id", "warc-date", "content-length"} - fields.keys():
        raise ValueError(f"missing headers {sorted(missing)}")
    if not fields["content-length"].isdecimal() or len(rest) != int(fields["content-length"]) + len(RECORD_END):
        raise ValueError(f"content-length {fields['content-length']} for {len(rest) - len(RECORD_END)} bytes")
    if not rest.endswith(RECORD_END):
        raise ValueError("no end of record")
    kind = fields["warc-type"]
    if kind not in ("response", "revisit"):
        raise ValueError(f"unknown type {kind[:20]!r}")
    http, gap, payload = rest[: -len(RECORD_END)].partition(b"\r\n\r\n")
    http_fields = parse_head(http.split(b"\r\n")[1:])
    if not gap or not http_fields.get("content-length", "").isdecimal():
        raise ValueError("no HTTP headers with a length")
    length = int(http_fields["content-length"])
    scheme, _, coded = fields.get("warc-payload-digest", "").partition(":")
    if scheme != "sha1":
        raise ValueError("no SHA-1 of the payload")
    digest = b32decode(coded).hex()
    if kind == "response" and (length != len(payload) or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError("the payload does not agree with its length or digest")
    if kind == "revisit" and (payload or "warc-refers-to" not in fields):
        raise ValueError("a revisit with a payload or without its response")
    return {
        "record_type": kind, "page_id": number_in(fields["warc-record-id"]),
        "target_uri": fields.get("warc-target-uri"), "payload_bytes": length, "payload_digest": digest,
        "refers_to": number_in(fields["warc-refers-to"]) if kind == "revisit" else None,
        "payload": payload,
    }


def read_archive(archive: str, records: int | None, payloads: bool) -> Iterator[dict]:
    """Rows of one archive; a row with an error for each record that fails, and one for the file
    if frames are damaged or their number is not ``records``."""
    files, path = files_at(archive)
    seen, offset, none = 0, 0, dict.fromkeys(name for name, _ in RECORD_FIELDS)
    with files.open_input_stream(path, compression=None) as stream:
        try:
            for offset, data in frames(stream):
                seen += 1
                row = none | {"archive": archive, "offset": offset}
                try:
                    row |= parse_record(data)
                except ValueError as error:
                    row["error"] = str(error)
                if not payloads:
                    row["payload"] = None
                yield row
        except (ValueError, zstandard.ZstdError) as error:
            yield none | {"archive": archive, "offset": offset, "error": f"after {seen} records: {error}"}
        else:
            if records is not None and seen != records:
                yield none | {"archive": archive, "error": f"{seen} records instead of {records}"}


def reader(payloads: bool, strict: bool):
    def packed(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist(rows, pa.schema(RECORD_FIELDS))

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, records in zip(batch.column("archive").to_pylist(), batch.column("records").to_pylist()):
                rows, held = [], 0
                for row in read_archive(archive, records, payloads):
                    if strict and row["error"]:
                        raise ValueError(f"{archive} at {row['offset']}: {row['error']}")
                    rows.append(row)
                    held += 200 + len(row["payload"] or b"")
                    if held >= BATCH_BYTES:
                        yield packed(rows)
                        rows, held = [], 0
                if rows:
                    yield packed(rows)

    return read


def read_archives(manifest: DataFrame, payloads: bool = True, strict: bool = True) -> DataFrame:
    """Every record of the archives in ``manifest`` (archive, records; null records: any number).

    Reads the dictionary from the leading skippable frame and then one frame per record. Version,
    headers, lengths and digests are checked; a failure ends the job, or with ``strict`` off stands
    in the column ``error``. Archives are dealt to tasks one by one and read as streams.
    """
    spark: SparkSession = manifest.sparkSession
    tasks = max(1, min(manifest.count(), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    dealt = manifest.select("archive", "records").repartition(tasks, "archive")
    return dealt.mapInArrow(reader(payloads, strict), RECORD_SCHEMA)
