"""WARC archives of individually compressed records that share a Zstandard dictionary.

Each archive is a .warc.zst file: a leading skippable frame holds the dictionary, itself trained on
records of that archive, and every record is one frame. Records with an equal payload revisit the
one of the smallest page_id. Archives are written by the executors through the file system that
spark.checkpoint.dir names, and read back by
them through the manifest that Spark commits.
"""

from __future__ import annotations

import hashlib
import struct
import uuid

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Staged, small_batches

MAGIC = 0x184D2A5D  # fixed value: the skippable frame of a dictionary
DATE = "2020-01-01T00:00:00Z"
#: An archive is closed at so many bytes of records before compression (and holds one record at least).
ARCHIVE_BYTES = 24 << 20
DICTIONARY_BYTES = 64 << 10
#: The dictionary is trained on so many bytes of the archive's records, an equal share and a kilobyte at least of each.
SAMPLE_BYTES = 4 << 20
LEVEL = 6
LEAST_REVISIT = 100
#: Tasks over which copies of one payload are spread.
SALTS = 16
_PAGE = "urn:uuid:"


def record_id(page_id: int | None) -> str:
    return f"<{_PAGE}{uuid.UUID(int=1 << 64 if page_id is None else page_id & (1 << 64) - 1)}>"


def page_of(rid: str) -> int | None:
    n = uuid.UUID(rid.strip("<>").removeprefix(_PAGE)).int
    if n >> 64:
        return None
    return n - (1 << 64) if n >> 63 else n


def build_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A WARC/1.1 response, or a revisit that carries the HTTP head only."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if refers_to is None else http
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_line(url)}")
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to)}"]
    head += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _line(url: str) -> str:
    """One header line, reversibly: control signs and % are percent-encoded if any control sign is there."""
    return "".join(f"%{ord(c):02X}" if ord(c) < 32 or c in "%\x7f" else c for c in url) if any(ord(c) < 32 or c == "\x7f" for c in url) else url


def train_dictionary(records: list[bytes], size: int = DICTIONARY_BYTES, sample_bytes: int = SAMPLE_BYTES) -> bytes:
    """From the beginnings of all records, and more of them the fewer they are; empty where they are too few or too alike to train one."""
    each = max(1 << 10, sample_bytes // max(1, len(records)))
    some = [r[at : at + (1 << 17)] for r in records for at in range(0, min(len(r), each), 1 << 17)]
    if len(some) < 16:
        return b""
    try:
        return zstandard.train_dictionary(min(size, max(1024, sum(map(len, some)) // 8)), some, k=256, d=8).as_bytes()
    except zstandard.ZstdError:
        return b""


def pack_archive(records: list[bytes]) -> bytes:
    """The bytes of one archive."""
    raw = train_dictionary(records)
    own = zstandard.ZstdCompressionDict(raw) if raw else None
    c = zstandard.ZstdCompressor(level=LEVEL, dict_data=own, write_content_size=True, write_checksum=True)
    return b"".join([struct.pack("<II", MAGIC, len(raw)), raw, *map(c.compress, records)])


def read_archive(data: bytes):
    """The records of an archive, one at a time."""
    magic, size = struct.unpack_from("<II", data)
    if magic != MAGIC:
        raise ValueError("no dictionary frame")
    raw = data[8 : 8 + size]
    d = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw) if raw else None)
    at, view = 8 + size, memoryview(data)
    while at < len(data):
        frame, out = d.decompressobj(), []
        while not frame.eof:
            if at >= len(data):
                raise ValueError("the last record is cut off")
            out.append(frame.decompress(view[at : at + 4096]))
            at = min(at + 4096, len(data))
        at -= len(frame.unused_data)
        yield b"".join(out)


def parse_record(raw: bytes) -> tuple:
    """(page_id, url, payload or None, payload_bytes, digest, record_type, refers_to) of a record."""
    head, _, block = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = block[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(dict(x.split(b": ", 1) for x in http.split(b"\r\n")[1:])[b"Content-Length"])
    kind = fields["WARC-Type"]
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    refers = fields.get("WARC-Refers-To")
    return page_of(fields["WARC-Record-ID"]), fields.get("WARC-Target-URI"), payload if kind == "response" else None, size, digest, kind, page_of(refers) if refers else None


def write_archives(pages: DataFrame, staged: Staged, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes one record per row of pages (page_id, url, html); returns the manifest: path, records, bytes.

    A task that is tried again writes new files; only those of the attempt that Spark commits are in the manifest.
    """
    small_batches(pages.sparkSession)
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"))
    p = p.withColumn("digest", F.sha2("payload", 256))
    long = F.octet_length("payload") >= LEAST_REVISIT
    # Only keys with copies; counted before the shuffle, so a payload that a third of all pages share is one row a task.
    first = p.where(long).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    # The rows carry payloads: copies of one digest are spread over SALTS tasks, and short payloads, which refer to none, over all.
    first = first.select("digest", "first", F.explode(F.array(*map(F.lit, range(SALTS)))).alias("salt")).select(F.concat_ws("/", "digest", "salt").alias("key"), "first")
    place = F.xxhash64("page_id", "url")
    p = p.withColumn("key", F.when(long, F.concat_ws("/", "digest", F.pmod(place, F.lit(SALTS)))).otherwise(place.cast("string")))
    p = p.join(first, "key", "left").withColumn("refers_to", F.when(long & (F.col("first") < F.col("page_id")), F.col("first")))
    where = f"{staged.root}/archives"

    def run(batches):
        from pyarrow import fs

        store, folder = fs.FileSystem.from_uri(where)
        store.create_dir(folder, recursive=True)
        records, size = [], 0

        def close():
            path = f"{folder}/{uuid.uuid4().hex}.warc.zst"
            data = pack_archive(records)
            with store.open_output_stream(path) as out:
                out.write(data)
            return pa.RecordBatch.from_arrays([pa.array([f"{where}/{path.rpartition('/')[2]}"]), pa.array([len(records)]), pa.array([len(data)])], names=["path", "records", "bytes"])

        for b in batches:
            for page, url, payload, digest, refers in zip(*(c.to_pylist() for c in b.columns)):
                records.append(build_record(page, url, payload, digest, refers))
                size += len(records[-1])
                if size >= archive_bytes:
                    yield close()
                    records, size = [], 0
        if records:
            yield close()

    return staged.put(p.select("page_id", "url", "payload", "digest", "refers_to").mapInArrow(run, "path string, records long, bytes long"), "manifest")


def read_archives(manifest: DataFrame, payloads: bool = False) -> DataFrame:
    """One row per record of the archives, each payload held against its digest: page_id, payload_bytes, payload_digest,
    record_type, refers_to, url and, where asked for, payload (null for revisits)."""

    def run(batches):
        from pyarrow import fs

        for b in batches:
            for path in b.column(0).to_pylist():
                store, name = fs.FileSystem.from_uri(path)
                with store.open_input_stream(name) as file:
                    data = file.read()
                rows = []
                for raw in read_archive(data):
                    page, url, payload, size, digest, kind, refers = parse_record(raw)
                    rows.append((page, size, digest, kind, refers, url, *([payload] if payloads else [])))
                    if len(rows) == 500:
                        yield batch(rows)
                        rows = []
                if rows:
                    yield batch(rows)

    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"]

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names[: len(rows[0])])

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string" + ", payload binary" * payloads
    return manifest.select("path").mapInArrow(run, schema)


def archive_pages(pages: DataFrame, payloads: bool = False) -> DataFrame:
    """Writes the pages as archives and reads them back, a row per row of pages.

    Null html is an empty payload; payloads under LEAST_REVISIT bytes are always responses. Repeated rows with one
    page_id are each a response. A null page_id is kept and never refers to another page; a null url has no
    target line. An empty table gives no archives and no rows; columns other than page_id, url and html are not read.
    """
    staged = Staged(pages.sparkSession, "warc")
    return read_archives(write_archives(pages, staged), payloads)
