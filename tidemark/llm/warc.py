"""WARC archives of records compressed one by one with a Zstandard dictionary, and their reader.

An archive starts with a skippable frame that holds its dictionary, compressed itself, then has a frame a record.
The dictionary is trained on the archive's own records, so that a reader needs the archive alone, and any
record can be read from its frame's offset.

Records: a ``warcinfo``, then per row a ``response``, an HTTP message with the payload, or a ``revisit`` of
the same payload, an HTTP head alone.  Of rows with equal payloads of at least ``least`` bytes those with the
smallest id are responses and the others revisit it; shorter payloads are always responses.

A task writes archives of about ``archive_bytes``, so that it holds no more than that and its longest record.
It names them itself and tells the names; the table of names is written by Spark's committer, and archives that it
doesn't name, left by attempts that failed, aren't read.  Archives lie in a folder that all executors share,
by a path or URI that Arrow's file systems open.

Null payloads are empty; a null id isn't the smallest of others, and is null again when read.  Repeated rows give records of
their own; of equal ids and payloads all are responses, or all revisits.  Line ends and other controls in addresses are
written as percent signs and digits, so that no address ends a header.  Columns besides the three are not read.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.storage import stored

#: The frame that holds the dictionary: a skippable frame of this number.
DICTIONARY_FRAME = 0x184D2A5D
DICTIONARY_BYTES = 64 << 10
#: Bytes of records that the training sees, spread evenly over the archive.
TRAINING_BYTES = 64 * DICTIONARY_BYTES
#: Bytes read at a time.
STEP = 256 << 10
#: Bytes of records that a reading task has on average, where there are more tasks than cores.
TASK_BYTES = 256 << 20

WRITTEN = "archive string, records long, record_bytes long, archive_bytes long"
READ = "archive string, record_id string, record_type string, page_id long, target_uri string, payload_bytes long, payload_digest string, refers_to long"


def _open_folder(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if re.match(r"[a-z0-9+]+:/", uri) else (fs.LocalFileSystem(), uri)


def _record_id(kind: str, page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{kind} {page_id} {digest}')}>"


def _address(url: str | None, page_id: int | None) -> str:
    """A target address in printable ASCII."""
    if not url:
        return f"urn:page:{page_id}"
    return re.sub(rb"[^\x21-\x7e]", lambda m: b"%%%02X" % m[0][0], url.encode()).decode()


def _record(headers: list[tuple[str, object]], block: bytes) -> bytes:
    lines = [f"{name}: {value}" for name, value in [*headers, ("Content-Length", len(block))] if value is not None]
    return "\r\n".join(["WARC/1.1", *lines, "", ""]).encode() + block + b"\r\n\r\n"


def page_record(page_id: int | None, url: str | None, payload: bytes, first: int | None, date: str) -> bytes:
    """The record of a page; ``first`` is the id of the page that it revisits, None for a response."""
    digest = hashlib.sha256(payload).hexdigest()
    kind = "response" if first is None else "revisit"
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    headers: list[tuple[str, object]] = [("WARC-Type", kind), ("WARC-Record-ID", _record_id(kind, page_id, digest)), ("WARC-Date", date), ("WARC-Target-URI", _address(url, page_id)), ("Page-ID", page_id)]
    headers += [("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    if first is None:
        return _record(headers, block + payload)
    headers += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", _record_id("response", first, digest)), ("Refers-To-Page-ID", first)]
    return _record(headers, block)


def train(records: list[bytes]) -> bytes:
    """A dictionary of the records, empty if they are too few or too short for one."""
    step = max(1, -(-sum(map(len, records)) // TRAINING_BYTES))
    chosen = [r[:TRAINING_BYTES] for r in records[::step]]
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, sum(map(len, chosen)) // 8), chosen).as_bytes()
    except zstandard.ZstdError:
        return b""


def packed(records: list[bytes], level: int = 6) -> bytes:
    """The bytes of an archive: the dictionary's frame, if there is one, and a frame a record."""
    trained = train(records)
    held = zstandard.ZstdCompressionDict(trained) if trained else None
    if held:
        held.precompute_compress(level=level)
    frames = zstandard.ZstdCompressor(dict_data=held, write_content_size=True, write_checksum=True, **({} if held else {"level": level}))
    parts = [frames.compress(r) for r in records]
    if trained:
        body = zstandard.ZstdCompressor(level=19).compress(trained)
        parts.insert(0, struct.pack("<II", DICTIONARY_FRAME, len(body)) + body)
    return b"".join(parts)


def _writer(folder: str, date: str, archive_bytes: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = _open_folder(folder)
        held: list[bytes] = []
        size = 0

        def close() -> pa.RecordBatch:
            name = f"{uuid.uuid4().hex}.warc.zst"
            info = _record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", date), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")
            data = packed([info, *held])
            with store.open_output_stream(f"{path}/{name}", compression=None) as out:
                out.write(data)
            row = pa.record_batch({"archive": [name], "records": [len(held)], "record_bytes": [size], "archive_bytes": [len(data)]})
            held.clear()
            return row

        for batch in batches:
            for page_id, url, payload, first in zip(*(batch.column(k) for k in range(4)), strict=True):
                held.append(page_record(page_id.as_py(), url.as_py(), payload.as_py(), first.as_py(), date))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield close()
                    size = 0
        if held:
            yield close()

    return write


def with_first(pages: DataFrame, least: int) -> DataFrame:
    """(page_id, url, payload, first): the id of the row's first equal payload, null for a response.

    Only digests of payloads that several ids share are joined to the rows: as few as there are, sent to the tasks
    if Spark finds them small, else joined by shuffles whose large partitions it splits.
    """
    rows = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.when(F.octet_length("payload") >= least, F.unhex(F.sha2("payload", 256))))
    shared = rows.where("digest IS NOT NULL").groupBy("digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last"), F.count(F.when(F.col("page_id").isNull(), 1)).alias("unnamed"))
    shared = shared.where("first IS NOT NULL AND (first < last OR unnamed > 0)").select("digest", "first")
    return rows.join(shared, "digest", "left").select("page_id", "url", "payload", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("first"))


def write(pages: DataFrame, folder: str, date: str = "2024-01-01T00:00:00Z", least: int = 100, archive_bytes: int = 64 << 20) -> DataFrame:
    """Writes (page_id, url, html) as archives into ``folder`` and returns (archive, records, record_bytes, archive_bytes) of each."""
    store, path = _open_folder(folder)
    store.create_dir(path, recursive=True)
    return stored(with_first(pages, least).mapInArrow(_writer(folder, date, archive_bytes), WRITTEN), "warc-names")


def frames(data: Iterator[bytes]) -> Iterator[bytes]:
    """The contents of an archive's frames, one at a time."""
    rest = next(data, b"")
    held = None
    if len(rest) >= 8 and struct.unpack_from("<I", rest)[0] == DICTIONARY_FRAME:
        end = 8 + struct.unpack_from("<I", rest, 4)[0]
        while len(rest) < end:
            rest += next(data)
        body, rest = rest[8:end], rest[end:]
        held = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(body))
    reader = zstandard.ZstdDecompressor(dict_data=held)
    one, parts = reader.decompressobj(), []
    while True:
        rest = rest or next(data, b"")
        if not rest:
            if parts:
                raise ValueError("the archive ends within a frame")
            return
        parts.append(one.decompress(rest))
        rest = b""
        if one.eof:
            yield b"".join(parts)
            rest, parts, one = one.unused_data, [], reader.decompressobj()


def parsed(record: bytes) -> tuple[dict[str, str], bytes]:
    """The headers of a record and its block."""
    head, block = record.split(b"\r\n\r\n", 1)
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"no record: {lines[0][:40]}")
    headers = dict(line.split(": ", 1) for line in lines[1:])
    size = int(headers["Content-Length"])
    if block[size:] != b"\r\n\r\n":
        raise ValueError(f"{headers['WARC-Record-ID']} is not as long as it says")
    return headers, block[:size]


def page_row(record: bytes) -> dict | None:
    """A page's row from its record: of a response by its payload, which must be that of its digest, of a revisit by its headers."""
    headers, block = parsed(record)
    kind = headers["WARC-Type"]
    if kind not in ("response", "revisit"):
        return None
    head, payload = block.split(b"\r\n\r\n", 1)
    size, digest = int(re.search(rb"\r\nContent-Length: (\d+)", head)[1]), headers["WARC-Payload-Digest"].removeprefix("sha256:")
    if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"{headers['WARC-Record-ID']} is not as it was written")
    number = lambda name: int(headers[name]) if name in headers else None
    return {"record_id": headers["WARC-Record-ID"], "record_type": kind, "page_id": number("Page-ID"), "target_uri": headers["WARC-Target-URI"], "payload_bytes": size, "payload_digest": digest, "refers_to": number("Refers-To-Page-ID")}


def _reader(folder: str):
    schema = pa.schema([pa.field(c.split()[0], pa.int64() if c.endswith("long") else pa.string()) for c in READ.split(", ")])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = _open_folder(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with store.open_input_stream(f"{path}/{name}", compression=None) as file:
                    rows = []
                    for record in frames(iter(lambda: file.read(STEP), b"")):  # noqa: B023
                        row = page_row(record)
                        if row:
                            rows.append({"archive": name} | row)
                        if len(rows) == 1000:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows = []
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return read


def read(names: DataFrame, folder: str) -> DataFrame:
    """(archive, record_id, record_type, page_id, target_uri, payload_bytes, payload_digest, refers_to) of all pages in the archives named."""
    size = names.agg(F.count("*").alias("archives"), F.coalesce(F.sum("record_bytes"), F.lit(0)).alias("bytes")).first()
    tasks = max(1, min(size["archives"], max(names.sparkSession.sparkContext.defaultParallelism, size["bytes"] // TASK_BYTES)))
    return names.select("archive").repartition(tasks, "archive").mapInArrow(_reader(folder), READ)


def write_and_read(spark: SparkSession, pages: DataFrame, folder: str) -> DataFrame:
    """Writes the pages and reads them back: (page_id, payload_bytes, payload_digest, record_type, refers_to)."""
    return read(write(pages, folder), folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
