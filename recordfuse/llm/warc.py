"""Web archives of records that are compressed one by one with a Zstandard dictionary.

A writer task builds the dictionary of its archive from pieces of that archive's own records, however long these are, puts
it first, in a skippable frame (magic 0x184D2A5D), and writes every record as a frame of its own. Archives too small or
too uniform to train on have the dictionary of record heads, the same in every run. Pages with equal payloads of ``MIN_REVISIT`` bytes or more are
stored once: the one with the smallest id as a response, the others as revisits that refer to it.

Pages are copied to the shared folder with a number for each row and the digest of its payload. Of payloads that repeat, the
numbers of the rows are joined by digest, digests with very many rows in pieces; what comes of it (which rows are revisits, and
of which row) is small, and is sent to the writers while it has ``MOST_SENT`` rows at most, so payloads stay where they are;
beyond that it is joined by row number, of which each is one row's.

Every record id is made of a number drawn for the run and the row's number, so ids are unique even where page ids repeat or are
missing; the page's id has a field of its own. Archives end after ``ARCHIVE_BYTES`` of payload, so a writer holds that much, and a
reader one archive. Each try of a task writes files of its own names, and Spark commits the list of those of one try only;
``read`` reads what is in the list and nothing else, so what a lost try left behind does no harm.

Defined results: null html is an empty payload; a null url is left out; a null id is left out and never stands before another;
of rows that repeat the smallest id one is the response and the others are revisits of it; an empty table gives no archives
and an empty result; columns with other names do not matter; a folder takes one run.
"""

from __future__ import annotations

import hashlib
import io
import re
import secrets
import struct
import uuid
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import new_folder, spread_join, written
from .runtime import made, named, prepare, slices

#: Fixed values of the formats.
DICTIONARY_FRAME = 0x184D2A5D
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

MIN_REVISIT = 100
ARCHIVE_BYTES = 24 << 20
DICTIONARY_BYTES, SAMPLE_BYTES, LEVEL = 32 << 10, 1 << 20, 3
PIECE_BYTES, LEAST_PIECES, LEAST_SAMPLE = 2 << 10, 16, 16 << 10
DATE = "2024-01-01T00:00:00Z"
MOST_SENT = 200_000


def record_id(run: int, row: int) -> str:
    """A URN of two numbers of 64 bits."""
    return f"<urn:uuid:{uuid.UUID(int=run << 64 | row)}>"


def _line(value: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record(run: int, row: int, page_id: int | None, url: str | None, payload: bytes, digest: str, size: int, original: tuple[int, int | None] | None = None) -> bytes:
    """``original``: the row and the page id of the response that a revisit refers to."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size + payload if original is None else b""
    head = ["WARC/1.1", f"WARC-Type: {'response' if original is None else 'revisit'}", f"WARC-Record-ID: {record_id(run, row)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_line(url)}")
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    head += [f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {size}"]
    if original is not None:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_id(run, original[0])}"]
        if original[1] is not None:
            head.append(f"X-Refers-To-Page-Id: {original[1]}")
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers in lower case and the block. Raises ValueError where the record is not what its headers say."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"not a record: {lines[0][:20]!r}")
    fields = {k.lower(): v for k, v in (x.split(": ", 1) for x in lines[1:])}
    size = int(fields["content-length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("a record does not end where its length says")
    return fields, rest[:size]


def pieces(records: list[bytes]) -> list[bytes]:
    """Stretches of ``PIECE_BYTES`` from all of the records, long ones too, spread evenly: ``SAMPLE_BYTES`` of them, or all."""
    places = [(i, at) for i, r in enumerate(records) for at in range(0, len(r), PIECE_BYTES)]
    total = sum(map(len, records))
    n = min(len(places), max(1, len(places) * SAMPLE_BYTES // max(total, 1)))
    # One in each of n equal ranges, each time at another place of it, so that records of one length do not all give the same part.
    chosen = places if n == len(places) else [places[int((j + j * 0.6180339887 % 1) * len(places) / n)] for j in range(n)]
    return [records[i][at : at + PIECE_BYTES] for i, at in chosen]


def _trained(size: int, samples: list[bytes]) -> bytes:
    import zstandard

    try:
        return zstandard.train_dictionary(size, samples, k=256, d=8, f=18, accel=4).as_bytes()
    except zstandard.ZstdError:  # samples too much alike to train on
        return b""


@lru_cache(1)
def head_dictionary() -> bytes:
    """From the heads of made-up records."""
    digests = [hashlib.sha256(b"%d" % i).hexdigest() for i in range(256)]
    return _trained(1 << 10, [record(2**63 + i, i, i, f"https://{d[:9]}.com/{d[9:15]}", b"", d, 97 * i, None if i % 4 else (i // 2, i // 2)) for i, d in enumerate(digests)])


def build_dictionary(records: list[bytes]) -> bytes:
    """From pieces of the archive's own records, an eighth of their size at most; where they are too few or too much alike
    to train on, that of record heads. (Only how small the archive gets depends on it.)"""
    samples = pieces(records)
    total = sum(map(len, samples))
    if len(samples) < LEAST_PIECES or total < LEAST_SAMPLE:
        return head_dictionary()
    return _trained(min(DICTIONARY_BYTES, total // 8), samples) or head_dictionary()


def archive(records: list[bytes]) -> bytes:
    import zstandard

    raw = build_dictionary(records)
    known = zstandard.ZstdCompressionDict(raw) if raw else None
    if known:
        known.precompute_compress(LEVEL)
    packer = zstandard.ZstdCompressor(dict_data=known) if known else zstandard.ZstdCompressor(level=LEVEL)
    out = io.BytesIO()
    out.write(struct.pack("<II", DICTIONARY_FRAME, len(raw)) + raw)
    for r in records:
        out.write(packer.compress(r))
    return out.getvalue()


def records_of(data: bytes) -> Iterator[bytes]:
    """The records of an archive, with the dictionary that it starts with."""
    import zstandard

    known, at = None, 0
    magic, size = struct.unpack_from("<II", data)
    if magic == DICTIONARY_FRAME:
        raw = data[8 : 8 + size]
        if raw.startswith(FRAME_MAGIC):
            raw = zstandard.ZstdDecompressor().decompress(raw)
        known, at = zstandard.ZstdCompressionDict(raw) if raw else None, 8 + size
    unpacker = zstandard.ZstdDecompressor(dict_data=known) if known else zstandard.ZstdDecompressor()
    view = memoryview(data)
    while at < len(data):
        frame = unpacker.decompressobj()
        out = [frame.decompress(view[at : at + 65536])]
        at = min(at + 65536, len(data))
        while not frame.eof:
            if at >= len(data):
                raise ValueError("an archive ends within a record")
            out.append(frame.decompress(view[at : at + 65536]))
            at = min(at + 65536, len(data))
        at -= len(frame.unused_data)
        yield b"".join(out)


def planned(pages: DataFrame, key: str = "page_id", html: str = "html", url: str = "url") -> DataFrame:
    """row, page_id, url, payload, payload_bytes, payload_digest, original_row, original_page: the last two null for responses."""
    payload = F.encode(F.coalesce(named(html).cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(F.monotonically_increasing_id().alias("row"), named(key).cast("long").alias("page_id"), named(url).cast("string").alias("url"), payload.alias("payload"))
    rows = written(rows.withColumns({"payload_bytes": F.length("payload").cast("long"), "payload_digest": F.sha2("payload", 256)}), "warc-pages")
    keys = rows.filter(F.col("payload_bytes") >= MIN_REVISIT).select("payload_digest", "row", "page_id")
    first = F.min(F.struct(F.col("page_id").isNull().alias("without"), "page_id", "row")).alias("first")
    firsts = keys.groupBy("payload_digest").agg(first, F.count("*").alias("n")).filter("n > 1").select("payload_digest", "n", F.col("first.row").alias("original_row"), F.col("first.page_id").alias("original_page"))
    revisits = spread_join(keys, firsts, "payload_digest", ["row"]).filter("row <> original_row").select("row", "original_row", "original_page")
    revisits = written(revisits, "warc-revisits")
    few = revisits.limit(MOST_SENT + 1).count() <= MOST_SENT
    return rows.join(F.broadcast(revisits) if few else revisits, "row", "left")


def _opened(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")


def write(pages: DataFrame, folder: str, key: str = "page_id", html: str = "html", url: str = "url") -> DataFrame:
    """Writes the archives and, beside them, their list, which it returns: (name, records, bytes)."""
    spark = pages.sparkSession
    prepare(spark)
    run = secrets.randbits(64)
    revisit = F.col("original_row").isNotNull()
    plan = planned(pages, key, html, url).select("row", "page_id", "url", F.when(~revisit, F.col("payload")).alias("payload"), "payload_bytes", "payload_digest", "original_row", "original_page")
    schema = pa.schema([("name", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, own, number, held, size = TaskContext.get().partitionId(), uuid.uuid4().hex, 0, [], 0

        def end() -> pa.RecordBatch:
            store, base = _opened(folder)
            store.create_dir(base, recursive=True)
            data, name = archive(held), f"part-{part:06d}-{number:05d}-{own}.warc.zst"
            with store.open_output_stream(f"{base}/{name}", compression=None) as f:
                f.write(data)
            return made([(name, len(held), len(data))], schema)

        for x in slices(batches, 64):
            for row, page_id, url, payload, n, digest, original, page in zip(*(c.to_pylist() for c in x.columns), strict=True):
                held.append(record(run, row, page_id, url, payload or b"", digest, n, None if original is None else (original, page)))
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    yield end()
                    number, held, size = number + 1, [], 0
        if held:
            yield end()

    plan.mapInArrow(save, "name string, records bigint, bytes bigint").write.parquet(f"{folder}/list")
    return spark.read.parquet(f"{folder}/list")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """The records of the archives in a folder's list: record_id, page_id, url, payload (null for revisits), payload_bytes,
    payload_digest, record_type, refers_to. Digest and length of a response's payload are those of what was read."""
    prepare(spark)
    listed = spark.read.parquet(f"{folder}/list").select("name")
    tasks = min(listed.count(), max(4096, 4 * spark.sparkContext.defaultParallelism))
    kinds = {"record_id": pa.string(), "page_id": pa.int64(), "url": pa.string(), "payload": pa.binary(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64()}
    schema = pa.schema(list(kinds.items()))

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for name in x.column(0).to_pylist():
                store, base = _opened(folder)
                with store.open_input_stream(f"{base}/{name}", compression=None) as f:
                    data = f.read()
                rows, size = [], 0
                for raw in records_of(data):
                    rows.append(_row(*parse(raw)))
                    size += len(raw)
                    if size > 4 << 20:
                        yield made(rows, schema)
                        rows, size = [], 0
                yield made(rows, schema)

    said = "record_id string, page_id bigint, url string, payload binary, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"
    return listed.repartition(max(tasks, 1)).mapInArrow(unpack, said)


def _row(fields: dict[str, str], block: bytes) -> tuple:
    payload = block.partition(b"\r\n\r\n")[2] if fields["warc-type"] == "response" else None
    digest, size = fields["warc-payload-digest"].removeprefix("sha256:"), int(fields["x-payload-length"])
    if payload is not None:
        size = len(payload)
        if digest != hashlib.sha256(payload).hexdigest():
            raise ValueError(f"the payload of {fields['warc-record-id']} does not have its digest")
    number = lambda name: int(fields[name]) if name in fields else None
    return fields["warc-record-id"], number("x-page-id"), fields.get("warc-target-uri"), payload, size, digest, fields["warc-type"], number("x-refers-to-page-id")


def round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes the pages and reads the archives back; one row per page, without payloads."""
    spark = pages.sparkSession
    folder = folder or new_folder(spark, "warc")
    write(pages, folder)
    return read(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
