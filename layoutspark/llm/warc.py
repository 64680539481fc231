"""WARC archives with dictionary compression.

Records go to archives of about ARCHIVE_BYTES of payload each. A writer builds a Zstandard dictionary from a sample of
the archive's own records, puts it into a leading skippable frame, and compresses every record as one frame with it,
so that single records can be read at their offsets. Equal payloads of MIN_REVISIT bytes or more are stored once (the
record with the smallest page_id); the others become revisit records that refer to it.

Archives are files in the folder that all executors share, written through pyarrow's file systems. A task writes under
a name of its own attempt, and only archives whose task's rows reached the manifest table are read, so a lost executor
or a speculative copy leaves nothing half-written in the result.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import materialize, new_path, small_batches

MIN_REVISIT = 100
#: Payload bytes of one archive, which a writer holds at once.
ARCHIVE_BYTES = 32 << 20
#: Dictionary size, and the bytes of evenly spread records (whole ones up to SAMPLE_RECORD) that it is built from.
DICTIONARY, SAMPLE, SAMPLE_RECORD = 64 << 10, 2 << 20, 64 << 10
LEVEL = 3
#: Bytes read at a time where a frame's end is not known; tasks that read archives back, at most.
PIECE, MOST_READERS = 64 << 10, 100_000
#: The magic number of the skippable frame that holds a dictionary in .warc.zst files, and of a zstd frame.
SKIPPABLE, FRAME = 0x184D2A5D, b"\x28\xb5\x2f\xfd"


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to, size: int) -> bytes:
    """One WARC 1.1 record. A revisit has no block and names the record that holds its payload."""
    revisit = refers_to is not None
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{page_id}>",
        f"WARC-Target-URI: {''.join((url or '').split())}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Payload-Length: {size}",
        "Content-Type: text/html",
    ]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    block = b"" if revisit else payload
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode("utf-8").split("\r\n")
    if first != "WARC/1.1":
        raise ValueError(f"not a WARC record: {first[:40]!r}")
    fields = dict(line.split(": ", 1) for line in lines)
    size = int(fields["Content-Length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError(f"record {fields['WARC-Record-ID']}: length differs from Content-Length")
    return fields, rest[:size]


def build_dictionary(records: list[bytes]) -> bytes:
    """From evenly spread records; empty if there is too little to train on."""
    total = sum(min(len(r), SAMPLE_RECORD) for r in records)
    step = max(1, -(-total // SAMPLE))
    sample = [r[:SAMPLE_RECORD] for r in records[::step]]
    if len(sample) < 8 or sum(map(len, sample)) < 16 << 10:
        return b""
    try:
        return zstandard.train_dictionary(min(DICTIONARY, sum(map(len, sample)) // 8), sample, k=256, d=8, level=LEVEL).as_bytes()
    except zstandard.ZstdError:  # too little variety
        return b""


def archive(records: list[bytes]) -> tuple[bytes, list[int]]:
    """The archive, and the place of each record's frame in it."""
    dictionary = build_dictionary(records)
    data = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=data, write_checksum=True)
    parts = [struct.pack("<II", SKIPPABLE, len(dictionary)) + dictionary, *(packer.compress(r) for r in records)]
    return b"".join(parts), list(accumulate(map(len, parts[:-1])))


def read_archive(data: bytes, places: list[int] | None = None) -> Iterator[bytes]:
    """The records. With their places each frame is read by itself, else frames are found by reading on from one to the next."""
    magic, size = struct.unpack("<II", data[:8])
    if magic != SKIPPABLE:
        raise ValueError("the archive has no leading dictionary frame")
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8 : 8 + size]) if size else None)
    view = memoryview(data)
    if places is not None:
        for at, end in zip(places, [*places[1:], len(data)], strict=False):
            yield reader.decompress(view[at:end])
        return
    at = 8 + size
    while at < len(data):
        frame, out = reader.decompressobj(), []
        while not frame.eof:
            if at >= len(data):
                raise ValueError("the archive ends inside a record")
            out.append(frame.decompress(view[at : at + PIECE]))
            at = min(at + PIECE, len(data))
        at -= len(frame.unused_data)
        yield b"".join(out)


def _batches(held: Iterator, folder: str) -> Iterator[pa.RecordBatch]:
    files, root = fs.FileSystem.from_uri(folder)
    files.create_dir(root, recursive=True)
    context = TaskContext.get()
    name = f"{context.partitionId():06d}-{context.taskAttemptId()}-{uuid.uuid4().hex[:8]}"
    for k, records in enumerate(held):
        data, places = archive(records)
        path = f"{root}/{name}-{k:04d}.warc.zst"
        with files.open_output_stream(path, compression=None) as out:
            out.write(data)
        yield pa.RecordBatch.from_arrays([pa.array([f"{name}-{k:04d}.warc.zst"]), pa.array([len(records)], pa.int64()), pa.array([len(data)], pa.int64()), pa.array([places], pa.list_(pa.int64()))], ["file", "records", "bytes", "places"])


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Writes pages (page_id, url, html) below folder; returns the manifest (file, records, bytes, places), already written.

    Revisits are found on digests alone; payloads are dealt by page_id, so a page that many copy is no hot key.
    """
    small_batches(pages.sparkSession)
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("payload"))
    pages = pages.withColumn("size", F.length("payload").cast("long")).withColumn("digest", F.sha2("payload", 256))
    long = pages.where(F.col("size") >= MIN_REVISIT).select("page_id", "digest").where("page_id is not null")
    firsts = long.groupBy("digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last")).where("first <> last").select("digest", "first")
    revisits = long.join(firsts, "digest").where("first <> page_id").groupBy("page_id", "digest").agg(F.min("first").alias("refers_to"))
    rows = pages.join(revisits, ["page_id", "digest"], "left")
    # the payload of a revisit is not needed any more
    rows = rows.select("page_id", "url", F.when(F.col("refers_to").isNull(), F.col("payload")).alias("payload"), "size", "digest", "refers_to")

    def run(batches):
        def archives():
            held, total = [], 0
            for batch in batches:
                for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    page_id, url, payload, size, digest, refers_to = row
                    held.append(record(page_id, url, payload or b"", digest, refers_to, size))
                    total += len(held[-1])
                    if total >= ARCHIVE_BYTES:
                        yield held
                        held, total = [], 0
            if held:
                yield held

        yield from _batches(archives(), folder)

    return materialize(rows.mapInArrow(run, "file string, records long, bytes long, places array<long>"), "manifest")


def read_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """page_id, url, record_type, payload, payload_bytes, payload_digest, refers_to, of all records of the manifest's archives.

    A response's length and digest are computed from the payload read back, and must be those of its header.
    """

    def run(batches):
        files, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, places in zip(batch.column("file").to_pylist(), batch.column("places").to_pylist(), strict=True):
                with files.open_input_stream(f"{root}/{name}", compression=None) as f:
                    data = f.read()
                rows, total = [], 0
                for fields, payload in map(parse, read_archive(data, places)):
                    kind, digest, size = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha256:"), int(fields["X-Payload-Length"])
                    number = lambda key: None if (x := fields[key][len("<urn:page:") : -1]) == "None" else int(x)  # noqa: B023, E731
                    if kind == "response":
                        found = hashlib.sha256(payload).hexdigest(), len(payload)
                        if found != (digest, size):
                            raise ValueError(f"{name}: record {fields['WARC-Record-ID']} differs from its header")
                    rows.append((number("WARC-Record-ID"), fields["WARC-Target-URI"], kind, payload if kind == "response" else None, size, digest, number("WARC-Refers-To") if kind == "revisit" else None))
                    total += len(payload)
                    if total > 4 << 20:
                        yield _rows(rows)
                        rows, total = [], 0
                yield _rows(rows)

    # a task for each archive, which holds as much as a partition; the manifest's rows say nothing of their sizes
    names = manifest.select("file", "places").repartitionByRange(min(MOST_READERS, max(1, manifest.count())), "file")
    return names.mapInArrow(run, "page_id long, url string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to long")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    types = (("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()))
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, (_, t) in enumerate(types)], [n for n, _ in types])


def round_trip(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every page, written to archives and read back.

    Null html is an empty payload; payloads under MIN_REVISIT bytes are never revisits. Repeated rows with the smallest
    page_id of their payload are all responses. A page without a page_id keeps null and is referred to only if no equal
    payload has a page_id. Other columns are ignored. An empty table gives no archive and no row.
    """
    folder = new_path(pages.sparkSession, "warc")
    if "://" not in folder:
        folder = "file://" + folder.removeprefix("file:")
    manifest = write_archives(pages, folder)
    return read_archives(manifest, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
