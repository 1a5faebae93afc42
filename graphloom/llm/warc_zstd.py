"""WARC files compressed with Zstandard and a dictionary.

Each file starts with a skippable frame (magic 0x184D2A5D) that holds a dictionary built from the file's own records; every record follows as a frame of its own that is
compressed with it, so any record can be read alone from its offset. This is the layout that public readers of ``.warc.zst`` expect.

A task writes the records of its partition one file after another, without a shuffle, and holds one file's records of ``FILE_BYTES`` at most (plus one record). The dictionary is trained on all
records of the file, whole. Files are rows of frames here: a frame's place is its file, number, offset and length, and the frames of a file
in order of their numbers are its bytes. ``save`` makes files of them. Everything is a function of the records, so a task that runs again writes the same bytes.

Defined results: page_id is an integer, or a string of one (others fail in the cast); a null url has no WARC-Target-URI; a null html is an empty block marked ``WARC-Truncated: unspecified``; a null page_id has no X-Page-Id; all three come back as null, empty strings as empty. Control
characters and blanks in a URL are percent-encoded, and decoded again by ``read``. Repeated rows are archived each. An empty table has no files. Columns besides page_id, url and html are ignored.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator
from urllib.parse import unquote_to_bytes

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAGIC = 0x184D2A5D
#: Bytes of records in a file, bytes of the dictionary, most bytes of one sample in training (the trainer takes no longer ones), and the level of compression.
FILE_BYTES, DICT_BYTES, SAMPLE_BYTES, LEVEL = 64 << 20, 64 << 10, 128 << 10, 3
#: Records are dated so where the caller gives no date: the tables have none.
DATE = "1970-01-01T00:00:00Z"
SCHEMA = "file string, number int, offset long, length long, record_id string, page_id long, url string, block_bytes long, digest string, frame binary"
_UNSAFE = re.compile(rb"[\x00-\x20%\x7f]")


def record(page_id: int | None, url: str | None, html: str | None, date: str = DATE) -> tuple[bytes, str, str, int]:
    """(record bytes, its id, digest of its block, size of its block)."""
    block = b"" if html is None else html.encode()
    digest = "sha256:" + hashlib.sha256(block).hexdigest()
    target = None if url is None else _UNSAFE.sub(lambda m: b"%%%02X" % m[0][0], url.encode())
    h = hashlib.blake2b(b"\0".join((str(page_id).encode(), b"-" if target is None else b"+" + target, digest.encode())), digest_size=16).hexdigest()
    rid = f"<urn:uuid:{h[:8]}-{h[8:12]}-4{h[13:16]}-a{h[17:20]}-{h[20:]}>"
    head = [b"WARC/1.1", b"WARC-Type: resource", b"WARC-Record-ID: " + rid.encode(), b"WARC-Date: " + date.encode()]
    if target is not None:
        head.append(b"WARC-Target-URI: " + target)
    if page_id is not None:
        head.append(b"X-Page-Id: %d" % page_id)
    if html is None:
        head.append(b"WARC-Truncated: unspecified")
    head += [b"WARC-Block-Digest: " + digest.encode(), b"Content-Type: text/html", b"Content-Length: %d" % len(block)]
    return b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n", rid, digest, len(block)


def dictionary(records: list[bytes], size: int = DICT_BYTES) -> bytes:
    """A dictionary trained on all records; where there is too little to train on, the end of the records as raw content."""
    pieces = [r[k : k + SAMPLE_BYTES] for r in records for k in range(0, len(r), SAMPLE_BYTES)]
    total = sum(map(len, pieces))
    if len(pieces) >= 8:
        try:
            return zstandard.train_dictionary(min(size, max(1024, total // 8)), pieces, level=LEVEL).as_bytes()
        except zstandard.ZstdError:
            pass
    return b"".join(records)[-size:].ljust(8, b"\n")


def leading_frame(d: bytes) -> bytes:
    """The skippable frame that holds a dictionary."""
    return struct.pack("<II", MAGIC, len(d)) + d


def archive(pages: DataFrame, date: str = DATE, file_bytes: int = FILE_BYTES) -> DataFrame:
    """One row a frame, see SCHEMA. Number 0 of each file is the dictionary's frame, which has no record."""
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    types = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.binary()]

    def run(batches):
        task = TaskContext.get()
        part, no = task.partitionId() if task else 0, 0
        held: list[tuple] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held, size, no
            d = dictionary([x[0] for x in held])
            packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=True, write_checksum=True)
            name = f"part-{part:06d}-{no:04d}.warc.zst"
            first = leading_frame(d)
            rows = [(name, 0, 0, len(first), None, None, None, None, None, first)]
            at, out = len(first), len(first)
            for k, (raw, rid, digest, n, page, url) in enumerate(held):
                frame = packer.compress(raw)
                rows.append((name, k + 1, at, len(frame), rid, page, url, n, digest, frame))
                at += len(frame)
                out += len(frame)
                if out > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*rows), types)], names=names)
                    rows, out = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*rows), types)], names=names)
            held, size, no = [], 0, no + 1

        for b in batches:
            for page, url, html in zip(b.column(0), b.column(1), b.column(2)):
                page, url = page.as_py(), url.as_py()
                r = record(page, url, html.as_py(), date)
                if held and size + len(r[0]) > file_bytes:
                    yield from flush()
                held.append((*r, page, url))
                size += len(r[0])
        if held:
            yield from flush()

    d = pages.selectExpr("cast(page_id as long) as page_id", "cast(url as string) as url", "cast(html as string) as html")
    return d.mapInArrow(run, SCHEMA)


def save(frames: DataFrame, path: str) -> DataFrame:
    """Write the files into a folder that all executors share, a path or a URL of any file system that Arrow knows (``file:``, ``hdfs:``, ``s3:`` and others); gives (file, bytes).

    A file is written under a name of its own and moved when it is whole, so that a task that is lost or runs twice leaves no part of one.
    """

    def run(batches):
        store, folder = fs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (fs.LocalFileSystem(), path)
        store.create_dir(folder, recursive=True)
        task = TaskContext.get()
        mark = f".{task.taskAttemptId() if task else 0}"
        name, out = None, None
        sizes: dict[str, int] = {}
        for b in batches:
            for f, frame in zip(b.column(0).to_pylist(), b.column(1)):
                if f != name:
                    if out:
                        out.close()
                        store.move(f"{folder}/{name}{mark}", f"{folder}/{name}")
                    name, out, sizes[f] = f, store.open_output_stream(f"{folder}/{f}{mark}"), 0
                sizes[f] += out.write(frame.as_buffer())
        if out:
            out.close()
            store.move(f"{folder}/{name}{mark}", f"{folder}/{name}")
        yield pa.RecordBatch.from_arrays([pa.array(list(sizes), pa.string()), pa.array(list(sizes.values()), pa.int64())], names=["file", "bytes"])

    rows = frames.repartition(F.col("file")).sortWithinPartitions("file", "number").select("file", "frame")
    return rows.mapInArrow(run, "file string, bytes long")


def frame_end(data: bytes, at: int) -> int:
    """Where the Zstandard frame that begins at a place ends, from its header and the headers of its blocks."""
    check = data[at + 4] & 4
    at += zstandard.frame_header_size(data[at : at + 18])
    while True:
        head = int.from_bytes(data[at : at + 3], "little")
        at += 3 + (1 if head >> 1 & 3 == 1 else head >> 3)
        if head & 1:
            return at + (4 if check else 0)


def frames_of(data: bytes) -> Iterator[bytes]:
    """The raw records of a whole file."""
    magic, n = struct.unpack_from("<II", data)
    if magic != MAGIC:
        raise ValueError("no dictionary frame")
    unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8 : 8 + n]))
    at = 8 + n
    while at < len(data):
        end = frame_end(data, at)
        yield unpacker.decompress(data[at:end])
        at = end


def parse(raw: bytes) -> tuple[int | None, str | None, str | None]:
    """(page_id, url, html) of a record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(b": ", 1) for x in head.split(b"\r\n")[1:])
    block = rest[: int(fields[b"Content-Length"])]
    if "sha256:" + hashlib.sha256(block).hexdigest() != fields[b"WARC-Block-Digest"].decode():
        raise ValueError("digest differs")
    page, url = fields.get(b"X-Page-Id"), fields.get(b"WARC-Target-URI")
    return (None if page is None else int(page), None if url is None else unquote_to_bytes(url).decode(), None if b"WARC-Truncated" in fields else block.decode())


def read(frames: DataFrame) -> DataFrame:
    """(page_id, url, html) of all frames of ``archive``: the inverse of writing, one file in one task."""

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table["number"].to_pylist(), table["frame"].to_pylist()))
        got = [parse(r) for r in frames_of(b"".join(f for _, f in rows))] if rows and rows[0][0] == 0 else []
        page, url, html = zip(*got) if got else ((), (), ())
        return pa.table({"page_id": pa.array(list(page), pa.int64()), "url": pa.array(list(url), pa.string()), "html": pa.array(list(html), pa.string())})

    return frames.select("file", "number", "frame").groupBy("file").applyInArrow(run, "page_id long, url string, html string")


def ratio(frames: DataFrame) -> DataFrame:
    """(file, records, raw_bytes, bytes) of each file."""
    return frames.groupBy("file").agg(F.count("record_id").alias("records"), F.coalesce(F.sum("block_bytes"), F.lit(0)).alias("raw_bytes"), F.sum("length").alias("bytes"))


__all__ = ["archive", "dictionary", "frames_of", "parse", "ratio", "read", "record", "save"]
