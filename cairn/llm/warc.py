"""WARC archives compressed with a shared Zstandard dictionary, and their reader.

An archive is one file: a skippable frame that holds a dictionary trained on records of that
archive, then every record as a frame of its own, compressed with it. A reader takes the
dictionary from the first frame and can decode any record alone.

Pages with equal payloads are stored once: the smallest page_id keeps the payload, the others
become revisit records that refer to it. Which is which comes from an aggregation over digests, and a digest
that very many pages have is joined by broadcast; only the payloads that are kept are written.

An archive begins with a ``warcinfo`` record. A response's block is an HTTP response whose body is the
payload; a record's id is made from its archive and its place there, so no two are alike, and the page's number has a header of its own.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from io import BytesIO

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.session import BROADCAST_BYTES, join_counted, materialize, scratch_path

#: A skippable frame's number as the .warc.zst convention has it; the dictionary's largest size.
SKIPPABLE, DICTIONARY_BYTES = 0x184D2A5D, 64 << 10
#: Records kept back to train on: this many bytes at the start of an archive (documented sample).
TRAIN_BYTES = 4 << 20
#: An archive is closed beyond this many bytes of compressed records.
ARCHIVE_BYTES = 256 << 20
LEVEL = 3
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Records carry no time of fetching: the tables have none.
DATE = "1970-01-01T00:00:00Z"


def base32_of_hex(digest: Column) -> Column:
    """Bare upper-case base32 of a 40-digit SHA-1: eight groups of five bits at a time from each 40 bits."""
    alphabet = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    parts = []
    for i in range(0, 40, 10):
        group = F.conv(F.substring(digest, i + 1, 10), 16, 10).cast("long")
        parts += [F.substring(alphabet, F.shiftright(group, 35 - 5 * k).bitwiseAND(F.lit(31)).cast("int") + 1, F.lit(1)) for k in range(8)]
    return F.concat(*parts)


def plan_records(pages: DataFrame, least_bytes: int = 0, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``(page_id, url, payload, digest, refers_to)``: payloads with their digest, and whom a revisit repeats.

    refers_to is the smallest page_id with an equal payload, null for that page itself and for
    payloads of fewer than ``least_bytes`` bytes. Null html is an empty payload. Rows that repeat
    a page_id and payload are all responses, as none refers to itself. A null page_id never
    stands for others.
    """
    body = F.coalesce(F.col(html), F.lit("")).cast("binary")
    given = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), body.alias("payload"))
    signed = given.withColumn("digest", F.sha1("payload"))
    first = signed.where(F.octet_length("payload") >= least_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last"), F.count(F.lit(1)).alias("n"))
    shared = materialize(first.where("n > 1").select("digest", "first", "n"), "warc-shared")
    if shared.count() * 64 <= BROADCAST_BYTES:
        joined = signed.join(F.broadcast(shared), "digest", "left")
    else:
        joined = join_counted(signed, shared, "digest", "n", signed.count())
    other = F.when(F.col("first") != F.coalesce("page_id", F.lit(-(1 << 63))), F.col("first"))
    return joined.select("page_id", "url", "payload", "digest", other.alias("refers_to"))


def _headers(kind: str, name: str, more: list[str], block: bytes) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>", f"WARC-Date: {DATE}", *more, f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def info(name: str) -> bytes:
    """The record that an archive begins with."""
    return _headers("warcinfo", name, ["Content-Type: application/warc-fields"], b"format: WARC File Format 1.1\r\nsoftware: cairn\r\n")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, name: str) -> bytes:
    """One WARC/1.1 record, whose id is made from ``name``. A revisit's block is empty; its headers tell the full payload's size and the page that has it."""
    more = [f"X-Page-ID: {'null' if page_id is None else page_id}"]
    if url is not None:
        more.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    more.append(f"WARC-Payload-Digest: sha1:{digest}")
    if refers_to is not None:
        more += [f"WARC-Profile: {PROFILE}", f"X-Refers-To-Page: {refers_to}", f"X-Payload-Length: {len(payload)}", "Content-Type: application/http;msgtype=response"]
        return _headers("revisit", name, more, b"")
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    return _headers("response", name, [*more, "Content-Type: application/http;msgtype=response"], head.encode() + payload)


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """A record's headers, and its block; of a response the HTTP body."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    return fields, block.partition(b"\r\n\r\n")[2] if fields["WARC-Type"] == "response" else block


def train(records: list[bytes]) -> bytes:
    """A dictionary for ``records``, of which the first 64 KB each are looked at; raw ones of their bytes where too few to train on. What is compressed is always whole."""
    samples = [r[:65536] for r in records]
    size = min(DICTIONARY_BYTES, max(1024, sum(map(len, samples)) // 10))
    try:
        return zstandard.train_dictionary(size, samples, threads=0).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:] or b"WARC/1.1\r\n"


class _Archive:
    """A file under a name of this attempt, moved to its own name when it is whole."""

    def __init__(self, folder: str, name: str, attempt: int, sample: list[bytes]):
        self.fs, root = pyarrow.fs.FileSystem.from_uri(folder)
        self.path, self.own = f"{root}/{name}.warc.zst", f"{root}/.{name}.{attempt}"
        self.out = self.fs.open_output_stream(self.own, compression=None)
        trained = train(sample)
        self.out.write(struct.pack("<II", SKIPPABLE, len(trained)) + trained)
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(trained), write_content_size=True)
        self.size = 0
        self.add(info(name))

    def add(self, data: bytes) -> None:
        frame = self.compressor.compress(data)
        self.size += len(frame)
        self.out.write(frame)

    def close(self) -> str:
        self.out.close()
        self.fs.move(self.own, self.path)
        return self.path


def write_archives(records: DataFrame, folder: str) -> DataFrame:
    """Writes ``plan_records``'s rows below ``folder``, which all executors share; ``(path, records)`` by archive.

    A task fills an archive after another. A task that is tried again writes under a new name and
    replaces the file when it is whole.
    """
    fs, root = pyarrow.fs.FileSystem.from_uri(folder)
    fs.create_dir(root, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        n, count, archive, held, size = 0, 0, None, [], 0

        def rows():
            for batch in batches:
                for i in range(batch.num_rows):
                    yield tuple(c[i].as_py() for c in batch.columns)

        def opened() -> _Archive:
            return _Archive(folder, f"{task.partitionId():06d}-{n:04d}", task.taskAttemptId(), held)

        for row in rows():
            data = record(*row, f"{task.partitionId():06d}-{n:04d}/{count}")
            count += 1
            if archive is None:
                held.append(data)
                size += len(data)
                if size < TRAIN_BYTES:
                    continue
                archive = opened()
                for x in held:
                    archive.add(x)
                held, size = [], 0
            else:
                archive.add(data)
            if archive.size >= ARCHIVE_BYTES:
                yield pa.RecordBatch.from_pydict({"path": [archive.close()], "records": [count]})
                n, count, archive = n + 1, 0, None
        if held:
            archive = opened()
            for x in held:
                archive.add(x)
        if archive:
            yield pa.RecordBatch.from_pydict({"path": [archive.close()], "records": [count]})

    packed = records.select("page_id", "url", "payload", base32_of_hex(F.col("digest")).alias("digest"), "refers_to")
    return materialize(packed.mapInArrow(run, "path string, records long"), "warc-written")


def frames(stream) -> Iterator[bytes]:
    """The records of an archive that is open as ``stream``, decoded one by one."""
    magic, size = struct.unpack("<II", stream.read(8))
    if magic != SKIPPABLE:
        raise ValueError("no leading dictionary frame")
    decoder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(stream.read(size)))
    rest = b""
    while True:
        unit, out = decoder.decompressobj(), BytesIO()
        while not unit.eof:
            rest = rest or stream.read(1 << 20)
            if not rest:
                if out.tell():
                    raise ValueError("a record is cut short")
                return
            out.write(unit.decompress(rest))
            rest = unit.unused_data if unit.eof else b""
        yield out.getvalue()


def read_archives(archives: DataFrame, folder: str, with_payload: bool = True) -> DataFrame:
    """Every record of the archives in ``archives`` (column ``path``), parsed.

    ``(page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload)``; the size and
    digest are the full payload's, a response's counted and hashed anew from its own bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pyarrow.fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with fs.open_input_stream(path, compression=None) as stream:
                    rows = []
                    for data in frames(stream):
                        head, payload = parse(data)
                        if head["WARC-Type"] == "warcinfo":
                            continue
                        number = lambda text: None if text is None or text == "null" else int(text)
                        refers = head.get("X-Refers-To-Page")
                        digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
                        if refers is None and (own := base64.b32encode(hashlib.sha1(payload).digest()).decode()) != digest:
                            raise ValueError(f"{head['WARC-Record-ID']}: digest {own} isn't {digest}")
                        size = len(payload) if refers is None else int(head["X-Payload-Length"])
                        rows.append((number(head["X-Page-ID"]), head.get("WARC-Target-URI"), head["WARC-Type"], number(refers), size, digest, payload if with_payload and refers is None else None))
                        if len(rows) == 500:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), READ.types, strict=True)], READ.names)
                            rows = []
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), READ.types, strict=True)], READ.names)

    spread = archives.select("path").repartition(max(1, archives.count()), "path")
    return spread.mapInArrow(run, "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary")


READ = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])


def archive_and_read(pages: DataFrame, folder: str | None = None, least_bytes: int = 0) -> DataFrame:
    """Writes ``pages`` to archives and returns what reading them back gives, a row per page.

    ``(page_id, payload_bytes, payload_digest, record_type, refers_to)``. Rows that repeat a page_id
    with another payload are records of their own. An empty table makes no archive and no rows.
    """
    folder = folder or scratch_path(pages.sparkSession, "warc")
    written = write_archives(plan_records(pages, least_bytes), folder)
    return read_archives(written, folder, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


