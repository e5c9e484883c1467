"""Folders of journals, a file to a run: listed, read and written by tasks, so that no file goes through the driver."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial, reduce
from urllib.parse import quote
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.session import materialize

#: Bytes read at a time; lines and bytes that a task hands on at a time; files, and bytes, to a task; tasks at most.
CHUNK, ROWS, HANDED, FILES, BYTES, TASKS = 4 << 20, 10_000, 4 << 20, 1000, 32 << 20, 4096
#: Folders that written journals are dealt into.
FOLDERS = 256
#: Endings of files that are opened as compressed ones, and read whole by one task.
PACKED = r"\.(gz|bz2|zst)$"
#: What Spark writes as %XX in a file's name.
ODD = re.compile(r"[\x00- \"#%<>?\[\\\]^`{|}\x7f]")
LINE = "run_id string, piece long, at long, value binary"


def _store(path: str) -> tuple[pyarrow.fs.FileSystem, str, str]:
    """The file system of ``path``, what its files' names begin with in Spark, and the path itself."""
    if local := re.match(r"(?:file:(?://)?)?(/.*)", path, re.DOTALL):
        return pyarrow.fs.LocalFileSystem(), "file:", local[1].rstrip("/") or "/"
    fs, own = pyarrow.fs.FileSystem.from_uri(path)
    return fs, path.rstrip("/").removesuffix(own.rstrip("/")), own.rstrip("/")


def _listed(spark: SparkSession, path: str) -> DataFrame:
    """``(file, size)`` below ``path``, level by level, each level's folders dealt over tasks. Names that begin with ``.`` or ``_`` are passed over, as Spark does."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs = _store(path)[0]
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                found = [f for f in fs.get_file_info(pyarrow.fs.FileSelector(folder)) if f.base_name[0] != "." and (f.base_name[0] != "_" or "=" in f.base_name)]
                for at in range(0, len(found), ROWS):
                    part = found[at : at + ROWS]
                    yield pa.RecordBatch.from_arrays([pa.array([f.path for f in part], pa.string()), pa.array([f.size if f.is_file else None for f in part], pa.int64())], ["file", "size"])

    fs, _, root = _store(path)
    top = fs.get_file_info(root)
    if top.is_file:
        return spark.createDataFrame([(root, top.size)], "file string, size long")
    frontier, levels = spark.createDataFrame([(root,)], "folder string"), []
    while True:
        seen = materialize(frontier.mapInArrow(run, "file string, size long"), "journal-level")
        levels.append(seen.where("size is not null"))
        below = seen.where("size is null").select(F.col("file").alias("folder"))
        if (n := below.count()) == 0:
            return reduce(DataFrame.unionByName, levels)
        frontier = below.repartition(max(1, min(n, spark.sparkContext.defaultParallelism)), "folder")


def _begun(f, start: int, end: int | None) -> Iterator[list[bytes]]:
    """Lines that begin from ``start`` on and before ``end``, some at a time; ``f`` stands at ``start``, or a byte before it if that isn't 0."""
    begin, skip, parts = max(0, start - 1), start > 0, []
    at = begin
    while (end is None or begin < end) and (chunk := f.read(CHUNK)):
        *whole, last = chunk.split(b"\n")
        at += len(chunk)
        if whole:
            whole[0], parts = b"".join([*parts, whole[0]]), []
            if end is not None and at > end:
                starts = begin + np.cumsum([0] + [len(x) + 1 for x in whole[:-1]])
                whole = whole[: int(np.searchsorted(starts, end))]
            yield whole[1:] if skip else whole
            begin, skip = at - len(last), False
        parts.append(last)
    if (end is None or begin < end) and not skip and any(parts):
        yield [b"".join(parts)]


def _read(path: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lines of pieces (file, piece, length; a null length for all of a file), numbered within each."""
    fs, prefix, _ = _store(path)
    held, size = [], 0

    def batch() -> pa.RecordBatch:
        sizes = np.array([len(x) for *_, x in held])
        which = pa.array(np.repeat(np.arange(len(held), dtype=np.int32), sizes))
        at = np.concatenate([np.arange(first, first + n) for (_, _, first, _), n in zip(held, sizes, strict=True)])
        names = pa.array([prefix + ODD.sub(lambda m: f"%{ord(m[0]):02X}", file) for file, *_ in held], pa.string())
        return pa.RecordBatch.from_arrays([names.take(which), pa.array([k for _, k, *_ in held], pa.int64()).take(which), pa.array(at, pa.int64()), pa.array([x for *_, own in held for x in own], pa.binary())], ["run_id", "piece", "at", "value"])

    for b in batches:
        for file, piece, length in zip(*[c.to_pylist() for c in b.columns], strict=True):
            count = 0
            with fs.open_input_stream(file, compression="detect") if length is None else fs.open_input_file(file) as f:
                if piece:
                    f.seek(piece - 1)
                for own in _begun(f, piece, None if length is None else piece + length):
                    for k in range(0, len(own), ROWS):
                        part = own[k : k + ROWS]
                        held.append((file, piece, count, part))
                        count += len(part)
                        size += sum(map(len, part)) + 100 * len(part)
                        if size > HANDED:
                            yield batch()
                            held, size = [], 0
    if held:
        yield batch()


def lines(spark: SparkSession, path: str) -> DataFrame:
    """``(run_id, piece, at, value)``: the lines of each file at or below ``path``, by the piece of the file that they begin in and their order there.

    Files are listed and read by tasks, through ``pyarrow.fs``; long ones in pieces of ``spark.sql.files.maxPartitionBytes``. What that can't open (globs, stores
    that only Spark reads) is listed and read by Spark, whose driver then holds all files' names.
    """
    try:
        _store(path)[0].get_file_info(_store(path)[2])
        known = not re.search(r"[*?\[{]", path)
    except (OSError, ValueError, pa.ArrowException):
        known = False
    if not known:
        file, piece = F.col("_metadata.file_path").alias("run_id"), F.col("_metadata.file_block_start").alias("piece")
        return spark.read.option("lineSep", "\n").text(path).select(file, piece, F.monotonically_increasing_id().alias("at"), "value")
    number, unit = re.match(r"(\d+)\s*([kmgt]?)", spark.conf.get("spark.sql.files.maxPartitionBytes").lower()).groups()
    most = F.lit(max(1, int(number) << 10 * " kmgt".index(unit or " "))).cast("long")
    files = _listed(spark, path)
    n, size = files.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    starts = F.when(F.col("file").rlike(PACKED), F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("size") - 1, F.lit(0).cast("long")), most))
    pieces = files.select("file", F.explode(starts).alias("piece"), F.when(~F.col("file").rlike(PACKED), most).alias("length"))
    # a row is a piece, whose work isn't told by its bytes here, so partitions mustn't be merged by these
    tasks = min(TASKS, max(n // FILES, size // BYTES, min(n, spark.sparkContext.defaultParallelism), 1))
    found = pieces.repartition(tasks, "file", "piece").mapInArrow(partial(_read, path), LINE)
    return found.withColumn("value", F.col("value").cast("string"))


def write(events: DataFrame, path: str) -> int:
    """A file below ``path`` to each run of ``events`` (run_id, seq, value), its values as lines by ``seq``; how many there are.

    Files lie in ``FOLDERS`` folders, however many runs. A task holds a batch, and writes under a name of its attempt until the file is whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        (fs, _, root), attempt = _store(path), TaskContext.get().taskAttemptId()
        made, name, out, n = set(), None, None, 0

        def close() -> None:
            out.close()
            fs.move(own(f".{attempt}"), own())

        def own(ending: str = "") -> str:
            coded = quote(name, safe="")
            return f"{root}/{crc32(name.encode()) % FOLDERS:03d}/{'.' * bool(ending)}{coded}.jsonl{ending}"

        for batch in batches:
            runs = batch.column(0).to_pylist()
            values = batch.column(1).to_pylist()
            at = 0
            while at < len(runs):
                to = at + 1
                while to < len(runs) and runs[to] == runs[at]:
                    to += 1
                if runs[at] != name:
                    if out:
                        close()
                    name, n = runs[at], n + 1
                    folder = own().rpartition("/")[0]
                    if folder not in made:
                        fs.create_dir(folder, recursive=True)
                        made.add(folder)
                    out = fs.open_output_stream(own(f".{attempt}"), compression=None)
                out.write(("\n".join(values[at:to]) + "\n").encode())
                at = to
        if out:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    dealt = events.repartition("run_id").sortWithinPartitions("run_id", "seq").select(F.coalesce(F.col("run_id").cast("string"), F.lit("null")), F.coalesce(F.col("value").cast("string"), F.lit("")))
    return dealt.mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
