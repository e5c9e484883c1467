"""A versioned store of features: what is known, what is to do, and taking in what is new.

A kept store is a folder. ``data`` has a folder of Parquet a commit, ``log`` a line of JSON a commit, in a file named by its
number. A commit counts once its line is there; the line comes by a rename that never replaces a file, so of two
writers that want the same number one goes on to the next. What a lost writer has left in ``data`` is never read.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEY = ["path", "size", "mtime"]


@dataclass(frozen=True)
class Commit:
    """The ``number``-th commit of a store: a ``batch`` of a ``stream``, in ``folder``. A ``snapshot`` stands for all before it."""

    number: int
    stream: str
    batch: int
    folder: str
    snapshot: bool = False


class KeptStore:
    """The store below ``path``, a row a ``key``: commits in order, each of them whole or absent, and each batch of a stream at most once."""

    def __init__(self, spark: SparkSession, path: str, key: str = "path"):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        hadoop = spark._jvm.org.apache.hadoop.fs
        self._of = hadoop.Path
        conf = spark._jsc.hadoopConfiguration()
        self._fs = self._of(self.path).getFileSystem(conf)
        self._files = hadoop.FileContext.getFileContext(self._fs.getUri(), conf)
        self._keep = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        self._fs.mkdirs(self._of(f"{self.path}/log"))

    def commits(self) -> list[Commit]:
        """All commits by number: as many lines as there were commits, since the start."""
        rows = self.spark.read.schema("number long, stream string, batch long, folder string, snapshot boolean").json(f"{self.path}/log").collect()
        return sorted((Commit(*r) for r in rows), key=lambda c: c.number)

    def current(self) -> list[Commit]:
        """The commits that readers need: the last snapshot and what came after it."""
        every = self.commits()
        start = max((i for i, c in enumerate(every) if c.snapshot), default=0)
        return every[start:]

    def has(self, stream: str, batch: int) -> bool:
        return any((c.stream, c.batch) == (stream, batch) for c in self.commits())

    def _log(self, commit: Commit) -> bool:
        """Writes the line of a commit; False if its number is taken."""
        draft = self._of(f"{self.path}/log/.{uuid.uuid4().hex}")
        out = self._fs.create(draft, False)
        out.write(bytearray((json.dumps(asdict(commit)) + "\n").encode()))
        out.close()
        try:
            self._files.rename(draft, self._of(f"{self.path}/log/{commit.number:012d}.json"), self._keep)
        except Exception as e:  # the gateway wraps Java's exception
            self._fs.delete(draft, False)
            if "FileAlreadyExists" in str(getattr(e, "java_exception", e)):
                return False
            raise
        return True

    def commit(self, rows: DataFrame, stream: str, batch: int, snapshot: bool = False) -> Commit | None:
        """Takes ``rows`` in as a batch of a stream; a batch that was taken in before changes nothing (None).

        Rows are written first and named by the log afterwards, so a try that broke off leaves no trace for readers.
        """
        if self.has(stream, batch):
            return None
        folder = uuid.uuid4().hex
        rows.write.parquet(f"{self.path}/data/{folder}")
        while True:
            known = self.commits()
            if any((c.stream, c.batch) == (stream, batch) for c in known):
                return None
            made = Commit(known[-1].number + 1 if known else 1, stream, batch, folder, snapshot)
            if self._log(made):
                return made

    def read(self, only: DataFrame | None = None) -> DataFrame | None:
        """Of each key the row of the last commit that has it; None where nothing was ever committed. ``commit`` tells which one.

        With ``only``, a table of keys, just these are looked up: the others are left out before rows are grouped.
        """
        commits = self.current()
        if not commits:
            return None
        rows = self.spark.read.option("mergeSchema", True).parquet(*[f"{self.path}/data/{c.folder}" for c in commits])
        numbers = F.broadcast(self.spark.createDataFrame([(c.folder, c.number) for c in commits], "_folder string, _number long"))  # a row a commit since the last snapshot
        named = rows.withColumn("_folder", F.regexp_extract(F.col("_metadata.file_path"), "/data/([0-9a-f]+)/[^/]*$", 1)).join(numbers, "_folder").drop("_folder")
        if only is not None:
            named = named.join(only.select(self.key).distinct(), self.key, "left_semi")
        columns = [c for c in rows.columns if c not in (self.key, "commit")]
        last = named.groupBy(self.key).agg(F.max_by(F.struct(*columns, F.col("_number").alias("commit")), "_number").alias("r"))
        return last.select(self.key, "r.*")

    def compact(self, keep: Column | None = None) -> Commit | None:
        """A snapshot of all keys, of rows that ``keep`` holds for, from which readers start; older folders stay for those who read them now."""
        rows, commits = self.read(), self.current()
        if rows is None or len(commits) == 1:
            return None
        folder = uuid.uuid4().hex
        (rows if keep is None else rows.where(keep)).drop("commit").write.parquet(f"{self.path}/data/{folder}")
        last = commits[-1].number
        made = Commit(last + 1, "snapshot", last, folder, True)
        # a commit that came meanwhile has the number, and isn't in the snapshot: then the snapshot isn't one
        return made if self._log(made) else None


def known(files: DataFrame, store: DataFrame, version: int) -> DataFrame:
    """Store rows that hold for the files as they are now."""
    return store.where(F.col("version") == version).join(files.select(*KEY), KEY, "left_semi")


def to_do(files: DataFrame, store: DataFrame, version: int, with_descriptors: bool = False) -> DataFrame:
    """Files without valid features; with ``with_descriptors`` also those that lack descriptors and could have some."""
    valid = store.where(F.col("version") == version)
    if with_descriptors:
        valid = valid.where("flat or error is not null or n_descriptors > 0")
    return files.join(valid.select(*KEY), KEY, "left_anti")


def upsert(store: DataFrame, new: DataFrame) -> DataFrame:
    """The store with ``new`` rows in place of those of the same path; write it as a new version of the folder."""
    return store.join(new.select("path").distinct(), "path", "left_anti").unionByName(new, allowMissingColumns=True)
