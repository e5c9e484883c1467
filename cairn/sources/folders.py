"""Listings of real folders, a level at a time."""

from __future__ import annotations

import os
import stat
from collections.abc import Iterator
from datetime import UTC, datetime
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions import paths
from cairn.session import materialize
from cairn.sources.inventory import LISTING, PACKAGES

#: Entries that a task hands on at a time.
ROWS = 10_000


def _time(seconds: float | None) -> datetime | None:
    return None if seconds is None else datetime.fromtimestamp(seconds, UTC)


def _entries(folder: str) -> Iterator[tuple]:
    """What lies in a folder itself; a folder or file that can't be read, or is gone, has no row."""
    try:
        opened = os.scandir(folder)
    except OSError:
        return
    with opened:
        for entry in opened:
            try:
                s = entry.stat(follow_symlinks=False)
                # a name that isn't Unicode can't be a string column's
                entry.path.encode()
            except (OSError, UnicodeEncodeError):
                continue
            kind = "file" if stat.S_ISREG(s.st_mode) else "folder" if stat.S_ISDIR(s.st_mode) else "symlink" if stat.S_ISLNK(s.st_mode) else "other"
            yield entry.path, kind, s.st_size, _time(s.st_mtime), _time(getattr(s, "st_birthtime", None))


def _opened(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns, found = ["path", "kind", "size", "mtime", "birthtime"], []
    frame = lambda: pd.DataFrame(found, columns=columns).astype({"mtime": "datetime64[us, UTC]", "birthtime": "datetime64[us, UTC]"})
    for batch in batches:
        for folder in batch["folder"]:
            for row in _entries(folder):
                found.append(row)
                if len(found) == ROWS:
                    yield frame()
                    found = []
    yield frame()


def walk(spark: SparkSession, root: str, exclude: str | None = None, include_hidden: bool = False) -> DataFrame:
    """Regular files below the folder ``root``, with ``LISTING``'s columns, from a folder that all executors have mounted.

    Level by level: one level's folders are dealt over tasks, each lists its own, and of what they find hidden folders (unless ``include_hidden``),
    packages and ``exclude`` are never opened. Links are neither followed nor listed, hidden files go as hidden folders do. A folder that can't be read is empty. The root itself may be
    hidden or a package; a root that isn't there has no files. As many passes as there are levels; what is found lies in the shared folder.
    """
    root = os.path.abspath(root)
    exclude = os.path.abspath(exclude) if exclude else None
    frontier = spark.createDataFrame([(root,)], "folder string")
    levels = [spark.createDataFrame([], LISTING)]
    while True:
        seen = frontier.mapInPandas(_opened, LISTING)
        if not include_hidden:
            seen = seen.where(~F.startswith(paths.name(F.col("path")), F.lit(".")))
        package = paths.suffix(paths.name(F.col("path"))).isin(*[f".{p}" for p in PACKAGES])
        seen = materialize(seen.where((F.col("kind") == "file") | ((F.col("kind") == "folder") & ~package & F.coalesce(F.col("path") != F.lit(exclude), F.lit(True)))), "level")
        levels.append(seen.where("kind = 'file'"))
        below = seen.where("kind = 'folder'").select(F.col("path").alias("folder"))
        if below.isEmpty():
            return reduce(DataFrame.unionByName, levels)
        frontier = below.repartition("folder")
