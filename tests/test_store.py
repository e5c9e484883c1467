"""The kept store: several listings, retries, rivals, snapshots."""

import datetime as dt
import threading

from pyspark.sql import functions as F

from cairn.sources import store
from cairn.sources.store import KeptStore
from cairn.streaming import runs

LISTING = "path string, size long, mtime timestamp"
JAN = dt.datetime(2024, 1, 1)


def listed(spark, path, rows):
    spark.createDataFrame([(p, s, JAN + dt.timedelta(days=d)) for p, s, d in rows], LISTING).coalesce(1).write.mode("append").parquet(path)


def contents(kept):
    return sorted((r.path, r.size, r.commit) for r in kept.read().collect())


def test_calls_go_on_where_the_last_one_ended(spark, tmp_path):
    source, path, calls = str(tmp_path / "in"), str(tmp_path / "store"), []

    def compute(df):
        calls.append(sorted(r.path for r in df.collect()))
        return df.withColumn("phash", F.col("size") * 10)

    refresh = lambda version=3: runs.refresh_store(spark.readStream.schema(LISTING).parquet(source), path, version, compute)
    kept = KeptStore(spark, path)
    assert kept.read() is None and kept.commits() == []
    listed(spark, source, [("a", 1, 0), ("b", 1, 0)])
    refresh()
    listed(spark, source, [("b", 2, 1), ("c", 1, 0)])
    refresh()
    assert contents(kept) == [("a", 1, 1), ("b", 2, 2), ("c", 1, 2)]
    refresh()  # nothing new
    listed(spark, source, [("a", 1, 0), ("d", 5, 0), ("d", 6, 3), ("d", 7, 1)])  # known, and one path three times
    refresh()
    assert calls == [["a", "b"], ["b", "c"], ["d"]]
    assert contents(kept) == [("a", 1, 1), ("b", 2, 2), ("c", 1, 2), ("d", 6, 3)]
    assert {r.path: r.phash for r in kept.read().collect()} == {"a": 10, "b": 20, "c": 10, "d": 60}
    # another stream, of another version of the features: all that it lists is computed anew
    other = str(tmp_path / "more")
    listed(spark, other, [("a", 1, 0), ("e", 1, 0)])
    runs.refresh_store(spark.readStream.schema(LISTING).parquet(other), path, 4, compute, stream="more")
    assert [(c.number, c.stream, c.batch) for c in kept.commits()] == [(1, "listings", 0), (2, "listings", 1), (3, "listings", 2), (4, "more", 0)]
    assert {(r.path, r.version) for r in kept.read().collect()} == {("a", 4), ("b", 3), ("c", 3), ("d", 3), ("e", 4)}


def test_a_batch_counts_once(spark, tmp_path):
    kept = KeptStore(spark, str(tmp_path / "store"))
    rows = spark.createDataFrame([("a", 1, JAN)], LISTING)
    assert kept.commit(rows, "s", 0).number == 1
    assert kept.commit(rows.withColumn("size", F.lit(9).cast("long")), "s", 0) is None  # tried again after the commit
    assert contents(kept) == [("a", 1, 1)]
    rows.withColumn("size", F.lit(9).cast("long")).write.parquet(str(tmp_path / "store/data/0abc"))  # what a lost writer left
    assert contents(kept) == [("a", 1, 1)]
    # more columns, then none of them, later
    assert kept.commit(rows.withColumn("size", F.lit(2).cast("long")).withColumn("extra", F.lit("x")), "s", 1).number == 2
    assert [(r.size, r.extra) for r in kept.read().collect()] == [(2, "x")]


def test_rival_writers_get_numbers_of_their_own(spark, tmp_path):
    path, made = str(tmp_path / "store"), []
    KeptStore(spark, path)

    def write(i):
        rows = spark.createDataFrame([(f"p{i}", i, JAN)], LISTING)
        made.append(KeptStore(spark, path).commit(rows, f"stream{i}", 0))

    writers = [threading.Thread(target=write, args=(i,)) for i in range(4)]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    assert sorted(c.number for c in made) == [1, 2, 3, 4]
    assert len(contents(KeptStore(spark, path))) == 4


def test_a_snapshot_stands_for_what_was_before(spark, tmp_path):
    kept = KeptStore(spark, str(tmp_path / "store"))
    assert kept.compact() is None
    for i, size in enumerate((1, 2, 3)):
        kept.commit(spark.createDataFrame([("a", size, JAN), (f"p{i}", i, JAN)], LISTING), "s", i)
    before = sorted((r.path, r.size) for r in kept.read().collect())
    assert kept.compact().number == 4 and len(kept.current()) == 1
    assert sorted((r.path, r.size) for r in kept.read().collect()) == before
    kept.commit(spark.createDataFrame([("a", 7, JAN)], LISTING), "s", 3)
    assert [c.number for c in kept.current()] == [4, 5] and kept.has("s", 0)
    assert {r.path: r.size for r in kept.read().collect()}["a"] == 7


def test_what_is_to_do(spark):
    files = spark.createDataFrame([("a", 1, JAN), ("b", 1, JAN), ("c", 1, JAN), ("d", 1, JAN), ("e", 1, JAN)], LISTING)
    have = files.where("path <> 'e'").withColumn("version", F.lit(2)).withColumn("flat", F.col("path") == "a")
    have = have.withColumn("error", F.when(F.col("path") == "b", "broken")).withColumn("n_descriptors", F.when(F.col("path") == "c", 4).otherwise(0))
    todo = lambda **k: sorted(r.path for r in store.to_do(files, have, 2, **k).collect())
    assert todo() == ["e"] and todo(with_descriptors=True) == ["d", "e"]
    assert store.to_do(files, have, 3).count() == 5 and store.known(files, have, 2).count() == 4


def test_walk_of_a_real_folder(spark, tmp_path):
    """Links, hidden files, packages, the excluded folder, pipes, and names that are hard to read."""
    import os

    from cairn.sources.folders import walk

    root = tmp_path / ".root.app"
    for name in ("a/b/c/d.txt", "a/.hidden/x", "a/.dot", "_under/y", "Trip.PhotosLibrary/p.jpg", "keep.app.d/z", "sorted/s", "a/sorted/t", "ümläut/é.jpg", "empty.app"):
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(name)
    (root / "void").mkdir()
    os.symlink(root / "a", root / "link")
    os.symlink(root / "a/b/c/d.txt", root / "a/to_file")
    os.symlink(root, root / "a/loop")
    os.symlink(root / "gone", root / "a/broken")
    os.mkfifo(root / "a/pipe")
    with open(os.path.join(os.fsencode(root), b"bad\xff"), "w"):
        pass
    rel = lambda df: sorted(r.path[len(str(root)) + 1 :] for r in df.collect())
    assert rel(walk(spark, f"{root}/", exclude=str(root / "sorted"))) == ["_under/y", "a/b/c/d.txt", "a/sorted/t", "empty.app", "keep.app.d/z", "ümläut/é.jpg"]
    assert rel(walk(spark, str(root), include_hidden=True)) == ["_under/y", "a/.dot", "a/.hidden/x", "a/b/c/d.txt", "a/sorted/t", "empty.app", "keep.app.d/z", "sorted/s", "ümläut/é.jpg"]
    (d,) = walk(spark, str(root / "a/b")).collect()
    s = os.lstat(root / "a/b/c/d.txt")
    assert (d.kind, d.size) == ("file", s.st_size) and abs(d.mtime.timestamp() - s.st_mtime) < 0.001
    assert walk(spark, str(root / "nowhere")).count() == 0 and walk(spark, str(root / "void")).count() == 0
