"""Run states and first sightings over several calls, with odd events; long journals in pieces."""

import datetime as dt
import gzip
import io
import json
import random

from pyspark.sql import functions as F

from cairn.operators import ledger
from cairn.sources import journals
from cairn.streaming import runs

JAN = dt.datetime(2024, 1, 1)
EVENT = "run_id string, seq long, type string, size long"
ARRIVAL = "path string, digest string, seen timestamp"


def test_states_whatever_the_order(spark, tmp_path):
    journals = {
        "finished": ["run", "file", "mkdir", "end"], "open": ["run", "file"], "undone": ["run", "file", "end", "undo"], "twice": ["run", "end", "undo", "undo"], "headless": ["file", "end"],
        "late": ["run", "file", "end", "file"], "late_folder": ["run", "end", "rmdir", "undo"], "only": ["run"],
    }
    events = [(run, k, kind, 5 if kind == "file" else None) for run, kinds in journals.items() for k, kind in enumerate(kinds)]
    random.Random(3).shuffle(events)
    want = {
        "finished": ("finished", None, 1), "open": ("open", None, 1), "undone": ("undone", None, 1), "twice": ("invalid", "undone twice", 0), "headless": ("invalid", "no header", 1), "late": ("invalid", "event after end", 2),
        "late_folder": ("invalid", "event after end", 0), "only": ("open", None, 0),
    }
    source, path = str(tmp_path / "in"), str(tmp_path / "states")
    read = lambda: runs.watch_ledger(spark, source, 1)
    for part in (events[:9], events[9:10], events[10:]):
        spark.createDataFrame(part, EVENT).repartition(2).write.mode("append").json(source)
        kept = runs.keep_status(read(), path)
    got = {r.run_id: (r.state, r.problem, r.transferred) for r in kept.read().collect()}
    assert got == want
    assert {r.run_id: (r.state, r.problem, r.transferred) for r in runs.run_status(spark.createDataFrame(events, EVENT)).collect()} == want
    # nothing new changes nothing, and only runs of an event that came are written
    before = len(kept.commits())
    spark.createDataFrame([("open", 9, "end", None)], EVENT).coalesce(1).write.mode("append").json(source)
    runs.keep_status(read(), path)
    (last,) = kept.commits()[before:]
    assert [r.run_id for r in spark.read.parquet(f"{path}/data/{last.folder}").collect()] == ["open"]


def arrive(spark, path, rows):
    spark.createDataFrame([(p, d, JAN + dt.timedelta(days=n)) for p, d, n in rows], ARRIVAL).coalesce(1).write.mode("append").parquet(path)


def test_copies_over_calls(spark, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "out")
    call = lambda every=16: runs.mark_copies(spark.readStream.schema(ARRIVAL).parquet(source), path, keep="interval 10 days", compact_every=every)
    arrive(spark, source, [("b", "x", 0), ("a", "x", 0), ("c", "x", -1), ("d", "y", 0), ("n", None, 0), ("m", None, 0)])
    call()
    arrive(spark, source, [("e", "x", 9), ("f", "z", 9), ("a", "x", 9)])
    call()
    got = sorted((r.path, r.digest, r.copy_of) for r in runs.marked(spark, path).collect() if r.digest)
    assert got == [("a", "x", "c"), ("a", "x", "c"), ("b", "x", "c"), ("c", "x", None), ("d", "y", None), ("e", "x", "c"), ("f", "z", None)]
    assert [r.copy_of for r in runs.marked(spark, path).where("digest is null").collect()] == [None, None]
    # y was last seen too long ago; x was seen since; the store forgets what is too old
    arrive(spark, source, [("g", "y", 15), ("h", "x", 15), ("i", "w", 40)])
    call(every=3)
    assert {(r.path, r.copy_of) for r in runs.marked(spark, path).where("path in ('g', 'h', 'i')").collect()} == {("g", None), ("h", "c"), ("i", None)}
    from cairn.sources.store import KeptStore

    kept = KeptStore(spark, f"{path}/digests", "digest")
    assert [r.digest for r in kept.read().collect()] == ["w"] and len(kept.current()) == 1


def test_first_seen_forgets_nothing(spark, tmp_path):
    """Copies that are centuries apart are copies: the table is as the SQL has it, whatever the files' times."""
    import duckdb

    from cairn.queries import ORACLES, QUERIES

    rows = [(i, f"text {i % 3}" if i != 7 else None, "src1", 9) for i in (0, 1, 2, 7, 300_000, 300_001, 500_003, 500_004)]
    spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    got = {(r.path, r.digest, r.copy_of) for r in QUERIES["stream_first_seen"](spark, str(tmp_path)).collect()}
    want = {tuple(r) for r in con.execute(f"select path, digest, copy_of from ({ORACLES['stream_first_seen']})").fetchall()}
    assert got == want and sum(r[2] is not None for r in want) == 4


def test_a_ledger_has_no_folder_a_run(spark, tmp_path):
    path = str(tmp_path / "ledger")
    for first in (0, 300):
        events = spark.range(first, first + 300, 1, 3).select(F.col("id").cast("string").alias("run_id"), F.lit(1).cast("long").alias("seq"), F.lit("run").alias("type"))
        ledger.append(events, path)
    assert sorted(int(r.run_id) for r in ledger.read_ledger(spark, path).collect()) == list(range(600))
    assert len(list((tmp_path / "ledger").rglob("*.json"))) == 6


def test_a_hot_digest_is_spread(spark, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "out")
    rows = spark.range(6000).select(F.concat(F.lit("p"), F.format_string("%05d", "id")).alias("path"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("digest"), F.lit(JAN).alias("seen"))
    rows.repartition(8).write.parquet(source)
    runs.mark_copies(spark.readStream.schema(ARRIVAL).parquet(source), path)
    told = runs.marked(spark, path)
    assert told.where("copy_of is not null").count() == 1999
    assert {r.copy_of for r in told.where("digest = 'hot'").select("copy_of").distinct().collect()} == {None, "p00000"}
    # the hot digest's rows were written by several tasks
    assert told.where("digest = 'hot'").select(F.col("_metadata.file_path")).distinct().count() >= 3


def test_long_journals_are_read_in_pieces(spark, tmp_path):
    """The same rows however a file is cut, with blank lines, umlauts and a broken line far inside."""
    event = lambda k: json.dumps({"type": "file", "src": f"/ü{k}", "size": k}, ensure_ascii=False)
    lines = [event(k) if k % 7 else "" for k in range(1, 4000)]
    cut = [*lines[:2500], '{"type": "fi', *lines[2500:], '{"broken'] + [event(1)]
    journals = {"whole": lines, "cut": cut, "bad": ["nonsense", event(1)], "blank": ["", "  ", ""]}
    (tmp_path / "j").mkdir()
    for name, own in journals.items():
        (tmp_path / "j" / name).write_bytes("\n".join(own).encode())
    want = []
    for name, own in journals.items():
        for k, line in enumerate(own):
            if line.strip():
                try:
                    want.append((name, k, json.loads(line)["src"]))
                except ValueError:
                    break
    pieces = {}
    for size in ("128m", "20k"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            got = ledger.read_journals(spark, str(tmp_path / "j"))
            pieces[size] = spark.read.text(str(tmp_path / "j")).rdd.getNumPartitions()
            assert sorted((r.run_id.rpartition("/")[2], r.seq, r.src) for r in got.collect()) == sorted(want)
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert pieces["20k"] > 10


def test_journals_are_written_and_listed_without_a_folder_to_a_run(spark, tmp_path):
    """As many files as runs in a bounded number of folders; names, hidden files, packed files and bytes are read as Spark's reader has them."""
    n = 2 * journals.FOLDERS
    assert journals.write(spark.range(3 * n).select((F.col("id") % n).cast("string").alias("run_id"), (F.col("id") / n).cast("long").alias("seq"), F.col("id").cast("string").alias("value")), f"file://{tmp_path}/w") == n
    files = [p for p in (tmp_path / "w").rglob("*") if p.is_file()]
    assert sorted(p.name for p in files) == sorted(f"{k}.jsonl" for k in range(n))
    assert all(p.read_text() == f"{int(p.stem)}\n{int(p.stem) + n}\n{int(p.stem) + 2 * n}\n" for p in files)
    assert len({p.parent for p in files}) <= journals.FOLDERS
    odd = tmp_path / "odd"
    (odd / "sub" / "_p=1").mkdir(parents=True)
    (odd / "sub" / ".hidden").mkdir()
    for name in ("a b%20ü#[x]", "sub/_p=1/plain", "sub/.hidden/no", "sub/_no", "sub/empty"):
        (odd / name).write_bytes(b"" if name == "sub/empty" else b"x\r\n\n\xff y")
    (odd / "packed.gz").write_bytes(gzip.compress(b"one\ntwo") + gzip.compress(b"more\n"))
    seen = lambda df: sorted((r.run_id, bytes(r.v)) for r in df.select("run_id", F.col("value").cast("binary").alias("v")).collect())
    by_spark = spark.read.option("lineSep", "\n").option("recursiveFileLookup", "true").text(str(odd)).select(F.col("_metadata.file_path").alias("run_id"), "value")
    for path in (str(odd), f"file://{odd}/"):
        assert seen(journals.lines(spark, path)) == seen(by_spark)
    assert seen(journals.lines(spark, str(odd / "sub" / "_p=1" / "plain"))) == seen(journals.lines(spark, str(odd / "sub" / "_p=1" / "pl*")))


def test_lines_of_pieces(monkeypatch):
    """Every line lies in one piece, wherever a file is cut and however much is read at a time."""
    rng = random.Random(4)
    data = b"\n".join(b"x" * rng.choice([0, 0, 1, 7, 40]) for _ in range(60))
    for ending in (b"", b"\n", b"\n\n"):
        whole = (data + ending).split(b"\n")
        whole = whole[:-1] if whole[-1] == b"" else whole
        for chunk, size in ((1, 3), (5, 7), (64, 1), (1 << 20, 50), (16, 1 << 20)):
            monkeypatch.setattr(journals, "CHUNK", chunk)
            got = []
            for start in range(0, len(data + ending), size):
                f = io.BytesIO(data + ending)
                f.seek(max(0, start - 1))
                got += [x for own in journals._begun(f, start, start + size) for x in own]
            assert got == whole
