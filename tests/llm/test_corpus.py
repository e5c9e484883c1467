"""Sharding, archives, decontamination and the pipeline, with odd rows."""

import base64
import hashlib
import random
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cairn.llm import decontaminate, near_dedup, quality, queries, sharding, toxicity, warc
from cairn.session import scratch_path

SMALL = Path("/root/testdata/sf0.001")
needs_tables = pytest.mark.skipif(not SMALL.exists(), reason="needs the given tables")


@needs_tables
@pytest.mark.parametrize("limit", [16 << 20, 60_000, 25_000])
def test_shards_equal_their_definition(spark, limit):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SMALL}/documents.parquet'")
    want = sorted(con.execute(sharding.oracle(limit)).fetchall())
    got = sharding.assign_shards(spark.read.parquet(f"{SMALL}/documents.parquet"), limit)
    assert sorted(map(tuple, got.select("key", "bytes", "depth", "shard").collect())) == want


def test_shards_of_one_hot_key(spark):
    rows = [(7 if i % 3 == 0 else i, "x" * 100, i) for i in range(900)] + [(None, None, 0), (None, "é", 0), (5, "y" * 9000, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, bytes int")
    got = sharding.assign_shards(df, 4000).collect()
    assert len(got) == len(rows) and sum(r.bytes for r in got) == sum(len((t or "").encode()) for _, t, _ in rows)
    sizes = {}
    for r in got:
        sizes.setdefault(r.shard, []).append(r.bytes)
    assert all(sum(s) <= 4000 + 100 for s in sizes.values() if max(s) < 4000)
    assert max(r.overflow for r in got) >= 6
    assert sharding.assign_shards(df.limit(0), 4000).count() == 0


def test_no_shard_of_a_hot_key_passes_the_limit(spark):
    rng = random.Random(4)
    rows = [(rng.choice([7, 7, 7, None, i]), "x" * rng.choice([0, 1, 90, 499, 500, 501, 1999, 2000, 2001, 3000, 4000, 4001, 9000])) for i in range(600)]
    got = sharding.assign_shards(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 4000).collect()
    assert sorted((r.key or -1, r.bytes) for r in got) == sorted((k or -1, len(t)) for k, t in rows)
    shards = {}
    for r in got:
        shards.setdefault(r.shard, []).append(r.bytes)
    assert all(sum(s) <= 4000 or len([b for b in s if b]) == 1 for s in shards.values())
    assert len(shards) <= 3 * sum(map(sum, shards.values())) / 4000


def test_shards_are_written_with_null_and_repeated_keys(spark, tmp_path):
    rows = [(7 if i % 3 == 0 else None if i % 3 == 1 else i, "x" * 40, i) for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string, extra int")
    sharding.write_shards(df, str(tmp_path / "out"), 1000)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(tuple, back.select(*df.columns).collect()), key=repr) == sorted(rows, key=repr)
    clash = df.withColumnRenamed("extra", "shard")
    sharding.write_shards(clash, str(tmp_path / "clash"), 1000)
    back = spark.read.parquet(str(tmp_path / "clash"))
    assert sorted(map(tuple, back.select(*clash.columns).collect()), key=repr) == sorted(rows, key=repr) and back.select("_shard").distinct().count() > 3
    assert back.groupBy("shard").agg(F.sum(F.length("text")).alias("b")).where("b >= 1040").count() == 0


def test_shards_are_written(spark, tmp_path):
    df = spark.createDataFrame([(i, "x" * 50) for i in range(100)], "doc_id long, text string")
    sharding.write_shards(df, str(tmp_path / "out"), 1000)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 100 and back.groupBy("shard").agg(F.sum(F.length("text")).alias("b")).where("b > 1000").count() == 0


@pytest.mark.parametrize("least", [0, 3])
def test_archives_round_trip(spark, least):
    rng = random.Random(3)
    rows = [(i, f"http://x/{i}", f"<p>{rng.randint(0, 20)} é {'word ' * (i % 7)}</p>") for i in range(120)]
    rows += [(500, None, None), (501, "u\r\nv", ""), (None, "w", rows[0][2]), (502, "x", "ab"), (503, "x", "ab"), (3, "again", rows[3][2]), (4, "y", "z" * 300_000)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, digest int")
    first = {}
    for i, _, h in rows:
        body = (h or "").encode()
        if i is not None and len(body) >= least:
            first[body] = min(first.get(body, i), i)
    want = []
    for i, _, h in rows:
        body = (h or "").encode()
        to = None if first.get(body, i) == i else first[body]
        want.append((i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "response" if to is None else "revisit", to))
    got = warc.archive_and_read(df, least_bytes=least).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert warc.archive_and_read(df.limit(0)).count() == 0


def test_a_record_decodes_alone(spark):
    folder = scratch_path(spark, "warc-test")
    df = spark.createDataFrame([(i, "u", f"<html>{i} common boilerplate text</html>") for i in range(300)], "page_id long, url string, html string")
    written = warc.write_archives(warc.plan_records(df).coalesce(1), folder).collect()
    assert sum(r.records for r in written) == 300
    import struct

    import zstandard

    data = Path(written[0].path).read_bytes()
    magic, size = struct.unpack("<II", data[:8])
    assert magic == warc.SKIPPABLE
    one = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8 : 8 + size])).decompressobj().decompress(data[8 + size :])
    assert one.startswith(b"WARC/1.1\r\n") and warc.parse(one)[0]["WARC-Type"] == "warcinfo"
    records = list(warc.frames(open(written[0].path, "rb")))
    assert len(records) == 301 and len({warc.parse(r)[0]["WARC-Record-ID"] for r in records}) == 301
    head, body = warc.parse(records[1])
    assert head["Content-Type"] == "application/http;msgtype=response" and b"HTTP/1.1 200 OK\r\n" in records[1] and body.startswith(b"<html>") and body.endswith(b"</html>")


def test_payloads_that_do_not_fit_a_broadcast(spark, monkeypatch):
    monkeypatch.setattr(warc, "BROADCAST_BYTES", 0)
    rows = [(i, "u", None if i % 3 == 0 else f"p{i % 50}") for i in range(2000)]
    got = {r.page_id: r.refers_to for r in warc.plan_records(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    first = {}
    for i, _, h in rows:
        first.setdefault(h or "", i)
    assert got == {i: None if first[h or ""] == i else first[h or ""] for i, _, h in rows}


ITEMS = [(1, "Anna has 3 apples and gives 2 apples to Tom. How many apples does Anna have now?"), (2, "Anna met Bob before Anna saw Carl while Bob walked to town"), (3, None), (4, "too short"), (None, "a null item of some words that stands in no report at all")]


def test_contamination(spark):
    texts = [
        (1, "x y z. Maria has 7 apples and gives 5 apples to Paul. How many apples does Maria have now? Done."),
        (2, "Eve met Dan before Eve saw Fay while Dan walked to town"),
        (3, "Eve met Dan before Zoe saw Fay while Max walked to town"),
        (4, None), (5, ""), (None, ITEMS[0][1]),
        (6, "She said: " + ITEMS[0][1] + " " + "filler words follow here " * 200),
        (7, "apples and pears are sold by the market on most days of the week"),
        (8, ITEMS[1][1]), (8, ITEMS[1][1]), (8, "other text of the same document number"),
    ]
    docs = spark.createDataFrame([(i, t, 0, "w") for i, t in texts], "doc_id long, text string, item_id int, words string")
    items = spark.createDataFrame([(i, t, "k") for i, t in ITEMS], "item_id long, text string, kinds string")
    got = {(r.doc_id, r.item_id): (r.kind, r.coverage) for r in decontaminate.contamination(docs, items).collect()}
    assert got == {(1, 1): ("reparameterised", 1.0), (2, 2): ("reparameterised", 1.0), (6, 1): ("verbatim", 1.0), (8, 2): ("verbatim", 1.0)}
    left = decontaminate.drop_contaminated(docs, items)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {3, 4, 5, None, 7}
    assert decontaminate.contamination(docs.limit(0), items).count() == 0 and decontaminate.contamination(docs, items.limit(0)).count() == 0


def test_slots_of_any_length_and_short_items(spark):
    items = [
        (1, "Mary Ann Smith bought 12 apples at the market and Mary Ann Smith ate 3 apples on the way home"),
        (2, "Solve for x: 3 + 4"),
        (3, "Anna kauft 5 Bücher und Anna liest zwei Stunden lang jeden Abend"),
        (4, "1,000 + 2,500"), (5, "?!"), (6, None),
        (7, "which river runs slowly past the old stone mill near our town and joins the sea in spring"),
    ]
    texts = [
        (10, "Bob bought 15 apples at the market and Tom ate 4 apples on the way home"),
        (11, "Bob bought 15 apples at the market and Bob ate 4 apples on the way home"),
        (12, "José María de Ruiz bought 1,500 apples at the market and José María de Ruiz ate 4 apples on the way home"),
        (13, "so: solve for x: 3 + 4 now"), (14, "solve for x: 3 + 5"), (15, "1,000 + 2,500 is 3,500"), (16, "1,000 + 2,600"),
        (17, "Karl kauft 17 Bücher und Karl liest drei Stunden lang jeden Abend"),
        (18, "which river runs slowly past the old stone mill near our own town and joins the sea in early spring"),
        (19, None), (20, ""),
    ]
    docs, bench = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.kind for r in decontaminate.contamination(docs, bench).collect()}
    assert {k for k in got if k[1] != 1} == {(13, 2), (14, 2), (15, 4), (17, 3), (18, 7)}
    assert (11, 1) in got and (10, 1) not in got and got[11, 1] == "reparameterised"
    assert got[13, 2] == got[15, 4] == got[18, 7] == "verbatim" and got[17, 3] == got[14, 2] == "reparameterised"


@needs_tables
def test_planted_passages_are_found(spark):
    docs, items = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "benchmark"))
    found = {(r.doc_id, r.item_id) for r in decontaminate.contamination(docs, items).collect()}
    bench = [(r.item_id, r.text) for r in items.collect()]
    assert {(d.doc_id, i) for d in docs.collect() for i, t in bench if t in (d.text or "")} <= found


@needs_tables
def test_pipeline_keeps_what_each_stage_keeps(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels, items = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("labels", "benchmark"))
    for keep in (
        lambda d: {r.doc_id for r in toxicity.toxicity(d, labels).where("predicted = 0").collect()},
        lambda d: {r.doc_id for r in quality.quality_rules(d).where("kept").collect()},
        lambda d: {r.doc_id for r in near_dedup.near_duplicates(d).where("kept").collect()},
        lambda d: {r.doc_id for r in d.collect()} - {r.doc_id for r in decontaminate.contamination(d, items).collect()},
    ):
        docs = spark.createDataFrame(docs.where(F.col("doc_id").isin(*keep(docs))).collect(), docs.schema)
    got = corpus_pipeline.run(spark, str(SMALL)).collect()
    assert {r.doc_id for r in got} == {r.doc_id for r in docs.collect()} and all(r.ids for r in got)


def test_stages_come_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "near_dedup", "decontaminate", "tokenize"]
    assert {int(n[2:].split("_")[0]) for n in queries.QUERIES} == set(range(1, 11))
