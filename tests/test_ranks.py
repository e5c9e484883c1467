"""Ranks and free numbers by ranges, against their definition; plans of many equal names against the sequential rule."""

import datetime as dt
import random

from pyspark.sql import functions as F

from cairn.operators import ranks
from cairn.plans import layout

JAN = dt.datetime(2024, 1, 1)


def test_running_counts_and_sums(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["hot", "hot", "hot", None, f"k{rng.randrange(40)}"]), i, rng.choice([None, 1, 5])) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, i int, v int").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = ranks.running(ranks.running(df, ["k"], [-F.col("i")]), ["k"], ["i"], F.col("v"), "total").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted((r.k or "", r.i) for r in got) == sorted((k or "", i) for k, i, _ in rows)
    by = {}
    for k, i, v in rows:
        by.setdefault(k, []).append((i, v))
    for k, own in by.items():
        total, want = 0, {}
        for n, (i, v) in enumerate(sorted(own)):
            total += v or 0
            want[i] = (len(own) - n, total)
        assert {r.i: (r["rank"], r.total) for r in got if r.k == k} == want
    assert ranks.running(df.limit(0), ["k"], ["i"]).count() == 0


def test_a_hot_key_lies_in_many_ranges(spark):
    df = spark.range(20_000).select(F.lit("all").alias("k"), "id")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = ranks.running(df, ["k"], ["id"])
        assert got.agg(F.sum((F.col("rank") - F.col("id") - 1).cast("int")), F.max("rank")).first()[:] == (0, 20_000)
        sizes = [r["count"] for r in got.groupBy(F.spark_partition_id().alias("p")).count().collect()]
        assert len(sizes) >= 2 and max(sizes) < 15_000
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_free_numbers(spark):
    rng = random.Random(2)
    claims = [(rng.choice("aab"), f"p{i:03d}") for i in range(200)]
    taken = [(k, n) for k in "abc" for n in rng.sample(range(-2, 150), 60)] + [("a", 5), ("a", 5)]
    got = {(r.k, r.p): r.number for r in ranks.free_numbers(spark.createDataFrame(claims, "k string, p string"), spark.createDataFrame(taken, "k string, number int"), ["k"], ["p"]).collect()}
    want = {}
    for k in "ab":
        used, n = {t for key, t in taken if key == k}, 0
        for _, p in sorted(c for c in claims if c[0] == k):
            n += 1
            while n in used:
                n += 1
            want[k, p] = n
    assert got == want
    assert {r.number for r in ranks.free_numbers(spark.createDataFrame([("a", "x"), ("a", "y")], "k string, p string"), spark.createDataFrame([], "k string, number int"), ["k"], ["p"]).collect()} == {1, 2}


def sequential(rows, there):
    """The rule itself: names are claimed in order."""
    out = {}
    for folder in {r[0] for r in rows}:
        lying = {n.lower(): s for f, n, *s in there if f == folder}
        claimed = {n.lower() for f, n, *_, held, _ in rows if f == folder and held}
        for _, name, path, size, mtime, held, included in sorted((r for r in rows if r[0] == folder), key=lambda r: r[2]):
            fold, root = name.lower(), name.rpartition(".")
            if held:
                out[path] = (name, "in_place")
            elif not included:
                out[path] = (name, "ready")
            elif fold in lying and lying[fold][0] == size and fold not in claimed:
                claimed.add(fold)
                out[path] = (name, "already_there" if abs((lying[fold][1] - mtime).total_seconds()) <= 2 else "check_first")
            elif fold in lying or fold in claimed:
                n = 1
                while (new := f"{root[0]} ({n}).{root[2]}").lower() in lying or new.lower() in claimed:
                    n += 1
                claimed.add(new.lower())
                out[path] = (new, "renamed")
            else:
                claimed.add(fold)
                out[path] = (name, "ready")
    return out


def test_equal_names_are_claimed_as_in_sequence(spark):
    rng = random.Random(6)
    for trial in range(4):
        rows, there = [], []
        for f in range(12):
            stem = f"n{f}"
            for i in range(rng.randrange(1, 9)):
                name = rng.choice([stem, stem.upper()]) + ".jpg"
                rows.append((f"/d/{f}", name, f"/s/{f}/{i}/{name}", rng.randrange(3), JAN + dt.timedelta(hours=rng.randrange(2)), False, rng.random() < 0.85))
            if rng.random() < 0.3:
                rows.append((f"/d/{f}", f"{stem}.jpg", f"/d/{f}/{stem}.jpg", 1, JAN, True, True))
            if rng.random() < 0.6:
                there.append((f"/d/{f}", f"{stem}.JPG", rng.randrange(3), JAN + dt.timedelta(hours=rng.randrange(2), seconds=rng.randrange(4))))
            there += [(f"/d/{f}", f"{stem} ({n}).jpg", 1, JAN) for n in rng.sample(range(1, 9), rng.randrange(4))]
        files = spark.createDataFrame([(p, n, "photos", s, m, None, f) for f, n, p, s, m, *_ in rows], "path string, name string, category string, size long, mtime timestamp, birthtime timestamp, dest_folder string")
        out = spark.createDataFrame([(r[2],) for r in rows if not r[6]] + [("/none",)], "path string")
        keep = layout.destinations
        layout.destinations = lambda files, options: files  # the folders are given
        try:
            got = layout.plan(files, spark.createDataFrame(there, "folder string, name string, size long, mtime timestamp"), layout.Options("/s", "/d"), out).collect()
        finally:
            layout.destinations = keep
        assert {r.path: (r.dest_name, r.status) for r in got} == sequential(rows, there), trial


def test_many_equal_names_in_one_folder(spark):
    """A million names would be the same work: ranges of them, no task with all."""
    files = spark.range(30_000).select(F.format_string("/s/%05d/a.jpg", "id").alias("path"), F.lit("a.jpg").alias("name"), F.lit("photos").alias("category"), F.col("id").alias("size"), F.lit(JAN).alias("mtime"), F.lit(None).cast("timestamp").alias("birthtime"))
    there = spark.createDataFrame([("/d", "a.jpg", 7, JAN), ("/d", "a (3).jpg", 1, JAN)], "folder string, name string, size long, mtime timestamp")
    planned = layout.plan(files, there, layout.Options("/s", "/d", by_type=False, by_date=False))
    assert {r.status: r["count"] for r in planned.groupBy("status").count().collect()} == {"already_there": 1, "renamed": 29_999}
    assert planned.select("dest_name").distinct().count() == 30_000
    assert planned.where("path in ('/s/00000/a.jpg', '/s/00002/a.jpg', '/s/00003/a.jpg', '/s/29999/a.jpg')").orderBy("path").select("dest_name").collect() == [("a (1).jpg",), ("a (4).jpg",), ("a (5).jpg",), ("a (30000).jpg",)]


def test_many_rows_to_one_destination(spark):
    rows = spark.range(5000).select(F.format_string("/s/%04d", "id").alias("path"), F.lit("/d/x.txt").alias("dest"), F.lit(True).alias("actionable"), F.lit(1).alias("size"))
    source = rows.select("path", F.lit("new").alias("digest"))
    dest = spark.createDataFrame([("/d/x.txt", "old"), ("/d/x (2).txt", "other"), ("/d/X (4).TXT", "other"), ("/d/x (07).txt", "o")], "path string, digest string")
    got = layout.reconcile(rows, source, dest)
    assert got.groupBy("outcome").count().collect() == [("renamed", 5000)]
    assert [r.final for r in got.orderBy("path").limit(5).collect()] == ["/d/x (1).txt", "/d/x (3).txt", "/d/x (5).txt", "/d/x (6).txt", "/d/x (7).txt"]
    assert got.select("final").distinct().count() == 5000
