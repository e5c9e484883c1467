import datetime as dt
import json
import os
import random
import re
import unicodedata

import numpy as np
from pyspark.sql import functions as F

from cairn import session
from cairn.functions import dates, paths
from cairn.operators import components, groups, hamming, ledger, report, review
from cairn.plans import layout
from cairn.sources import inventory

JAN = dt.datetime(2021, 1, 15, 12)
LISTING = "path string, kind string, size long, mtime timestamp, birthtime timestamp"


def listing(spark, names, root="/in", size=4):
    rows = [(f"{root}/{n}", "file", size if isinstance(size, int) else size[i], JAN, None) for i, n in enumerate(names)]
    return inventory.classify(spark.createDataFrame(rows, LISTING))


def dest(spark, rows=()):
    return spark.createDataFrame(list(rows), "folder string, name string, size long, mtime timestamp")


def one(spark, column, value):
    return spark.createDataFrame([(value,)], f"x {column}")


def test_scan_prunes(spark):
    rows = [("/r/a.jpg", "file"), ("/r/.hidden.jpg", "file"), ("/r/.git/obj.jpg", "file"), ("/r/Lib.photoslibrary/originals/x.jpg", "file"), ("/r/sorted/already.jpg", "file"), ("/r/link.jpg", "symlink"), ("/r/my.app", "file")]
    df = spark.createDataFrame([(p, k, 1, JAN, None) for p, k in rows], LISTING)
    assert [r.rel for r in inventory.scan(df, "/r", exclude="/r/sorted").orderBy("rel").collect()] == ["a.jpg", "my.app"]


def test_layouts(spark):
    files = listing(spark, ["trip/IMG_1.JPG", "clip.mov", "notes.txt"])
    o = layout.Options("/in", "/out", categories=("photos", "videos"))
    assert {r.dest for r in layout.plan(files, dest(spark), o).collect()} == {"/out/Photos/2021/2021-01/IMG_1.JPG", "/out/Videos/2021/2021-01/clip.mov"}
    deep = layout.Options("/in", "/out", date_layout="year_month_day", keep_structure=True)
    assert layout.plan(listing(spark, ["trip/day1/a.jpg"]), dest(spark), deep).first().dest == "/out/Photos/2021/2021-01/2021-01-15/trip/day1/a.jpg"
    flat = layout.Options("/in", "/out", by_type=False, by_date=False)
    assert layout.plan(listing(spark, ["x/a.pdf"]), dest(spark), flat).first().dest == "/out/a.pdf"


def test_name_filters(spark):
    names = spark.createDataFrame([("Invoice-2021.pdf",), ("old invoice.pdf",), ("receipt.pdf",)], "name string")
    count = lambda p, m: names.where(layout.name_predicate(F.col("name"), p, m)).count()
    assert [count("invoice", "contains"), count("invoice-2021", "exact"), count("invoice*.pdf", "wildcard"), count(r"\d{4}", "regex"), count("  ", "exact")] == [2, 1, 1, 1, 3]
    assert layout.pattern_error(spark, "(", "regex").startswith("Invalid regex")
    assert layout.pattern_error(spark, "(", "contains") is None


def test_clashes(spark):
    flat = layout.Options("/in", "/out", by_type=False, by_date=False)
    got = layout.plan(listing(spark, ["a/IMG.jpg", "b/img.JPG", "c/img.jpg"]), dest(spark), flat).orderBy("path").collect()
    assert [(r.dest_name, r.status) for r in got] == [("IMG.jpg", "ready"), ("img (1).JPG", "renamed"), ("img (2).jpg", "renamed")]


def test_at_destination(spark):
    flat = layout.Options("/in", "/out", by_type=False, by_date=False)
    there = dest(spark, [("/out", "same.jpg", 4, JAN), ("/out", "maybe.jpg", 4, JAN + dt.timedelta(hours=1)), ("/out", "different.jpg", 9, JAN)])
    got = layout.plan(listing(spark, ["same.jpg", "maybe.jpg", "different.jpg"]), there, flat).collect()
    assert {(r.dest_name, r.status, r.actionable) for r in got} == {("same.jpg", "already_there", False), ("maybe.jpg", "check_first", True), ("different (1).jpg", "renamed", True)}


def test_in_place_and_excluded(spark):
    o = layout.Options("/in", "/in")
    got = {r.path: (r.dest, r.status) for r in layout.plan(listing(spark, ["Photos/2021/2021-01/a.jpg", "a.jpg", "b.jpg"]), dest(spark), o).collect()}
    assert got["/in/Photos/2021/2021-01/a.jpg"] == ("/in/Photos/2021/2021-01/a.jpg", "in_place")
    assert got["/in/a.jpg"] == ("/in/Photos/2021/2021-01/a (1).jpg", "renamed") and got["/in/b.jpg"][1] == "ready"
    out = spark.createDataFrame([("/in/keep.jpg",)], "path string")
    rows = layout.plan(listing(spark, ["keep.jpg", "go.jpg"]), dest(spark), layout.Options("/in", "/out"), out).collect()
    assert {(r.name, r.status, r.included, r.actionable) for r in rows} == {("keep.jpg", "ready", False, False), ("go.jpg", "ready", True, True)}


def claims_by_hand(files, there, root):
    """The rules as they are told: one file after another."""
    claimed, out = set(), {}
    for path, size in files:
        if path == f"{root}/{path.split('/')[-1]}":
            claimed.add(path.split("/")[-1].lower())
    for path, size in files:
        name = path.split("/")[-1]
        if path == f"{root}/{name}":
            out[path] = (name, "in_place")
            continue
        if there.get(name.lower()) == size and name.lower() not in claimed:
            claimed.add(name.lower())
            out[path] = (name, "already_there")
            continue
        final, n = name, 0
        stem, ext = os.path.splitext(name)
        while final.lower() in claimed or final.lower() in there:
            n += 1
            final = f"{stem} ({n}){ext}"
        claimed.add(final.lower())
        out[path] = (final, "renamed" if n else "ready")
    return out


def test_claims_equal_the_walk(spark):
    rng = random.Random(5)
    pool = ["a.jpg", "A.JPG", "a (1).jpg", "a (1) (1).jpg", "a (2).jpg", "b", "b (1)", ".x", ".x (1)", "..y", "c.", "c (1)."]
    for _ in range(6):
        folders = ["", "p", "p/q", "pa", "z"]
        names = sorted({(rng.choice(folders), rng.choice(pool)) for _ in range(22)}, key=lambda x: (("/in/" + x[0]).rstrip("/").split("/"), x[1]))
        sizes = [rng.randint(1, 3) for _ in names]
        there = {n.lower(): (n, rng.randint(1, 3)) for n in rng.sample(pool, 4)}
        files = [(f"/in/{f}/{n}" if f else f"/in/{n}", s) for (f, n), s in zip(names, sizes, strict=True)]
        root = "/in"
        flat = layout.Options("/in", root, by_type=False, by_date=False)
        df = listing(spark, [p[4:] for p, _ in files], size=sizes)
        # what lies in the source folder itself isn't listed at the destination here: names there are other files
        got = {r.path: (r.dest_name, r.status) for r in layout.plan(df, dest(spark, [(root, n, s, JAN) for n, s in there.values()]), flat).collect()}
        assert got == claims_by_hand(files, {k: s for k, (_, s) in there.items()}, root)


def test_reconciled_names_and_events(spark):
    rows = [("/s/a.jpg", "/d/a.jpg", 1), ("/s/b/a.jpg", "/d/a.jpg", 2), ("/s/c.jpg", "/d/c.jpg", 3), ("/s/e", "/d/e", 4), ("/s/f", "/d/f", 5)]
    planned = spark.createDataFrame([(p, d, n, True) for p, d, n in rows], "path string, dest string, size long, actionable boolean")
    source = spark.createDataFrame([("/s/a.jpg", "x"), ("/s/b/a.jpg", "y"), ("/s/c.jpg", "z"), ("/s/e", "e")], "path string, digest string")
    there = spark.createDataFrame([("/d/a.jpg", "o"), ("/d/A (2).jpg", "o"), ("/d/c.jpg", "z")], "path string, digest string")
    got = layout.reconcile(planned, source, there)
    assert {r.path: (r.outcome, r.final) for r in got.collect()} == {"/s/a.jpg": ("renamed", "/d/a (1).jpg"), "/s/b/a.jpg": ("renamed", "/d/a (3).jpg"), "/s/c.jpg": ("skipped", None), "/s/e": ("transferred", "/d/e"), "/s/f": ("failed", None)}
    events = layout.ledger_events(got).orderBy("seq").collect()
    assert [(e.seq, e.src, e.dst) for e in events] == [(2, "/s/a.jpg", "/d/a (1).jpg"), (3, "/s/b/a.jpg", "/d/a (3).jpg"), (4, "/s/e", "/d/e")]


def test_settled_rows_are_neither_skipped_nor_unticked(spark):
    o = layout.Options("/in", "/in")
    files = listing(spark, ["Photos/2021/2021-01/a.jpg", "b.jpg"])
    planned = layout.plan(files, dest(spark), o, files.select("path"))
    shown = {r.path: r.t for r in planned.select("path", layout.status_text(F.col("included"), F.col("status")).alias("t")).collect()}
    assert shown == {"/in/Photos/2021/2021-01/a.jpg": "Already sorted", "/in/b.jpg": "Skipped"}
    assert layout.plan_summary(planned).first().unticked == 1


def test_many_equal_names_take_linear_time():
    root = layout._Root()
    root.there["a (5).jpg"] = (9, 0)
    names = [root.settle("a.jpg" if k % 2 else "A.jpg", 1, 0)[0] for k in range(20_000)]
    assert names[0] == "A.jpg" and names[4] == "A (4).jpg" and names[5] == "a (6).jpg" and len({n.lower() for n in names}) == 20_000


def test_paths(spark):
    rows = [("a.b.JPG", ".jpg"), (".bashrc", ""), ("a.", ""), ("x", ""), ("..x", ".x")]
    for name, ext in rows:
        assert one(spark, "string", name).select(paths.suffix(F.col("x"))).first()[0] == ext
    for name in ("a.jpg", "..x", ".a", "a.", "x.tar.gz", "x", "...", "é.ö"):
        stem, ext = os.path.splitext(name)
        assert one(spark, "string", name).select(paths.numbered(F.col("x"), F.lit(2))).first()[0] == f"{stem} (2){ext}"
    for size in (0, 1, 999, 1000, 50_150, 50_250, 99_949, 99_950, 100_500, 340_500, 999_999, 10**9 + 5, 5 * 10**15):
        want = "1 byte" if size == 1 else f"{size} bytes" if size < 1000 else next(f"{size / 1000**p:.1f} {u}" if size / 1000**p < 100 else f"{size / 1000**p:.0f} {u}" for p, u in ((1, "KB"), (2, "MB"), (3, "GB"), (4, "TB")) if size < 1000 ** (p + 1) or p == 4)
        assert one(spark, "long", size).select(paths.human_size(F.col("x"))).first()[0] == want
    assert one(spark, "string", "/h/me/x").select(paths.short_path(F.col("x"), "/h/me")).first()[0] == "~/x"
    assert one(spark, "double", 0.125).select(paths.percent(F.col("x"))).first()[0] == "12%"


def test_dates(spark):
    seconds = int((dt.datetime(2019, 7, 4, 18, 30) - dt.datetime(1904, 1, 1)).total_seconds())
    for s, want in ((seconds, dt.datetime(2019, 7, 4, 18, 30)), (0, None), (None, None)):
        assert one(spark, "long", s).select(dates.header_date(F.col("x"), 2024)).first()[0] == want
    for text, want in (("2018:12:25 08:15:00", dt.datetime(2018, 12, 25, 8, 15)), ("  2018:12:25 08:15:00+02", dt.datetime(2018, 12, 25, 8, 15)), ("0000:00:00 00:00:00", None), ("", None), (None, None), ("1960:01:01 00:00:00", None)):
        assert one(spark, "string", text).select(dates.tag_date(F.col("x"), 2024)).first()[0] == want


def test_journals_and_undo(spark, tmp_path):
    lines = [{"type": "run", "operation": "copy", "started": "2024-01-01T00:00:00"}, {"type": "file", "src": "/s/a", "dst": "/d/a", "size": 4}, {"type": "file", "src": "/s/b", "dst": "/d/b", "size": 4}, {"type": "file", "src": "/s/c", "dst": "/d/c", "size": 4}]
    (tmp_path / "1.jsonl").write_text("\n".join(map(json.dumps, lines)) + '\n\n{"type": "end", "skip\n{"type": "end", "skipped": 1}')
    (tmp_path / "2.jsonl").write_text('{"type": "file", "size": 3}\n')
    j = ledger.read_journals(spark, str(tmp_path))
    (run,) = ledger.run_summaries(j).collect()
    assert (run.transferred, run.bytes, run.interrupted, run.undone_at) == (3, 12, True, None)
    now = spark.createDataFrame([("/d/a", 4), ("/d/b", 5), ("/s/a", 4)], "path string, size long")
    got = {r.src: r.outcome for r in ledger.undo_outcomes(j, now).collect()}
    assert got == {"/s/a": "restored", "/s/b": "problem_changed", "/s/c": "already_gone"}


def test_components_against_union_find(spark):
    rng = random.Random(3)
    for n, m in ((1, 0), (30, 20), (60, 90), (200, 150)):
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] + [(i, i + 1) for i in range(1000, 1000 + n)]
        root = {}

        def find(x, root=root):
            root.setdefault(x, x)
            while root[x] != x:
                x = root[x]
            return x

        for a, b in edges:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
        df = spark.createDataFrame([*edges, (None, 1)], "a long, b long")
        assert {(r.node, r.component) for r in components.connected_components(df).collect()} == {(x, find(x)) for x in root}


def test_hamming_is_lossless(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(-(2**63), 2**63, 12)
    rows = []
    for i, b in enumerate(base.tolist()):
        for k in range(8):
            bits = rng.choice(64, rng.integers(0, 11), replace=False)
            flipped = b & (2**64 - 1)
            for x in bits.tolist():
                flipped ^= 1 << x
            rows.append((i * 10 + k, flipped - 2**64 if flipped >> 63 else flipped, 0, 400, 300, False))
    df = spark.createDataFrame(rows, "item_id long, phash long, dhash long, width long, height long, flat boolean")
    classes = {}
    for r in rows:
        classes.setdefault(r[1], r[0])
    reps = [(i, p) for p, i in classes.items()]
    for level, limit in (("close", 8), ("loose", 14)):
        want = {(min(a, b), max(a, b)) for a, p in reps for b, q in reps if a != b and bin((p ^ q) & (2**64 - 1)).count("1") <= limit}
        assert {(r.a, r.b) for r in hamming.hamming_pairs(df, level).collect()} == want


def test_blocks_of_signatures_meet_once_and_no_side_is_broadcast(spark, monkeypatch):
    """Many blocks of several aspects, some within the ratio of another, one of height 0: all pairs as by brute force, and no side goes through the driver."""
    monkeypatch.setattr(hamming, "BLOCK", 16)
    rng, rows = np.random.default_rng(5), []
    base = [int(x) for x in rng.integers(-(2**62), 2**62, 10)]
    for i in range(400):
        p, d = base[i % 10], base[(i + 1) % 10]
        for x in rng.choice(62, rng.integers(0, 9), replace=False).tolist():
            p, d = p ^ (1 << x), d ^ (1 << (61 - x))
        rows.append((i, p, d, int(rng.choice([400, 425, 440, 460, 800, 0])), 0 if i % 50 == 0 else 300, i % 31 == 0))
    rows += [(400 + k, *rows[k][1:]) for k in range(20)]
    df = spark.createDataFrame(rows, "item_id long, phash long, dhash long, width long, height long, flat boolean")
    reps = {}
    for r in rows:
        if not r[5]:
            reps.setdefault(r[1:5], r[0])
    far = lambda x, y: bin((x ^ y) & (2**64 - 1)).count("1")
    aspect = lambda r: r[2] / r[3] if r[3] else 0.0
    alike = lambda r, s: max(aspect(r), aspect(s)) / max(min(aspect(r), aspect(s)), 1e-6) < 1.08
    want = {(min(a, b), max(a, b)) for r, a in reps.items() for s, b in reps.items() if a != b and far(r[0], s[0]) <= 14 and far(r[1], s[1]) <= 20 and alike(r, s)}
    found = hamming.hamming_pairs(df, "loose")
    got = [(r.a, r.b) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 100
    assert set(re.findall(r"BroadcastHashJoin \[(\w+)#", found._jdf.queryExecution().executedPlan().toString())) <= {"shape"}  # a row an aspect


def test_relations(spark):
    rows = [(1, "/a", 100, JAN, 400, 300, "x"), (2, "/b", 90, JAN, 400, 300, "x"), (3, "/c", 50, JAN, 200, 150, "y"), (4, "/d", 60, JAN, 390, 300, "z"), (5, "/e", 60, JAN, 390, 300, "w")]
    items = spark.createDataFrame(rows, "item_id long, path string, size long, mtime timestamp, width long, height long, digest string")
    links = spark.createDataFrame([(1, 2), (1, 3), (3, 4), (5, 4)], "a long, b long")
    crops = spark.createDataFrame([(4, 1, 0.95, 0.5)], "a long, b long, coverage_of_a double, coverage_of_b double")
    found = groups.members(items, links, crops)
    assert {r.item_id: r.relation for r in found.collect()} == {1: "keeper", 2: "exact", 3: "smaller", 4: "cropped", 5: "similar"}
    (g,) = groups.summaries(found).collect()
    assert (g.title, g.members, g.reclaimable, g.keeper) == ("Includes cropped versions", 5, 260, "/a")


def test_sides_that_grow_are_counted_before_they_are_broadcast(spark, monkeypatch):
    """Beyond ``SENT_BYTES`` neither links, classes, keepers, crops nor items go through the driver, though each is under Spark's threshold; the rows are the same."""
    rows = [(i, f"/{i}", i % 9, JAN, 400 + i % 2, 300, str(i % 40), i % 30, i % 20, False) for i in range(300)]
    items = spark.createDataFrame(rows, "item_id long, path string, size long, mtime timestamp, width long, height long, digest string, phash long, dhash long, flat boolean")
    links = session.materialize(spark.createDataFrame([(i % 10, i + 10) for i in range(290)], "a long, b long"), "links")
    crops = links.select("a", "b", (F.col("a") % 7 / F.lit(8.0)).alias("coverage_of_a"), (F.col("b") % 8 / F.lit(8.0) + 0.125).alias("coverage_of_b"))
    made = {
        "members": lambda: groups.members(items, links, crops), "classes": lambda: hamming.signature_classes(items), "digests": lambda: report.exact_links(items),
        "large": lambda: components._large_star(links.toDF("v", "u"), 290), "small": lambda: components._small_star(links.toDF("v", "u"), 290), "nodes": lambda: components.connected_components(links),
    }
    before = {k: sorted(map(str, f().collect())) for k, f in made.items()}
    monkeypatch.setattr(session, "SENT_BYTES", 256)
    for k, f in made.items():
        assert sorted(map(str, (df := f()).collect())) == before[k] and before[k]
        # the sums before a range are as many as ranges
        assert set(re.findall(r"BroadcastHashJoin \[(\w+)#", df._jdf.queryExecution().executedPlan().toString())) <= {"_part"}, k


def test_review(spark):
    members = spark.createDataFrame([("g", "/1", 1, 5), ("g", "/2", 2, 6), ("h", "/3", 1, 7), ("h", "/4", 2, 8), ("h", "/5", 3, 9)], "group_id string, path string, rank int, size long")
    paths_of = lambda df: sorted(r.path for r in df.collect())
    marks = review.suggested(members)
    assert paths_of(marks) == ["/2", "/4", "/5"]
    assert paths_of(review.keep_only(members, marks, "/4")) == ["/2", "/3", "/5"]
    assert paths_of(review.keep_group(members, marks, "/4")) == ["/2"]
    assert paths_of(review.after_removal(members, marks.where("path <> '/5'"))) == ["/3", "/5"]
    old, shown = (spark.createDataFrame([(p,) for p in x], "path string") for x in (["/1", "/9"], ["/1", "/2"]))
    assert paths_of(review.exclusions(old, shown, spark.createDataFrame([("/2",)], "path string"))) == ["/2", "/9"]


def test_wildcards_are_anchored():
    assert re.fullmatch(layout._glob("a?[!b]*").replace(r"\z", r"\Z"), "axc.txt") and not re.fullmatch(layout._glob("a?[!b]*").replace(r"\z", r"\Z"), "axb")


def test_names_are_folded_as_python_does(spark):
    texts = [chr(c) for c in (*range(1, 0xD800), *range(0xE000, 0x1F000)) if chr(c) != "İ" and unicodedata.category(chr(c)) != "Cn"] + ["Straße.JPG", "ΣΑΣ ΟΔΥΣΣΕΥΣ", "ﬁle ŉ", "plain ASCII.txt", "", None]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", paths.folded(F.col("t")).alias("f")).collect()
    assert not [(r.t, r.f) for r in got if r.f != (r.t.casefold() if r.t is not None else None)]
    names = spark.createDataFrame([("STRASSE.jpg",), ("straße.JPG",), ("strase.jpg",)], "name string")
    assert names.where(layout.name_predicate(F.col("name"), "straße", "contains")).count() == 2
    assert names.where(layout.name_predicate(F.col("name"), "STRASSE", "exact")).count() == 2


def test_a_plan_reads_its_files_twice_at_most(spark):
    """Once for their names, once for what the plan's rows have besides; not again for each of its steps."""
    n, read = 40, spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(len(b))
            yield b

    names = [f"/s/{k}/{'ab'[k % 2]}{' (1)' * (k % 5 == 0)}.txt" for k in range(n)]
    rows = [(p, p.rpartition("/")[2], "documents", k, JAN) for k, p in enumerate(names)]
    files = spark.createDataFrame(rows, "path string, name string, category string, size long, mtime timestamp")
    files = files.mapInPandas(counted, files.schema).withColumn("birthtime", F.lit(None).cast("timestamp"))
    there = spark.createDataFrame([("/d", "a.txt", 1, JAN)], "folder string, name string, size long, mtime timestamp")
    planned = layout.plan(files, there, layout.Options(source="/s", dest="/d", categories=("documents",), by_type=False, by_date=False)).collect()
    assert len({r.dest.lower() for r in planned}) == n
    assert read.value <= 2 * n
