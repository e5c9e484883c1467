"""Product codes, hard negatives and URL filters, against brute force and with odd rows."""

import itertools
import math
import random
import re
import time

import numpy as np
import pytest

from cairn.llm import hard_negatives as hn
from cairn.llm import url_filter as uf
from cairn.llm import vector_codes as vc
from cairn.llm.vectors import packed

VECTORS = "vec_id long, embedding array<float>, label int, q string"


def odd_vectors(n=300, dim=16, labels=3, seed=5):
    """Random rows, a third of them one and the same vector, with nulls, infinities, repeats and columns that clash."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim)).astype(np.float32)
    x[::3] = x[0]
    rows = [(i, x[i].tolist(), int(rng.integers(labels)), "q") for i in range(n)]
    rows += [(n, None, 1, None), (n + 1, [None] + [0.5] * (dim - 1), 1, "x"), (n + 2, [math.nan] * dim, 0, ""), (n + 3, [-math.inf] * dim, 0, ""), (n + 4, x[1].tolist(), None, None), rows[7], rows[7]]
    return rows


def usable(rows, scale):
    return [(i, [math.floor(scale * v) for v in e], label) for i, e, label, _ in rows if e is not None and all(v is not None and math.isfinite(v) for v in e)]


# Codes


def test_nearest_is_brute_force_with_ties():
    rng = np.random.default_rng(1)
    for n, k, m, span in itertools.product((1, 500), (1, 4, 9), (1, 2, 16), (2, 100, 10**6)):
        parts, entries = rng.integers(-span, span, (n, k)), rng.integers(-span, span, (m, k))
        far = ((parts[:, None] - entries) ** 2).sum(2)
        codes, errors = vc.nearest(parts, entries)
        assert (codes == far.argmin(1)).all() and (errors == far.min(1)).all()


def brute_codes(rows, parts=8, size=16, rounds=6):
    dim = len(rows[0][1]) // parts
    cut = lambda v, p: v[p * dim : (p + 1) * dim]
    gap = lambda a, b: sum((s - t) ** 2 for s, t in zip(a, b, strict=True))
    books = [[cut(v, p) for _, v, _ in sorted(rows, key=lambda r: r[0])[:size]] for p in range(parts)]
    assign = lambda v, p: min((gap(cut(v, p), e), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        for p in range(parts):
            by = {}
            for _, v, _ in rows:
                by.setdefault(assign(v, p)[1], []).append(cut(v, p))
            books[p] = [[sum(c) // len(by[k]) for c in zip(*by[k], strict=True)] if k in by else e for k, e in enumerate(books[p])]
    return sorted((i, "".join(f"{assign(v, p)[1]:02x}" for p in range(parts)), sum(assign(v, p)[0] for p in range(parts))) for i, v, _ in rows), books


def test_codes_of_odd_rows(spark):
    rows = odd_vectors()
    want, books = brute_codes(usable(rows, 4096))
    coded, found = vc.compress(spark.createDataFrame(rows, VECTORS).repartition(5))
    assert sorted((r.vec_id, r.code, r.error) for r in coded.collect()) == want
    assert found.entries.tolist() == books
    codes = np.array([[int(r[1][2 * p : 2 * p + 2], 16) for p in range(8)] for r in want])
    back = found.decode(codes)
    assert [int(((np.array(v) - b) ** 2).sum()) for (_, v, _), b in zip(sorted(usable(rows, 4096)), back, strict=True)] == [e for _, _, e in want]
    report = vc.code_report(spark.createDataFrame(rows, VECTORS)).collect()
    labels = {i: label for i, _, label, _ in rows}
    for r in report:
        assert r.label_error == sum(e for i, _, e in want if labels[i] == labels[r.vec_id])
    assert len({r.codebooks_sha256 for r in report}) == 1


def test_codes_of_few_and_no_rows(spark):
    none = spark.createDataFrame([], VECTORS)
    assert vc.code_report(none).count() == 0
    one = spark.createDataFrame([(None, [0.5, -0.25, 1.0], 1, ""), (3, [0.5], None, "")], VECTORS)  # ends in zeros, up to eight
    assert sorted(r.error for r in vc.code_report(one).collect()) == [0, 0]
    with pytest.raises(Exception, match="32 bits"):
        packed(spark.createDataFrame([(1, [1e30], 1, "")], VECTORS), "embedding", 4096).collect()


# Hard negatives


def test_hilbert_curve_goes_from_neighbour_to_neighbour():
    for dim, bits in ((2, 4), (3, 2), (4, 2), (5, 1)):
        cells = np.array(list(itertools.product(range(1 << bits), repeat=dim)), np.uint8)
        keys = hn.hilbert_keys(cells, bits)
        assert len(set(keys)) == len(cells)
        path = cells[sorted(range(len(cells)), key=keys.__getitem__)].astype(int)
        assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_bounds_hold_every_score():
    rng = np.random.default_rng(3)
    anchors, block = rng.integers(-9, 9, (20, 7)), rng.integers(-9, 9, (50, 7))
    least, greatest = hn.reach(anchors.astype(float), block.min(0, keepdims=True).astype(float), block.max(0, keepdims=True).astype(float))
    scores = anchors @ block.T
    assert (least <= scores).all() and (scores <= greatest).all()


def brute_negatives(rows, every, rules=hn.Windows()):
    first = {}
    for i, v, label in sorted(rows, key=lambda r: (r[0], [x & 0xFFFFFFFF for x in r[1]])):
        if label is not None:
            first.setdefault(i, (np.array(v), label))
    out = []
    for a, (v, label) in first.items():
        if a % every:
            continue
        near = lambda same: sorted(((-int(v @ w), i) for i, (w, own) in first.items() if i != a and (own == label) == same))  # noqa: B023, E731
        others = near(False)
        for s, p in near(True)[: rules.positives]:
            inside = [(-t, i) for t, i in others if rules.low * -s <= 100 * -t <= rules.high * -s][: rules.negatives]
            out += [(a, p, k + 1, i, -s, t) for k, (t, i) in enumerate(inside)]
    return sorted(out)


@pytest.mark.parametrize(("block", "chunk", "page"), [(2048, 512, 512), (16, 3, 2)])
def test_negatives_of_odd_rows(spark, monkeypatch, block, chunk, page):
    monkeypatch.setattr(hn, "BLOCK", block)
    monkeypatch.setattr(hn, "CHUNK", chunk)
    monkeypatch.setattr(hn, "PAGE", page)
    rows = odd_vectors(dim=4)
    got = hn.hard_negatives(spark.createDataFrame(rows, VECTORS).repartition(3), every=10)
    want = brute_negatives(usable(rows, 256), 10)
    assert sorted(map(tuple, got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())) == want
    assert len(want) > 100


def test_negatives_of_few_and_no_rows(spark):
    columns = 6
    assert len(hn.hard_negatives(spark.createDataFrame([], VECTORS)).columns) == columns
    assert hn.hard_negatives(spark.createDataFrame([], VECTORS)).count() == 0
    alone = spark.createDataFrame([(0, [1.0], 1, ""), (1, [0.5], 2, ""), (None, [1.0], 1, ""), (3, [1.0], None, "")], VECTORS)
    assert hn.hard_negatives(alone).count() == 0


def test_blocks_beyond_the_bounds_are_not_read(spark, monkeypatch):
    """Vectors in clusters: an anchor reads few blocks, and the result is still brute force's."""
    monkeypatch.setattr(hn, "BLOCK", 32)
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(12, 6)) * 4
    rows = [(i, (centres[i % 12] + 0.1 * rng.normal(size=6)).tolist(), i // 12 % 2, "") for i in range(1200)]
    given, read = spark.createDataFrame(rows, VECTORS), []
    keep = hn.to_read
    monkeypatch.setattr(hn, "to_read", lambda *a: read.append(keep(*a)) or read[-1])
    got = hn.hard_negatives(given, every=10)
    assert sorted(map(tuple, got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())) == brute_negatives(usable([(i, np.float32(e).tolist(), label, q) for i, e, label, q in rows], 256), 10)
    for pairs in read:
        assert sum(len(r["at"]) for r in pairs.collect()) < 0.35 * 120 * (1200 / 32)


# URL filters


def as_regex(glob):
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if glob[i : i + 2] == "**":
            n = len(glob[i:]) - len(glob[i:].lstrip("*"))
            out, i = out + ".*", i + n
            continue
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[" and glob.find("]", i + 2) > 0:
            end = glob.find("]", i + 2)
            out, i = out + "[" + re.escape(glob[i + 1 : end]) + "]", end
        elif c == "\\" and i + 1 < len(glob):
            i += 1
            out += re.escape(glob[i])
        else:
            out += re.escape(c)
        i += 1
    return re.compile(f"(?s){out}\\Z")


def test_automaton_is_regular_expressions():
    rng = random.Random(6)
    globs = ["".join(rng.choice(["a", "b", "/", ".", "é", "*", "**", "?", "[ab.]", "\\*"]) for _ in range(rng.randint(0, 9))) for _ in range(150)]
    texts = ["".join(rng.choice("aab/.é*") for _ in range(rng.randint(0, 9))) for _ in range(400)] + ["", "é" * 70, "ab" * 90]
    data = "".join(texts).encode()
    offsets = np.cumsum([0, *(len(t.encode()) for t in texts)])
    for some in (globs, globs[:1], globs[:12]):
        met = uf.Automaton(some).matches(np.frombuffer(data, np.uint8), offsets[:-1], offsets[1:])
        for j, glob in enumerate(some):
            rx = as_regex(glob)
            assert [bool(rx.match(t)) for t in texts] == met[:, j].tolist(), glob
    assert uf.Automaton(globs).words > 10


def test_urls_of_all_kinds(spark, monkeypatch):
    urls = [
        (1, "http://A.Example.NET/en/x?y=/de/"), (2, "https://net/"), (3, "https://net"), (4, "ftp://xnet/en/"), (5, None), (6, "no scheme"), (7, ""), (8, "x://b.example.com/de/#f"),
        (9, "http://example.org/fr/é"), (10, "http://spam.org/fr/"), (11, "http://spam.org/en/"), (12, "http://a.org/b.net/"), (13, "http://ÄX.net/p"), (14, "a://b://c.net/"), (15, "http://q.com/" + "z/" * 400_000 + ".exe"), (1, "https://net/"),
        (16, "http://x.example.com?a=http://net/"), (17, "://net/\nq"),
    ]
    df = spark.createDataFrame([(i, u, "h", i) for i, u in urls], "page_id long, url string, host string, rule int")
    began = time.time()
    got = {(r.page_id, r.host, r.path[:9], r.rule, r.verdict) for r in uf.verdicts(df).collect()}
    assert time.time() - began < 60
    assert got == {
        (1, "a.example.net", "/en/x", "example.net/en/", "allow"), (2, "net", "/", "net/", "block"), (3, "net", "", None, "allow"), (4, "xnet", "/en/", None, "allow"), (5, "", "", None, "allow"), (6, "", "", None, "allow"), (7, "", "", None, "allow"),
        (8, "b.example.com", "/de/", "example.com/de/", "block"), (9, "example.org", "/fr/é", "org/fr/", "allow"), (10, "spam.org", "/fr/", "org/fr/", "allow"), (11, "spam.org", "/en/", None, "block"), (12, "a.org", "/b.net/", None, "allow"),
        (13, "Äx.net", "/p", "net/", "block"), (14, "b:", "//c.net/", None, "allow"), (15, "q.com", "/z/z/z/z/", None, "block"), (1, "net", "/", "net/", "block"), (16, "x.example.com", "", None, "allow"), (17, "net", "/\nq", "net/", "block"),
    }
    assert uf.verdicts(df.limit(0)).count() == 0
    assert {r.verdict for r in uf.filter_urls(df, [], default="block").collect()} == {"block"}
    # many rules, in several portions: the longest wins, then the first
    monkeypatch.setattr(uf, "WORDS", 2)
    rules = [uf.site_rule("block" if i % 2 else "allow", "net", f"/{'p' * i}") for i in range(60)] + [uf.site_rule("never", "net", "/")]
    sites = spark.createDataFrame([(i, f"http://x{i}.net/" + "p" * i) for i in range(80)], "page_id long, url string")
    for r in uf.filter_urls(sites, rules).collect():
        n = min(r.page_id, 59)
        assert (r.rule, r.verdict) == (f"net/{'p' * n}", "block" if n % 2 else "allow")
