"""Near-duplicates, token counts and the codec against brute force, with odd rows."""

import base64
import hashlib
import itertools
import random
import re
import string

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from cairn.llm.bpe_codec import decode, encode, pack_numbers, round_trip_digests, unpack_numbers
from cairn.llm.near_dedup import drop_near_duplicates, near_duplicates
from cairn.llm.token_counts import chars_within, counter, prefix_tables, token_counts

JSON, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
DOCS = "doc_id long, text string, id string, n int"


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def components(rows):
    ids = {i for i, _ in rows if i is not None}
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    for (a, x), (b, y) in itertools.combinations(sets, 2):
        if x and y and 100 * len(x & y) >= 75 * len(x | y):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_near_duplicates_against_all_pairs(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(400)]
    rows, n = [], 0
    for _ in range(14):
        base = [rng.choice(words) for _ in range(rng.choice([3, 5, 6, 40, 150]))]
        for _ in range(rng.randint(1, 9)):
            own = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 5])):
                own[rng.randrange(len(own))] = rng.choice(words)
            rows.append((n, " ".join(own).upper() if rng.random() < 0.3 else "\n".join(own)))
            n += 1
    rng.shuffle(rows)
    rows += [(900, ""), (901, None), (902, " \n\t "), (903, "É a b c d e"), (904, "é a b c d e"), (None, rows[0][1]), rows[1], (5000, rows[2][1]), (5000, rows[9][1])]
    df = spark.createDataFrame([(i, t, "x", 0) for i, t in rows], DOCS)
    got = near_duplicates(df).collect()
    want = components(rows)
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.component_id, r.kept) == (want[r.doc_id], want[r.doc_id] == r.doc_id)
    sizes = sorted((r.doc_id, r.n_shingles) for r in got if r.doc_id is not None)
    assert sizes == sorted((i, len(shingles(t))) for i, t in rows if i is not None)
    kept = drop_near_duplicates(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {None} | {i for i, c in want.items() if i == c}
    assert near_duplicates(df.limit(0)).count() == 0


@pytest.fixture(scope="module")
def encoding():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


ODD = ["", None, " ", "\n\n  x", "a  b", "it's they'll  'sup", "<|endoftext|>x<|endoftext|>", "日本語 テスト　です", "é́ ñ", "x" * 3000, "a\tb \n c ", "1234567 !!! ...", "ab cd\xa0 e", "the cat sat. " * 50]


def random_texts(n):
    rng = random.Random(6)
    parts = ["a", "the", "'", "'s", "'re", " ", "  ", "\n", "\t", " \n", "é", "日本", "23", "!", "<|endoftext|>", "<|end", "ing", "x'r", " word", " tion"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(1, 16))) for _ in range(n)]


def test_every_prefix_has_its_count():
    library, own = Tokenizer.from_file(JSON), counter(JSON, public_tokenizers.PATTERN)
    for text in [t for t in ODD if t and len(t) < 700] + random_texts(150):
        assert own.prefixes(text).tolist() == [len(library.encode(text[: i + 1], add_special_tokens=False).ids) for i in range(len(text))]


def test_token_counts(spark):
    library = Tokenizer.from_file(JSON)
    texts = ODD + random_texts(40)
    df = spark.createDataFrame([*((i, t, "x", 0) for i, t in enumerate(texts)), (None, "a b", "y", 1), (0, "", "z", 2)], DOCS)
    got = token_counts(df, JSON, public_tokenizers.PATTERN, limit=20).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        text = (texts[r.doc_id] if r.doc_id is not None else "a b") or ""
        n = len(library.encode(text, add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), n, n > 20)
        assert len(library.encode(text[: r.chars_within_limit], add_special_tokens=False).ids) <= 20
    tables = prefix_tables(df, JSON, public_tokenizers.PATTERN).select("doc_id", chars_within("prefix_tokens", 20).alias("n"))
    assert sorted(map(tuple, tables.collect()), key=str) == sorted(((r.doc_id, r.chars_within_limit) for r in got), key=str)
    assert token_counts(df.limit(0), JSON, public_tokenizers.PATTERN).count() == 0


def test_codec_round_trip(spark, encoding):
    texts = ODD + random_texts(60)
    df = spark.createDataFrame([*((i, t, "x", 0) for i, t in enumerate(texts)), (None, "a b", "y", 1), (0, "", "z", 2)], DOCS)
    got = round_trip_digests(df, RANKS, public_tokenizers.PATTERN).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        text = (texts[r.doc_id] if r.doc_id is not None else "a b") or ""
        ids = encoding.encode_ordinary(text)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert encode(df.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0
    nulls = spark.createDataFrame([(1, None), (2, [])], "k int, ids array<int>")
    assert [bytes(r.decoded) for r in decode(nulls, RANKS, public_tokenizers.PATTERN).collect()] == [b"", b""]


def test_numbers_pack():
    import numpy as np

    for values in ([], [0], [127, 128, 16383, 16384, 2**28, 2**34], list(range(300))):
        assert unpack_numbers(pack_numbers(np.array(values, np.int64))).tolist() == values


def test_chunks_end_by_size():
    import pyarrow as pa

    from cairn.llm import bpe, bpe_codec

    texts = [f"some words {i} and more" for i in range(9)] + [None, ""]
    batches = [pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64()), "text": pa.array([texts[i] for i in ids], pa.string())}) for ids in (range(4), range(4, 11))]
    parts = list(bpe.portions_of_text(iter(batches), 1, 40))
    assert len(parts) == 5 and [i for p in parts for i in p.column(0).to_pylist()] == list(range(11))
    chunks = [bpe_codec._Chunk(p, str.split) for p in parts]
    for part, chunk in zip(parts, chunks, strict=True):
        words = [w.decode() for w in chunk.words.to_pylist()]
        for i, packed in zip(part.column(0).to_pylist(), chunk.sequences().to_pylist(), strict=True):
            assert [words[n] for n in unpack_numbers(packed)] == (texts[i] or "").split()
    assert len({c.name(0, i) for i, c in enumerate(chunks)}) == len({chunks[0].name(p, n) for p in range(3) for n in range(2)}) - 1 == 5


def test_equal_texts_are_spread(spark, encoding):
    """A thousand equal texts are many chunks, whose rows lie in many tasks."""
    from cairn.llm import bpe_codec

    text = "the same words again, " * 50
    df = spark.range(1000).selectExpr("id as doc_id", f"'{text}' as text").repartition(4)
    parts = bpe_codec._parts(df, RANKS, public_tokenizers.PATTERN, "doc_id", "text", False, 20_000)
    by = parts.where("kind = 1").groupBy("chunk").count().collect()
    assert len(by) >= 40 and max(r["count"] for r in by) <= 30 and sum(r["count"] for r in by) == 1000
    got = encode(df, RANKS, public_tokenizers.PATTERN)
    ids = encoding.encode_ordinary(text)
    assert got.count() == 1000 and [list(r.ids) for r in got.select("ids").distinct().collect()] == [ids]


def test_pieces_encode_apart(encoding):
    """Whatever white space a text has, its pieces' ids make up the text's ids."""
    import pyarrow as pa

    from cairn.llm.bpe import Pieces

    rng = random.Random(11)
    signs = ["a", "b1", "é", "的", "'s", ".", " ", " ", "  ", "\n", "\n", "\n\n", "\r\n", "\t", "\u00a0", "\u2003", "\u3000", "\u0085", "\x1c", "\u1680", "\u205f", "à", "\u2028", "😀"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 25))) for _ in range(3000)] + [None]
    pieces = Pieces(pa.array(texts, pa.string()))
    for k, text in enumerate(texts):
        own = [pieces.distinct[i] for i in pieces.index[pieces.bounds[k] : pieces.bounds[k + 1]]]
        assert "".join(own) == (text or "")
        assert [i for p in own for i in encoding.encode_ordinary(p)] == encoding.encode_ordinary(text or "")


def test_decoding_in_blocks_and_unknown_ids(spark, encoding, monkeypatch):
    import pyarrow as pa
    import pytest

    from cairn.llm import bpe_codec

    monkeypatch.setattr(bpe_codec, "BLOCK_IDS", 3)
    monkeypatch.setattr(bpe_codec, "_texts", lambda batches: iter([(pa.array([7, None, 8], pa.int64()), np.arange(8, dtype=np.int32), np.array([0, 7, 7, 8]))]))
    (batch,) = bpe_codec._in_blocks(iter([]))
    assert batch.to_pydict() == {"doc_id": [7, 7, 7, None, 8], "ids": [[0, 1, 2], [3, 4, 5], [6], [], [7]], "head": [True, False, False, True, True]}
    rows = spark.createDataFrame([(1, [50256 + 9])], "k int, ids array<int>")
    with pytest.raises(Exception, match="outside the vocabulary"):
        decode(rows, RANKS, public_tokenizers.PATTERN).collect()
    texts = ["two words", "", None, "ab " * 70000]
    both = bpe_codec.encode_and_decode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), RANKS, public_tokenizers.PATTERN).collect()
    for r in both:
        text = texts[r.doc_id] or ""
        assert r.ids == encoding.encode_ordinary(text) and r.n_tokens == len(r.ids)
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    plain = decode(encode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), RANKS, public_tokenizers.PATTERN), RANKS, public_tokenizers.PATTERN)
    assert {r.doc_id: bytes(r.decoded).decode() for r in plain.collect()} == {i: t or "" for i, t in enumerate(texts)}


def test_encoded_portions_are_read_a_few_at_a_time(spark, encoding, monkeypatch):
    """A reader of columns holds a row group, so one of many portions is held whole by the JVM."""
    import pyarrow.parquet as pq

    from cairn.llm import bpe_codec

    monkeypatch.setattr(bpe_codec, "GROUP_PORTIONS", 1, raising=False)
    written, plain = [], bpe_codec.materialize
    monkeypatch.setattr(bpe_codec, "materialize", lambda *a: written.append(plain(*a)) or written[-1])
    rng = random.Random(3)
    texts = [" ".join("".join(rng.choice("abcdef") for _ in range(6)) for _ in range(100)) for _ in range(1500)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = bpe_codec.encode_and_decode(df, RANKS, public_tokenizers.PATTERN).collect()
    assert {r.doc_id: r.ids for r in got} == {i: encoding.encode_ordinary(t) for i, t in enumerate(texts)}
    groups = [f.metadata.row_group(k).num_rows for name in written[-1].inputFiles() for f in [pq.ParquetFile(name.removeprefix("file://"))] for k in range(f.num_row_groups)]
    assert sum(groups) >= 2 and max(groups) == 1


def test_recall_near_the_threshold(spark):
    """Pairs of texts at a similarity of just over 75 %, and of just under it: all of the first are linked, none of the second."""
    rng = random.Random(12)
    texts, linked = [], []
    for i in range(600):
        n = rng.randint(110, 140)
        words = [f"w{rng.randrange(10**6)}" for _ in range(n)]
        away = 3 if i % 2 else 4
        other = list(words)
        for k in range(away):
            other[6 + k * (n - 12) // away + rng.randrange(5)] = f"v{rng.randrange(10**6)}"
        a, b = ({tuple(t[j : j + 5]) for j in range(n - 4)} for t in (words, other))
        linked.append(100 * len(a & b) >= 75 * len(a | b))
        texts += [" ".join(words), " ".join(other)]
    found = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert sum(linked) >= 250 and [found[2 * i + 1] == 2 * i for i in range(600)] == linked
