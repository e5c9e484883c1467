"""An interpolated modified Kneser-Ney bigram model.

Counted in Spark: a task counts its texts' words and word pairs, chunk by chunk, and ships each
chunk's distinct ones, packed by bucket; a bucket's task adds up what all chunks sent. A pair's
bucket comes from its first word, except that the pairs of words that make up over a thousandth of
all tokens (so at most a thousand words) are dealt by both words: no bucket holds a hot word's pairs.

Stored as sorted arrays below the shared folder, a file per bucket and kind; scoring tasks map
these into memory and look up a portion of text at a time. Words are 48-bit hashes, a pair's key is
another 48 bits within its bucket of some two million pairs.

P(w | h) = max(c(h, w) - D(c), 0) / C(h) + g(h) * P(w), with three discounts D(1), D(2), D(3+) from
counts of counts; P(w) is the same over how many words w follows, interpolated with one in V + 1.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.bpe_codec import pack_numbers, unpack_numbers
from cairn.llm.words import Words, mix, portions
from cairn.session import materialize, scratch_path

CHUNK_TOKENS, PAIRS_PER_BUCKET, HOT_SHARE, HOT_WAYS = 4_000_000, 2_000_000, 1000, 256
_U = np.uint64
END, START = _U(1), _U(2)


def _ids(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """All texts' tokens, each text's words and then END; and where each text's begin."""
    n = len(words.bounds) - 1
    first = words.bounds + np.arange(n + 1)
    out = np.full(len(words.hashes) + n, END, _U)
    out[np.arange(len(words.hashes)) + np.repeat(np.arange(n), words.counts())] = np.maximum(words.hashes >> _U(16), _U(3))
    return out, first


def _before(tokens: np.ndarray, first: np.ndarray) -> np.ndarray:
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[first[:-1]] = START
    return before


def _six(ids: np.ndarray) -> bytes:
    return np.ascontiguousarray(ids.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _unsix(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def _sums(keys: list[np.ndarray], counts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct tuples in order, first key foremost, and the sums of their counts."""
    order = np.lexsort(keys[::-1])
    keys = [k[order] for k in keys]
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    at = np.flatnonzero(new)
    return [k[at] for k in keys], np.add.reduceat(counts[order], at) if len(at) else counts


def _pair_bucket(h: np.ndarray, w: np.ndarray, hot: np.ndarray, n: int) -> np.ndarray:
    dealt = np.where(np.isin(h, hot), mix(h * _U(HOT_WAYS) + w % _U(HOT_WAYS)), h)
    return (dealt % _U(n)).astype(np.int64)


def _pair_key(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mix(mix(h) + w) >> _U(16)


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 7 == 2


class _Store:
    """Arrays by name in the shared folder: a file is whole, or has another name."""

    def __init__(self, folder: str):
        self.fs, self.root = pyarrow.fs.FileSystem.from_uri(folder)

    def save(self, name: str, arrays: list[np.ndarray], attempt: int) -> None:
        own = f"{self.root}/.{name}.{attempt}"
        with self.fs.open_output_stream(own, compression=None) as out:
            for a in arrays:
                held = io.BytesIO()
                np.save(held, a)
                out.write(held.getvalue())
        self.fs.move(own, f"{self.root}/{name}")

    def load(self, name: str, n: int) -> list[np.ndarray]:
        """Mapped into memory where the folder is mounted; read otherwise."""
        path = f"{self.root}/{name}"
        source = pa.memory_map(path) if isinstance(self.fs, pyarrow.fs.LocalFileSystem) else self.fs.open_input_file(path)
        data = source.read_buffer(source.size())
        arrays, at = [], 0
        for _ in range(n):
            head = io.BytesIO(data.slice(at, min(256, data.size - at)).to_pybytes())
            np.lib.format.read_magic(head)
            shape, _, kind = np.lib.format.read_array_header_1_0(head)
            at += head.tell()
            arrays.append(np.frombuffer(data, kind, shape[0], at))
            at += shape[0] * kind.itemsize
        return arrays


@dataclass
class Model:
    """Where the arrays are, and the totals."""

    folder: str
    word_buckets: int
    pair_buckets: int
    hot: np.ndarray
    tokens: int
    types: int
    #: Discounts for 1, 2 and 3 or more: of pair counts and of continuation counts.
    discounts: np.ndarray
    below: np.ndarray
    follows: int = 0
    below_mass: float = 1.0
    _open: dict = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return self.__dict__ | {"_open": {}}

    def _arrays(self, name: str, n: int) -> list[np.ndarray]:
        if name not in self._open:
            self._open[name] = _Store(self.folder).load(name, n)
        return self._open[name]

    def words(self, ids: np.ndarray) -> np.ndarray:
        """Rows (count, continuations, C, N1, N2, N3+) of distinct, sorted ``ids``; zeros for unseen ones."""
        out = np.zeros((6, len(ids)), np.int64)
        bucket = (ids % _U(self.word_buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[order], np.arange(self.word_buckets + 1))
        for b in np.flatnonzero(np.diff(cuts)).tolist():
            mine = order[cuts[b] : cuts[b + 1]]
            known, *columns = self._arrays(f"words-{b:05d}", 7)
            if len(known):
                at = np.minimum(np.searchsorted(known, ids[mine]), len(known) - 1)
                hit = known[at] == ids[mine]
                for row, column in zip(out, columns, strict=True):
                    row[mine[hit]] = column[at[hit]]
        return out

    def pairs(self, h: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Counts of the pairs."""
        out = np.zeros(len(h), np.int64)
        bucket, key = _pair_bucket(h, w, self.hot, self.pair_buckets), _pair_key(h, w)
        order = np.lexsort((key, bucket))
        cuts = np.searchsorted(bucket[order], np.arange(self.pair_buckets + 1))
        for b in np.flatnonzero(np.diff(cuts)).tolist():
            mine = order[cuts[b] : cuts[b + 1]]
            high, low, counts, large_at, large = self._arrays(f"pairs-{b:05d}", 5)
            if not len(high):
                continue
            k = key[mine]
            top, rest = (k >> _U(16)).astype(np.uint32), (k & _U(0xFFFF)).astype(np.uint16)
            at = np.searchsorted(high, top)
            open_ = np.arange(len(k))
            while len(open_):  # equal upper halves are few and stand together
                open_ = open_[at[open_] < len(high)]
                open_ = open_[high[at[open_]] == top[open_]]
                hit = low[at[open_]] == rest[open_]
                found = open_[hit]
                c = counts[at[found]].astype(np.int64)
                if len(large_at):
                    much = np.flatnonzero(c == 0)
                    c[much] = large[np.searchsorted(large_at, at[found[much]])]
                out[mine[found]] = c
                open_ = open_[~hit]
                at[open_] += 1
        return out

    def log10(self, h: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 P(w | h) of each pair, and each w's count."""
        ids, back = np.unique(np.concatenate([h, w]), return_inverse=True)
        count, follows, total, n1, n2, n3 = self.words(ids)[:, back]
        of_h, of_w = slice(0, len(h)), slice(len(h), None)
        kept = np.maximum(follows[of_w] - self.below[np.minimum(follows[of_w], 3)], 0)
        p = (kept / self.follows if self.follows else 0.0) + self.below_mass / (self.types + 1)
        c = self.pairs(h, w)
        seen = total[of_h] > 0
        d = self.discounts
        left = d[1] * n1[of_h] + d[2] * n2[of_h] + d[3] * n3[of_h]
        total_h = np.maximum(total[of_h], 1)
        p = np.where(seen, np.maximum(c - d[np.minimum(c, 3)], 0) / total_h + left / total_h * p, p)
        return np.log10(p), count[of_w]


def _discounts(n: list[int]) -> np.ndarray:
    """D(0..3+) from how many things were seen 1, 2, 3 and 4 times; a half off where these tell nothing."""
    if not all(n[:3]):
        return np.array([0.0, 0.5, 0.5, 0.5]) if n[0] or n[1] else np.zeros(4)
    y = n[0] / (n[0] + 2 * n[1])
    raw = [1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2]]
    return np.array([0.0, *(min(max(d, 0.05), k - 0.05) for k, d in enumerate(raw, 1))])


def _chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(tokens, tokens before them) of some four million tokens at a time."""
    held, size = [], 0
    for batch in batches:
        for _, _, words in portions(batch.column(0)):
            tokens, first = _ids(words)
            held.append((tokens, _before(tokens, first)))
            size += len(tokens)
            if size >= CHUNK_TOKENS:
                yield tuple(map(np.concatenate, zip(*held, strict=True)))
                held, size = [], 0
    if held:
        yield tuple(map(np.concatenate, zip(*held, strict=True)))


def _frame(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


COUNTED = pa.schema([("bucket", pa.int32()), ("ids", pa.binary()), ("n", pa.binary())])
PAIRED = pa.schema([("bucket", pa.int32()), ("h", pa.binary()), ("runs", pa.binary()), ("w", pa.binary()), ("n", pa.binary())])
PARTS = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("ids", pa.binary()), *((f"v{k}", pa.binary()) for k in range(4))])
STATS = pa.schema([("kind", pa.int32()), *((f"n{k}", pa.int64()) for k in range(1, 5)), ("total", pa.int64())])


def _sql(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {dict(int32='int', int64='long', binary='binary')[str(f.type)]}" for f in schema)


def train(texts: DataFrame, folder: str | None = None) -> Model:
    """Counts the column ``text`` of ``texts`` and stores the model below ``folder``, which all executors share."""
    spark = texts.sparkSession
    folder = folder or scratch_path(spark, "ngrams")
    fs, root = pyarrow.fs.FileSystem.from_uri(folder)
    fs.create_dir(root, recursive=True)
    n_words = max(64, int(spark.conf.get("spark.sql.shuffle.partitions")))
    texts = texts.select("text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tokens, _ in _chunked(batches):
            ids, n = np.unique(tokens, return_counts=True)
            bucket = (ids % _U(n_words)).astype(np.int64)
            for b in range(n_words):
                mine = bucket == b
                if mine.any():
                    yield _frame([(b, _six(ids[mine]), pack_numbers(n[mine]))], COUNTED)

    def add_counts(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, n = [], []
        for batch in batches:
            ids += [_unsix(x.as_py()) for x in batch.column(1)]
            n += [unpack_numbers(x.as_py()) for x in batch.column(2)]
        (words,), counts = _sums([np.concatenate(ids)], np.concatenate(n))
        out = {"bucket": [key[0].as_py()], "types": [len(words)], "tokens": [int(counts.sum())], "ids": [_six(words)], "n": [counts.astype("<i8").tobytes()]}
        yield pa.RecordBatch.from_pydict(out, pa.schema([("bucket", pa.int32()), ("types", pa.int64()), ("tokens", pa.int64()), ("ids", pa.binary()), ("n", pa.binary())]))

    counted = texts.mapInArrow(count, _sql(COUNTED)).groupBy("bucket").applyInArrow(add_counts, "bucket int, types long, tokens long, ids binary, n binary")
    counted = materialize(counted, "ngram-words")
    types, tokens = (int(v or 0) for v in counted.agg(F.sum("types"), F.sum("tokens")).first())

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, n in zip(batch.column(0), batch.column(1), strict=True):
                words, counts = _unsix(ids.as_py()), np.frombuffer(n.as_py(), "<i8")
                yield pa.RecordBatch.from_pydict({"id": pa.array(words[counts * HOT_SHARE > tokens].astype(np.int64))})

    hot = np.array(sorted(r[0] for r in counted.select("ids", "n").mapInArrow(frequent, "id long").collect()), _U)  # under HOT_SHARE words
    hot = np.unique(np.append(hot, START))
    n_pairs = max(64, -(-tokens // PAIRS_PER_BUCKET))

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for w, h in _chunked(batches):
            (h, w), n = _sums([h, w], np.ones(len(w), np.int64))
            bucket = _pair_bucket(h, w, hot, n_pairs)
            order = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[order], np.arange(n_pairs + 1))
            for b in np.flatnonzero(np.diff(cuts)).tolist():
                mine = order[cuts[b] : cuts[b + 1]]
                own = h[mine]
                at = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
                yield _frame([(b, _six(own[at]), pack_numbers(np.diff(np.append(at, len(own)))), _six(w[mine]), pack_numbers(n[mine]))], PAIRED)

    def add_pairs(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        h, w, n = [], [], []
        for batch in batches:
            for row in zip(*batch.columns[1:], strict=True):
                a, runs, b, c = (x.as_py() for x in row)
                h.append(np.repeat(_unsix(a), unpack_numbers(runs)))
                w.append(_unsix(b))
                n.append(unpack_numbers(c))
        (h, w), n = _sums([np.concatenate(h), np.concatenate(w)], np.concatenate(n))
        k = _pair_key(h, w)
        order = np.argsort(k)
        large = n[order] > 0xFFFF
        arrays = [(k[order] >> _U(16)).astype(np.uint32), (k[order] & _U(0xFFFF)).astype(np.uint16), np.where(large, 0, n[order]).astype(np.uint16), np.flatnonzero(large), n[order][large]]
        _Store(folder).save(f"pairs-{key[0].as_py():05d}", arrays, TaskContext.get().taskAttemptId())
        stats = [pack_numbers(np.array([(n == j).sum()])) for j in range(1, 5)]
        yield _frame([(-1, 9, pack_numbers(np.array([len(n)])), *stats)], PARTS)
        at = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        of_h = [np.add.reduceat(x, at) for x in (n, (n == 1).astype(np.int64), (n == 2).astype(np.int64), (n > 2).astype(np.int64))]
        words, follows = np.unique(w, return_counts=True)
        for kind, ids, values in ((1, h[at], of_h), (2, words, [follows])):
            bucket = (ids % _U(n_words)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[order], np.arange(n_words + 1))
            for b in np.flatnonzero(np.diff(cuts)).tolist():
                mine = order[cuts[b] : cuts[b + 1]]
                packed = [pack_numbers(v[mine]) for v in values]
                yield _frame([(b, kind, _six(ids[mine]), *packed, *[None] * (4 - len(packed)))], PARTS)

    def add_words(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        parts = [[x.as_py() for x in row] for batch in batches for row in zip(*batch.columns[1:], strict=True)]
        if key[0].as_py() < 0:
            n = [sum(int(unpack_numbers(p[2 + j])[0]) for p in parts) for j in range(4)]
            yield _frame([(0, *n, sum(int(unpack_numbers(p[1])[0]) for p in parts))], STATS)
            return
        own = [_unsix(p[1]) for p in parts]
        ids = np.unique(np.concatenate(own))
        table = np.zeros((6, len(ids)), np.int64)
        for (kind, _, *values), mine in zip(parts, own, strict=True):
            at = np.searchsorted(ids, mine)
            for row, v in zip({0: [0], 2: [1], 1: [2, 3, 4, 5]}[kind], values, strict=False):
                table[row, at] += np.frombuffer(v, "<i8") if kind == 0 else unpack_numbers(v)
        _Store(folder).save(f"words-{key[0].as_py():05d}", [ids, *(r.astype(np.uint32) if r.max(initial=0) < 1 << 32 else r for r in table)], TaskContext.get().taskAttemptId())
        yield _frame([(1, *[int((table[1] == j).sum()) for j in range(1, 5)], int(table[1].sum()))], STATS)

    paired = texts.mapInArrow(pair, _sql(PAIRED)).groupBy("bucket").applyInArrow(add_pairs, _sql(PARTS))
    singles = counted.select("bucket", F.lit(0).alias("kind"), "ids", F.col("n").alias("v0"), *[F.lit(None).cast("binary").alias(f"v{k}") for k in (1, 2, 3)])
    stats = paired.unionByName(singles).groupBy("bucket").applyInArrow(add_words, _sql(STATS))
    stats = materialize(stats, "ngram-stats").groupBy("kind").agg(*[F.sum(f"n{k}") for k in range(1, 5)], F.sum("total"))
    by_kind = {r[0]: [int(x) for x in r[1:]] for r in stats.collect()}
    *n, _ = by_kind.get(0, [0] * 5)
    *m, follows = by_kind.get(1, [0] * 5)
    below = _discounts(m)
    store = _Store(folder)
    for kind, count_, arrays in (("words", n_words, [np.empty(0, _U)] + [np.empty(0, np.uint32)] * 6), ("pairs", n_pairs, [np.empty(0, t) for t in (np.uint32, np.uint16, np.uint16, np.int64, np.int64)])):
        there = {f.base_name for f in fs.get_file_info(pyarrow.fs.FileSelector(root))}
        for b in range(count_):
            if f"{kind}-{b:05d}" not in there:
                store.save(f"{kind}-{b:05d}", arrays, 0)
    mass = (below[1] * m[0] + below[2] * m[1] + below[3] * (types - m[0] - m[1])) / follows if follows else 1.0
    return Model(folder, n_words, n_pairs, hot, tokens, types, _discounts(n), below, follows, float(mass))


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` per row of ``docs``.

    Scores are log10 probabilities of whole texts. Null, empty and blank texts are the end alone.
    held_out is null for a null doc_id; repeated rows score alike; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for i, j, words in portions(batch.column(1)):
                tokens, first = _ids(words)
                logs, counts = model.log10(_before(tokens, first), tokens)
                base = np.log10((counts + 1) / (model.tokens + model.types + 1))
                add = lambda x: pa.array(np.add.reduceat(x, first[:-1]))  # noqa: B023, E731
                n = len(first) - 1
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, n), pa.array(np.diff(first)), add((counts > 0).astype(np.int64)), pa.array(np.full(n, model.tokens, np.int64)), add(base), add(logs)], ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    given = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    scored = given.mapInArrow(run, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def train_and_score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Learns from the rows that aren't held out (crc32 of doc_id modulo 7 is not 2) and scores all rows.

    A row with a null doc_id is scored, not learned from.
    """
    given = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return score(given, train(given.where(~held_out())))
