"""Byte-level BPE over a corpus: each distinct word is encoded once.

1. A task cuts its texts into the pattern's matches and numbers the distinct ones, chunk by chunk
   (a chunk is some 6 MB of text): a text is then the sequence of its words' numbers by position.
2. Each chunk's distinct words are shuffled by word, packed by bucket, so all chunks' copies of a
   word meet; there a word is encoded once, and its ids go back to every chunk that asked.
3. Number sequences and answers meet by chunk, and each text's ids are put together by position.
4. Decoding does the same the other way: a portion's distinct ids become rows ahead of its texts and
   join the vocabulary's token-byte table, which is broadcast, as it has a row a token. The join keeps
   a task's order, so a portion's texts find their tokens' bytes before them and nothing is shuffled.

What is shuffled by word is each chunk's *distinct* words, so a word that makes up a twentieth of
all text costs a row's share per chunk. Texts themselves are never shuffled. Texts are cut twice, as
sequences would cost another shuffle of their size if they were kept: both times must see the rows
in the same order, which a stored table grants; other inputs are stored first (``stored``).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from hashlib import blake2b
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.bpe import Pieces, gather, matches, portions_of_text, vocabulary
from cairn.llm.words import mix, text_buffer, tidy
from cairn.session import bounded_batches, materialize

#: Bytes of text to a chunk; texts from which ids are put together at once; ids to a row, and to a portion, when they are decoded.
CHUNK_BYTES, SOME_TEXTS, BLOCK_IDS, PORTION_IDS = 6 << 20, 64, 1 << 16, 1 << 18
#: Words whose ids a worker keeps while it answers; beyond it the store starts anew.
KEPT_WORDS = 100_000
#: Encoded portions to a row group.
GROUP_PORTIONS = 8
#: A portion of encoded texts in one row.
PACKED = "doc_ids array<bigint>, sizes binary, ids binary"


def _packed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``values`` seven bits to a byte, low ones first; and where each one ends."""
    kind = np.uint32 if values.max(initial=0) < 1 << 32 else np.uint64
    values = values.astype(kind)
    size = np.ones(len(values), np.int64)
    for k in range(1, 5 if kind is np.uint32 else 9):
        size += values >= kind(1 << 7 * k)
    ends = np.cumsum(size)
    start = ends - size
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    for k in range(int(size.max(initial=0))):
        on = np.flatnonzero(size > k)
        out[start[on] + k] = ((values[on] >> kind(7 * k)) & kind(127)).astype(np.uint8) | ((size[on] > k + 1).astype(np.uint8) << np.uint8(7))
    return out, ends


def pack_numbers(values: np.ndarray) -> bytes:
    """Numbers below 2**63 in as few bytes as each needs."""
    return _packed(values)[0].tobytes()


def _unpacked(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers, and where each one's last byte stands."""
    ends = np.flatnonzero(b < 128)
    starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
    out = (b[starts] & 127).astype(np.int64)
    size = ends - starts
    for k in range(1, int(size.max(initial=0)) + 1):
        on = np.flatnonzero(size >= k)
        out[on] |= (b[starts[on] + k] & 127).astype(np.int64) << (7 * k)
    return out, ends


def unpack_numbers(data: bytes) -> np.ndarray:
    return _unpacked(np.frombuffer(data, np.uint8))[0]


class _Chunk:
    """A portion's distinct words by first sight, and each text as their numbers."""

    def __init__(self, part: pa.RecordBatch, find):
        pieces = Pieces(part.column(1))
        numbers: dict[str, int] = {}
        flat: list[int] = []
        lengths = np.empty(len(pieces.distinct), np.int64)
        for i, piece in enumerate(pieces.distinct):
            found = find(piece)
            lengths[i] = len(found)
            for word in found:
                flat.append(numbers.setdefault(word, len(numbers)))
        self.words = pa.array(list(numbers), pa.large_string()).view(pa.large_binary())
        self.doc_id = part.column(0)
        self._pieces, self._flat, self._lengths = pieces, np.array(flat, np.uint32), lengths

    def name(self, part: int, nth: int) -> int:
        """By the place, the ``nth`` chunk of a partition, so equal texts in many chunks stay apart; and by the words, so that another order of rows could never pass unseen."""
        data, offsets = text_buffer(self.words)
        h = blake2b(digest_size=8, salt=part.to_bytes(8, "little") + nth.to_bytes(8, "little"))
        h.update(np.ascontiguousarray(offsets))
        h.update(data)
        return int.from_bytes(h.digest(), "little", signed=True)

    def sequences(self) -> pa.Array:
        """Each text's word numbers, packed."""
        lengths = self._lengths[self._pieces.index]
        numbers = gather(self._flat, (np.cumsum(self._lengths) - self._lengths)[self._pieces.index], lengths)
        data, ends = _packed(numbers)
        at = np.concatenate([[0], np.cumsum(lengths)])[self._pieces.bounds]
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(np.concatenate([[0], ends])[at]), pa.py_buffer(data)])


def _buckets(words: pa.Array, n: int) -> np.ndarray:
    """A word's bucket by its bytes, the same in every task."""
    data, offsets = text_buffer(words)
    position = np.arange(len(data), dtype=np.uint64) - np.repeat(offsets[:-1], np.diff(offsets)).astype(np.uint64)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(data.astype(np.uint64) * np.uint64(1 << 32) + position), dtype=np.uint64)])
    return (mix(sums[offsets[1:]] - sums[offsets[:-1]]) % np.uint64(n)).astype(np.int64)


def _parts(docs: DataFrame, path: str, pattern: str, doc_id: str, text: str, stored: bool, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Answers (kind 0) and texts (kind 1), chunk by chunk and answers first."""
    spark = docs.sparkSession
    bounded_batches(spark)
    n_buckets = max(64, int(spark.conf.get("spark.sql.shuffle.partitions")))
    given = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    given = given if stored else materialize(given, "texts")
    given = given.withColumn("part", F.spark_partition_id())  # the same in both passes, which read the same files

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[_Chunk, int]]:
        for nth, part in enumerate(portions_of_text(batches, 1, chunk_bytes)):
            chunk = _Chunk(part, matches(pattern))
            yield chunk, chunk.name(part.column(2)[0].as_py(), nth)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, name in chunks(batches):
            bucket = _buckets(chunk.words, n_buckets)
            order = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
            data, offsets = text_buffer(chunk.words.take(pa.array(order)))
            for k in np.flatnonzero(np.diff(cuts)).tolist():
                a, b = cuts[k], cuts[k + 1]
                row = {"bucket": [k], "chunk": [name], "numbers": [pack_numbers(np.diff(order[a:b], prepend=0))], "sizes": [pack_numbers(np.diff(offsets[a : b + 1]))], "words": [data[offsets[a] : offsets[b]].tobytes()]}
                yield pa.RecordBatch.from_pydict(row, schema=ASKED)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, known, bucket = vocabulary(path, pattern), {}, None
        for batch in batches:
            for row in batch.to_pylist():
                if row["bucket"] != bucket:
                    known, bucket = {}, row["bucket"]
                ends, data, found = np.cumsum(unpack_numbers(row["sizes"])).tolist(), row["words"], []
                start = 0
                for end in ends:
                    word = data[start:end]
                    start = end
                    ids = known.get(word)
                    if ids is None:
                        if len(known) >= KEPT_WORDS:
                            known = {}
                        ids = known[word] = np.array(vocab.encode_word(word), np.uint32).tobytes()
                    found.append(ids)
                sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
                ids = np.frombuffer(b"".join(found), np.uint32)
                yield pa.RecordBatch.from_pydict({"chunk": [row["chunk"]], "kind": [0], "doc_id": [None], "a": [row["numbers"]], "b": [pack_numbers(sizes)], "c": [pack_numbers(ids)]}, schema=PARTS)

    def sequence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, name in chunks(batches):
            rows, n = chunk.sequences(), len(chunk.doc_id)
            for i in range(0, n, SOME_TEXTS):
                m = min(SOME_TEXTS, n - i)
                empty = pa.nulls(m, pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([name] * m, pa.int64()), pa.array([1] * m, pa.int32()), chunk.doc_id.slice(i, m), rows.slice(i, m).cast(pa.binary()), empty, empty], schema=PARTS)

    asked = given.mapInArrow(tidy(ask), "bucket int, chunk long, numbers binary, sizes binary, words binary")
    answers = asked.repartition(n_buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(tidy(answer), PARTS_SQL)
    parts = answers.unionByName(given.mapInArrow(tidy(sequence), PARTS_SQL))
    return parts.repartition("chunk").sortWithinPartitions("chunk", "kind")


ASKED = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("numbers", pa.binary()), ("sizes", pa.binary()), ("words", pa.binary())])
PARTS = pa.schema([("chunk", pa.int64()), ("kind", pa.int32()), ("doc_id", pa.int64()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary())])
PARTS_SQL = "chunk long, kind int, doc_id long, a binary, b binary, c binary"


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """``(doc_ids, ids, ends)`` of some texts at a time, from rows that come by chunk, its answers before its texts."""
    chunk, answers, table = None, [], None
    for batch in batches:
        names, kinds = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        i = 0
        while i < batch.num_rows:
            if names[i] != chunk:
                chunk, answers, table = names[i], [], None
            if kinds[i] == 0:
                answers.append([unpack_numbers(batch.column(k)[i].as_py()) for k in (3, 4, 5)])
                i += 1
                continue
            if table is None:
                numbers = [np.cumsum(n) for n, _, _ in answers]
                size = max((int(n[-1]) + 1 for n in numbers), default=0)
                lengths, starts = np.zeros(size, np.int64), np.zeros(size, np.int64)
                flat = np.concatenate([c.astype(np.int32) for _, _, c in answers] or [np.empty(0, np.int32)])
                done = 0
                for n, (_, sizes, ids) in zip(numbers, answers, strict=True):
                    lengths[n] = sizes
                    starts[n] = done + np.cumsum(sizes) - sizes
                    done += len(ids)
                table, answers = (flat, starts, lengths), []
            j = i
            while j < batch.num_rows and j < i + SOME_TEXTS and names[j] == chunk and kinds[j] == 1:
                j += 1
            flat, starts, lengths = table
            packed = batch.column(3).slice(i, j - i)
            offsets = np.concatenate([[0], np.cumsum([len(p.as_buffer()) for p in packed])])
            numbers, last = _unpacked(np.frombuffer(b"".join(p.as_buffer() for p in packed), np.uint8))
            if len(numbers) and (numbers.max() >= len(lengths) or not lengths[numbers].all()):
                raise RuntimeError("a chunk's words came in another order when read again: leave `stored` out")
            words = np.searchsorted(last, offsets)  # numbers before each text's end
            ends = np.concatenate([[0], np.cumsum(lengths[numbers])])[words]
            yield batch.column(2).slice(i, j - i), gather(flat, starts[numbers], lengths[numbers]), ends
            i = j


def _put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for doc_id, ids, ends in _texts(batches):
        yield pa.RecordBatch.from_arrays([doc_id, pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))], ["doc_id", "ids"])


def _in_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """As ``_put_together``, a long text's ids in several rows, ``head`` marking the first."""
    for doc_id, ids, ends in _texts(batches):
        n = np.maximum(1, -(-np.diff(ends) // BLOCK_IDS))
        of = np.repeat(np.arange(len(n)), n)
        nth = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
        bounds = np.append(ends[of] + nth * BLOCK_IDS, ends[-1])
        yield pa.RecordBatch.from_arrays([doc_id.take(pa.array(of)), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids)), pa.array(nth == 0)], ["doc_id", "ids", "head"])


def encode(docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text", stored: bool = False) -> DataFrame:
    """``(doc_id, ids array<int>)`` per row of ``docs``, ids as the tiktoken library gives them.

    Null and empty texts have no ids; a null doc_id is kept, repeated rows come out repeated, an empty
    table gives no rows, other columns are ignored. Special tokens don't exist: their strings are
    ordinary text. With ``stored``, ``docs`` reads rows of a stored table, without a shuffle
    between, so that reading twice gives the same order; else its texts are written first.
    """
    return _parts(docs, path, pattern, doc_id, text, stored).mapInArrow(tidy(_put_together), "doc_id long, ids array<int>")


def token_bytes(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """``(id, bytes)``: the token-byte table, a row a token. Ranks are read by Spark, from where the workers have them too."""
    if not path.endswith(".json"):
        line = F.split("value", " ")
        return spark.read.text(path if "://" in path else f"file://{path}").select(line[1].cast("int").alias("id"), F.unbase64(line[0]).alias("bytes"))
    tokens = vocabulary(path, pattern).token_bytes
    return spark.createDataFrame(pa.table({"id": pa.array(list(tokens), pa.int32()), "bytes": pa.array(list(tokens.values()), pa.binary())}))


def _ids_of(rows: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A list column's values end to end, and where each row's end; null is empty."""
    lengths = pc.fill_null(pc.list_value_length(rows), 0).to_numpy(zero_copy_only=False)
    return rows.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(lengths)])


def _portions(batches: Iterator[pa.RecordBatch], ids: str) -> Iterator[tuple[pa.StructArray, np.ndarray]]:
    """Rows as structs, some ``PORTION_IDS`` ids at a time, and their distinct ids."""

    def one(held: list[pa.RecordBatch]) -> tuple[pa.StructArray, np.ndarray]:
        rows = pa.concat_arrays([pa.StructArray.from_arrays(h.columns, h.schema.names) for h in held])
        return rows, np.unique(_ids_of(pa.Table.from_batches(held).column(ids).combine_chunks())[0]).astype(np.int32)

    held, n = [], 0
    for batch in batches:
        for i in range(0, batch.num_rows, SOME_TEXTS):
            part = batch.slice(i, SOME_TEXTS)
            held.append(part)
            n += pc.sum(pc.list_value_length(part.column(ids))).as_py() or 0
            if n >= PORTION_IDS:
                yield one(held)
                held, n = [], 0
    if held:
        yield one(held)


def _ask_tokens(batches: Iterator[pa.RecordBatch], ids: str) -> Iterator[pa.RecordBatch]:
    """``(row, asked)``: the rows as structs, and before each portion of them a row that asks for its distinct ids."""
    for rows, distinct in _portions(batches, ids):
        asked = pa.ListArray.from_arrays(pa.array([0, *[len(distinct)] * (len(rows) + 1)], pa.int32()), pa.array(distinct), mask=pa.array([False] + [True] * len(rows)))
        yield pa.RecordBatch.from_arrays([pa.concat_arrays([pa.nulls(1, rows.type), rows]), asked], ["row", "asked"])


def _packed_portions(batches: Iterator[pa.RecordBatch], ids: str) -> Iterator[pa.RecordBatch]:
    """``(doc_ids, sizes, ids, asked)``: a portion and its distinct ids in one row, which no reader of a table can part; ids as two or four bytes each."""
    for rows, distinct in _portions(batches, ids):
        own, ends = _ids_of(rows.field(rows.type.get_field_index(ids)))
        kind = np.uint16 if distinct.max(initial=0) < 1 << 16 else np.uint32
        columns = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (rows.field(0).cast(pa.int64()), pa.array(distinct))]
        yield pa.RecordBatch.from_arrays([columns[0], pa.array([pack_numbers(np.diff(ends))]), pa.array([own.astype(kind).tobytes()]), columns[1]], ["doc_ids", "sizes", "ids", "asked"])


def _unpacked_portions(rows: pa.StructArray) -> Iterator[pa.StructArray]:
    """The texts (doc_id, ids, head) of each of some rows of ``_packed_portions``."""
    for row in rows:
        sizes, data = unpack_numbers(row["sizes"].as_py()), row["ids"].as_buffer()
        n = int(sizes.sum())
        own = np.frombuffer(data, np.uint16 if data.size == 2 * n else np.uint32).astype(np.int32)
        ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        yield pa.StructArray.from_arrays([row["doc_ids"].values, pa.ListArray.from_arrays(pa.array(ends), pa.array(own)), pa.array([True] * len(sizes))], ["doc_id", "ids", "head"])


def _joined(each: DataFrame, tokens: DataFrame) -> DataFrame:
    """``(row, id, bytes)``: each portion's tokens as rows, then its texts, for which id is null."""
    met = each.join(F.broadcast(tokens), "id", "left")  # the vocabulary bounds its size
    known = F.coalesce("bytes", F.when(F.col("id").isNotNull(), F.raise_error(F.lit("an id outside the vocabulary")).cast("binary")))
    return met.select("row", "id", known.alias("bytes"))


class _Tokens:
    """The bytes of a portion's tokens, by id."""

    def __init__(self):
        self.ids, self.bytes, self.table = [], [], None

    def add(self, ids: np.ndarray, column: pa.Array) -> None:
        self.ids.append(ids)
        self.bytes += column.to_pylist()

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The tokens' bytes end to end, and each one's length."""
        if self.table is None:
            known = np.concatenate(self.ids or [np.empty(0, np.int64)]).astype(np.int64)
            starts, lengths = np.zeros((2, int(known.max(initial=-1)) + 1), np.int64)
            own = np.fromiter(map(len, self.bytes), np.int64, len(self.bytes))
            starts[known], lengths[known] = np.cumsum(own) - own, own
            self.table = np.frombuffer(b"".join(self.bytes), np.uint8), starts, lengths
        flat, starts, lengths = self.table
        return gather(flat, starts[ids], lengths[ids]), lengths[ids]


def _decoded(batches: Iterator[pa.RecordBatch], ids: str, packed: bool = False) -> Iterator[tuple[pa.StructArray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """``(rows, ids, ends, bytes, byte ends)`` of some rows of ``_joined`` at a time; its rows are texts, or ``packed`` portions of them."""
    tokens, served = _Tokens(), False
    for batch in batches:
        asked = batch.column(1).is_valid().to_numpy(zero_copy_only=False)
        bare = ~asked & batch.column(0).is_null().to_numpy(zero_copy_only=False)  # a portion without any id asks for none
        turns = [0, *(np.flatnonzero(np.diff(asked)) + 1).tolist(), batch.num_rows]
        for a, b in pairwise(turns):
            if a == b:
                continue
            if asked[a]:
                if served:
                    tokens, served = _Tokens(), False
                tokens.add(batch.column(1).slice(a, b - a).to_numpy(), batch.column(2).slice(a, b - a))
                continue
            served = True
            found = batch.column(0).slice(a, b - a).filter(pa.array(~bare[a:b]))
            for texts in _unpacked_portions(found) if packed else [found]:
                for i in range(0, len(texts), SOME_TEXTS):
                    rows = texts.slice(i, SOME_TEXTS)
                    own, ends = _ids_of(rows.flatten()[[f.name for f in rows.type].index(ids)])
                    data, lengths = tokens.decode(own)
                    yield rows, own, ends, data, np.concatenate([[0], np.cumsum(lengths)])[ends]


def _sql_of(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def decode(encoded: DataFrame, path: str, pattern: str, ids: str = "ids") -> DataFrame:
    """``encoded`` with the column ``decoded``: the bytes of its ids, joined from the token-byte table.

    Null and empty id lists decode to empty bytes; an id that the vocabulary lacks fails. Repeated
    rows come out repeated; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, _, _, data, ends in _decoded(batches, ids):
            column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(rows), [None, pa.py_buffer(ends), pa.py_buffer(data)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([*rows.flatten(), column], [*[f.name for f in rows.type], "decoded"])

    asked = encoded.mapInArrow(tidy(lambda batches: _ask_tokens(batches, ids)), f"row struct<{_sql_of(encoded).replace('` ', '`: ')}>, asked array<int>")
    each = asked.select("row", F.explode_outer("asked").alias("id"))
    return _joined(each, token_bytes(encoded.sparkSession, path, pattern)).mapInArrow(tidy(run), f"{_sql_of(encoded)}, decoded binary")


class _Digests:
    """Digests of a text's ids, as decimals with a space between, and of its bytes."""

    _flat = _starts = _lengths = None

    def __init__(self):
        self.n, self.ids, self.bytes = 0, hashlib.sha256(), hashlib.sha256()

    @classmethod
    def _decimals(cls, size: int) -> None:
        texts = [b" %d" % i for i in range(size)]
        cls._lengths = np.fromiter(map(len, texts), np.int64, size)
        cls._starts, cls._flat = np.cumsum(cls._lengths) - cls._lengths, np.frombuffer(b"".join(texts), np.uint8)

    def more(self, ids: np.ndarray, data: np.ndarray) -> None:
        if len(ids):
            if self._lengths is None or ids.max() >= len(self._lengths):
                self._decimals(max(1 << 16, int(ids.max()) + 1))
            spaced = gather(self._flat, self._starts[ids], self._lengths[ids])
            self.ids.update(spaced if self.n else spaced[1:])
            self.n += len(ids)
            self.bytes.update(np.ascontiguousarray(data))

    def end(self) -> tuple[int, str, str]:
        return self.n, self.ids.hexdigest(), self.bytes.hexdigest()


DIGESTS = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def _digested(batches: Iterator[pa.RecordBatch], keep: tuple[str, ...], packed: bool = False) -> Iterator[pa.RecordBatch]:
    """Each text's columns ``keep`` and digests; its rows follow each other, the first one has ``head``."""
    state, mine, out = None, [], []

    def ready() -> pa.RecordBatch:
        rows = pa.concat_arrays(mine[: len(out)])
        kept = [rows.field(rows.type.get_field_index(k)) for k in keep]
        return pa.RecordBatch.from_arrays([*kept, *map(pa.array, zip(*out, strict=True))], [*keep, "n_tokens", "ids_sha256", "decoded_sha256"])

    for rows, ids, ends, data, byte_ends in _decoded(batches, "ids", packed):
        heads = rows.field(rows.type.get_field_index("head")).to_pylist()
        for k, head in enumerate(heads):
            if head:
                if state is not None:
                    out.append(state.end())
                mine.append(rows.slice(k, 1))
                state = _Digests()
            state.more(ids[ends[k] : ends[k + 1]], data[byte_ends[k] : byte_ends[k + 1]])
        if out:
            yield ready()
            mine, out = mine[len(out) :], []
    if state is not None:
        out.append(state.end())
        yield ready()


def round_trip_digests(docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text", stored: bool = False) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)`` per row: the ids' and the decoded bytes' digests.

    Rows as for ``encode``. Long texts are decoded in blocks of ids: none is held whole after encoding.
    """
    blocks = _parts(docs, path, pattern, doc_id, text, stored).mapInArrow(tidy(lambda batches: _ask_tokens(_in_blocks(batches), "ids")), "row struct<doc_id: long, ids: array<int>, head: boolean>, asked array<int>")
    each = blocks.select("row", F.explode_outer("asked").alias("id"))
    return _joined(each, token_bytes(docs.sparkSession, path, pattern)).mapInArrow(tidy(lambda batches: _digested(batches, ("doc_id",))), f"doc_id long, {DIGESTS}")


def encode_and_decode(docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text", stored: bool = False, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``(doc_id, ids, n_tokens, ids_sha256, decoded_sha256)`` per row: token ids, and the digests of ids and of what they decode to.

    Smaller chunks take less of a worker's memory and ship more copies of words. What is encoded is
    stored before it is decoded, so a task never has workers for both. Rows as for ``encode``.
    """

    parts = _parts(docs, path, pattern, doc_id, text, stored, chunk_bytes)
    packed = parts.mapInArrow(tidy(lambda batches: _packed_portions(_put_together(batches), "ids")), f"{PACKED}, asked array<int>")
    # a reader of columns holds a row group, and a portion is a large row
    portions = materialize(packed, "encoded", {"parquet.block.row.count.limit": GROUP_PORTIONS})
    row = F.struct("doc_ids", "sizes", "ids")
    each = portions.select(F.explode(F.concat(F.transform("asked", lambda i: F.struct(F.lit(None).cast(f"struct<{PACKED}>").alias("row"), i.alias("id"))), F.array(F.struct(row.alias("row"), F.lit(None).cast("int").alias("id"))))).alias("at"))
    joined = _joined(each.select("at.row", "at.id"), token_bytes(docs.sparkSession, path, pattern))
    return joined.mapInArrow(tidy(lambda batches: _digested(batches, ("doc_id", "ids"), True)), f"doc_id long, ids array<int>, {DIGESTS}")
