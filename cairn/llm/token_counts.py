"""Exact token counts of every prefix of a text, by dynamic programming.

BPE has a prefix property: the encoding of ``w[:i]`` ends in the one token t such that the pair of
t and the last token of ``w[:i - len(t)]`` is itself left apart by the merges. So one pass over a
word gives the count and the last token of every prefix from those of shorter ones, whatever the
word's length; no word is encoded, only pairs of tokens are tested, and remembered.

Texts are cut into pieces whose encoding doesn't depend on their neighbours (see
``bpe.piece_starts``). A portion's distinct pieces are counted once, and sums along a text give
every prefix: how many tokens it has and where a budget ends needs no further encoding.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.bpe import Pieces, Vocabulary, gather, portions_of_text, vocabulary
from cairn.llm.words import tidy
from cairn.session import bounded_batches

#: Pieces whose counts, and pairs of tokens whose test, a worker keeps; beyond it the store starts anew.
KEPT_PIECES, KEPT_PAIRS = 600_000, 400_000
#: Bytes of text whose pieces are made distinct at once; and of texts whose prefixes are laid out at once.
PORTION_BYTES, TABLE_BYTES = 8 << 20, 1 << 20

_SPACE = regex.compile(r"\s")


class PrefixCounter(dict):
    """Piece -> its prefix counts at each code point, as bytes; as an int32 array beyond 255 tokens."""

    def __init__(self, vocab: Vocabulary):
        super().__init__()
        self.vocab = vocab
        self._apart: dict[int, bool] = {}
        self._before: tuple[bytes, list[int], list[int]] = b"", [0], [0]

    def _pair_stays(self, left: int, right: int) -> bool:
        both = self.vocab.token_bytes[left] + self.vocab.token_bytes[right]
        if len(self._apart) >= KEPT_PAIRS:
            self._apart.clear()
        stays = self._apart[left << 32 | right] = self.vocab.encode_word(both) == [left, right]
        return stays

    def word(self, word: str) -> list[int]:
        """Token counts of ``word``'s prefixes by code point, ``word`` being one match of the pattern.

        What it shares with the word before it isn't gone over again: words are best asked for in order.
        """
        data, rank, apart, longest = word.encode(), self.vocab.ranks.get, self._apart.get, self.vocab.longest
        n, (before, counts, lasts), same = len(data), self._before, 0
        for a, b in zip(data, before, strict=False):
            if a != b:
                break
            same += 1
        counts, lasts = counts[: same + 1] + [0] * (n - same), lasts[: same + 1] + [0] * (n - same)
        at = same - len(self.vocab.token_bytes[lasts[same]]) if same else 0
        for i in range(same + 1, n + 1):
            # one token alone can end a prefix, so the order of trying is free: most often the last one grew, or a byte joins
            least = i - longest if i > longest else 0
            for k in (at, i - 1, *range(least, i - 1)) if at >= least else range(least, i):
                t = rank(data[k:i])
                if t is not None and (not k or (stays if (stays := apart(lasts[k] << 32 | t)) is not None else self._pair_stays(lasts[k], t))):
                    counts[i], lasts[i], at = counts[k] + 1, t, k
                    break
        self._before = data, counts, lasts
        return counts[1:] if n == len(word) else [c for i, c in enumerate(counts) if i and (i == n or data[i] & 0xC0 != 0x80)]

    def _count(self, piece: str) -> list[int]:
        if "'" not in piece and not _SPACE.search(piece, 1) and piece != " ":
            first, *rest = self.vocab.words.findall(piece)
            out = self.word(first)
            for word in rest:
                base = out[-1]
                out += [base + c for c in self[word]]
            return out
        out, base, run_base, run = [], 0, 0, ""
        for match in self.vocab.words.finditer(piece):
            word = match.group()
            own = self.word(word)
            lead = len(word) - len(word.lstrip()) if word[0].isspace() else 0
            if lead:  # a prefix that ends in white space has all of it in one match
                run_base, run = (run_base, run) if run else (base, "")
                run += word[:lead]
                out += [run_base + c for c in self.word(run)[-lead:]]
            if lead < len(word):
                run = ""
            if word[0] == "'" and len(word) > 2:  # a contraction cut short is other matches
                out += [base + sum(self.word(w)[-1] for w in self.vocab.words.findall(word[:i])) for i in range(1, len(word))] + [base + own[-1]]
            else:
                out += [base + c for c in own[lead:]]
            base += own[-1]
        return out

    def __missing__(self, piece: str) -> bytes | np.ndarray:
        counts = self._count(piece)
        found = bytes(counts) if max(counts) < 256 else np.array(counts, np.int32)
        if len(piece) < 256:
            if len(self) >= KEPT_PIECES:
                self.clear()
            self[piece] = found
        return found

    def prefixes(self, text: str) -> np.ndarray:
        """Token counts of ``text[:1]``, ``text[:2]``, ... as the library encodes each of them."""
        plain = lambda t: _Counted(self, pa.array([t], pa.large_string())).prefixes(0, 1)[0]
        special = self.vocab.special
        if not special or special not in text:
            return plain(text)
        out, base = [], 0
        *parts, tail = text.split(special)
        for part in parts:
            own = plain(part + special[:-1])  # the special string cut short is ordinary text
            whole = int(own[len(part) - 1]) if part else 0
            out += [own + base, np.array([base + whole + 1], np.int32)]
            base += whole + 1
        return np.concatenate([*out, plain(tail) + base]).astype(np.int32)


class _Counted:
    """A portion's texts: counts of its distinct pieces laid end to end, and the pieces by text."""

    def __init__(self, counter: PrefixCounter, column: pa.Array):
        self.pieces = Pieces(column)
        distinct = self.pieces.distinct
        found = [counter.get(p) for p in distinct]
        for k in sorted((k for k, f in enumerate(found) if f is None), key=distinct.__getitem__):
            found[k] = counter[distinct[k]]
        self.lengths = np.fromiter(map(len, found), np.int64, len(found))
        self.starts = np.cumsum(self.lengths) - self.lengths
        if all(type(f) is bytes for f in found):
            self.flat = np.frombuffer(b"".join(found), np.uint8)
        else:
            self.flat = np.concatenate([np.frombuffer(f, np.uint8) if type(f) is bytes else f for f in found])
        last = self.flat[self.starts + self.lengths - 1].astype(np.int64) if found else np.empty(0, np.int64)
        #: Tokens up to the end of each piece, all texts in a row.
        self.done = np.concatenate([[0], np.cumsum(last[self.pieces.index])])

    def totals(self) -> np.ndarray:
        return self.done[self.pieces.bounds[1:]] - self.done[self.pieces.bounds[:-1]]

    def prefixes(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """The prefix counts of texts ``a`` to ``b``, end to end, and where each text's end."""
        p, q = self.pieces.bounds[a], self.pieces.bounds[b]
        own = self.pieces.index[p:q]
        lengths = self.lengths[own]
        of_text = np.repeat(self.done[self.pieces.bounds[a:b]], np.diff(self.pieces.bounds[a : b + 1]))
        counts = gather(self.flat, self.starts[own], lengths) + np.repeat(self.done[p:q] - of_text, lengths)
        ends = np.concatenate([[0], np.cumsum(lengths)])[self.pieces.bounds[a : b + 1] - p]
        return counts.astype(np.int32), ends

    def within(self, k: int, limit: int) -> int:
        """The most code points of text ``k`` whose prefix has at most ``limit`` tokens.

        A prefix ends in the last piece that begins below the limit, or with the one before it:
        every piece has a token at least.
        """
        p, q = self.pieces.bounds[k], self.pieces.bounds[k + 1]
        base = self.done[p:q] - self.done[p]
        at = int(np.searchsorted(base, limit)) - 1  # the last piece whose base is under the limit
        if at < 0:
            return 0
        own = self.pieces.index[p : p + at + 1]
        start, length = self.starts[own[-1]], self.lengths[own[-1]]
        inside = np.flatnonzero(self.flat[start : start + length] <= limit - base[at]).max(initial=-1) + 1
        return int(self.lengths[own[:-1]].sum() + inside)


_counters: dict[tuple[str, str], PrefixCounter] = {}


def counter(path: str, pattern: str) -> PrefixCounter:
    """One per worker, so that later tasks find what earlier ones counted."""
    return _counters.setdefault((path, pattern), PrefixCounter(vocabulary(path, pattern)))


def _specials(count: PrefixCounter, column: pa.Array) -> dict[int, str]:
    """Rows whose text holds the special string."""
    if not count.vocab.special:
        return {}
    rows = np.flatnonzero(pc.fill_null(pc.match_substring(column, count.vocab.special), False).to_numpy(zero_copy_only=False))
    return {int(k): column[int(k)].as_py() for k in rows}


def prefix_tables(docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, prefix_tokens)``: element i is the token count of the first i + 1 code points.

    Empty and null texts have an empty array; repeated rows come out repeated. Store it, and ask
    ``chars_within`` or index it. A text's array takes four bytes a code point.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path, pattern)
        for part in portions_of_text(batches, 1, TABLE_BYTES):
            special = _specials(count, part.column(1))
            flat, ends = _Counted(count, part.column(1)).prefixes(0, part.num_rows)
            if special:
                rows = [count.prefixes(special[k]) if k in special else flat[ends[k] : ends[k + 1]] for k in range(part.num_rows)]
                flat, ends = np.concatenate(rows), np.concatenate([[0], np.cumsum([len(r) for r in rows])])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat))], ["doc_id", "prefix_tokens"])

    bounded_batches(docs.sparkSession)
    given = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return given.mapInArrow(tidy(run), "doc_id long, prefix_tokens array<int>")


def chars_within(prefix_tokens: str, budget: int):
    """Column: the most code points whose prefix has at most ``budget`` tokens. Counts needn't rise steadily."""
    fits = F.transform(F.col(prefix_tokens), lambda c, i: F.when(c <= budget, i + 1).otherwise(0))
    return F.coalesce(F.array_max(fits), F.lit(0)).cast("long")


def token_counts(docs: DataFrame, path: str, pattern: str, limit: int = 512, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit, chars_within_limit)`` per row of ``docs``.

    The count is what the tokenizers library gives for ``path`` without added tokens; its special
    string inside a text is one token. chars_within_limit is the longest prefix, in code points,
    of at most ``limit`` tokens. Null texts count as empty: 0 bytes, 0 tokens. A null doc_id is
    kept, repeated rows come out repeated, an empty table gives no rows, other columns are ignored.
    Texts are read whole; memory goes with the longest text and a portion of 8 MB.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path, pattern)
        for part in portions_of_text(batches, 1, PORTION_BYTES):
            column = part.column(1)
            counted, special = _Counted(count, column), _specials(count, column)
            total = counted.totals()
            chars = pc.fill_null(pc.utf8_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            for k in np.flatnonzero(total > limit).tolist():
                chars[k] = counted.within(k, limit)
            for k, t in special.items():
                prefix = count.prefixes(t)
                total[k], chars[k] = prefix[-1], np.flatnonzero(prefix <= limit).max(initial=-1) + 1
            n_bytes = pc.fill_null(pc.binary_length(column), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(0), n_bytes, pa.array(total), pa.array(total > limit), pa.array(chars)], ["doc_id", "n_bytes", "n_tokens", "over_limit", "chars_within_limit"])

    bounded_batches(docs.sparkSession)
    given = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return given.mapInArrow(tidy(run), "doc_id long, n_bytes long, n_tokens long, over_limit boolean, chars_within_limit long")
