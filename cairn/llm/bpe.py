"""Byte-level BPE vocabularies, and texts cut where their encoding can't depend on what follows."""

from __future__ import annotations

import base64
import json
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from cairn.llm.words import BLOCK, text_buffer

_WHITE = np.zeros(256, bool)
_WHITE[[32, *range(9, 14), *range(28, 32)]] = True


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-ins that .json vocabularies use for bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Ranks of a byte-level BPE: of ``path``, a .tiktoken or a tokenizers .json file."""

    def __init__(self, path: str, pattern: str):
        self.special: str | None = None
        if path.endswith(".json"):
            spec = json.loads(Path(path).read_text(encoding="utf-8"))
            alphabet = _byte_alphabet()
            self.ranks = {bytes(alphabet[c] for c in token): i for token, i in spec["model"]["vocab"].items()}
            self.special = next((t["content"] for t in spec["added_tokens"] if t["special"]), None)
        else:
            lines = Path(path).read_bytes().splitlines()
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.words = regex.compile(pattern)
        import tiktoken  # workers that only decode do without it

        self._core = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=self.ranks, special_tokens={})._core_bpe
        self.longest = max(map(len, self.ranks))
        self.token_bytes = {i: b for b, i in self.ranks.items()}

    def encode_word(self, word: bytes) -> list[int]:
        """Token ids of one match of the pattern."""
        return self._core.encode_single_piece(word) if word else []


@lru_cache(maxsize=4)
def matches(pattern: str):
    """Finds the pattern's matches in a piece; needs no vocabulary."""
    return regex.compile(pattern).findall


@lru_cache(maxsize=4)
def vocabulary(path: str, pattern: str) -> Vocabulary:
    """Loaded once per worker."""
    return Vocabulary(path, pattern)


def _white(data: np.ndarray) -> np.ndarray:
    """Which bytes belong to white-space characters of Unicode; 0x1C to 0x1F count among these."""
    white = _WHITE[data]
    lead = np.flatnonzero((data == 0xC2) | ((data >= 0xE1) & (data <= 0xE3)))
    if len(lead):
        a = data[lead]
        b, c = (data[np.minimum(lead + k, len(data) - 1)] for k in (1, 2))
        two = (a == 0xC2) & ((b == 0x85) | (b == 0xA0))
        general = (a == 0xE2) & (b == 0x80) & (((c >= 0x80) & (c <= 0x8A)) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))
        three = general | ((a == 0xE1) & (b == 0x9A) & (c == 0x80)) | ((a == 0xE2) & (b == 0x81) & (c == 0x9F)) | ((a == 0xE3) & (b == 0x80) & (c == 0x80))
        white[np.concatenate([lead[two], lead[two] + 1, lead[three], lead[three] + 1, lead[three] + 2])] = True
    return white


def piece_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Bytes at which pieces of the texts begin: at texts, single spaces, single line feeds, and after these.

    Single means between two characters that are no white space. No match of the pattern crosses such
    a cut and none looks beyond it, so a piece's encoding is the same wherever it stands.
    """
    n = len(data)
    white = _white(data)
    before, after = np.ones(n, bool), np.ones(n, bool)
    before[1:], after[:-1] = white[:-1], white[1:]
    before[offsets[:-1][offsets[:-1] < n]] = True
    after[offsets[1:][offsets[1:] > 0] - 1] = True
    single = white & ~before & ~after
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    cut[:n] |= single & (data == 32)
    feeds = np.flatnonzero(single & (data == 10))
    cut[feeds] = cut[feeds + 1] = True
    return np.flatnonzero(cut[:n])


class Pieces:
    """Texts as pieces: ``index`` of each among the ``distinct`` ones (strings), ``bounds`` by text."""

    def __init__(self, column: pa.Array):
        data, offsets = text_buffer(column)
        data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
        found, i = [], 0
        while i < len(offsets) - 1:  # the masks take some ten bytes a byte of text
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + BLOCK, "right")) - 1)
            found.append(piece_starts(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) + offsets[i])
            i = j
        starts = np.concatenate(found or [np.empty(0, np.int64)])
        ends = np.append(starts, len(data))
        every = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))])
        coded = every.dictionary_encode()
        self.index = coded.indices.to_numpy()
        self.distinct: list[str] = coded.dictionary.cast(pa.large_string()).to_pylist()
        self.bounds = np.searchsorted(starts, offsets)


def portions_of_text(batches: Iterator[pa.RecordBatch], column: int, size: int) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in portions whose text in ``column`` is about ``size`` bytes."""
    held, n = [], 0
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        i, done = 0, 0
        while i < batch.num_rows:
            j = min(batch.num_rows, int(np.searchsorted(ends, done + size - n)) + 1)
            held.append(batch.slice(i, j - i))
            n += int(ends[j - 1]) - done
            i, done = j, int(ends[j - 1])
            if n >= size:
                yield _one(held)
                held, n = [], 0
    if held:
        yield _one(held)


def _one(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    if len(held) == 1:
        return held[0]
    whole = pa.Table.from_batches(held)
    columns = [c.cast(pa.large_string()).combine_chunks() if pa.types.is_string(c.type) else c.combine_chunks() for c in whole.columns]
    return pa.RecordBatch.from_arrays(columns, whole.column_names)


def gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Slices of ``flat``, one after another."""
    ends = np.cumsum(lengths)
    return flat[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - ends + lengths, lengths)]
