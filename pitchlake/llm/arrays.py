"""Words of Arrow text columns as flat numpy arrays, for functions run by `mapInArrow`.

A batch is cut into slices of bounded bytes; within a slice every step is a whole-array operation:
word borders come from a byte table, word hashes from differences of one polynomial prefix sum.
Words never join across rows. Null texts have no words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
_BASE, _WORD_BASE = np.uint64(0x9E3779B97F4A7C55), np.uint64(0xD6E8FEB86659FD93)
_MIX_1, _MIX_2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def byte_set(*spans: tuple[int, int]) -> np.ndarray:
    """A table over bytes: true within the given inclusive spans."""
    table = np.zeros(256, dtype=bool)
    for low, high in spans:
        table[low:high + 1] = True
    return table


#: What separates words: ASCII white space only, or everything in ASCII but letters and digits.
SPACES = byte_set((0x20, 0x20), (0x09, 0x0D))
NON_ALNUM = byte_set((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F))
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 32
_CODES = np.random.RandomState(20240501).randint(0, 1 << 63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    h = (h ^ (h >> np.uint64(30))) * _MIX_1
    h = (h ^ (h >> np.uint64(27))) * _MIX_2
    return h ^ (h >> np.uint64(31))


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: np.uint64):
        self.base, self.inverse = base, np.uint64(pow(int(base), -1, 1 << 64))
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 16)
            self.up, self.down = (np.multiply.accumulate(np.concatenate(
                [np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)])) for b in (self.base, self.inverse))
        return self.up[:n], self.down[:n]


_BYTE_POWERS, _WORD_POWERS = _Powers(_BASE), _Powers(_WORD_BASE)


@dataclass
class Words:
    """Words of some rows: `first[r]:first[r + 1]` are the words of row r."""

    data: np.ndarray    # bytes of all rows, as they are
    rows: np.ndarray    # byte offsets of the rows, one more than rows
    start: np.ndarray   # first byte of each word
    end: np.ndarray     # byte after each word
    first: np.ndarray   # word offsets of the rows, one more than rows
    code: np.ndarray    # 64-bit hash of each word
    total: np.ndarray   # prefix sums behind the hashes of byte spans

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def row_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def span_code(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the byte spans [start, end)."""
        down = _BYTE_POWERS.get(len(self.total))[1]
        return mix((self.total[end] - self.total[start]) * down[start] + (end - start).astype(np.uint64) * _MIX_2)

    def byte_grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Start and hash of every n bytes within one row."""
        at = np.arange(max(len(self.data) - n + 1, 0))
        row = np.repeat(np.arange(len(self.rows) - 1), np.diff(self.rows))[:len(at)]
        at = at[at + n <= self.rows[row + 1]]
        return at, self.span_code(at, at + n)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all rows end to end, and the offsets of the rows; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    rows = np.frombuffer(offsets, dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(data, dtype=np.uint8)[rows[0]:rows[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, rows - rows[0]


def words_of(texts: pa.Array, separators: np.ndarray, fold: bool = False) -> Words:
    """Words of each row; with `fold` A-Z count as a-z in the hashes."""
    data, rows = text_bytes(texts)
    inside = np.zeros(len(data) + 1, dtype=bool)
    inside[:-1] = ~separators[data]
    before = np.zeros(len(data) + 1, dtype=bool)
    before[1:] = inside[:-1]
    before[rows[:-1]] = False  # a row begins a new word
    start = np.flatnonzero(inside & ~before)
    after = np.zeros(len(data) + 1, dtype=bool)
    after[:-1] = inside[1:]
    after[rows[1:][rows[1:] > 0] - 1] = False
    end = np.flatnonzero(inside & ~after) + 1
    first = np.searchsorted(start, rows)
    up, _ = _BYTE_POWERS.get(len(data) + 1)
    terms = (_CODES[_FOLD] if fold else _CODES)[data]
    terms *= up[:-1]
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(terms, out=total[1:])
    words = Words(data, rows, start, end, first, None, total)
    words.code = words.span_code(start, end)
    return words


def rolling(code: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each position on; shorter than `code` by k - 1. Rows are not told apart."""
    if len(code) < k:
        return np.zeros(0, dtype=np.uint64)
    up, down = _WORD_POWERS.get(len(code) + 1)
    total = np.zeros(len(code) + 1, dtype=np.uint64)
    np.cumsum(code * up[:-1], out=total[1:])
    return mix((total[k:] - total[:-k]) * down[:len(code) - k + 1] + np.uint64(k))


def hash_spans(code: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hashes of the word spans [start, stop)."""
    up, down = _WORD_POWERS.get(len(code) + 1)
    total = np.zeros(len(code) + 1, dtype=np.uint64)
    np.cumsum(code * up[:-1], out=total[1:])
    return mix((total[stop] - total[start]) * down[start] + (stop - start).astype(np.uint64))


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least of the `width` values from each place on."""
    if len(values) < width:
        return values[:0]
    have = 1
    while have * 2 <= width:
        values, have = np.minimum(values[:len(values) - have], values[have:]), have * 2
    rest = width - have
    return np.minimum(values[:len(values) - rest], values[rest:]) if rest else values


def whole_within(words: Words, k: int) -> np.ndarray:
    """True for the positions from which k words lie within one row; as long as `rolling(code, k)`."""
    n = max(len(words.start) - k + 1, 0)
    row = words.row_of_word()
    return np.arange(n) + k <= words.first[row[:n] + 1]


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of at most `limit` bytes of text, or of one row."""
    if not batch.num_rows:
        return
    total = text_bytes(batch.column(column))[1][1:]
    begin = 0
    while begin < len(total):
        base = total[begin - 1] if begin else 0
        stop = max(int(np.searchsorted(total, base + limit, side="right")), begin + 1)
        yield batch.slice(begin, stop - begin)
        begin = stop


def signed(h: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's long."""
    return h.view(np.int64)


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All integers of the spans [start, start + length), end to end."""
    lengths = np.asarray(lengths, dtype=np.int64)
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    offset = np.repeat(np.asarray(starts, dtype=np.int64) - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths)
    return offset + np.arange(total)


def covered(size: int, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """True for the positions below `size` inside any of the spans [start, stop)."""
    marks = np.zeros(size + 1, dtype=np.int64)
    np.add.at(marks, starts, 1)
    np.add.at(marks, stops, -1)
    return np.cumsum(marks)[:-1] > 0
