"""Vectorised scanning of UTF-8 text columns inside Arrow UDFs.

A batch of texts is seen as one byte array with document offsets.  Word
boundaries come from a 256-entry byte table, and every word (or any prefix of
one) gets a 64-bit hash from one running polynomial sum, so no Python string is
made for a word.  Byte classes are ASCII-only, hence exact on UTF-8: all bytes of
a multi-byte character are >= 0x80 and share one class.

Nulls count as empty texts.  Memory is about 60 bytes per byte of a chunk;
``chunks`` bounds a chunk at CHUNK_BYTES, or one text where a text is longer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 19
U = np.uint64
_P = U(0x9E3779B97F4A7C15 | 1)
_P_INV = U(pow(int(_P), -1, 1 << 64))


def byte_class(*spans: tuple[int, int]) -> np.ndarray:
    """Boolean byte table that holds the given inclusive ranges."""
    table = np.zeros(256, dtype=bool)
    for lo, hi in spans:
        table[lo : hi + 1] = True
    return table


#: Everything but space and the controls from tab to carriage return.
NON_SPACE = ~byte_class((0x20, 0x20), (0x09, 0x0D))
#: Digits, lower-case ASCII letters and all bytes of non-ASCII characters.
ALNUM_LOWER = byte_class((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """Avalanche of a 64-bit word (a bijection)."""
    h = h ^ (h >> U(33))
    h = h * U(0xFF51AFD7ED558CCD)
    h = h ^ (h >> U(33))
    h = h * U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U(33))


def stream(seed: int, n: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit words; the same in every process."""
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=U) + U(seed * 1_000_003)) * U(0xC2B2AE3D27D4EB4F))


_BYTE = stream(7, 256)
_pow = np.ones(1, dtype=U)
_inv = np.ones(1, dtype=U)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _pow, _inv
    if len(_pow) < n:
        size = max(n, CHUNK_BYTES + 1)
        one = np.ones(1, dtype=U)
        _pow = np.concatenate([one, np.multiply.accumulate(np.full(size, _P))])
        _inv = np.concatenate([one, np.multiply.accumulate(np.full(size, _P_INV))])
    return _pow[:n], _inv[:n]


def running(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of a byte array and factors: mix((sum[b] - sum[a]) * factor[a]) ranks bytes a to b."""
    power, inverse = _powers(len(text) + 1)
    total = np.zeros(len(text) + 1, dtype=U)
    np.cumsum(_BYTE[text] * power[:-1], out=total[1:])
    return total, inverse


def as_strings(column: pa.Array) -> pa.Array:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.type != pa.string():
        column = column.cast(pa.string())
    return column.fill_null("") if column.null_count else column


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (from 0, one more than texts) of a string array without nulls."""
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    buf = np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, off - off[0]


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[pa.Array]:
    """Slices of a string column of at most ``limit`` bytes, or of one text."""
    column = as_strings(column)
    _, off = raw(column)
    begin = 0
    while begin < len(column):
        end = max(begin + 1, int(np.searchsorted(off, off[begin] + limit, side="right")) - 1)
        yield column.slice(begin, end - begin)
        begin = end


class Scan:
    """Words of a chunk: byte positions, document numbers and hashes.

    start, end: byte range of each word; doc: the document it is in;
    first: index of each document's first word (one more entry than documents).
    """

    def __init__(self, column: pa.Array, word: np.ndarray = NON_SPACE, fold: np.ndarray | None = LOWER):
        self.buf, self.off = raw(column)
        self.n_docs = len(self.off) - 1
        self.text = fold[self.buf] if fold is not None else self.buf
        is_word = word[self.text]
        n = len(is_word)
        if n:
            edge = np.zeros(n + 1, dtype=bool)
            edge[self.off] = True  # a document begins (or the chunk ends)
            before = np.empty(n, dtype=bool)
            before[0] = False
            before[1:] = is_word[:-1]
            before &= ~edge[:-1]
            after = np.empty(n, dtype=bool)
            after[-1] = False
            after[:-1] = is_word[1:]
            after &= ~edge[1:]
            self.start = np.flatnonzero(is_word & ~before)
            self.end = np.flatnonzero(is_word & ~after) + 1
        else:
            self.start = self.end = np.zeros(0, dtype=np.int64)
        self.first = np.searchsorted(self.start, self.off)
        self.doc = np.repeat(np.arange(self.n_docs), np.diff(self.first))
        self._sum: np.ndarray | None = None

    def _running(self) -> np.ndarray:
        if self._sum is None:
            self._sum, _ = running(self.text)
        return self._sum

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of byte ranges of the folded text; equal ranges hash alike anywhere."""
        total = self._running()
        _, inverse = _powers(len(self.text) + 1)
        return mix((total[end] - total[start]) * inverse[start] + (end - start).astype(U))

    def words(self) -> np.ndarray:
        return self.hashes(self.start, self.end)

    def count(self, table: np.ndarray) -> np.ndarray:
        """Bytes of each document that are in a byte table (of the unfolded text)."""
        return self.sums(table[self.buf])

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Sums of a byte-aligned array by document."""
        total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
        return total[self.off[1:]] - total[self.off[:-1]]

    def word_sums(self, values: np.ndarray) -> np.ndarray:
        """Sums of a word-aligned array by document."""
        total = np.concatenate([[0], np.cumsum(values)])
        return total[self.first[1:]] - total[self.first[:-1]]


def hash_of(word: str) -> int:
    """The hash that Scan gives to a word."""
    data = word.encode()
    s = Scan(pa.array([word]), word=np.ones(256, dtype=bool), fold=None)
    return int(s.hashes(np.array([0]), np.array([len(data)]))[0])


class Lookup:
    """Membership and position of 64-bit hashes in a small sorted table."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.unique(np.asarray(keys, dtype=U))
        self.gate = np.zeros(1 << 16, dtype=bool)
        self.gate[(self.keys >> U(48)).astype(np.int64)] = True

    def find(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indexes of the values that are in the table, and their places in ``keys``."""
        near = np.flatnonzero(self.gate[(values >> U(48)).astype(np.int64)])
        if not len(near) or not len(self.keys):
            return near[:0], near[:0]
        place = np.minimum(np.searchsorted(self.keys, values[near]), len(self.keys) - 1)
        hit = self.keys[place] == values[near]
        return near[hit], place[hit]


def windows(words: np.ndarray, first: np.ndarray, n: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-word windows within documents, and the word each begins at."""
    total = len(words)
    if total < n:
        return words[:0], np.zeros(0, dtype=np.int64)
    weight = stream(seed, n) | U(1)
    h = np.zeros(total - n + 1, dtype=U)
    for k in range(n):
        h += words[k : total - n + 1 + k] * weight[k]
    # a window is inside if its document goes on to its last word
    ends = np.repeat(first[1:], np.diff(first))[: total - n + 1]
    at = np.flatnonzero(np.arange(total - n + 1) + n <= ends)
    return mix(h[at] + U(n)), at
