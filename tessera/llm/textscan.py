"""Word scanning of Arrow string columns with NumPy: spans, hashes and shingles, without a Python loop over words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: Bytes of text looked at in one go; a longer text is a piece of its own.
PIECE = 1 << 20
BASE = U(0x9E3779B97F4A7C15)


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix)."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def powers(n: int, base: np.uint64 = BASE) -> np.ndarray:
    out = np.full(max(1, n), base, dtype=U)
    out[0] = 1
    return np.cumprod(out, dtype=U)


#: Code of each byte: A-Z as a-z.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
UNCHANGED = np.arange(256, dtype=np.uint8)
#: Which bytes belong to words. UTF-8 bytes from 0x80 are parts of characters above U+007F.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.zeros(256, dtype=bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
BYTE_CODES = mixed(np.arange(1, 257, dtype=U) * U(0xD1342543DE82EF95))


def pieces(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets of the rows' texts in them); nulls are empty."""
    column = column.fill_null("").cast(pa.large_string())
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    first = 0
    while first < n:
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + PIECE, side="right")) - 1)
        end = min(end, n)
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


def words(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray, codes: np.ndarray = LOWER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of every word (lower-cased, or as codes has its bytes), first byte of every word, and the words' range of each row (n + 1 numbers)."""
    inside = kind[data]
    if not len(data) or not inside.any():
        return np.zeros(0, dtype=U), np.zeros(0, dtype=np.int64), np.zeros(len(offsets), dtype=np.int64)
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    heads = offsets[:-1][np.diff(offsets) > 0]
    begins[heads] = inside[heads]
    starts = np.flatnonzero(begins)
    letters = codes[data[inside]]
    at = np.flatnonzero(begins[inside])
    lengths = np.diff(np.append(at, len(letters)))
    place = np.arange(len(letters)) - np.repeat(at, lengths)
    hashes = np.add.reduceat(BYTE_CODES[letters] * powers(int(lengths.max()))[place], at)
    return mixed(hashes + lengths.astype(U) * U(0xA0761D6478BD642F)), starts, np.searchsorted(starts, offsets)


def shingle_sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """Of each row the sorted distinct hashes of its shingles of k words; of fewer words, one hash of them all."""
    weights = mixed(np.arange(11, 11 + k, dtype=U))
    for first, end, data, offsets in pieces(column):
        hashes, _, ranges = words(data, offsets, NOT_SPACE)
        grams = np.zeros(max(0, len(hashes) - k + 1), dtype=U)
        for j in range(k if len(grams) else 0):
            grams += hashes[j : j + len(grams)] * weights[j]
        grams = mixed(grams)
        for i in range(end - first):
            a, b = ranges[i], ranges[i + 1]
            if b - a >= k:
                yield np.unique(grams[a : b - k + 1])
            elif b > a:
                yield mixed(np.array([np.sum(hashes[a:b] * weights[: b - a]) + U(int(b - a))], dtype=U))
            else:
                yield np.zeros(0, dtype=U)


def word_array(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.LargeBinaryArray, np.ndarray]:
    """The words of all rows, unchanged, between white space, and the words' range of each row (n + 1 numbers)."""
    inside = NOT_SPACE[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    heads = offsets[:-1][np.diff(offsets) > 0]
    begins[heads] = inside[heads]
    letters = data[inside]
    at = np.append(np.flatnonzero(begins[inside]), len(letters)).astype(np.int64)
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(letters)])
    return words, np.searchsorted(np.flatnonzero(begins), offsets)
