"""Word shingles as 64-bit numbers, taken from whole Arrow batches of texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: Bytes of text whose numbers are worked out together; a longer text is taken whole, its words piece by piece.
SLICE_BYTES = 1 << 20
#: Bytes of a piece, and the longest word that its running sums serve.
PIECE, LONG = 1 << 17, 256

_STEP = 0x9E3779B97F4A7C15
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[0x41:0x5B] += np.uint64(0x20)
_WEIGHTS = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_VALUES = mixed((_LOWER + np.uint64(1)) * np.uint64(_STEP))


def _powers(base: int) -> np.ndarray:
    out = np.full(PIECE + LONG + 1, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


_UP, _DOWN = _powers(_STEP), _powers(pow(_STEP, -1, 1 << 64))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column, one text after the other, and where each begins (one more: where all end)."""
    column = column.fill_null("") if column.null_count else column
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of texts of about `most` bytes, or of one longer text."""
    if not len(column):
        return
    data, offsets = text_bytes(column)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, side="right")) - 1)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def word_numbers(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number for each word (what ASCII white space leaves, A-Z in lower case), and where each text's words begin."""
    word = ~_WHITE[data]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    inner = offsets[(offsets > 0) & (offsets < len(data))]  # a word ends with its text
    first[inner] = word[inner]
    last[inner - 1] = word[inner - 1]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    out = np.empty(len(begin), np.uint64)
    lo = 0
    while lo < len(begin):
        hi = int(np.searchsorted(begin, begin[lo] + PIECE))
        a = begin[lo]
        piece = data[a : min(end[hi - 1], begin[hi - 1] + LONG)]
        sums = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(_VALUES[piece] * _UP[: len(piece)], out=sums[1:])
        b, e = begin[lo:hi] - a, np.minimum(end[lo:hi] - a, len(piece))
        out[lo:hi] = mixed((sums[e] - sums[b]) * _DOWN[b])
        lo = hi
    for i in np.flatnonzero(end - begin > LONG).tolist():
        out[i] = xxhash.xxh3_64_intdigest(data[begin[i] : end[i]].tobytes().lower())
    return out, np.searchsorted(begin, offsets)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's sorted distinct shingles, one text after the other, and how many each has.

    A shingle is a run of `words` words; a shorter text's whole sequence is one; a text without words has none.
    """
    number, at = word_numbers(data, offsets)
    count = np.diff(at)
    total = len(number) - words + 1
    runs = np.full(max(0, total), words, np.uint64)
    for i in range(words if total > 0 else 0):
        runs += number[i : i + total] * np.uint64(_WEIGHTS[i % 5] + 2 * (i // 5))
    runs = mixed(runs)
    out = []
    for a, n in zip(at[:-1].tolist(), count.tolist()):
        if n >= words:
            part = np.sort(runs[a : a + n - words + 1])
            out.append(part)
        elif n:
            one = n + sum(int(x) * (_WEIGHTS[i % 5] + 2 * (i // 5)) for i, x in enumerate(number[a : a + n]))
            out.append(mixed(np.array([one & (1 << 64) - 1], np.uint64)))
    sizes = np.where(count >= words, count - words + 1, np.minimum(count, 1))
    if not out:
        return np.zeros(0, np.uint64), sizes
    grams = np.concatenate(out)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
    return grams[new], np.bincount(owner[new], minlength=len(sizes))


def binary_column(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """A column of byte strings: runs of `sizes` elements of data."""
    offsets = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes * data.itemsize, out=offsets[1:])
    if offsets[-1] >= 1 << 31:
        raise ValueError("more than 2 GB in one batch")
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])
