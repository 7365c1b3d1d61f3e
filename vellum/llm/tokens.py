"""Words and word shingles of whole texts as numpy arrays, without a Python loop over words.

A word is a run of bytes other than ASCII white space; that equals the runs of
``[^\\x20\\x09-\\x0D]`` of the text, as every byte of a longer UTF-8 sequence is above 0x7F.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

WHITE = b" \t\n\x0b\x0c\r"
_IS_WORD = np.ones(256, bool)
_IS_WORD[list(WHITE)] = False
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += 32
_LOWER += 1

#: Odd 64-bit multipliers; the base of the rolling word hash and its inverse modulo 2**64.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_MIX = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)
SHINGLE = 5
#: Bytes of text that are turned into arrays at once; a longer text is a slice of its own.
SLICE_BYTES = 1 << 20

_powers: list[np.ndarray] = []


def _tables(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) <= n:
        size = max(n + 1, SLICE_BYTES * 2)
        _powers[:] = [np.cumprod(np.array([1] + [x] * size, np.uint64), dtype=np.uint64) for x in (_BASE, _INVERSE)]
    return _powers


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x *= _MIX[0]
    x ^= x >> np.uint64(27)
    x *= _MIX[1]
    x ^= x >> np.uint64(31)
    return x


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about `limit` bytes of text, so that arrays stay small."""
    sizes = np.diff(text_bytes(batch.column(column))[1])
    cuts = np.cumsum(sizes) // limit
    starts = np.flatnonzero(np.diff(cuts, prepend=-1)) if len(sizes) else []
    for a, b in zip(starts, [*starts[1:], len(sizes)], strict=True):
        yield batch.slice(a, b - a)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, one after the other, and the offsets of each; null counts as empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def word_spans(raw: np.ndarray, at: np.ndarray, table: np.ndarray = _IS_WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and where each text's words begin among them. table: the bytes of words."""
    word = table[raw]
    if not len(word):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    before = np.concatenate([[False], word[:-1]])
    after = np.concatenate([word[1:], [False]])
    edges = at[(at > 0) & (at < len(raw))]
    before[edges] = False
    after[edges - 1] = False
    starts = np.flatnonzero(word & ~before)
    ends = np.flatnonzero(word & ~after) + 1
    return starts, ends, np.searchsorted(starts, at)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word, A-Z lower-cased: the same for the same bytes anywhere."""
    power, inverse = _tables(len(raw))
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_LOWER[raw] * power[: len(raw)], out=total[1:])
    return mix64((total[ends] - total[starts]) * inverse[starts])


def shingle_sets(texts: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each text's word shingles, one set after the other, and their offsets.

    A text of fewer words than `size` has its whole word sequence as its one shingle; a text
    without words has an empty set.
    """
    raw, at = text_bytes(texts)
    starts, ends, first = word_spans(raw, at)
    hashes = word_hashes(raw, starts, ends)
    n = np.diff(first)
    rolled = np.zeros(max(len(hashes) - size + 1, 0), np.uint64)
    for k in range(size):
        rolled += hashes[k : k + len(rolled)] * _MIX[k % len(_MIX)]
    rolled = mix64(rolled)
    sets, offsets = [], np.zeros(len(n) + 1, np.int64)
    for i, count in enumerate(n):
        if count >= size:
            own = np.sort(rolled[first[i] : first[i] + count - size + 1])
            own = own[np.concatenate([[True], own[1:] != own[:-1]])]
        elif count:
            few = hashes[first[i] : first[i + 1]] * _MIX[:count]
            own = mix64(np.array([few.sum(dtype=np.uint64) + np.uint64(count)], np.uint64))
        else:
            own = rolled[:0]
        sets.append(own)
        offsets[i + 1] = offsets[i] + len(own)
    return (np.concatenate(sets) if sets else rolled[:0]), offsets
