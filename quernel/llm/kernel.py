"""Vectorised text kernels over Arrow string buffers.

A *word* is a maximal run of ASCII letters, ASCII digits and non-ASCII characters. Texts are
handled in slices of about ``SLICE`` bytes, always whole documents, so memory follows the slice
and the longest document, not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE = 1 << 19
_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_PINV = np.uint64(pow(int(_P), -1, 1 << 64))

IS_WORD = np.zeros(256, bool)
for _lo, _hi in ((48, 58), (65, 91), (97, 123), (128, 256)):
    IS_WORD[_lo:_hi] = True
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True

_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers["p"]) < n:
        size = max(n, SLICE + (SLICE >> 1))
        for name, base in (("p", _P), ("i", _PINV)):
            a = np.full(size, base, np.uint64)
            a[0] = 1
            _powers[name] = np.multiply.accumulate(a)
    return _powers["p"], _powers["i"]


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string array; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null("")
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, offsets


def slices(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets from 0) for runs of whole documents."""
    if len(column) == 0:
        return
    raw, offsets = buffers(column)
    a = 0
    while a < len(column):
        b = int(np.searchsorted(offsets, offsets[a] + SLICE, "right")) - 1
        b = min(max(b, a + 1), len(column))
        yield a, b, raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


def runs(mask: np.ndarray, offsets: np.ndarray, kind: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of ``mask`` inside documents (of equal ``kind``, if given)."""
    n = len(mask)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    change = np.empty(n, bool)
    change[0] = True
    change[1:] = (mask[1:] != mask[:-1]) if kind is None else (kind[1:] != kind[:-1])
    edge = np.flatnonzero(change | cut[:n])
    keep = mask[edge]
    ends = np.append(edge[1:], n)
    return edge[keep], ends[keep]


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes."""
    if len(starts) == 0:
        return np.zeros(0, np.uint64)
    p, inv = _power(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * p[: len(raw)], out=total[1:])
    return mix((total[ends] - total[starts]) * inv[starts])


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word starts, word ends, per document the index of its first word, one longer than the documents)."""
    starts, ends = runs(IS_WORD[raw], offsets)
    return starts, ends, np.searchsorted(starts, offsets)


def ngram_hashes(word: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each document's word n-grams, per document the index of its first).

    A document of fewer than n words, but one at least, has one n-gram: all its words.
    """
    counts = np.diff(first)
    total = len(word)
    if total == 0:
        return np.zeros(0, np.uint64), np.zeros(len(first), np.int64)
    padded = np.concatenate([word, np.zeros(n - 1, np.uint64)])
    at = np.arange(total)
    left = np.repeat(first[1:], counts) - at  # words of the document from here on
    acc = np.zeros(total, np.uint64)
    for k in range(n):
        coefficient = np.uint64((0xD6E8FEB86659FD93 * (2 * k + 1) + k) & (2**64 - 1) | 1)
        acc += np.where(left > k, padded[k : k + total] * coefficient, np.uint64(0))
    begin = np.repeat(first[:-1], counts) == at
    keep = (left >= n) | (begin & (np.repeat(counts, counts) < n))
    out = mix(acc[keep])
    bounds = np.concatenate([[0], np.cumsum(keep)])[first]
    return out, bounds
