"""Word shingles of whole texts as 64-bit hashes, computed with numpy.

A word is a run of bytes other than space and U+0009..U+000D, with A-Z lower
cased. A text's set holds the hashes of its distinct k-word shingles; a text of
fewer words has its whole sequence as its only shingle; one without words has
the empty set. Work runs over blocks of whole texts so that memory follows the
longest text, never the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text hashed at once.
BLOCK = 1 << 19

_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0xD6E8FEB86659FD93)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * _M1
    x = x ^ (x >> np.uint64(33))
    x = x * _M2
    return x ^ (x >> np.uint64(33))


def _byte_values() -> np.ndarray:
    low = np.arange(256, dtype=np.uint64)
    low[65:91] += np.uint64(32)
    v = mix((low + np.uint64(1)) * _STEP)
    v[_SPACE] = 0
    return v


_VALUE = _byte_values()
_powers = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    """_BASE to the powers 0 .. n-1."""
    global _powers
    if len(_powers) < n:
        x = np.full(max(n, 2 * len(_powers)), _BASE)
        x[0] = 1
        _powers = np.multiply.accumulate(x)
    return _powers[:n]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column, nulls as empty texts."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, at


def words(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts raw[at[i]:at[i+1]], and the count of words before each text."""
    body = raw[at[0] : at[-1]]
    cut = at - at[0]
    if not len(body):
        return np.zeros(0, np.uint64), np.zeros(len(at), np.int64)
    inside = ~_SPACE[body]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edges = cut[(cut > 0) & (cut < len(body))]
    first[edges] = inside[edges]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(at), np.int64)
    spans = np.diff(np.append(starts, len(body)))
    local = np.arange(len(body), dtype=np.int64)[starts[0] :] - np.repeat(starts, spans)
    value = _VALUE[body[starts[0] :]] * powers(int(spans.max()))[local]
    hashed = np.add.reduceat(value, starts - starts[0])
    return mix(hashed), np.searchsorted(starts, cut)


def join_words(w: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k neighbouring words."""
    n = len(w) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = mix(out * _BASE + w[i : i + n] + np.uint64(i + 1))
    return out


def blocks(at: np.ndarray, size: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `size` bytes, one text at least."""
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + size, "right")) - 1)
        yield i, j
        i = j


def shingle_lists(column: pa.Array, k: int = 5) -> Iterator[np.ndarray]:
    """For each text the hashes of its shingles in reading order, repeats included."""
    raw, at = utf8(column)
    for i, j in blocks(at):
        w, before = words(raw, at[i : j + 1])
        runs = join_words(w, k)
        for a, b in zip(before[:-1], before[1:], strict=True):
            if b - a >= k:
                yield runs[a : b - k + 1]
            elif b > a:
                yield join_words(w[a:b], int(b - a)) ^ np.uint64(b - a)
            else:
                yield np.zeros(0, np.uint64)


def shingle_sets(column: pa.Array, k: int = 5) -> Iterator[np.ndarray]:
    """For each text its sorted distinct shingle hashes."""
    for x in shingle_lists(column, k):
        x = np.sort(x)
        yield x[np.append(True, x[1:] != x[:-1])] if len(x) else x


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    i = np.searchsorted(b, a)
    i[i == len(b)] = 0
    return int(np.count_nonzero(b[i] == a))
