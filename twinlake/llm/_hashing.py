"""Rolling hashes over Arrow text columns, in NumPy: bytes, words and windows of words.

All hashes are polynomial sums modulo 2**64 over random per-byte values, read off prefix
sums, then scrambled. There are two families of them: where equal hashes decide a result, both
are compared, 128 bits. A column's text is one buffer; no Python object is made per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: Bases of bytes in a word or span, and of words in a window, by family.
_BASE, _STEP = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F), (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
#: Bytes of text that are hashed together; one longer text is hashed alone.
CHUNK = 1 << 20


def scramble(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x ^ (x >> U(33))
    x *= U(0xFF51AFD7ED558CCD)
    x ^= x >> U(33)
    x *= U(0xC4CEB9FE1A85EC53)
    x ^= x >> U(33)
    return x


_BYTES = [scramble(np.arange(1, 257, dtype=U) * U(odd)) for odd in (0x2545F4914F6CDD1D, 0x9FB21C651E98DF25)]
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_tables: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    t = _tables.get(base)
    if t is None or len(t) < n:
        t = np.full(max(n, CHUNK + 1), base, U)
        t[0] = 1
        _tables[base] = t = np.cumprod(t)
    return t[:n]


def _inverses(base: int, n: int) -> np.ndarray:
    return _powers(pow(base, -1, 1 << 64), n)


def prefix_sums(values: np.ndarray, base: int) -> np.ndarray:
    out = np.zeros(len(values) + 1, U)
    np.cumsum(values * _powers(base, len(values)), out=out[1:])
    return out


def between(sums: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """The sum over [start, end), shifted to start at power 0."""
    return (sums[end] - sums[start]) * _inverses(base, len(sums))[start]


def byte_sums(data: np.ndarray, family: int = 0) -> np.ndarray:
    return prefix_sums(_BYTES[family][data], _BASE[family])


def byte_windows(sums: np.ndarray, size: int) -> np.ndarray:
    """The hash of each window of ``size`` bytes."""
    n = max(0, len(sums) - size)
    return scramble((sums[size : size + n] - sums[:n]) * _inverses(_BASE[0], len(sums))[:n])


def spans_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray, family: int = 0) -> np.ndarray:
    return scramble(between(sums, start, end, _BASE[family]) + (end - start).astype(U) * U(0xA24BAED4963EE407))


def windows(h: np.ndarray, size: int, family: int = 0) -> np.ndarray:
    """The hash of each window of ``size`` neighbouring hashes."""
    n = len(h) - size + 1
    if n <= 0:
        return np.empty(0, U)
    s = prefix_sums(h, _STEP[family])
    return scramble((s[size:] - s[:n]) * _inverses(_STEP[family], len(s))[:n])


def buffer(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column, null as empty, and where each text starts and the last ends."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    if not len(col):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offsets, data = col.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def chunks(batch: pa.RecordBatch, text: str, size: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``size`` bytes of text; at least a row each."""
    _, at = buffer(batch.column(text))
    i = 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(at, at[i] + size, "right")) - 1)
        yield batch.slice(i, j - i)
        i = j


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of each word: runs of bytes that are not ASCII white space, within one text."""
    inside = ~_SPACE[data]
    n = len(data)
    before, after = np.empty(n, bool), np.empty(n, bool)
    if n:
        before[0] = after[-1] = False
        before[1:], after[:-1] = inside[:-1], inside[1:]
        edges = at[(at > 0) & (at < n)]
        before[edges] = False
        after[edges - 1] = False
    start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return start, end, np.searchsorted(at, start, "right") - 1


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, family: int = 0) -> np.ndarray:
    return spans_hash(byte_sums(data, family), start, end, family)


def runs(sorted_values: np.ndarray) -> np.ndarray:
    """Where each run of equal values starts, and the end."""
    n = len(sorted_values)
    if not n:
        return np.zeros(1, np.int64)
    return np.concatenate(([0], np.flatnonzero(sorted_values[1:] != sorted_values[:-1]) + 1, [n]))


def first_of_equal(*keys: np.ndarray) -> np.ndarray:
    """Whether each place is the first with its keys."""
    order = np.lexsort(keys[::-1])  # stable, so equal keys keep their order
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.any([k[order[1:]] != k[order[:-1]] for k in keys], axis=0)
    out = np.empty(len(order), bool)
    out[order] = new
    return out
