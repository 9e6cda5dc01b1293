"""Texts of an Arrow batch as flat numpy arrays: bytes, words, word hashes, shingles.

Everything works on the UTF-8 buffer of a whole slice of rows at once, without a Python
object for each word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U64 = np.uint64
_rng = np.random.default_rng(20240229)
#: A random 64-bit code for each byte; A-Z share the codes of a-z.
BYTE_CODE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
BYTE_CODE[65:91] = BYTE_CODE[97:123]
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)
STEP = 0xD6E8FEB86659FD93
_powers = {"up": np.ones(1, U64), "down": np.ones(1, U64)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n."""
    if len(_powers["up"]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        for name, base in (("up", BASE), ("down", BASE_INVERSE)):
            out = np.full(size, base, U64)
            out[0] = 1
            _powers[name] = np.cumprod(out, dtype=U64)
    return _powers["up"][:n], _powers["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is an empty text."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def words(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of each run of bytes that are not white space, within its text."""
    if not len(raw):
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    solid = ~IS_SPACE[raw]
    cut = np.zeros(len(raw) + 1, bool)
    cut[off] = True
    before = np.empty(len(raw), bool)
    before[0], before[1:] = False, solid[:-1]
    start = np.flatnonzero(solid & (~before | cut[:-1]))
    after = np.empty(len(raw), bool)
    after[-1], after[:-1] = False, solid[1:]
    end = np.flatnonzero(solid & (~after | cut[1:])) + 1
    rows = np.repeat(np.arange(len(off) - 1), np.diff(np.searchsorted(start, off)))
    return start, end, rows


def word_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray, block: int = 1 << 20) -> np.ndarray:
    """A 64-bit hash of each word, A-Z as a-z, from prefix sums over blocks of whole words."""
    out = np.empty(len(start), U64)
    first = 0
    while first < len(start):
        low = start[first]
        last = max(first + 1, int(np.searchsorted(end, low + block, "right")))
        high = end[last - 1]
        up, down = powers(high - low + 1)
        prefix = np.zeros(high - low + 1, U64)
        np.cumsum(BYTE_CODE[raw[low:high]] * up[:-1], out=prefix[1:])
        a, b = start[first:last] - low, end[first:last] - low
        out[first:last] = mix((prefix[b] - prefix[a]) * down[a] + (b - a).astype(U64))
        first = last
    return out


def shingles(hashes: np.ndarray, rows: np.ndarray, n: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct word shingles of each of n texts, sorted by row, then hash.

    A text of fewer words than ``size`` has its whole sequence as its one shingle.
    """
    counts = np.bincount(rows, minlength=n)
    full = len(hashes) - size + 1
    parts_h, parts_r = [], []
    if full > 0:
        h = np.zeros(full, U64)
        weight = 1
        for k in range(size):
            h += hashes[k : k + full] * U64(weight)
            weight = weight * STEP & ((1 << 64) - 1)
        same = rows[:full] == rows[size - 1 :]
        parts_h.append(mix(h[same]))
        parts_r.append(rows[:full][same])
    short = (counts > 0) & (counts < size)
    if short.any():
        begin = np.cumsum(counts) - counts
        h = np.zeros(int(short.sum()), U64)
        weight, which = 1, np.flatnonzero(short)
        for k in range(size - 1):
            has = counts[which] > k
            h[has] += hashes[begin[which[has]] + k] * U64(weight)
            weight = weight * STEP & ((1 << 64) - 1)
        parts_h.append(mix(h + counts[which].astype(U64) * U64(0xA24BAED4963EE407)))
        parts_r.append(which)
    if not parts_h:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    h, r = np.concatenate(parts_h), np.concatenate(parts_r)
    order = np.argsort(h)
    order = order[np.argsort(r[order].astype(np.uint16) if n < 65536 else r[order], kind="stable")]
    h, r = h[order], r[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    return r[new], h[new]
