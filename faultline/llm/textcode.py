"""Vectorized fingerprints of words, shingles and byte windows.

An Arrow string column is one byte buffer with offsets, so words, shingles and
windows of a whole batch are found with array operations and no loop over texts.
A fingerprint is 64 bits wide: a polynomial over random byte values modulo 2**64,
read off prefix sums, then mixed. Two different strings share one with a chance of
about 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: bytes of text handled at once inside a task; a longer text is handled alone
CHUNK_BYTES = 1 << 21

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)
_BASE = int(_rng.integers(1, 1 << 61)) * 8 + 3
_BASE_INV = pow(_BASE, -1, 1 << 64)
_STEP = int(_rng.integers(1, 1 << 61)) * 8 + 5

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_powers: tuple[np.ndarray, np.ndarray] | None = None


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose every output bit depends on every input bit."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i for i < n, kept between calls."""
    global _powers
    if _powers is None or len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES + 1)
        out = []
        for b in (_BASE, _BASE_INV):
            p = np.full(size, b, U64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        if n > 4 * CHUNK_BYTES:
            return out[0], out[1]
        _powers = (out[0], out[1])
    return _powers


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows (null: empty)."""
    col = column.cast(pa.large_binary())
    if col.null_count:
        col = col.fill_null(b"")
    offs = np.frombuffer(col.buffers()[1], np.int64)[col.offset:col.offset + len(col) + 1]
    data = col.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0]:offs[-1]], offs - offs[0]


def pieces(data: np.ndarray, offs: np.ndarray, limit: int = CHUNK_BYTES
           ) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole rows of about ``limit`` bytes: first row, end row, bytes, offsets."""
    n, at = len(offs) - 1, 0
    while at < n:
        end = int(np.searchsorted(offs, offs[at] + limit, "right")) - 1
        end = min(max(end, at + 1), n)
        yield at, end, data[offs[at]:offs[end]], offs[at:end + 1] - offs[at]
        at = end


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case."""
    return _LOWER[data]


def ragged(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[i], first[i] + 1, ... (count[i] of them) for every i, one after the other."""
    return np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())


def prefix_sums(data: np.ndarray) -> np.ndarray:
    h = np.empty(len(data) + 1, U64)
    h[0] = 0
    np.cumsum(_BYTE[data] * powers(len(data) + 1)[0][:len(data)], out=h[1:])
    return h


def span_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Fingerprints of data[start:end] for arrays of starts and ends."""
    inv = powers(len(sums))[1]
    return mix((sums[end] - sums[start]) * inv[start] + (end - start).astype(U64))


def word_spans(data: np.ndarray, offs: np.ndarray, outside: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs of bytes that are not ``outside``: ASCII white
    space by default) and the row of each."""
    inside = ~outside[data]
    before = np.empty_like(inside)
    before[:1] = False
    before[1:] = inside[:-1]
    edges = offs[:-1][offs[:-1] < len(data)]
    before[edges] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1:] = False
    after[:-1] = inside[1:]
    edges = offs[1:][offs[1:] > 0] - 1
    after[edges] = False
    ends = np.flatnonzero(inside & ~after) + 1
    rows = np.searchsorted(offs, starts, "right") - 1
    return starts, ends, rows


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of the words, A-Z lower-cased, and the number of words of each row."""
    starts, ends, rows = word_spans(data, offs)
    sums = prefix_sums(_LOWER[data])
    return span_hashes(sums, starts, ends), np.bincount(rows, minlength=len(offs) - 1)


def shingles(word: np.ndarray, count: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of the k-word windows of each row, in order, and their number. A row
    with fewer words has its whole word sequence as one; a row without words has none."""
    n = np.where(count >= k, count - k + 1, (count > 0).astype(count.dtype))
    first = np.repeat(np.cumsum(count) - count - (np.cumsum(n) - n), n) + np.arange(n.sum())
    width = np.repeat(np.minimum(count, k), n)
    out = width.astype(U64)
    factor = 1
    padded = np.concatenate([word, np.zeros(k, U64)])
    for i in range(k):
        out = out + np.where(width > i, padded[first + i] * U64(factor), U64(0))
        factor = factor * _STEP % (1 << 64)
    return mix(out), n


def distinct_by_row(value: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each row in ascending order, and their number."""
    rows = np.repeat(np.arange(len(count)), count)
    order = np.lexsort((value, rows))
    v, r = value[order], rows[order]
    keep = np.ones(len(v), bool)
    keep[1:] = (v[1:] != v[:-1]) | (r[1:] != r[:-1])
    return v[keep], np.bincount(r[keep], minlength=len(count))
