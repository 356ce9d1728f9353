"""Vectorised text primitives shared by the operators that work on Arrow batches.

Texts are treated as one byte buffer per Arrow batch, cut at document boundaries into pieces of about
``CHUNK_BYTES`` (a longer document makes a piece of its own), so memory is bounded by a few tens of bytes per
byte of the longest document and never by the batch. A hash of any span costs one subtraction and one product:
with prefix sums ``S[i] = sum(R[byte_j] * B**j for j < i)`` modulo 2**64, ``(S[e] - S[s]) * B**-s`` depends on
the span's bytes alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20
_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE2 = 0xD6E8FEB86659FD93 | 1
_cache: dict = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values in which every output bit depends on every input bit (splitmix64's finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def mix_int(x: int) -> int:
    return int(mix(np.array([x & _MASK], dtype=np.uint64))[0])


def _powers(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    have = _cache.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, CHUNK_BYTES + 4096)
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.empty(size, dtype=np.uint64)
            p[0] = 1
            done = 1
            while done < size:
                k = min(done, size - done)
                p[done : done + k] = p[:k] * np.uint64(pow(b, done, 1 << 64))
                done += k
            out.append(p)
        have = _cache[base] = (out[0], out[1])
    return have


def byte_values(seed: int, fold: dict[int, int] | None = None) -> np.ndarray:
    """A random odd 64-bit value for each byte; ``fold`` makes bytes equal to others (such as A-Z to a-z)."""
    values = mix(np.arange(1, 257, dtype=np.uint64) + np.uint64(mix_int(seed))) | np.uint64(1)
    for a, b in (fold or {}).items():
        values[a] = values[b]
    return values


LOWER = {c: c + 32 for c in range(65, 91)}


class SpanHash:
    """Hashes of spans of ``data``; equal bytes give equal hashes wherever they stand."""

    def __init__(self, data: np.ndarray, values: np.ndarray, base: int = _BASE):
        power, self.inverse = _powers(len(data) + 1, base)
        self.sums = np.empty(len(data) + 1, dtype=np.uint64)
        self.sums[0] = 0
        np.cumsum(values[data] * power[: len(data)], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (self.sums[end] - self.sums[start]) * self.inverse[start]
        return mix(h + (end - start).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))

    def windows(self, k: int) -> np.ndarray:
        """Of every span of ``k`` bytes."""
        n = len(self.sums) - k
        if n <= 0:
            return np.empty(0, dtype=np.uint64)
        return mix((self.sums[k:] - self.sums[:n]) * self.inverse[:n] + np.uint64((k * 0xA0761D6478BD642F) & _MASK))


def second_hash(data: np.ndarray) -> SpanHash:
    """A hash independent of the first; both together are 128 bits."""
    return SpanHash(data, byte_values(77), _BASE2)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its row offsets (a null counts as empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.empty(0, dtype=np.uint8)
    return raw, offsets


def pieces(column: pa.Array, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets in these bytes) of runs of rows of about ``size`` bytes."""
    raw, offsets = buffers(column)
    n, a = len(offsets) - 1, 0
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + size, side="right")) - 1
        b = min(max(b, a + 1), n, a + 60_000)
        yield a, b, raw[offsets[a] : offsets[b]], (offsets[a : b + 1] - offsets[a]).astype(np.int64)
        a = b


SPACES = np.zeros(256, dtype=bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True


def word_spans(data: np.ndarray, offsets: np.ndarray, is_space: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every maximal run of bytes that are no spaces; runs end where rows end."""
    n = len(data)
    if not n:
        e = np.empty(0, dtype=np.int64)
        return e, e, e
    word = ~is_space[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    starts = np.flatnonzero(word & (edge[:-1] | np.concatenate(([True], ~word[:-1]))))
    ends = np.flatnonzero(word & (edge[1:] | np.concatenate((~word[1:], [True])))) + 1
    return starts, ends, row_of(starts, offsets)


def row_of(positions: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The row that each byte position lies in."""
    return np.searchsorted(offsets, positions, side="right") - 1


def shingles(words: np.ndarray, rows: np.ndarray, n_rows: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``k`` words inside a row, with their rows in order; a row of 1 to k-1 words gives one for its whole sequence."""
    count = np.bincount(rows, minlength=n_rows)
    first = np.concatenate(([0], np.cumsum(count)))[:-1]
    n = len(words) - k + 1
    h = np.zeros(max(n, 0), dtype=np.uint64)
    r = rows[: max(n, 0)]
    if n > 0:
        for j in range(k):
            h = (h + words[j : j + n]) * np.uint64(_BASE)
        whole = r == rows[k - 1 :]
        h, r = mix(h[whole]), r[whole]
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        one = np.empty(len(short), dtype=np.uint64)
        for i, s in enumerate(short):
            x = mix_int(int(count[s]))
            for w in words[first[s] : first[s] + count[s]]:
                x = ((x + int(w)) * _BASE) & _MASK
            one[i] = mix_int(x)
        h, r = np.concatenate((h, one)), np.concatenate((r, short))
        order = np.argsort(r, kind="stable")
        h, r = h[order], r[order]
    return h, r


def distinct_in_rows(h: np.ndarray, r: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each row, their rows, and row bounds. ``r`` is in order."""
    bounds = np.searchsorted(r, np.arange(n_rows + 1))
    h = h.copy()
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b - a > 1:
            h[a:b].sort()
    if len(h):
        keep = np.concatenate(([True], (h[1:] != h[:-1]) | (r[1:] != r[:-1])))
        h, r = h[keep], r[keep]
    return h, r, np.searchsorted(r, np.arange(n_rows + 1))


def list_column(values: np.ndarray, bounds: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column whose row i holds ``values[bounds[i]:bounds[i + 1]]``."""
    return pa.LargeListArray.from_arrays(pa.array(bounds, pa.int64()), pa.array(values, kind)).cast(pa.list_(kind))
