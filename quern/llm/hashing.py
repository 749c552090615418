"""Vectorised word hashes over the bytes of an Arrow text column."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

U = np.uint64
_RNG = np.random.default_rng(20240229)
LETTER = _RNG.integers(0, 1 << 63, 256, dtype=U) * U(2) + U(1)
P = U(0x9E3779B97F4A7C15)
P_INV = U(pow(int(P), -1, 1 << 64))
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_POWERS: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(33))) * U(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> U(29))) * U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U(32))


def powers(n: int) -> list[np.ndarray]:
    if len(_POWERS[0]) < n:
        size = max(n, 1 << 20)
        for i, p in enumerate((P, P_INV)):
            a = np.full(size, p, U)
            a[0] = 1
            _POWERS[i] = np.cumprod(a, dtype=U)
    return _POWERS


def prefix(data: np.ndarray) -> np.ndarray:
    """c with (c[j] - c[i]) * P**-i a hash of data[i:j]."""
    c = np.zeros(len(data) + 1, U)
    np.cumsum(LETTER[data] * powers(len(data) + 1)[0][: len(data)], out=c[1:])
    return c


def spans(c: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return (c[end] - c[start]) * powers(len(c))[1][start]


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, n + 1 offsets) of a string or binary Arrow array; nulls are empty."""
    import pyarrow as pa

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = column.type in (pa.large_string(), pa.large_binary())
    _, offs, data = column.buffers()
    n = len(column)
    if not n or offs is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    o = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    d = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return d[o[0] : o[-1]], o - o[0]


def slices(offsets: np.ndarray, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``limit`` bytes together, a longer text on its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(n, max(j, i + 1))
        yield i, j
        i = j


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, hashes, first word of each text, with the number of all at the end)."""
    n = len(data)
    word = ~SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    start = np.flatnonzero(word & (edge[:n] | np.concatenate(([True], ~word[:-1]))))
    end = np.flatnonzero(word & (edge[1:] | np.concatenate((~word[1:], [True])))) + 1
    h = mix(spans(prefix(data), start, end) + (end - start).astype(U) * P)
    return start, end, h, np.searchsorted(start, offsets)


def shingles(h: np.ndarray, first: np.ndarray, size: int) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of its runs of ``size`` words; with fewer words, the whole sequence as one."""
    n = len(h)
    acc = h.copy()
    for k in range(1, size):
        acc[: n - k] = mix(acc[: n - k] * P + h[k:])
    out = []
    for a, b in zip(first[:-1], first[1:]):
        if b - a >= size:
            out.append(np.unique(acc[a : b - size + 1]))
        elif b > a:
            whole = h[a : a + 1].copy()
            for k in range(a + 1, b):
                whole = mix(whole * P + h[k : k + 1])
            out.append(mix(whole + U(b - a)))
        else:
            out.append(h[:0])
    return out
