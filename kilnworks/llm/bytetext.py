"""Texts of an Arrow column as one byte array, with word and shingle hashes computed for all of it at once.

Hashes are polynomials over the bytes modulo 2**64, taken from prefix sums, then mixed; equal words have equal
hashes in every task. White space and the letters A-Z are ASCII, so bytes and code points give the same words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_PLACES = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], dtype=np.uint64)
_WORD = np.ones(256, dtype=bool)
_WORD[[0x20, *range(0x09, 0x0E)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """BASE (or its inverse) to the powers 0 to n."""
    key = "inverse" if inverse else "plain"
    if key not in _powers or len(_powers[key]) <= n:
        size = max(n + 1, 1 << 21)
        x = np.full(size, _INVERSE if inverse else BASE, dtype=np.uint64)
        x[0] = 1
        _powers[key] = np.cumprod(x, dtype=np.uint64)
    return _powers[key]


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """Sums of the weighted bytes before each position; one more entry than bytes."""
    out = np.empty(len(data) + 1, dtype=np.uint64)
    out[0] = 0
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(len(data))[: len(data)], out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Unmixed hashes of the bytes from start to end; equal strings have equal hashes wherever they stand."""
    return (prefix[end] - prefix[start]) * powers(len(prefix), inverse=True)[start]


def blocks(texts: pa.Array, max_bytes: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of runs of rows, null as empty; a longer text is a run of its own."""
    texts = texts.cast(pa.large_string()).fill_null("")
    _, at, data = texts.buffers()
    at = np.frombuffer(at, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(at, at[first] + max_bytes, side="right")) - 1)
        yield first, last, data[at[first] : at[last]], at[first : last + 1] - at[first]
        first = last


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case."""
    return _LOWER[data]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of each word."""
    inside = _WORD[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    before, after = np.zeros(len(data) + 1, dtype=bool), np.zeros(len(data) + 1, dtype=bool)
    before[1:], after[:-1] = inside, inside
    starts = np.flatnonzero(after & (~before | edge))
    ends = np.flatnonzero(before & (~after | edge))
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return mix(span_hashes(prefix_hashes(data), starts, ends) + (ends - starts).astype(np.uint64) * _PLACES[0])


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = 5) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its runs of `size` words; of all its words, if it has fewer; none without words."""
    starts, ends, doc = word_spans(data, offsets)
    h = word_hashes(data, starts, ends)
    n = max(0, len(h) - size + 1)
    total = np.zeros(n, dtype=np.uint64)
    for k in range(size):
        total += h[k : k + n] * _PLACES[k]
    runs = mix(total)
    first = np.searchsorted(doc, np.arange(len(offsets)))
    out = []
    for k in range(len(offsets) - 1):
        a, b = int(first[k]), int(first[k + 1])
        if b - a >= size:
            out.append(np.unique(runs[a : b - size + 1]))
        elif b > a:
            few = h[a:b] * _PLACES[: b - a]
            out.append(mix(few.sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out
