"""The lattice of all ways to build a word from a vocabulary's pieces: forward and backward sums in log space."""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass, field

import numpy as np

#: Words of more bytes than this are summed one by one.
LONG = 64
_BASE = 0x9E3779B97F4A7C15


def _key(piece: bytes) -> int:
    h = 0
    for b in piece:
        h = (h * _BASE + b + 1) & 0xFFFFFFFFFFFFFFFF
    return h


@dataclass
class Lattice:
    """Pieces as bytes (with all 256 single bytes among them) and the natural logarithm of each one's probability."""

    pieces: list[bytes]
    logp: np.ndarray
    ids: dict[bytes, int] = field(init=False)
    lengths: list[int] = field(init=False)

    def __post_init__(self) -> None:
        self.ids = {p: k for k, p in enumerate(self.pieces)}
        self.lengths = sorted({len(p) for p in self.pieces})
        by_length = defaultdict(list)
        for k, p in enumerate(self.pieces):
            by_length[len(p)].append((_key(p), k))
        self._tables = {}
        for n, pairs in by_length.items():
            pairs.sort()
            self._tables[n] = (np.array([p[0] for p in pairs], dtype=np.uint64), np.array([p[1] for p in pairs], dtype=np.int64))

    def _edges(self, rows: np.ndarray) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
        """(start, end, words, pieces) of all pieces in equally long words, by start."""
        width = rows.shape[1]
        base = np.uint64(_BASE)
        out = []
        for i in range(width):
            h = np.zeros(len(rows), dtype=np.uint64)
            for j in range(i, min(width, i + self.lengths[-1])):
                h = h * base + rows[:, j] + np.uint64(1)
                if (table := self._tables.get(j - i + 1)) is None:
                    continue
                spot = np.minimum(np.searchsorted(table[0], h), len(table[0]) - 1)
                hit = np.flatnonzero(table[0][spot] == h)
                if len(hit):
                    out.append((i, j + 1, hit, table[1][spot[hit]]))
        return out

    def _batch(self, words: list[bytes], weights: np.ndarray | None, counts: np.ndarray | None) -> np.ndarray:
        rows = np.frombuffer(b"".join(words), dtype=np.uint8).reshape(len(words), -1).astype(np.uint64)
        edges = self._edges(rows)
        alpha = np.full((rows.shape[1] + 1, len(words)), -np.inf)
        alpha[0] = 0
        for i, j, w, p in edges:
            alpha[j, w] = np.logaddexp(alpha[j, w], alpha[i, w] + self.logp[p])
        if counts is not None:
            beta = np.full_like(alpha, -np.inf)
            beta[-1] = 0
            for i, j, w, p in reversed(edges):
                beta[i, w] = np.logaddexp(beta[i, w], beta[j, w] + self.logp[p])
            for i, j, w, p in edges:
                share = np.exp(alpha[i, w] + self.logp[p] + beta[j, w] - alpha[-1, w])
                counts += np.bincount(p, weights=share * weights[w], minlength=len(counts))
        return alpha[-1]

    def _single(self, word: bytes, weight: float, counts: np.ndarray | None) -> float:
        n = len(word)
        edges = [(i, i + k, p) for i in range(n) for k in self.lengths if i + k <= n and (p := self.ids.get(word[i : i + k])) is not None]
        alpha = [-np.inf] * (n + 1)
        alpha[0] = 0.0
        for i, j, p in edges:
            alpha[j] = float(np.logaddexp(alpha[j], alpha[i] + self.logp[p]))
        if counts is not None:
            beta = [-np.inf] * (n + 1)
            beta[n] = 0.0
            for i, j, p in reversed(edges):
                beta[i] = float(np.logaddexp(beta[i], beta[j] + self.logp[p]))
            for i, j, p in edges:
                counts[p] += weight * np.exp(alpha[i] + self.logp[p] + beta[j] - alpha[n])
        return alpha[n]

    def log_probability(self, words: list[bytes], weights: np.ndarray | None = None, counts: np.ndarray | None = None) -> np.ndarray:
        """Of each word, over all of its segmentations; adds the expected uses of each piece, times weights, to counts if given."""
        out = np.zeros(len(words))
        by_length = defaultdict(list)
        for k, w in enumerate(words):
            by_length[len(w)].append(k)
        for n, at in by_length.items():
            if n == 0:
                continue
            if n > LONG:
                for k in at:
                    out[k] = self._single(words[k], 1.0 if weights is None else float(weights[k]), counts)
                continue
            for first in range(0, len(at), 8192):
                some = at[first : first + 8192]
                out[some] = self._batch([words[k] for k in some], None if weights is None else weights[some], counts)
        return out
