"""Suffix arrays of byte segments in numpy, with common prefixes, and binary search between two of them."""

from __future__ import annotations

import numpy as np


class Shard:
    """The suffixes of some byte segments in order. A suffix ends with its segment; equal ones stand in order of segment."""

    def __init__(self, segments: list[bytes]) -> None:
        self.data = np.frombuffer(b"".join(segments), dtype=np.uint8)
        lengths = np.array([len(s) for s in segments], dtype=np.int64)
        self.ends = np.cumsum(lengths)
        self.starts = self.ends - lengths
        self.segment = np.repeat(np.arange(len(segments)), lengths)
        self.left = np.repeat(self.ends, lengths) - np.arange(len(self.data))  # bytes up to the segment's end
        self.order = self._sort()

    def _sort(self) -> np.ndarray:
        """Larsson-Sadakane: groups of equal prefixes are refined by the rank of what follows, doubling its distance."""
        n = len(self.data)
        at = np.arange(n)
        key = np.zeros(n, dtype=np.int64)
        for k in range(7):  # seven symbols of nine bits; none where the segment has ended
            inside = self.left > k
            key = (key << 9) | np.where(inside, self.data[np.minimum(at + k, n - 1)].astype(np.int64) + 1, 0)
        order = np.argsort(key, kind="stable")
        rank = np.empty(n, dtype=np.int64)
        rank[order] = self._firsts(key[order])  # a group's rank is the place of its first
        segments, h = len(self.starts), 7
        open_ = self._open(order, rank)
        while len(open_):
            # A suffix that has ended within h symbols equals the others of its group, so segments decide.
            ended = self.left[open_] <= h
            second = np.where(ended, self.segment[open_], rank[np.minimum(open_ + h, n - 1)] + segments)
            both = rank[open_] * (n + segments + 1) + second
            by = np.argsort(both, kind="stable")
            open_, both = open_[by], both[by]
            group = rank[open_]
            rank[open_] = group + self._firsts(both) - self._firsts(group)
            open_ = self._open(open_, rank)
            h *= 2
        order = np.empty(n, dtype=np.int64)
        order[rank] = at
        self.rank = rank
        return order

    @staticmethod
    def _firsts(keys: np.ndarray) -> np.ndarray:
        """Of sorted keys, the place of the first equal one."""
        new = np.ones(len(keys), dtype=bool)
        new[1:] = keys[1:] != keys[:-1]
        return np.maximum.accumulate(np.where(new, np.arange(len(keys)), 0))

    @staticmethod
    def _open(order: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """Those in groups of two or more, in order."""
        r = rank[order]
        same = np.zeros(len(order), dtype=bool)
        same[1:] = r[1:] == r[:-1]
        same[:-1] |= same[1:]
        return order[same]

    def common_prefixes(self, cap: int) -> np.ndarray:
        """Bytes that each suffix, by place in order, shares with the one before it, up to cap.

        Kasai's scan: going from one position to the next loses at most one byte of the common prefix. All segments
        are scanned in step.
        """
        n = len(self.data)
        before = np.full(n, -1, dtype=np.int64)
        before[self.order[1:]] = self.order[:-1]
        out = np.zeros(n, dtype=np.int64)
        longest = int((self.ends - self.starts).max(initial=0))
        have = np.zeros(len(self.starts), dtype=np.int64)
        live = np.arange(len(self.starts))
        for step in range(longest):
            live = live[self.starts[live] + step < self.ends[live]]
            here = self.starts[live] + step
            there = before[here]
            h = np.where(there >= 0, np.maximum(have[live] - 1, 0), 0)
            most = np.where(there >= 0, np.minimum(np.minimum(self.left[here], self.left[np.maximum(there, 0)]), cap), 0)
            going = np.flatnonzero(h < most)
            while len(going):
                equal = self.data[here[going] + h[going]] == self.data[there[going] + h[going]]
                going = going[equal]
                h[going] += 1
                going = going[h[going] < most[going]]
            have[live] = h
            out[self.rank[here]] = h
        return out

    def repeated(self, size: int) -> np.ndarray:
        """Whether the `size` bytes at each position, all inside its segment, stand at another position too."""
        shared = self.common_prefixes(size) >= size
        fits = self.left[self.order] >= size
        shared &= fits
        hit = shared.copy()
        hit[:-1] |= shared[1:]
        out = np.zeros(len(self.data), dtype=bool)
        out[self.order[hit]] = True
        return out

    def windows(self, at: np.ndarray, size: int) -> np.ndarray:
        """The `size` bytes at some positions, as one array of fixed-width strings."""
        return np.lib.stride_tricks.sliding_window_view(self.data, size)[at].copy().view(f"S{size}").ravel()

    def also_in(self, other: Shard, size: int, step: int = 20_000) -> tuple[np.ndarray, np.ndarray]:
        """Positions of this shard, and of the other, whose `size` bytes stand in both: binary search in the other's order."""
        mine, theirs = (s.order[s.left[s.order] >= size] for s in (self, other))
        mine_hit, theirs_hit = np.zeros(len(self.data), dtype=bool), np.zeros(len(other.data), dtype=bool)
        for first in range(0, len(mine), step):
            at = mine[first : first + step]
            keys = self.windows(at, size)
            low, high = np.zeros(len(at), dtype=np.int64), np.full(len(at), len(theirs), dtype=np.int64)
            while (open_ := low < high).any():
                k = np.flatnonzero(open_)
                mid = (low[k] + high[k]) // 2
                less = other.windows(theirs[mid], size) < keys[k]
                low[k] = np.where(less, mid + 1, low[k])
                high[k] = np.where(less, high[k], mid)
            k = np.flatnonzero(low < len(theirs))
            k = k[other.windows(theirs[low[k]], size) == keys[k]] if len(k) else k
            mine_hit[at[k]] = True
            while len(k):  # all equal ones of the other shard
                theirs_hit[theirs[low[k]]] = True
                low[k] += 1
                k = k[low[k] < len(theirs)]
                k = k[~theirs_hit[theirs[low[k]]]]
                k = k[other.windows(theirs[low[k]], size) == keys[k]] if len(k) else k
        return mine_hit, theirs_hit
