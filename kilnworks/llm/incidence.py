"""Products of a block of the document by n-gram incidence matrix with itself, inside one task."""

from __future__ import annotations

import numpy as np

#: Entries that one step of the product gathers at most, beyond those of a single row.
STEP = 1 << 21
#: Rows that are multiplied with the whole block first, where one column holds more than CROWDED of it.
HUBS = 16
CROWDED = 64


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers from each start on, size of each, one after the other."""
    ends = np.cumsum(size)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - size - start, size)


class Block:
    """Rows (sorted distinct hashes, none empty) of the incidence matrix, and the labels of the components known so far."""

    def __init__(self, sets: list[np.ndarray], labels: np.ndarray, percent: int):
        self.percent = percent
        self.n = np.array([len(s) for s in sets], dtype=np.int64)
        self.start = np.cumsum(self.n) - self.n
        self.labels = np.unique(labels, return_inverse=True)[1]
        held, columns = np.unique(np.concatenate(sets), return_inverse=True)
        rows = np.repeat(np.arange(len(sets)), self.n)
        filled = np.bincount(columns, minlength=len(held))
        # Inside a row, columns of few rows come first: the order of all prefixes.
        self.columns = columns[np.lexsort((columns, filled[columns], rows))]
        # Linked rows share a column of both prefixes; what they share besides lies behind one of the prefixes.
        self.behind = -(-percent * self.n // 100) - 1
        self.heads = self.n - self.behind
        first = _ranges(self.start, self.heads)
        owner = np.repeat(np.arange(len(sets)), self.heads)
        known = filled[self.columns[first]] > 1
        first, owner = self.columns[first[known]], owner[known]
        order = np.argsort(first, kind="stable")
        self.holders = owner[order]
        self.spread = np.bincount(first, minlength=len(held))
        self.at = np.cumsum(self.spread) - self.spread
        self.crowded = int(filled.max()) > CROWDED
        self.marks = np.zeros(len(held), dtype=bool)
        self.weight = np.add.reduceat(filled[self.columns].astype(np.float64), self.start) / self.n

    def _hopeful(self, x: int, closed: np.ndarray) -> np.ndarray:
        """Open rows of other components whose accumulated prefix columns and sizes leave room for a link with row x, likeliest first."""
        mine = self.columns[self.start[x] : self.start[x] + self.heads[x]]
        met = np.bincount(self.holders[_ranges(self.at[mine], self.spread[mine])], minlength=len(self.n))
        met[closed | (self.labels == self.labels[x])] = 0
        rows = np.flatnonzero(met)
        most = met[rows] + np.maximum(self.behind[x], self.behind[rows])
        both = self.n[x] + self.n[rows]
        fits = 100 * np.minimum(self.n[x], self.n[rows]) >= self.percent * np.maximum(self.n[x], self.n[rows])
        rows = rows[fits & ((100 + self.percent) * most >= self.percent * both)]
        return rows[np.argsort(-met[rows], kind="stable")]

    def _multiply(self, x: int, rows: np.ndarray) -> np.ndarray:
        """Those of the rows that link with row x, by the accumulated overlap of whole rows."""
        mine = self.columns[self.start[x] : self.start[x] + self.n[x]]
        self.marks[mine] = True
        size = self.n[rows]
        shared = np.add.reduceat(self.marks[self.columns[_ranges(self.start[rows], size)]].astype(np.int64), np.cumsum(size) - size)
        self.marks[mine] = False
        return rows[100 * shared >= self.percent * (self.n[x] + size - shared)]

    def _row(self, x: int, closed: np.ndarray, out: list[tuple[int, int]]) -> None:
        """Links of row x to one row of each other component that it links with."""
        rows, few = self._hopeful(x, closed), 8
        while len(rows):
            fit = int(np.searchsorted(np.cumsum(self.n[rows]), STEP)) + 1
            few = min(few, fit)
            for y in self._multiply(x, rows[:few]).tolist():
                if self.labels[y] != self.labels[x]:
                    out.append((x, y))
                    self.labels[self.labels == self.labels[y]] = self.labels[x]
            rows = rows[few:]
            rows = rows[self.labels[rows] != self.labels[x]]
            few *= 8

    def links(self, guests: np.ndarray | None = None) -> list[tuple[int, int]]:
        """Pairs of rows that link and join all components of the block that have a link; with guests, of pairs that have one."""
        out: list[tuple[int, int]] = []
        closed = np.zeros(len(self.n), dtype=bool)
        if guests is None and self.crowded:
            for x in np.argsort(-self.weight, kind="stable")[:HUBS].tolist():
                self._row(x, closed, out)
        # Of two components, one is not the largest: its rows are enough to find what joins them.
        largest = np.argmax(np.bincount(self.labels))
        rest = np.flatnonzero(self.labels != largest) if guests is None else np.flatnonzero(guests)
        for x in rest.tolist():
            self._row(x, closed, out)
            closed[x] = True
        return out
