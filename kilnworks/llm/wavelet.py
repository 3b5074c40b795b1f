"""A wavelet matrix of token ids in one compressed file.

Plane k holds bit k of every id (the highest first), in the order that stable partitions by the planes before leave:
zeros first, then ones. A plane is cut into blocks of BLOCK bits, each compressed on its own; the directory has, for each
block, its place in the file and the ones before it. Any id, the count of an id up to a place, and the place of its k-th
occurrence therefore take one block of each plane, whatever the size of the file.

Layout, little-endian: HEAD; for each plane its zeros, then for each block (ones before, offset, size); the blocks; the
documents (ids, null marks and lengths), compressed. A block whose size is its plain size is stored plain.
"""

from __future__ import annotations

import struct
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import zstandard

MAGIC = b"KWMX"
VERSION = 1
#: magic, version, planes, ids, documents, offset and size of the documents' part.
HEAD = struct.Struct("<4sHHQQQQ")
ENTRY = np.dtype([("ones", "<u8"), ("offset", "<u8"), ("size", "<u4")])
BLOCK = 1 << 18


def planes_of(ids: np.ndarray, width: int) -> tuple[list[np.ndarray], list[int]]:
    """The packed bits of each plane, and how many are zero."""
    planes, zeros = [], []
    for k in range(width - 1, -1, -1):
        bits = (ids >> ids.dtype.type(k)) & ids.dtype.type(1) != 0
        planes.append(np.packbits(bits, bitorder="little"))
        low = np.flatnonzero(~bits)  # places are much faster than masks
        zeros.append(len(low))
        ids = np.concatenate([ids[low], ids[np.flatnonzero(bits)]])
    return planes, zeros


def ids_of(planes: list[np.ndarray], n: int, dtype: type = np.uint32) -> np.ndarray:
    """The ids again: the partitions are undone from the last plane to the first."""
    ids = np.zeros(n, dtype=dtype)
    for k, plane in enumerate(reversed(planes)):
        bits = np.unpackbits(plane, count=n, bitorder="little").view(bool)
        before, low = np.empty_like(ids), np.flatnonzero(~bits)
        before[low] = ids[: len(low)]
        before[np.flatnonzero(bits)] = ids[len(low) :] | dtype(1 << k)
        ids = before
    return ids


def encode(ids: np.ndarray, doc_ids: list[int | None], lengths: np.ndarray, width: int, level: int = 1) -> bytes:
    """The bytes of a file of ids (all below 2 ** width), of which documents hold `lengths` each, in their order."""
    press = zstandard.ZstdCompressor(level=level)
    planes, zeros = planes_of(ids, width)
    blocks_each = -(-len(ids) // BLOCK)
    at = HEAD.size + width * (8 + blocks_each * ENTRY.itemsize)
    directory, blocks = [], []
    for plane, low in zip(planes, zeros, strict=True):
        table, ones = np.zeros(blocks_each, dtype=ENTRY), 0
        for b in range(blocks_each):
            plain = plane[b * BLOCK // 8 : (b + 1) * BLOCK // 8]
            block = press.compress(plain.tobytes())
            if len(block) >= len(plain):
                block = plain.tobytes()
            table[b] = ones, at, len(block)
            ones += int(np.bitwise_count(plain).sum())
            at += len(block)
            blocks.append(block)
        directory.append(struct.pack("<Q", low) + table.tobytes())
    nulls = np.packbits(np.array([x is None for x in doc_ids], dtype=bool), bitorder="little")
    numbers = np.array([x or 0 for x in doc_ids], dtype="<i8")
    documents = press.compress(np.diff(numbers, prepend=np.int64(0)).tobytes() + np.asarray(lengths, dtype="<u8").tobytes() + nulls.tobytes())
    head = HEAD.pack(MAGIC, VERSION, width, len(ids), len(doc_ids), at, len(documents))
    return b"".join([head, *directory, *blocks, documents])


class WaveletFile:
    """Reads a file piece by piece; `read(offset, size)` gives its bytes."""

    def __init__(self, read: Callable[[int, int], bytes], remembered: int = 256) -> None:
        self._read = read
        magic, version, self.width, self.n, self.docs, self._docs_at, self._docs_size = HEAD.unpack(read(0, HEAD.size))
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a wavelet file of this version")
        each = -(-self.n // BLOCK)
        size = 8 + each * ENTRY.itemsize
        directory = read(HEAD.size, self.width * size)
        self.zeros = [struct.unpack_from("<Q", directory, p * size)[0] for p in range(self.width)]
        self._tables = [np.frombuffer(directory, ENTRY, each, p * size + 8) for p in range(self.width)]
        self._block = lru_cache(remembered)(self._unpacked)

    @classmethod
    def of(cls, data: bytes) -> WaveletFile:
        return cls(lambda offset, size: data[offset : offset + size])

    def _unpacked(self, plane: int, block: int) -> np.ndarray:
        """The bytes of one block."""
        _, offset, size = (int(x) for x in self._tables[plane][block])
        plain, data = -(-min(BLOCK, self.n - block * BLOCK) // 8), self._read(offset, size)
        return np.frombuffer(data if size == plain else zstandard.ZstdDecompressor().decompress(data, max_output_size=plain), np.uint8)

    def _ones(self, plane: int, i: int) -> int:
        """Ones among the first i bits of a plane."""
        if i >= self.n:
            return self.n - self.zeros[plane]
        block, bit = divmod(i, BLOCK)
        data = self._block(plane, block)
        part = int(np.bitwise_count(data[: bit // 8]).sum()) + (int(data[bit // 8]) & (1 << bit % 8) - 1).bit_count()
        return int(self._tables[plane][block]["ones"]) + part

    def _bit(self, plane: int, i: int) -> int:
        block, bit = divmod(i, BLOCK)
        return int(self._block(plane, block)[bit // 8]) >> bit % 8 & 1

    def _place(self, plane: int, bit: int, k: int) -> int:
        """The place of the k-th one (or zero), from 0, of a plane."""
        table = self._tables[plane]
        ones = table["ones"].astype(np.int64)
        before = ones if bit else np.arange(len(table), dtype=np.int64) * BLOCK - ones
        block = int(np.searchsorted(before, k, side="right")) - 1
        count = min(BLOCK, self.n - block * BLOCK)
        bits = np.unpackbits(self._block(plane, block), count=count, bitorder="little")
        return block * BLOCK + int(np.flatnonzero(bits == bit)[k - int(before[block])])

    def access(self, i: int) -> int:
        """The id at place i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for p in range(self.width):
            bit, ones = self._bit(p, i), self._ones(p, i)
            value = value << 1 | bit
            i = self.zeros[p] + ones if bit else i - ones
        return value

    def _range(self, token: int, start: int, stop: int) -> tuple[int, int]:
        """Where the occurrences of a token between two places stand below the last plane."""
        for p in range(self.width):
            a, b = self._ones(p, start), self._ones(p, stop)
            start, stop = (self.zeros[p] + a, self.zeros[p] + b) if token >> self.width - 1 - p & 1 else (start - a, stop - b)
        return start, stop

    def count(self, token: int, start: int = 0, stop: int | None = None) -> int:
        """Occurrences of a token from place start to place stop."""
        if not 0 <= token < 1 << self.width:
            return 0
        stop = self.n if stop is None else min(stop, self.n)
        a, b = self._range(token, min(max(start, 0), stop), stop)
        return b - a

    def select(self, token: int, k: int) -> int:
        """The place of the k-th occurrence, from 0, of a token."""
        if not 0 <= k < self.count(token):
            raise IndexError(k)
        return self._up(token, self._range(token, 0, self.n)[0] + k)

    def _up(self, token: int, i: int) -> int:
        for p in range(self.width - 1, -1, -1):
            bit = token >> self.width - 1 - p & 1
            i = self._place(p, bit, i - self.zeros[p] if bit else i)
        return i

    def occurrences(self, token: int, start: int = 0, stop: int | None = None) -> list[int]:
        """The places of a token from place start to place stop."""
        if not 0 <= token < 1 << self.width:
            return []
        stop = self.n if stop is None else min(stop, self.n)
        a, b = self._range(token, min(max(start, 0), stop), stop)
        return [self._up(token, i) for i in range(a, b)]

    def tokens(self) -> np.ndarray:
        """All ids."""
        planes = [np.concatenate([self._unpacked(p, b) for b in range(len(self._tables[p]))] or [np.zeros(0, np.uint8)]) for p in range(self.width)]
        return ids_of(planes, self.n, np.uint16 if self.width <= 16 else np.uint32)

    def documents(self) -> tuple[list[int | None], np.ndarray]:
        """Ids of the documents, and how many token ids each has."""
        data = zstandard.ZstdDecompressor().decompress(self._read(self._docs_at, self._docs_size), max_output_size=17 * self.docs + 8)
        numbers = np.cumsum(np.frombuffer(data, "<i8", self.docs), dtype=np.int64)
        lengths = np.frombuffer(data, "<u8", self.docs, 8 * self.docs).astype(np.int64)
        nulls = np.unpackbits(np.frombuffer(data, np.uint8, -1, 16 * self.docs), count=self.docs, bitorder="little")
        return [None if z else int(x) for x, z in zip(numbers, nulls, strict=True)], lengths
