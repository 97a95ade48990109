"""A wavelet matrix over token ids: bit planes with rank and select, kept in one compressed file per shard.

File: magic, a JSON header (lengths, zeros per plane, compressed sizes), the table of document ids and token
counts, then the planes from the highest bit down, each compressed by itself. Rank directories are rebuilt
on reading (one cumulative count per 64 bits).
"""

from __future__ import annotations

import json
import struct

import numpy as np
import zstandard

MAGIC = b"WVMX1\n"


class WaveletMatrix:
    """Access, rank, select and counting over a sequence of ids, from its bit planes alone."""

    def __init__(self, n: int, planes: list[np.ndarray], zeros: list[int]):
        self.n, self.planes, self.zeros = n, planes, zeros
        self._ranks: list[np.ndarray | None] = [None] * len(planes)

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        ids = np.ascontiguousarray(ids, dtype=np.uint32)
        levels = max(1, int(ids.max()).bit_length()) if len(ids) else 1
        work = ids.astype(np.uint16) if levels <= 16 else ids
        planes, zeros = [], []
        for k in range(levels - 1, -1, -1):
            bit = (work & work.dtype.type(1 << k)).astype(bool)
            planes.append(np.packbits(bit, bitorder="little"))
            low, high = np.flatnonzero(~bit), np.flatnonzero(bit)  # positions: much faster than masks on random bits
            zeros.append(len(low))
            work = np.concatenate([work.take(low), work.take(high)])
        return cls(len(ids), planes, zeros)

    def _directory(self, level: int) -> np.ndarray:
        if (found := self._ranks[level]) is None:
            p = self.planes[level]
            words = np.frombuffer(p.tobytes() + bytes(-len(p) % 8), dtype="<u8")
            found = self._ranks[level] = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])
        return found

    def _bit(self, level: int, i: int) -> int:
        return int(self.planes[level][i >> 3]) >> (i & 7) & 1

    def _rank1(self, level: int, i: int) -> int:
        """Ones before position i."""
        w, rest = divmod(i, 64)
        r = int(self._directory(level)[w])
        if rest:
            word = int.from_bytes(self.planes[level][w * 8 : w * 8 + 8].tobytes(), "little")
            r += (word & ((1 << rest) - 1)).bit_count()
        return r

    def _select(self, level: int, bit: int, j: int) -> int:
        """Position of the j-th (from 0) such bit."""
        ones = self._directory(level)
        counts = ones if bit else np.arange(len(ones), dtype=np.int64) * 64 - ones
        w = int(np.searchsorted(counts, j, side="right")) - 1
        word = int.from_bytes(self.planes[level][w * 8 : w * 8 + 8].tobytes(), "little")
        left = j - int(counts[w])
        for i in range(64):
            if word >> i & 1 == bit:
                if left == 0:
                    return w * 64 + i
                left -= 1
        raise IndexError(j)

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for level, z in enumerate(self.zeros):
            bit, ones = self._bit(level, i), self._rank1(level, i)
            value = value << 1 | bit
            i = z + ones if bit else i - ones
        return value

    def _range(self, value: int, start: int, stop: int) -> tuple[int, int]:
        levels = len(self.planes)
        if value < 0 or value >> levels:
            return 0, 0
        for level, z in enumerate(self.zeros):
            a, b = self._rank1(level, start), self._rank1(level, stop)
            start, stop = (z + a, z + b) if value >> (levels - 1 - level) & 1 else (start - a, stop - b)
        return start, stop

    def count(self, value: int, start: int = 0, stop: int | None = None) -> int:
        """Occurrences of value in [start, stop)."""
        a, b = self._range(value, start, self.n if stop is None else stop)
        return b - a

    def select(self, value: int, j: int) -> int:
        """Position of the j-th (from 0) occurrence of value."""
        a, b = self._range(value, 0, self.n)
        if not 0 <= j < b - a:
            raise IndexError(j)
        i, levels = a + j, len(self.planes)
        for level in range(levels - 1, -1, -1):
            bit = value >> (levels - 1 - level) & 1
            i = self._select(level, bit, i - self.zeros[level] if bit else i)
        return i

    def ids(self) -> np.ndarray:
        """All ids, by undoing the planes from the lowest."""
        kind = np.uint16 if len(self.planes) <= 16 else np.uint32
        out = np.zeros(self.n, dtype=kind)
        for level in range(len(self.planes) - 1, -1, -1):
            bit = np.unpackbits(self.planes[level], count=self.n, bitorder="little").view(bool)
            up, z = np.empty(self.n, dtype=kind), self.zeros[level]
            up[np.flatnonzero(~bit)] = out[:z]
            up[np.flatnonzero(bit)] = out[z:] | kind(1 << (len(self.planes) - 1 - level))
            out = up
        return out.astype(np.uint32)


def dump(ids: np.ndarray, doc_ids: list[int | None], counts: list[int]) -> bytes:
    """One shard as bytes."""
    m = WaveletMatrix.build(ids)
    z = zstandard.ZstdCompressor(level=1)
    planes = [z.compress(p.tobytes()) for p in m.planes]
    docs = z.compress(np.array([x or 0 for x in doc_ids], "<i8").tobytes() + np.array(counts, "<i8").tobytes() + bytes(x is None for x in doc_ids))
    head = json.dumps({"n": m.n, "docs": len(doc_ids), "zeros": m.zeros, "sizes": [len(docs), *map(len, planes)]}).encode()
    return b"".join([MAGIC, struct.pack("<I", len(head)), head, docs, *planes])


def load(data: bytes) -> tuple[WaveletMatrix, list[int | None], np.ndarray]:
    """The matrix, the document ids and their token counts of one shard."""
    if data[: len(MAGIC)] != MAGIC:
        raise ValueError("not a wavelet matrix file")
    at = len(MAGIC) + 4
    (size,) = struct.unpack("<I", data[at - 4 : at])
    head, at, parts = json.loads(data[at : at + size]), at + size, []
    z = zstandard.ZstdDecompressor()
    for k in head["sizes"]:
        parts.append(z.decompress(data[at : at + k]))
        at += k
    d = head["docs"]
    doc_ids, counts = np.frombuffer(parts[0][: 8 * d], "<i8"), np.frombuffer(parts[0][8 * d : 16 * d], "<i8")
    ids = [None if missing else int(x) for x, missing in zip(doc_ids, parts[0][16 * d :], strict=True)]
    return WaveletMatrix(head["n"], [np.frombuffer(p, np.uint8) for p in parts[1:]], head["zeros"]), ids, counts
