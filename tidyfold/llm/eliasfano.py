"""Elias-Fano sequences and a three-level n-gram trie of them, as flat arrays that can be mapped from a file."""

from __future__ import annotations

import os
import tempfile

import numpy as np

_ONES = np.array([bin(b).count("1") for b in range(256)], dtype=np.uint8)
_SELECT = np.full((256, 8), 8, dtype=np.uint8)  # place of the k-th one of a byte
for _b in range(256):
    for _k, _p in enumerate(p for p in range(8) if _b >> p & 1):
        _SELECT[_b, _k] = _p


def _narrow(bits: int):
    return np.uint8 if bits <= 8 else np.uint16 if bits <= 16 else np.uint32 if bits <= 32 else np.uint64


class EliasFano:
    """A non-decreasing sequence below `universe`: low bits as they are, high parts in unary with select samples."""

    def __init__(self, low: np.ndarray, high: np.ndarray, zeros: np.ndarray, shift: int, n: int):
        self.low, self.high, self.zeros, self.shift, self.n = low, high, zeros, np.uint64(shift), n
        self.ones = np.arange(len(zeros), dtype=np.int64) * 64 - zeros.astype(np.int64)  # before each sample, as `zeros` counts zeros

    @classmethod
    def build(cls, values: np.ndarray, universe: int) -> EliasFano:
        n = len(values)
        shift = max(0, int(universe // max(n, 1)).bit_length() - 1)
        values = values.astype(np.uint64)
        low = (values & np.uint64((1 << shift) - 1)).astype(_narrow(shift))
        part = (values >> np.uint64(shift)).astype(np.int64)
        length = n + (universe >> shift) + 2
        bits = np.zeros((length + 7) // 8 * 8, dtype=np.uint8)
        bits[part + np.arange(n)] = 1
        high = np.packbits(bits, bitorder="little")
        zeros = np.concatenate([[0], np.cumsum(8 - _ONES[high].astype(np.int64))])[::8].astype(np.uint64 if length > 2**32 else np.uint32)
        return cls(low, high, zeros, shift, n)

    def arrays(self) -> list[np.ndarray]:
        return [self.low, self.high, self.zeros]

    def _select(self, k: np.ndarray, zeros: bool) -> np.ndarray:
        """Places of the k-th zeros, or ones, (from 0) of the high bits."""
        before = self.zeros if zeros else self.ones
        word = np.searchsorted(before, k.astype(before.dtype), side="right") - 1
        left = k - before[word].astype(np.int64)
        byte = word * 8
        open_ = np.ones(len(k), dtype=bool)
        for _ in range(8):
            have = _ONES[self.high[np.minimum(byte, len(self.high) - 1)]].astype(np.int64)
            have = 8 - have if zeros else have
            open_ &= left >= have
            if not open_.any():
                break
            left = np.where(open_, left - have, left)
            byte = np.where(open_, byte + 1, byte)
        return byte * 8 + _SELECT[255 - self.high[byte] if zeros else self.high[byte], left]

    def _select_zero(self, k: np.ndarray) -> np.ndarray:
        return self._select(k, True)

    def bucket(self, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The range of entries whose high part is `part`."""
        first = np.where(part > 0, self._select_zero(np.maximum(part - 1, 0)) + 1 - part, 0)
        return first, self._select_zero(part) - part

    def get(self, at: np.ndarray) -> np.ndarray:
        """Entries by place: how far the at-th one of the high bits has moved, and the low bits."""
        part = self._select(at, False) - at
        return (part.astype(np.uint64) << self.shift) | self.low[at].astype(np.uint64)

    def successor(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each key the place of the first entry not below it within its bucket's end, and whether it is the key itself."""
        keys = keys.astype(np.uint64)
        start, stop = self.bucket((keys >> self.shift).astype(np.int64))
        want = (keys & np.uint64((1 << int(self.shift)) - 1)).astype(self.low.dtype)
        low, high = start.copy(), stop.copy()
        while (low < high).any():
            middle = (low + high) // 2
            less = (low < high) & (self.low[np.minimum(middle, self.n - 1)] < want)
            low, high = np.where(less, middle + 1, low), np.where(less | (low >= high), high, middle)
        inside = low < stop
        return low, inside & (self.low[np.minimum(low, max(self.n - 1, 0))] == want) if self.n else inside


class Mapped:
    """Arrays laid out in one file and mapped from it; the file goes with this object."""

    def __init__(self, arrays: list[np.ndarray]):
        handle, path = tempfile.mkstemp(prefix="trie-")
        places = []
        with os.fdopen(handle, "wb") as out:
            for a in arrays:
                out.write(b"\0" * (-out.tell() % 8))
                places.append((out.tell(), a.dtype, a.shape))
                out.write(np.ascontiguousarray(a).tobytes())
            out.write(b"\0" * 8)
        whole = np.memmap(path, dtype=np.uint8, mode="r")
        os.unlink(path)  # the mapping keeps it as long as it is used
        self.arrays = [np.frombuffer(whole, dtype=d, count=int(np.prod(s)), offset=o).reshape(s) for o, d, s in places]


#: Steps of a tenfold, of 16-bit codes of logarithms; the last code is "nothing".
STEPS, NOTHING = 4095, 65535


def coded(x: np.ndarray) -> np.ndarray:
    """Probabilities as 16-bit codes of their logarithms, 1e-16 the least."""
    with np.errstate(divide="ignore"):
        return np.where(x > 0, np.minimum(np.rint(-np.log10(x) * STEPS), NOTHING - 1), NOTHING).astype(np.uint16)


_DECODED = np.append(10.0 ** (-np.arange(NOTHING) / STEPS), 0.0)


def decoded(codes: np.ndarray) -> np.ndarray:
    return _DECODED[codes]


class Level:
    """Children of the nodes above, each with codes.

    `pointers` is where each parent's children begin. A parent's children are
    made monotone by adding one more than the last child of the parents before,
    so a child is found relative to its parent: by its range, and by what stands
    before the range.
    """

    def __init__(self, pointers: EliasFano, nodes: EliasFano, codes: list[np.ndarray]):
        self.pointers, self.nodes, self.codes = pointers, nodes, codes

    @classmethod
    def plan(cls, parents: int, parent: np.ndarray, key: np.ndarray, bits: int) -> tuple[EliasFano, EliasFano]:
        """Sequences for children sorted by (parent, key), `parent` among `parents`."""
        start = np.searchsorted(parent, np.arange(parents + 1))
        last = np.append(np.flatnonzero(np.diff(parent)), len(parent) - 1) if len(parent) else np.zeros(0, np.int64)
        room = np.zeros(parents, np.uint64)
        room[parent[last]] = key[last] + np.uint64(1)
        base = np.concatenate([np.zeros(1, np.uint64), np.cumsum(room, dtype=np.uint64)])
        return EliasFano.build(start, len(parent) + 1), EliasFano.build(base[parent] + key, int(base[-1]) + (1 << bits))

    def find(self, parent: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place of each (parent, key), and whether it is there."""
        owner, index = np.unique(parent, return_inverse=True)
        start, stop = (self.pointers.get(owner + k).astype(np.int64) for k in (0, 1))
        base = np.zeros(len(owner), np.uint64)
        some = start > 0
        base[some] = self.nodes.get(start[some] - 1) + np.uint64(1)
        place, found = self.nodes.successor(base[index] + key)
        return place, found & (place >= start[index]) & (place < stop[index])

    def size(self, parent: np.ndarray) -> np.ndarray:
        return (self.pointers.get(parent + 1) - self.pointers.get(parent)).astype(np.int64)


class Trie:
    """Words, the words after them, and the words after those pairs, mapped from one file.

    Level 1 holds first words by their 64-bit hashes, levels 2 and 3 the next
    words by 40 bits of theirs. A pair has two codes: its own discounted
    probability after its first word, and the share that a third word's
    probability leaves to shorter contexts. A triple has the first only.
    """

    BITS = 40

    def __init__(self, words: np.ndarray, first: np.ndarray, second: np.ndarray, two: np.ndarray, rest: np.ndarray, pair: np.ndarray, third: np.ndarray, three: np.ndarray):
        """`words` sorted and distinct; (first, second) and (pair, third) likewise, `first` and `pair` as ranks in the level above."""
        parts = [EliasFano.build(words >> np.uint64(1), 1 << 63), *Level.plan(len(words), first, second, self.BITS), *Level.plan(len(first), pair, third, self.BITS)]
        mapped = Mapped([a for e in parts for a in e.arrays()] + [two, rest, three]).arrays
        level1, *others = (EliasFano(*mapped[3 * i : 3 * i + 3], int(e.shift), e.n) for i, e in enumerate(parts))
        self.level1, self.level2, self.level3 = level1, Level(others[0], others[1], mapped[15:17]), Level(others[2], others[3], mapped[17:])

    def pairs(self, words: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Each pair's place, whether it is there, and its two codes; without it nothing, and all left to shorter contexts."""
        known, index = np.unique(words, return_inverse=True)
        rank, there = (x[index] for x in self.level1.successor(known >> np.uint64(1)))
        place, found = np.zeros(len(words), np.int64), np.zeros(len(words), bool)
        place[there], found[there] = self.level2.find(rank[there], second[there])
        two, rest = np.full(len(words), NOTHING, np.uint16), np.zeros(len(words), np.uint16)
        two[found], rest[found] = (c[place[found]] for c in self.level2.codes)
        return place, found, two, rest

    def triples(self, pair: np.ndarray, third: np.ndarray) -> np.ndarray:
        """Codes of the words after pairs, which are given by place."""
        place, found = self.level3.find(pair, third)
        three = np.full(len(pair), NOTHING, np.uint16)
        three[found] = self.level3.codes[0][place[found]]
        return three
