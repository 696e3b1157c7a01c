"""Binary fuse filters: a static set of 64-bit keys in about 18 bits a key, with one false positive in 65,536.

A key has a cell in each of three neighbouring segments; the xor of the cells is the key's fingerprint. Cells are
filled by peeling: cells that one key alone uses are set aside, round by round, and filled in the reverse order.
"""

import math

import numpy as np

from .buffers import mix

_U = np.uint64


class FuseFilter:
    def __init__(self, seed: int, segment: int, segments: int, cells: np.ndarray):
        self.seed, self.segment, self.segments, self.cells = seed, segment, segments, cells

    @classmethod
    def build(cls, keys: np.ndarray) -> "FuseFilter":
        keys = np.unique(keys.astype(np.uint64))
        n = max(len(keys), 2)
        segment = min(1 << 18, 1 << int(math.log(n) / math.log(3.33) + 2.25))
        capacity = int(n * max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(n)))
        segments = max(1, -(-capacity // segment) - 2)
        for seed in range(1000):
            out = cls(seed, segment, segments, np.zeros((segments + 2) * segment, np.uint16))
            if out._fill(keys):
                return out
        raise RuntimeError("no seed leads to a filter")

    def _places(self, keys: np.ndarray):
        h = mix(keys.astype(np.uint64), self.seed)
        mask = _U(self.segment - 1)
        a = ((h >> _U(32)) * _U(self.segments * self.segment)) >> _U(32)
        b = (a + _U(self.segment)) ^ ((h >> _U(18)) & mask)
        c = (a + _U(2 * self.segment)) ^ (h & mask)
        return np.stack([a, b, c]).astype(np.int64), (mix(h, 1) >> _U(48)).astype(np.uint16)

    def _fill(self, keys: np.ndarray) -> bool:
        cells, marks = self._places(keys)
        count, which = np.zeros(len(self.cells), np.int64), np.zeros(len(self.cells), np.int64)
        number = np.arange(len(keys))
        for c in cells:
            np.add.at(count, c, 1)
            np.bitwise_xor.at(which, c, number)
        alone, rounds, left = np.flatnonzero(count == 1), [], len(keys)
        while len(alone):
            key, first = np.unique(which[alone], return_index=True)
            rounds.append((key, alone[first]))
            left -= len(key)
            touched = cells[:, key]
            for c in touched:
                np.subtract.at(count, c, 1)
                np.bitwise_xor.at(which, c, key)
            touched = np.unique(touched)
            alone = touched[count[touched] == 1]
        if left:
            return False
        for key, cell in reversed(rounds):
            a, b, c = self.cells[cells[:, key]]
            self.cells[cell] = marks[key] ^ a ^ b ^ c ^ self.cells[cell]
        return True

    def has(self, keys: np.ndarray) -> np.ndarray:
        """False only for keys that are not in the set."""
        cells, marks = self._places(keys)
        a, b, c = self.cells[cells]
        return (a ^ b ^ c) == marks
