"""Look-up tables over whole numpy arrays of 64-bit keys."""

from __future__ import annotations

import numpy as np

ODD = np.uint64(0x9E3779B97F4A7C15)


class Table:
    """Values 0.. of keys, built once. ``get`` looks up many keys at a time; -1 for a key that isn't there."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(len(keys)).bit_length() + 2)
        self.shift, self.last = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.keys, self.values = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32)
        keys, values = keys.astype(np.uint64), values.astype(np.int32)
        slot = self._slot(keys)
        while len(keys):  # of keys that want one free slot the first takes it; the others try the next
            free = self.values[slot] < 0
            _, first = np.unique(slot[free], return_index=True)
            put = np.flatnonzero(free)[first]
            self.keys[slot[put]], self.values[slot[put]] = keys[put], values[put]
            rest = np.ones(len(keys), bool)
            rest[put] = False
            keys, values, slot = keys[rest], values[rest], (slot[rest] + 1) & self.last

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * ODD) >> self.shift).view(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        found = self.values[slot]
        open_ = np.flatnonzero((found >= 0) & (self.keys[slot] != keys))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & self.last
            at = slot[open_]
            found[open_] = self.values[at]
            open_ = open_[(found[open_] >= 0) & (self.keys[at] != keys[open_])]
        return found


class Memory:
    """What was worked out before, in a fixed number of slots: a new key takes the place of another in its slot.

    A key is one or more 64-bit numbers, compared as a whole, so what comes back is always the key's own value.
    """

    def __init__(self, bits: int, width: int = 1, value: type = np.int8):
        self.shift = np.uint64(64 - bits)
        self.keys = [np.zeros(1 << bits, np.uint64) for _ in range(width)]
        self.values = np.zeros(1 << bits, value)
        self.used = np.zeros(1 << bits, bool)

    def slots(self, *key: np.ndarray) -> np.ndarray:
        h = key[0] * ODD
        for k in key[1:]:
            h = ((h ^ (h >> np.uint64(32))) + k) * ODD
        return (h >> self.shift).view(np.int64)

    def known(self, slot: np.ndarray, *key: np.ndarray) -> np.ndarray:
        ok = self.used[slot]
        for mine, k in zip(self.keys, key, strict=True):
            ok &= mine[slot] == k
        return ok

    def put(self, slot: np.ndarray, value: np.ndarray, *key: np.ndarray) -> None:
        # Of keys that fall into one slot the last stays, as one row: equal slots are written in the same order everywhere.
        for mine, k in zip(self.keys, key, strict=True):
            mine[slot] = k
        self.values[slot], self.used[slot] = value, True
