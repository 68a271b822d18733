"""A hash table from 64-bit keys to numbers, as arrays sorted by hash, for vectorised lookups."""

from __future__ import annotations

import numpy as np

from .wordhash import mix

_U = np.uint64


class HashTable:
    """Distinct keys with columns of numbers; floats are kept in 32 bits.

    The hash's top bits tell where to begin in the sorted hashes. The hash is a
    bijection, so equal hashes are equal keys, and the keys themselves aren't stored.
    """

    def __init__(self, keys: np.ndarray, columns: dict[str, np.ndarray]):
        hashes = mix(keys)
        order = np.argsort(hashes, kind="stable")
        self.hashes = np.append(hashes[order], _U(2**64 - 1))
        self.columns = {name: (values[order].astype(np.float32) if values.dtype.kind == "f" else values[order]) for name, values in columns.items()}
        bits = max(4, int(2 * len(keys)).bit_length())
        self.shift = _U(64 - bits)
        self.first = np.searchsorted(self.hashes[:-1], np.arange(1 << bits, dtype=_U) << self.shift).astype(np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Each key's place in the columns, or -1."""
        h = mix(keys)
        at = self.first[h >> self.shift]
        behind = np.flatnonzero(self.hashes[at] < h)
        while len(behind):
            at[behind] += 1
            behind = behind[self.hashes[at[behind]] < h[behind]]
        hit = (self.hashes[at] == h) & (at < len(self.hashes) - 1)
        return np.where(hit, at, np.int32(-1))
