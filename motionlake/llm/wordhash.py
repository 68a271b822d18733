"""Vectorised word splitting and hashing for Arrow batches of texts.

A word's hash is a chain of mixing steps over its bytes, eight at a time; the hash of
a run of words is built from hashes of shorter runs by mixing steps, in as many passes
over the batch as the run's length has binary digits. No step is linear in the words,
so texts of a regular build don't collide by their build. Hashes have 64 bits; what
rests on them compares the words' bytes (``packed``) where a result hangs on it.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

_U = np.uint64
_P = _U(0x9E3779B97F4A7C15)
_LEFT, _FOLD, _LENGTH = _U(0xD1342543DE82EF93), _U(0xFF51AFD7ED558CCD), _U(0xC4CEB9FE1A85EC53)
_LONG = 256  # bytes; longer words are hashed one by one
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], _U)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words with good avalanche (the splitmix finaliser)."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def _joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hashes of two neighbouring runs made one; their order counts."""
    x = left * _LEFT
    x += right
    x ^= x >> _U(32)
    x *= _FOLD
    x ^= x >> _U(29)
    return x


class Words:
    """The words of a batch: start and end in its bytes, per-document ranges, hashes."""

    def __init__(self, texts: pa.Array, lower: bool = False):
        """texts: a string or binary array; null counts as empty."""
        texts = texts.cast(pa.large_binary()).fill_null(b"")
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = texts.buffers()[2]
        raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(texts) else np.zeros(0, np.uint8)
        self.offsets = offsets - offsets[0]
        self.raw = _LOWER[raw] if lower else raw
        word = ~_SPACE[raw]
        left, right = word.copy(), word.copy()
        left[1:] &= ~word[:-1]
        right[:-1] &= ~word[1:]
        edges = self.offsets[(self.offsets > 0) & (self.offsets < len(raw))]
        left[edges] = word[edges]
        right[edges - 1] = word[edges - 1]
        self.start, self.end = np.flatnonzero(left), np.flatnonzero(right) + 1
        self.first = np.searchsorted(self.start, self.offsets)  # words of document i: first[i] to first[i + 1]
        self._runs: dict[int, np.ndarray] = {}
        self._packed: tuple | None = None

    @property
    def hash(self) -> np.ndarray:
        if 1 not in self._runs:
            size = self.end - self.start
            eight = np.ndarray((len(self.raw) + 1,), "<u8", np.append(self.raw, np.zeros(8, np.uint8)).tobytes(), 0, (1,))
            hashes = mix(size.astype(_U) * _LENGTH)
            todo, at = np.arange(len(size)), 0
            while todo.size and at < _LONG:
                part = eight[self.start[todo] + at] & _MASK[np.minimum(size[todo] - at, 8)]
                hashes[todo] = mix(hashes[todo] ^ part)
                at += 8
                todo = todo[size[todo] > at]
            for i in todo.tolist():
                hashes[i] = int.from_bytes(hashlib.blake2b(self.word(i), digest_size=8).digest(), "little")
            self._runs[1] = hashes
        return self._runs[1]

    def runs(self, k: int) -> np.ndarray:
        """Hash of the k words from each word on; meaningless for a document's last k - 1."""
        if k == 1:
            return self.hash
        if k not in self._runs:
            half = 1 << (k - 1).bit_length() - 1
            n = max(0, len(self.start) - k + 1)
            self._runs[k] = _joined(self.runs(half)[:n], self.runs(k - half)[half : half + n])
        return self._runs[k]

    def word(self, i: int) -> bytes:
        return self.raw[self.start[i] : self.end[i]].tobytes()

    @property
    def packed(self) -> tuple[bytes, np.ndarray]:
        """All words, each followed by one space, and where each word begins in that (with the end)."""
        if self._packed is None:
            size = self.end - self.start
            begin = np.concatenate([[0], np.cumsum(size + 1)])
            out = np.full(begin[-1], 32, np.uint8)
            number, before = np.repeat(np.arange(len(size)), size), np.cumsum(size) - size
            rank = np.arange(len(number))
            out[rank + number] = self.raw[rank + (self.start - before)[number]]
            self._packed = out.tobytes(), begin
        return self._packed

    def text(self, a: int, b: int) -> bytes:
        """The words from a to b (exclusive), each followed by a space."""
        data, begin = self.packed
        return data[begin[a] : begin[b]]
