"""Words of many texts at once, and their hashes, by array operations on the bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_RANDOM = np.random.default_rng(20240607)
_SIGN = _RANDOM.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_STEP_BACK = np.uint64(pow(int(_STEP), -1, 1 << 64))
_ODD = _RANDOM.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS: list[np.ndarray] = []

#: A-Z to a-z, all else as it is.
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
#: Bytes of words that white space parts: all but space and 9 to 13.
UNSPACED = np.array([b != 32 and not 9 <= b <= 13 for b in range(256)])
#: Bytes of words of ASCII digits, a-z (after lower-casing) and all beyond ASCII.
ALPHANUMERIC = np.array([48 <= b <= 57 or 97 <= b <= 122 or b >= 128 for b in range(256)])


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose output bits all depend on all input bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        m = max(n, 1 << 16)
        _POWERS[:] = [np.concatenate(([np.uint64(1)], np.full(m - 1, base, np.uint64))).cumprod(dtype=np.uint64) for base in (_STEP, _STEP_BACK)]
    return _POWERS[0][:n], _POWERS[1][:n]


class Words:
    """starts and ends: bytes of each word; of: the number of its text; hashes: 64 bits of each word;
    first: index of the first word of each text, with one more at the end."""

    def __init__(self, texts: list[bytes], kind: np.ndarray, hashed: bool = True):
        joined = b" ".join(texts) + b" "
        self.bytes = LOWER[np.frombuffer(joined, np.uint8)]
        inside = kind[self.bytes]
        edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if inside[0]:
            edges = np.concatenate(([0], edges))
        self.starts, self.ends = edges[0::2], edges[1::2]
        lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        self.offsets = np.concatenate(([0], np.cumsum(lengths)))
        self.first = np.searchsorted(self.starts, self.offsets)
        if hashed:
            up, back = _powers(len(self.bytes))
            sums = np.concatenate(([np.uint64(0)], np.cumsum(_SIGN[self.bytes] * up, dtype=np.uint64)))
            self.hashes = mixed((sums[self.ends] - sums[self.starts]) * back[self.starts] + (self.ends - self.starts).astype(np.uint64))

    def windows(self, size: int) -> np.ndarray:
        """A hash for each run of ``size`` words, by its first word; runs may reach over into the next text."""
        n = len(self.hashes) - size + 1
        if n <= 0:
            return np.empty(0, np.uint64)
        return mixed(sum((self.hashes[k : k + n] * _ODD[k] for k in range(size)), np.zeros(n, np.uint64)))


def one(hashes: np.ndarray) -> np.uint64:
    """A hash of a whole sequence of words, of any length."""
    n = len(hashes)
    return mixed((hashes * _powers(n)[0]).sum(dtype=np.uint64, keepdims=True) * _ODD[63] + np.uint64(n))[0]


def chunks(texts: list, most: int = 1 << 18) -> Iterator[tuple[int, list[bytes]]]:
    """(number of the first text, texts) of up to ``most`` bytes together, or a single longer text; null is empty."""
    own, size, at = [], 0, 0
    for k, text in enumerate(texts):
        b = text.encode() if isinstance(text, str) else text or b""
        if own and size + len(b) > most:
            yield at, own
            own, size, at = [], 0, k
        own.append(b)
        size += len(b)
    if own:
        yield at, own
