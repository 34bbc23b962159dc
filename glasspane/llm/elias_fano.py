"""Elias-Fano coding of non-decreasing numbers, with a select structure.

Of each of n numbers below u the lowest floor(log2(u / n)) bits are kept as they are; the rest is a bit
vector in which the i-th one stands at (number >> low bits) + i. That takes 2 + log2(u / n) bits a number
at most. select(i) finds the i-th one from the place of every SAMPLE-th one, which is kept in 32 bits;
values() decodes all numbers at once, search() finds where a number stands by halving over select().
"""

from __future__ import annotations

import struct

import numpy as np

SAMPLE = 256
_HEAD = "<QQB7x"
_ONES = np.array([bin(b).count("1") for b in range(256)], np.uint8)


class EliasFano:
    """n numbers; ``low`` packed low bits of ``width`` each, ``high`` the bit vector, ``samples`` places of ones."""

    def __init__(self, n: int, width: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.width, self.low, self.high, self.samples = n, width, low, high, samples

    @classmethod
    def of(cls, numbers: np.ndarray) -> EliasFano:
        numbers = np.asarray(numbers, np.uint64)
        n = len(numbers)
        if n == 0:
            return cls(0, 0, np.empty(0, np.uint8), np.empty(0, np.uint8), np.empty(0, np.uint32))
        if (numbers[1:] < numbers[:-1]).any():
            raise ValueError("numbers must not decrease")
        width = max(0, int(numbers[-1]) // n).bit_length() - 1 if int(numbers[-1]) >= n else 0
        low = np.empty(0, np.uint8)
        if width:
            shifts = np.arange(width, dtype=np.uint64)
            low = np.concatenate([np.packbits(((numbers[k : k + 65536, None] >> shifts) & np.uint64(1)).astype(np.uint8), axis=None, bitorder="little") for k in range(0, n, 65536)])
        places = (numbers >> np.uint64(width)).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(places[-1]) + 1, np.uint8)
        bits[places] = 1
        return cls(n, width, low, np.packbits(bits, bitorder="little"), places[::SAMPLE].astype(np.uint32))

    def tobytes(self) -> bytes:
        return struct.pack(_HEAD, self.n, len(self.high), self.width) + self.low.tobytes() + self.high.tobytes() + self.samples.astype("<u4").tobytes()

    @classmethod
    def frombytes(cls, data: bytes) -> EliasFano:
        n, high, width = struct.unpack_from(_HEAD, data)
        low, at = -(-n * width // 8), struct.calcsize(_HEAD)
        part = lambda a, size: np.frombuffer(data, np.uint8, size, a)
        return cls(n, width, part(at, low), part(at + low, high), np.frombuffer(data, "<u4", -(-n // SAMPLE), at + low + high))

    def _low(self, i: int) -> int:
        if not self.width:
            return 0
        a, b = i * self.width, (i + 1) * self.width
        word = int.from_bytes(self.low[a // 8 : -(-b // 8)].tobytes(), "little")
        return word >> a % 8 & (1 << self.width) - 1

    def select(self, i: int) -> int:
        """The i-th number (from 0): the sampled place before it, then whole bytes by their number of ones."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at = int(self.samples[i // SAMPLE])
        wanted = i % SAMPLE  # ones after the sampled one
        byte = at // 8
        first = int(self.high[byte]) >> at % 8 << at % 8
        wanted += 1
        if (own := first.bit_count()) < wanted:
            wanted, byte = wanted - own, byte + 1
            while True:
                block = _ONES[self.high[byte : byte + 64]].cumsum(dtype=np.int64)
                if block[-1] >= wanted:
                    k = int(np.searchsorted(block, wanted))
                    wanted -= int(block[k - 1]) if k else 0
                    byte += k
                    break
                wanted, byte = wanted - int(block[-1]), byte + 64
            first = int(self.high[byte])
        for _ in range(wanted - 1):
            first &= first - 1
        place = byte * 8 + (first & -first).bit_length() - 1
        return place - i << self.width | self._low(i)

    def values(self) -> np.ndarray:
        places = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        out = (places - np.arange(self.n)).astype(np.uint64) << np.uint64(self.width)
        if self.width:
            step = 65536  # a multiple of 8: each part starts at a whole byte
            for k in range(0, self.n, step):
                m = min(step, self.n - k)
                bits = np.unpackbits(self.low[k * self.width // 8 :][: -(-m * self.width // 8)], bitorder="little")[: m * self.width].reshape(m, self.width)
                out[k : k + m] |= (bits.astype(np.uint64) << np.arange(self.width, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
        return out

    def search(self, number: int) -> int:
        """How many of the numbers are smaller than ``number``."""
        a, b = 0, self.n
        while a < b:
            mid = (a + b) // 2
            a, b = (mid + 1, b) if self.select(mid) < number else (a, mid)
        return a
