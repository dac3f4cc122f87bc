"""Elias–Fano form of ascending numbers: near-minimal space, with a sampled select."""

from __future__ import annotations

import struct

import numpy as np

#: Every SAMPLE-th one of the upper bits has its place stored.
SAMPLE = 512
_HEAD = "<QQBQQQ"


def encode(values: np.ndarray) -> bytes:
    """Ascending numbers from 0 up to below 2**63; at most 2 + log2(largest / count) bits a number, and the samples."""
    values = np.asarray(values, np.uint64)
    n = len(values)
    most = int(values[-1]) if n else 0
    width = max(0, (most // n).bit_length() - 1) if n else 0
    lower = np.zeros(0, np.uint8)
    if width:
        bits = ((values[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
        lower = np.packbits(bits.ravel(), bitorder="little")
    ones = (values >> np.uint64(width)).astype(np.int64) + np.arange(n)
    upper = np.zeros((int(ones[-1]) if n else 0) + 1, np.uint8)
    upper[ones] = 1
    upper = np.packbits(upper, bitorder="little")
    samples = ones[::SAMPLE].astype("<u8")
    return struct.pack(_HEAD, n, most, width, len(lower), len(upper), len(samples)) + lower.tobytes() + upper.tobytes() + samples.tobytes()


class Ascending:
    """Encoded numbers; `select(i)` reads one of them, `between` a stretch, `all()` decodes them all."""

    def __init__(self, data: bytes):
        self.n, self.most, self.width, a, b, c = struct.unpack_from(_HEAD, data)
        at = struct.calcsize(_HEAD)
        self.lower = np.frombuffer(data, np.uint8, a, at)
        self.upper = np.frombuffer(data, np.uint8, b, at + a)
        self.samples = np.frombuffer(data, "<u8", c, at + a + b)
        self.size = at + a + b + 8 * c

    def select(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        place = int(self.samples[i // SAMPLE])
        left, byte = i % SAMPLE, place // 8
        first = int(self.upper[byte]) >> place % 8 << place % 8
        ones = first.bit_count()
        while ones <= left:
            left -= ones
            byte += 1
            first = int(self.upper[byte])
            ones = first.bit_count()
        for _ in range(left):
            first &= first - 1
        high = byte * 8 + (first & -first).bit_length() - 1 - i
        start = i * self.width
        low = int.from_bytes(self.lower[start // 8 : (start + self.width + 7) // 8].tobytes(), "little") >> start % 8
        return high << self.width | low & (1 << self.width) - 1

    def between(self, first: int, last: int) -> np.ndarray:
        """Numbers first … last - 1, selected together: only the samples' stretch that holds them is decoded."""
        if first >= last:
            return np.zeros(0, np.int64)
        begin, end = int(self.samples[first // SAMPLE]), -(-last // SAMPLE)
        stop = int(self.samples[end]) if end < len(self.samples) else 8 * len(self.upper)
        ones = np.flatnonzero(np.unpackbits(self.upper[begin // 8 : stop // 8 + 1], bitorder="little")) + begin // 8 * 8
        skip = int(np.searchsorted(ones, begin)) + first % SAMPLE
        out = (ones[skip : skip + last - first] - np.arange(first, last)).astype(np.uint64) << np.uint64(self.width)
        if self.width:
            at = first * self.width
            bits = np.unpackbits(self.lower[at // 8 : (last * self.width + 7) // 8], bitorder="little")[at % 8 :]
            bits = bits[: (last - first) * self.width].reshape(last - first, self.width)
            for k in range(self.width):
                out |= bits[:, k].astype(np.uint64) << np.uint64(k)
        return out.astype(np.int64)

    def all(self) -> np.ndarray:
        return self.between(0, self.n)
