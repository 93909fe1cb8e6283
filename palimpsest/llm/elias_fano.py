"""Elias-Fano sequences: monotone integers in about two bits each plus their low bits, searched without decoding.

A value's low bits are packed; its high bits are written in unary, a one for each value after as many zeros as the high bits say.
Counts of ones and zeros before every word of the unary part make select fast. All methods take and return whole arrays.
"""

from __future__ import annotations

import io
import json
import mmap
import os
import tempfile

import numpy as np

_U = np.uint64


def _select_table() -> np.ndarray:
    """Of each byte and rank the position of that one, at rank * 256 + byte."""
    out = np.zeros((8, 256), np.uint8)
    for b in range(256):
        ones = [i for i in range(8) if b >> i & 1]
        out[: len(ones), b] = ones
    return out.ravel()


_IN_BYTE = _select_table()
#: 1 and 128 in each byte of a word, and masks of its bits by two, four and eight.
_EACH, _HIGH, _TWO, _FOUR, _EIGHT = (_U(x * 0x0101010101010101) for x in (0x01, 0x80, 0x55, 0x33, 0x0F))


def _in_word(word: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Position of the rank-th one of each word: the byte by sums of the bytes up to each, then by a table."""
    rank = rank.astype(_U)
    upto = word - (word >> _U(1) & _TWO)
    upto = (upto & _FOUR) + (upto >> _U(2) & _FOUR)
    upto = (upto + (upto >> _U(4)) & _EIGHT) * _EACH
    before = np.bitwise_count((rank * _EACH | _HIGH) - upto & _HIGH).astype(_U) << _U(3)
    left = rank - (upto << _U(8) >> before & _U(255))
    return (before + _IN_BYTE[left << _U(8) | word >> before & _U(255)]).astype(np.int64)


class EliasFano:
    """A sorted sequence of integers, repeats allowed."""

    FIELDS = ("low", "high", "ones", "zeros")

    def __init__(self, n: int, bits: int, low: np.ndarray, high: np.ndarray, ones: np.ndarray, zeros: np.ndarray):
        self.n, self.bits, self.low, self.high, self.ones, self.zeros = n, bits, low, high, ones, zeros

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, _U)
        n = len(values)
        bits = max(0, (int(values[-1]) // n).bit_length() - 1) if n else 0
        low = np.zeros((n * bits >> 6) + 2, _U)
        if bits:
            part, at = values & _U((1 << bits) - 1), np.arange(n, dtype=np.int64) * bits
            word, shift = at >> 6, (at & 63).astype(_U)
            np.bitwise_or.at(low, word, part << shift)
            over = np.flatnonzero((at & 63) + bits > 64)
            np.bitwise_or.at(low, word[over] + 1, part[over] >> (_U(64) - shift[over]))
        top = values >> _U(bits)
        size = n + (int(top[-1]) if n else 0) + 2
        unary = np.zeros((size >> 6) + 1 << 6, np.uint8)
        unary[top.astype(np.int64) + np.arange(n)] = 1
        high = np.packbits(unary, bitorder="little").view(_U)
        ones = np.concatenate([[0], np.cumsum(np.bitwise_count(high), dtype=np.int64)])
        zeros = 64 * np.arange(len(high) + 1) - ones
        kind = np.uint32 if zeros[-1] + ones[-1] < 1 << 32 else np.int64
        return cls(n, bits, low, high, ones.astype(kind), zeros.astype(kind))

    def arrays(self, name: str) -> dict[str, np.ndarray]:
        return {f"{name}.shape": np.array([self.n, self.bits])} | {f"{name}.{f}": getattr(self, f) for f in self.FIELDS}

    @classmethod
    def of(cls, arrays: dict[str, np.ndarray], name: str) -> EliasFano:
        n, bits = arrays[f"{name}.shape"].tolist()
        return cls(n, bits, *(arrays[f"{name}.{f}"] for f in cls.FIELDS))

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), _U)
        at = i * self.bits
        word, shift = at >> 6, (at & 63).astype(_U)
        x = self.low[word] >> shift
        x |= np.where(shift > 0, self.low[word + 1] << (_U(64) - np.maximum(shift, _U(1))), _U(0))
        return x & _U((1 << self.bits) - 1)

    def _select(self, k: np.ndarray, before: np.ndarray, flip: bool) -> np.ndarray:
        word = np.searchsorted(before, k.astype(before.dtype), "right") - 1
        x = self.high[word]
        return (word << 6) + _in_word(~x if flip else x, k - before[word])

    def access(self, i: np.ndarray) -> np.ndarray:
        """The values at these places."""
        i = np.asarray(i, np.int64)
        top = (self._select(i, self.ones, False) - i).astype(_U)
        return top << _U(self.bits) | self._low(i)

    def _search(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first place whose value is at least x, and whether the value there has the same high bits."""
        top = x >> _U(self.bits)
        beyond = top >= _U(int(self.zeros[-1]) - 1)  # no zero of that number is followed by a value
        k = np.where(beyond, 0, top.astype(np.int64))
        start = np.where(k > 0, self._select(np.maximum(k - 1, 0), self.zeros, True) - np.maximum(k - 1, 0), 0)
        last = self._select(k, self.zeros, True) - k
        part = x & _U((1 << self.bits) - 1)
        end = last.copy()
        while True:  # within the values of these high bits
            open_ = np.flatnonzero(start < end)
            if not len(open_):
                break
            mid = (start[open_] + end[open_]) >> 1
            less = self._low(mid) < part[open_]
            start[open_[less]] = mid[less] + 1
            end[open_[~less]] = mid[~less]
        return np.where(beyond, self.n, start), (start < last) & ~beyond

    def successor(self, x: np.ndarray) -> np.ndarray:
        """The first place whose value is at least x; n if there is none."""
        x = np.asarray(x, _U)
        return self._search(x)[0] if self.n else np.zeros(len(x), np.int64)

    def find(self, x: np.ndarray) -> np.ndarray:
        """The place of x, or -1."""
        x = np.asarray(x, _U)
        out = np.full(len(x), -1)
        if self.n:
            i, same = self._search(x)
            same = np.flatnonzero(same)
            good = same[self._low(i[same]) == x[same] & _U((1 << self.bits) - 1)]
            out[good] = i[good]
        return out


def packed(arrays: dict[str, np.ndarray]) -> bytes:
    """Arrays as one file: a JSON list of them after its length, then each at a multiple of 64 bytes."""
    heads, at, out = [], 0, io.BytesIO()
    for name, x in arrays.items():
        heads.append((name, x.dtype.str, len(x), at))
        at += -(-x.nbytes // 64) * 64
    head = json.dumps(heads).encode()
    head += b" " * (-(len(head) + 8) % 64)
    out.write(len(head).to_bytes(8, "little") + head)
    for x in arrays.values():
        out.write(x.tobytes() + b"\0" * (-x.nbytes % 64))
    return out.getvalue()


def mapped(store, path: str) -> dict[str, np.ndarray]:
    """The arrays of a file, memory-mapped: a local file where it is, another by a copy that has no name and goes with its use."""
    from pyarrow import fs

    if isinstance(store, fs.LocalFileSystem):
        with open(path, "rb") as f:
            memory = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
    else:
        with store.open_input_stream(path, compression=None) as source, tempfile.TemporaryFile() as f:
            while block := source.read(1 << 22):
                f.write(block)
            f.flush()
            os.fsync(f.fileno())
            memory = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
    n = int.from_bytes(memory[:8], "little")
    return {name: np.frombuffer(memory, kind, count, 8 + n + at) for name, kind, count, at in json.loads(memory[8 : 8 + n])}
