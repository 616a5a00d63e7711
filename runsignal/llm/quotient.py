"""Counting quotient filters of packed id n-grams, as sorted arrays of bytes.

The ids of an n-gram are packed into one number of ``n * bits`` bits, which a Feistel network permutes.  The
permutation can be undone and the remainder is kept in full, so a filter loses nothing: it is a compact
table of exact counts.  The topmost bits name the part (one merging task has a part), the next ones are the
quotient, the rest the remainder.  Two bit vectors (occupied quotients, ends of runs) and the bytes of the sorted
remainders are all that a key takes; a count of one takes a bit more.
"""

from __future__ import annotations

import numpy as np

from .words import mix

_ROUNDS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)


def _mask(n: int) -> np.uint64:
    return np.uint64((1 << n) - 1)


class Packing:
    """Keys of ``n`` ids of ``bits`` bits each (at most 31) as one or two 64-bit limbs, the upper one first."""

    def __init__(self, n: int, bits: int, part_bits: int) -> None:
        self.n, self.bits = n, bits
        self.wide = (n + 1) // 2 * bits, n // 2 * bits
        self.width = n * bits
        self.low = max(0, self.width - 64)  # bits of the lower limb
        self.part_bits = min(part_bits, self.width - self.low)

    def keys(self, ids: np.ndarray) -> np.ndarray:
        """(n, m) ids to (limbs, m) permuted keys."""
        half = (self.n + 1) // 2
        left, right = self._joined(ids[:half]), self._joined(ids[half:])
        for i, c in enumerate(_ROUNDS):
            if i % 2:
                right = right ^ (mix(left + c) & _mask(self.wide[1]))
            else:
                left = left ^ (mix(right + c) & _mask(self.wide[0]))
        out = np.zeros((1 + bool(self.low), ids.shape[1]), np.uint64)
        self._put(out, 0, self.wide[1], right)
        self._put(out, self.wide[1], self.wide[0], left)
        return out

    def ids(self, key: np.ndarray) -> np.ndarray:
        """The inverse of ``keys``."""
        right, left = self._get(key, 0, self.wide[1]), self._get(key, self.wide[1], self.wide[0])
        for i, c in reversed(list(enumerate(_ROUNDS))):
            if i % 2:
                right = right ^ (mix(left + c) & _mask(self.wide[1]))
            else:
                left = left ^ (mix(right + c) & _mask(self.wide[0]))
        half = (self.n + 1) // 2
        return np.array([(x >> np.uint64(self.bits * (k - 1 - j))) & _mask(self.bits) for x, k in ((left, half), (right, self.n - half)) for j in range(k)])

    def part(self, key: np.ndarray) -> np.ndarray:
        return self._get(key, self.width - self.part_bits, self.part_bits)

    def filter(self, key: np.ndarray, count: np.ndarray) -> bytes:
        """Sorted distinct keys of one part and their counts, as a filter."""
        n, width = key.shape[1], self.width - self.part_bits
        # Up to four quotients a key, if that saves a byte of each remainder.
        size = min(max(0, -(-(width - n.bit_length() - 1) // 8)), width // 8)
        q = width - 8 * size
        quotient = self._get(key, 8 * size, q).astype(np.int64)
        occupied = np.zeros(1 << q, bool)
        occupied[quotient] = True
        ends = np.append(quotient[1:] != quotient[:-1], True)
        more = (count[count > 1] - 1).astype(np.uint64)
        large = more[more >= 255]
        head = np.array([n, q, size, len(more), len(large)], np.int64)
        rest = [self._get(key, 8 * j, 8).astype(np.uint8) for j in range(size)]
        return b"".join(x.tobytes() for x in (head, np.packbits(occupied), np.packbits(ends), *rest, np.packbits(count > 1), np.minimum(more, 255).astype(np.uint8), large))

    def entries(self, part: int, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Keys, sorted, and counts of a filter."""
        n, q, size, n_more, n_large = (int(x) for x in np.frombuffer(data, np.int64, 5))
        at = 40

        def take(k: int) -> np.ndarray:
            nonlocal at
            at += k
            return np.frombuffer(data, np.uint8, k, at - k)

        occupied = np.flatnonzero(np.unpackbits(take(-(-(1 << q) // 8)), count=1 << q))
        ends = np.unpackbits(take(-(-n // 8)), count=n)
        key = np.zeros((1 + bool(self.low), n), np.uint64)
        for j in range(size):
            self._put(key, 8 * j, 8, take(n).astype(np.uint64))
        run = np.cumsum(ends) - ends
        self._put(key, 8 * size, q, occupied[run].astype(np.uint64))
        self._put(key, self.width - self.part_bits, self.part_bits, np.full(n, part, np.uint64))
        many = np.unpackbits(take(-(-n // 8)), count=n).astype(bool)
        more = take(n_more).astype(np.uint64)
        more[more == 255] = np.frombuffer(data, np.uint64, n_large, at)
        count = np.ones(n, np.uint64)
        count[many] += more
        return key, count

    def _joined(self, ids: np.ndarray) -> np.ndarray:
        out = np.zeros(ids.shape[1], np.uint64)
        for row in ids:
            out = (out << np.uint64(self.bits)) | row.astype(np.uint64)
        return out

    def _get(self, key: np.ndarray, at: int, n: int) -> np.ndarray:
        """n bits from bit ``at`` on."""
        if n == 0:
            return np.zeros(key.shape[1], np.uint64)
        if at >= self.low:
            return (key[0] >> np.uint64(at - self.low)) & _mask(n)
        out = key[1] >> np.uint64(at)
        if at + n > self.low:
            out = out | (key[0] << np.uint64(self.low - at))
        return out & _mask(n)

    def _put(self, key: np.ndarray, at: int, n: int, value: np.ndarray) -> None:
        if n == 0:
            return
        if at >= self.low:
            key[0] |= value << np.uint64(at - self.low)
            return
        key[1] |= (value << np.uint64(at)) & _mask(self.low)
        if at + n > self.low:
            key[0] |= value >> np.uint64(self.low - at)


def summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, with the sums of their counts.  Sorted inputs are merged rather than sorted."""
    key, n = np.concatenate(keys, axis=1), np.concatenate(counts)
    order = np.argsort(key[0], kind="stable") if len(key) == 1 else np.lexsort(key[::-1])
    key, n = key[:, order], n[order]
    if not len(n):
        return key, n
    new = np.flatnonzero(np.concatenate(([True], (key[:, 1:] != key[:, :-1]).any(0))))
    return key[:, new], np.add.reduceat(n, new)


class Sum:
    """Running sum of sorted keys: what has come is merged in once there is as much of it as has been merged."""

    def __init__(self, least: int = 1 << 18) -> None:
        self.keys: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.done, self.fresh, self.least = 0, 0, least

    def add(self, key: np.ndarray, count: np.ndarray) -> None:
        self.keys.append(key)
        self.counts.append(count)
        self.fresh += len(count)
        if self.fresh > max(self.least, self.done):
            self.merge()

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        key, count = summed(self.keys, self.counts)
        self.keys, self.counts, self.done, self.fresh = [key], [count], len(count), 0
        return key, count
