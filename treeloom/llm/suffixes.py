"""Suffix sorting by hashes: prefix polynomial hashes, common extensions by binary search, a mergesort of suffixes.

All arrays are over one buffer of bytes, or of 64-bit codes. Arithmetic is modulo 2^64; hashes that are equal are verified by the
buffer itself.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

_BASE = 0x2545F4914F6CDD1D  # odd, so that powers can be undone
_M = np.uint64(0xFF51AFD7ED558CCD)
_M2 = np.uint64(0xC4CEB9FE1A85EC53)


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads a hash's bits."""
    h = (h ^ (h >> np.uint64(33))) * _M
    h = (h ^ (h >> np.uint64(29))) * _M2
    return h ^ (h >> np.uint64(32))


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    made = []
    for b in (_BASE, pow(_BASE, -1, 1 << 64)):
        p = np.full(n, b, np.uint64)
        p[0] = 1
        made.append(np.multiply.accumulate(p))
    return made[0], made[1]


class Buffer:
    """Bytes with the prefix sums of a polynomial hash."""

    def __init__(self, data: np.ndarray):
        self.data = data
        power, self.undo = _powers(1 << max(16, int(len(data) + 1).bit_length()))
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=self.sums[1:])

    def hash(self, start: np.ndarray, length) -> np.ndarray:
        """The hash of the length bytes at each start: equal for equal bytes wherever they are."""
        return mix(self._raw(start, length))

    def gram_hashes(self, k: int) -> np.ndarray:
        """The hash of the k bytes at every position that has them."""
        return mix((self.sums[k:] - self.sums[:-k]) * self.undo[: len(self.data) - k + 1])

    def _raw(self, start: np.ndarray, length) -> np.ndarray:
        return (self.sums[start + length] - self.sums[start]) * self.undo[start]

    def extension(self, a: np.ndarray, b: np.ndarray, limit: int) -> np.ndarray:
        """How many bytes at a and b agree, up to limit: all of them by one comparison, else by binary search."""
        out = np.full(len(a), limit, np.int64)
        left = np.flatnonzero(self._raw(a, limit) != self._raw(b, limit))
        x, y, low = a[left], b[left], np.zeros(len(left), np.int64)
        step = 1 << (limit.bit_length() - 1)
        while step:
            more = np.minimum(low + step, limit)
            low = np.where(self._raw(x, more) == self._raw(y, more), more, low)
            step >>= 1
        out[left] = np.minimum(low, limit - 1)
        return out

    def less(self, a: np.ndarray, b: np.ndarray, limit: int) -> np.ndarray:
        """Whether the suffix at a comes before the one at b, or is its equal at a smaller place."""
        same = self.extension(a, b, limit)
        at = np.minimum(same, limit - 1)
        return np.where(same >= limit, a < b, self.data[a + at] < self.data[b + at])


def suffix_order(buffer: Buffer, starts: np.ndarray, limit: int) -> np.ndarray:
    """The distinct starts in the order of their suffixes of limit bytes, equal ones by place.

    The first eight bytes (or the first code) come first; what they leave equal is mergesorted from runs of one. A merge finds each suffix's rank in
    the other run by binary search, so a merge level is a few array operations whatever its number of runs.
    """
    if not len(starts):
        return starts
    starts = np.sort(starts)
    if buffer.data.itemsize == 8:
        head = buffer.data[starts]
    else:
        head = np.zeros(len(starts), np.uint64)
        for k in range(8):
            head = (head << np.uint64(8)) | buffer.data[starts + k].astype(np.uint64)
    order = np.argsort(head, kind="stable")
    out, head = starts[order], head[order]
    bounds = np.flatnonzero(np.r_[True, head[1:] != head[:-1], True])
    sizes = np.diff(bounds)
    many = sizes > 1
    group_start, group_size = bounds[:-1][many], sizes[many]
    if not len(group_size):
        return out
    slots = np.concatenate([np.arange(s, s + n) for s, n in zip(group_start, group_size, strict=True)]) if len(group_size) < 64 else np.repeat(group_start - np.r_[0, np.cumsum(group_size)[:-1]], group_size) + np.arange(group_size.sum())
    begin, size = np.repeat(group_start, group_size), np.repeat(group_size, group_size)
    width = 1
    while True:
        live = size > width
        if not live.any():
            return out
        slots, begin, size = slots[live], begin[live], size[live]
        at = slots - begin
        run = at // width
        other = run ^ 1
        low = np.minimum(other * width, size)
        high = np.minimum(low + width, size)
        mine, first = out[slots], low.copy()
        # the rank in the other run: how many of its suffixes come before mine
        for _ in range(int(width).bit_length()):
            open_ = low < high
            if not open_.any():
                break
            mid = (low + high) // 2
            rows = np.flatnonzero(open_)
            before = buffer.less(out[begin[rows] + mid[rows]], mine[rows], limit)
            low[rows] = np.where(before, mid[rows] + 1, low[rows])
            high[rows] = np.where(before, high[rows], mid[rows])
        to = begin + (run // 2) * 2 * width + (at - run * width) + (low - first)
        out[to] = mine
        width *= 2


def equal_neighbours(buffer: Buffer, order: np.ndarray, limit: int) -> np.ndarray:
    """For each but the first of sorted suffixes whether its limit bytes are those of the one before; verified by the bytes."""
    a, b = order[:-1], order[1:]
    same = buffer.extension(a, b, limit) >= limit
    rows = np.flatnonzero(same)
    span = np.arange(limit)
    for at in range(0, len(rows), 4096):
        r = rows[at : at + 4096]
        same[r] = (buffer.data[a[r][:, None] + span] == buffer.data[b[r][:, None] + span]).all(axis=1)
    return same
