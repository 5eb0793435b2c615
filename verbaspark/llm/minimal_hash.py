"""A minimal perfect hash by hash-and-displace, looked up for whole numpy arrays at once."""

from __future__ import annotations

import numpy as np

_DIRECT = np.uint64(1 << 63)
_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    x = x ^ np.uint64(seed)
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


class MinimalPerfectHash:
    """Maps n distinct 64-bit keys one to one onto 0..n-1.

    Keys fall into buckets of about two; each bucket stores the displacement that sends all its keys to
    free slots, large buckets first; a bucket of one key stores its slot itself. ``find`` also compares the stored key, so a key that was
    never put in gives -1. An empty set of keys finds nothing.
    """

    def __init__(self, keys: np.ndarray):
        keys = np.asarray(keys, np.uint64)
        n = self.n = len(keys)
        if not n:
            return
        assert len(np.unique(keys)) == n, "keys must be distinct"
        self.buckets = max(1, n // 2)
        for self.seed in range(1, 50):
            if self._place(keys):
                return
        raise ValueError("no perfect hash found")

    def _place(self, keys: np.ndarray) -> bool:
        n = self.n
        bucket, h = self._parts(keys)
        order = np.argsort(bucket, kind="stable")
        sizes = np.bincount(bucket, minlength=self.buckets)
        starts = np.cumsum(sizes) - sizes
        taken = np.zeros(n, bool)
        self.displace = np.zeros(self.buckets, np.uint64)
        self.key = np.zeros(n, np.uint64)
        self.index = np.zeros(n, np.int64)
        h_l, m1, m2, top = h[order].tolist(), int(_M1), int(_M2), 2**64 - 1
        free = None
        for b in np.argsort(-sizes, kind="stable").tolist():
            size, start = int(sizes[b]), int(starts[b])
            if not size:
                break
            if size == 1:
                if free is None:
                    free = iter(np.flatnonzero(~taken).tolist())
                s = next(free)
                self.displace[b] = np.uint64(s) | _DIRECT
                self.key[s], self.index[s] = keys[order[start]], order[start]
                continue
            mine = h_l[start : start + size]
            for d in range(40 * n):
                slots = [(((x + d * m1) * m2 & top) >> 32) * n >> 32 for x in mine]
                if len(set(slots)) == size and not any(taken[s] for s in slots):
                    break
            else:
                return False
            self.displace[b] = d
            for k, s in enumerate(slots):
                taken[s] = True
                self.key[s] = keys[order[start + k]]
                self.index[s] = order[start + k]
        return True

    def _parts(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = _mix(keys, self.seed)
        return ((h >> np.uint64(32)) * np.uint64(self.buckets) >> np.uint64(32)).astype(np.int64), h

    def _slots(self, h: np.ndarray, d: np.ndarray) -> np.ndarray:
        return ((h + d * _M1) * _M2 >> np.uint64(32)) * np.uint64(self.n) >> np.uint64(32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Place of each key in the array it was built from, or -1."""
        keys = np.asarray(keys, np.uint64)
        if not self.n:
            return np.full(len(keys), -1, np.int64)
        bucket, h = self._parts(keys)
        d = self.displace[bucket]
        slot = np.where(d >= _DIRECT, d ^ _DIRECT, self._slots(h, d)).astype(np.int64)
        return np.where(self.key[slot] == keys, self.index[slot], -1)
