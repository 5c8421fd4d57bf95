"""A minimal perfect hash over a fixed set of byte strings.

Hash and displace: keys fall into small buckets, the largest buckets first look for a displacement
that sends all their keys to free slots, and buckets of one key take the slots that are left. A
lookup is two array reads and ends with a comparison of the key itself, so that strings outside the
set are recognised.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import numpy as np
import xxhash

MIX = np.uint64(0x9E3779B97F4A7C15)


def _slots(hashes: np.ndarray, displacement: np.ndarray, size: int) -> np.ndarray:
    x = (hashes ^ (displacement.astype(np.uint64) * MIX)) * MIX
    return ((x ^ (x >> np.uint64(32))) % np.uint64(size)).astype(np.int64)


class PerfectHash:
    """Slots 0 to n-1 for n distinct keys; `keys[slot]` is the key there."""

    def __init__(self, keys: Sequence[bytes], bucket_keys: int = 3) -> None:
        if len(set(keys)) != len(keys):
            raise ValueError("keys must be distinct")
        self.size = len(keys)
        self.seed = 0
        self.buckets = max(1, self.size // bucket_keys)
        while not self._build(keys):
            self.seed += 1

    def _hashes(self, keys: Iterable[bytes]) -> np.ndarray:
        return np.array([xxhash.xxh3_64_intdigest(k, self.seed) for k in keys], dtype=np.uint64)

    def _build(self, keys: Sequence[bytes]) -> bool:
        hashes = self._hashes(keys)
        if len(np.unique(hashes)) != self.size:
            return False
        bucket = (hashes >> np.uint64(17)) % np.uint64(self.buckets)
        order = np.argsort(bucket, kind="stable")
        bounds = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        sizes = np.diff(bounds)
        # at least 0: a displacement; below: a slot of its own, as -1 - slot
        self.displacement = np.zeros(self.buckets, dtype=np.int64)
        taken = np.zeros(self.size, dtype=bool)
        where = np.zeros(self.size, dtype=np.int64)
        tries = np.arange(64)
        for b in np.argsort(-sizes, kind="stable"):
            members = order[bounds[b] : bounds[b + 1]]
            if len(members) < 2:
                break
            for first in range(0, 1 << 16, 64):
                slots = _slots(hashes[members][None, :], (first + tries)[:, None], self.size)
                free = ~taken[slots].any(axis=1)
                hit = next(
                    (i for i in np.flatnonzero(free) if len(set(slots[i])) == len(members)), None
                )
                if hit is not None:
                    break
            else:
                return False
            self.displacement[b] = first + hit
            taken[slots[hit]] = True
            where[members] = slots[hit]
        single = np.flatnonzero(sizes == 1)
        left = np.flatnonzero(~taken)
        self.displacement[single] = -1 - left[: len(single)]
        where[order[bounds[single]]] = left[: len(single)]
        self.keys: list[bytes] = [b""] * self.size
        self.index = np.zeros(self.size, dtype=np.int64)
        for i, slot in enumerate(where.tolist()):
            self.keys[slot] = keys[i]
            self.index[slot] = i
        return True

    def lookup(self, keys: Sequence[bytes]) -> list[int]:
        """Position of each key in the list the hash was built from, -1 for other strings."""
        if not keys or not self.size:
            return [-1] * len(keys)
        hashes = self._hashes(keys)
        displacement = self.displacement[(hashes >> np.uint64(17)) % np.uint64(self.buckets)]
        slots = np.where(
            displacement < 0,
            -1 - displacement,
            _slots(hashes, np.maximum(displacement, 0), self.size),
        )
        index = self.index[slots].tolist()
        table = self.keys
        return [i if table[s] == k else -1 for k, s, i in zip(keys, slots.tolist(), index)]
