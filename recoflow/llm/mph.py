"""A minimal perfect hash of integer keys, built in shards.

A shard's keys are hashed into a bit field of twice their number; keys that meet no
other are placed there, the others go on to the next, smaller field. A key's slot is the
number of set bits before its own, so the slots of n keys are 0 to n - 1. The key of
every slot is kept beside the bits: a lookup verifies what it finds.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np

from recoflow.llm.windows import mixed

#: Bits per key of each field.
GAMMA = 2
#: Keys are dealt into 2**FINE_BITS fine buckets; a shard is a range of them.
FINE_BITS = 20
_STEP = np.uint64(0x9E3779B97F4A7C15)


def fine_bucket(keys: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mixed(keys.astype(np.uint64) * _STEP) >> np.uint64(64 - FINE_BITS)).astype(np.int64)


def _at(keys: np.ndarray, level: int, size: np.ndarray | int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mixed(keys.astype(np.uint64) + np.uint64(level + 1) * _STEP) % np.asarray(size).astype(np.uint64)).astype(np.int64)


def build(keys: np.ndarray) -> tuple[list[int], bytes, np.ndarray]:
    """(bits per level, the bits as 64-bit words, keys by slot) of distinct ``keys``."""
    sizes, fields, placed, left, level = [], [], [], keys, 0
    while len(left):
        size = 64 * max(1, -(-GAMMA * len(left) // 64))
        at = _at(left, level, size)
        alone = np.bincount(at, minlength=size) == 1
        hit = alone[at]
        placed.append(left[hit][np.argsort(at[hit])])
        sizes.append(size)
        fields.append(np.packbits(alone, bitorder="little"))
        left, level = left[~hit], level + 1
    words = np.concatenate(fields).tobytes() if fields else b""
    return sizes, words, np.concatenate(placed) if placed else keys


@dataclass(frozen=True)
class Index:
    """The shards ``first`` to ``last`` (of ``n_shards``) behind one another."""

    first: int
    last: int
    n_shards: int
    sizes: np.ndarray
    bases: np.ndarray
    words: np.ndarray
    ranks: np.ndarray
    keys: np.ndarray
    starts: np.ndarray

    @classmethod
    def join(cls, first: int, last: int, n_shards: int, shards: Sequence[tuple[int, list[int], bytes, bytes]]) -> Index:
        """``shards``: (shard, sizes, words, keys as 64-bit numbers), ascending; shards without keys are absent."""
        depth = max([len(s) for _, s, _, _ in shards], default=0)
        sizes = np.zeros((last - first + 1, depth), np.int64)
        held = np.zeros(last - first + 1, np.int64)
        for shard, s, _, k in shards:
            sizes[shard - first, : len(s)] = s
            held[shard - first] = len(k) // 8
        ends = np.cumsum(sizes.ravel()).reshape(sizes.shape)
        words = np.frombuffer(b"".join(w for _, _, w, _ in shards), "<u8")
        ranks = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])
        keys = np.frombuffer(b"".join(k for _, _, _, k in shards), "<i8")
        return cls(first, last, n_shards, sizes, ends - sizes, words, ranks, keys, np.concatenate([[0], np.cumsum(held)]))

    def __len__(self) -> int:
        return len(self.keys)

    def own(self, keys: np.ndarray) -> np.ndarray:
        """Which keys belong to the shards of this index."""
        shard = shard_of(fine_bucket(keys), self.n_shards)
        return (shard >= self.first) & (shard <= self.last)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of every key, -1 for a key that the index does not hold."""
        out = np.full(len(keys), -1, np.int64)
        shard = shard_of(fine_bucket(keys), self.n_shards) - self.first
        left = np.flatnonzero((shard >= 0) & (shard <= self.last - self.first))
        for level in range(self.sizes.shape[1]):
            left = left[self.sizes[shard[left], level] > 0]
            if not len(left):
                break
            s = shard[left]
            at = self.bases[s, level] + _at(keys[left], level, self.sizes[s, level])
            word, bit = self.words[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1))).astype(np.int64)
            slot = self.ranks[at >> 6] + below
            found = hit & (self.keys[np.where(hit, slot, 0)] == keys[left])
            out[left[found]] = slot[found]
            left = left[~hit]
        return out


def shard_of(fine: np.ndarray, n_shards: int) -> np.ndarray:
    return fine * n_shards >> FINE_BITS
