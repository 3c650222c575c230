"""Multiprobe p-stable hashing: Gaussian projections cut into slots of a width, and the order in which to try other slots."""

from __future__ import annotations

import heapq

import numpy as np


class Hashes:
    """TABLES tables of `functions` p-stable functions floor((a.x + b) / width) over vectors of `dim` components."""

    def __init__(self, dim: int, tables: int, functions: int, width: float, seed: int = 11):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.tables, self.functions, self.width = tables, functions, width
        self.a = rng.standard_normal((dim, tables * functions))
        self.b = rng.uniform(0, width, tables * functions)
        self.mix = rng.integers(0, 2**63, functions, np.uint64) * np.uint64(2) + np.uint64(1)

    def slots(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows, tables, functions): the slot of each function, and where in it (0 to 1) the vector falls."""
        at = (x @ self.a + self.b) / self.width
        slot = np.floor(at)
        shape = (len(x), self.tables, self.functions)
        return slot.astype(np.int64).reshape(shape), (at - slot).reshape(shape)

    def keys(self, slots: np.ndarray) -> np.ndarray:
        """A 64-bit key of the slots in the last axis."""
        out = ((slots.astype(np.uint64) + np.uint64(1 << 40)) * self.mix).sum(axis=-1, dtype=np.uint64)
        out ^= out >> np.uint64(31)
        return (out * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def probe_sets(functions: int, probes: int) -> list[tuple[int, ...]]:
    """Sets of ranks 0 to 2*functions-1 of single steps, in the order of their expected scores, the empty set first.

    Steps of a vector are ranked by the squared distance to the slot's edge that they cross; the step of rank j and that of
    rank 2*functions-1-j are the two steps of one function and exclude each other. The expected squared distance of rank j
    gives the order once for all vectors: sets are generated by shifting or expanding the best so far.
    """
    m = functions
    j = np.arange(1, 2 * m + 1, dtype=float)
    score = np.where(j <= m, j * (j + 1) / (4 * (m + 1) * (m + 2)), 1 - (2 * m + 1 - j) / (m + 1) + (2 * m + 1 - j) * (2 * m + 2 - j) / (4 * (m + 1) * (m + 2)))
    out: list[tuple[int, ...]] = [()]
    heap = [(score[0], (0,))]
    while heap and len(out) < probes:
        _, s = heapq.heappop(heap)
        if all(2 * m - 1 - x not in s for x in s):
            out.append(s)
        last = s[-1] + 1
        if last < 2 * m:
            for new in ((*s[:-1], last), (*s, last)):
                heapq.heappush(heap, (float(score[list(new)].sum()), new))
    return out


def probe_keys(hashes: Hashes, x: np.ndarray, sets: list[tuple[int, ...]]) -> np.ndarray:
    """(rows, tables, probes): the keys of the buckets to visit, in the order of `sets`."""
    slots, at = hashes.slots(x)
    m = hashes.functions
    # The ranks of a function's two steps add up to 2m-1: functions are sorted by their nearer edge.
    near = np.argsort(np.minimum(at, 1 - at), axis=2, kind="stable")
    down = np.take_along_axis(at, near, 2) <= 0.5
    delta = np.where(down, -1, 1)
    out = np.empty((*slots.shape[:2], len(sets)), np.int64)
    rows, tables = np.ogrid[: slots.shape[0], : slots.shape[1]]
    for k, s in enumerate(sets):
        moved = slots.copy()
        for rank in s:
            r = rank if rank < m else 2 * m - 1 - rank
            moved[rows, tables, near[:, :, r]] += delta[:, :, r] if rank < m else -delta[:, :, r]
        out[:, :, k] = hashes.keys(moved)
    return out
