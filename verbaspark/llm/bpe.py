"""Byte-pair encoding by a heap over linked symbols, and the rank files."""

from __future__ import annotations

import base64
import heapq


def merge_by_heap(ids: list[int], pair) -> list[int]:
    """Merge linked symbols, the lowest rank and of equals the leftmost first.

    ``pair(a, b)`` gives (rank, id made) or None. Outdated entries of the heap are known by the ids they name.
    """
    n = len(ids)
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    heap = [(p[0], i, ids[i], ids[i + 1], p[1]) for i in range(n - 1) if (p := pair(ids[i], ids[i + 1]))]
    heapq.heapify(heap)
    while heap:
        _, i, a, b, made = heapq.heappop(heap)
        j = after[i]
        if ids[i] != a or j >= n or ids[j] != b:
            continue
        ids[i], ids[j] = made, -1
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            if p := pair(made, ids[k]):
                heapq.heappush(heap, (p[0], i, made, ids[k], p[1]))
        h = before[i]
        if h >= 0 and (p := pair(ids[h], made)):
            heapq.heappush(heap, (p[0], h, ids[h], made, p[1]))
    return [x for x in ids if x >= 0]


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file, in order of rank."""
    ranks = {}
    with open(path, "rb") as f:
        for line in f:
            if line.strip():
                token, rank = line.split()
                ranks[int(rank)] = base64.b64decode(token)
    return [ranks[i] for i in range(len(ranks))]
