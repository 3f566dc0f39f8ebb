"""Burrows-Wheeler transforms of shards, merged by iterative interleave refinement.

A shard is a byte string, read cyclically.  Its rotations are sorted once, on their own (prefix
doubling).  Shards are then merged without sorting rotations again: the merged order is kept as an
interleave (which shard each place belongs to), and a pass over the transform's preceding symbols
sorts it one step deeper (Holt and McMillan, "Merging of multi-string BWTs with applications",
Bioinformatics 2014).  A step here takes two symbols, so it is one stable radix pass.  Where an
entry's prefix first differs from its predecessor's is noted in the step that separates them, which
gives the common prefixes; entries not separated at depth d have equal d-byte prefixes.
"""

from __future__ import annotations

import numpy as np


def rotations(text: np.ndarray, depth: int) -> np.ndarray:
    """Starts of the rotations of a cyclic text, sorted by at least their first ``depth`` bytes."""
    n = len(text)
    turn = np.arange(n)
    key = np.zeros(n, np.uint64)
    for j in range(8):
        key = (key << np.uint64(8)) | text[(turn + j) % n]
    have = 8
    while True:
        order = np.argsort(key)  # equal keys get equal ranks, so their order is free
        sorted_key = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.append(0, sorted_key[1:] != sorted_key[:-1]))
        if have >= depth or rank[order[-1]] == n - 1:
            return order
        key = rank * n + rank[(turn + have) % n]
        have *= 2


def merge(texts: list[np.ndarray], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merge the shards' transforms: (shard, start, block) of all rotations in merged order.

    Rotations with equal ``depth``-byte prefixes (depth even), and no others, have equal block numbers.
    """
    if len(texts) > 255:
        raise ValueError("at most 255 shards are merged at once")
    orders = [rotations(t, depth) for t in texts]
    preceding = np.concatenate([(t[o - 2].astype(np.uint16) << np.uint16(8)) | t[o - 1] for t, o in zip(texts, orders, strict=True)])
    start = np.concatenate([o.astype(np.int32) for o in orders])
    del orders
    shard = np.repeat(np.arange(len(texts), dtype=np.uint8), [len(t) for t in texts])
    n = len(start)
    entry = np.arange(n, dtype=np.int32)  # of each place of the merged order: the shard's entry there
    block = np.zeros(n, np.int32)
    for _ in range(0, depth, 2):
        key = preceding[entry]
        order = np.argsort(key, kind="stable")
        key, old, inter = key[order], block[order], shard[entry][order]
        block = np.zeros(n, np.int32)
        np.cumsum((key[1:] != key[:-1]) | (old[1:] != old[:-1]), out=block[1:])
        del key, old, order
        entry[np.argsort(inter, kind="stable")] = np.arange(n, dtype=np.int32)
        if block[-1] == n - 1:
            break
    return shard[entry], start[entry], block
