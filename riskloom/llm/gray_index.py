"""Gray-order hierarchical index over 64-bit fingerprints, in numpy.

Fingerprints are sorted by Gray rank, so that neighbours differ in few bits. Each node of the tree
keeps the bits all its members share (a mask and their values). Two nodes differ at least in the
shared bits in which both are fixed and unlike; once these differences pass the limit, all pairs
below are pruned together.
"""

from __future__ import annotations

import numpy as np

FAN_OUT = 8
FRONTIER = 1 << 18


def gray_rank(fingerprints: np.ndarray) -> np.ndarray:
    rank = fingerprints.astype(np.uint64)
    for shift in (1, 2, 4, 8, 16, 32):
        rank = rank ^ (rank >> np.uint64(shift))
    return rank


def _levels(values: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(shared-bit mask, shared values) of every node, leaves first."""
    ones, zeros = values, values
    levels = [(np.full(len(values), ~np.uint64(0)), values)]
    while len(ones) > 1:
        starts = np.arange(0, len(ones), FAN_OUT)
        ones, zeros = np.bitwise_and.reduceat(ones, starts), np.bitwise_or.reduceat(zeros, starts)
        mask = ~(ones ^ zeros)
        levels.append((mask, ones & mask))
    return levels


def close_pairs(values: np.ndarray, limit: int):
    """Yield index arrays (i, j), i < j, of all pairs of the Gray-sorted ``values`` that differ in
    at most ``limit`` bits; every pair once."""
    levels = _levels(values)
    if len(values) < 2:
        return
    stack = [(len(levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while stack:
        level, a, b = stack.pop()
        if level == 0:
            yield a, b
            continue
        below = len(levels[level - 1][0])
        step = np.arange(FAN_OUT)
        left = np.repeat(a * FAN_OUT, FAN_OUT * FAN_OUT) + np.tile(np.repeat(step, FAN_OUT), len(a))
        right = np.repeat(b * FAN_OUT, FAN_OUT * FAN_OUT) + np.tile(np.tile(step, FAN_OUT), len(b))
        keep = (left < below) & (right < below) & ((left < right) if level == 1 else (left <= right))
        left, right = left[keep], right[keep]
        mask, shared = levels[level - 1]
        apart = np.bitwise_count((shared[left] ^ shared[right]) & mask[left] & mask[right])
        near = apart <= limit
        left, right = left[near], right[near]
        # Depth first in bounded pieces: the frontier never holds all pairs.
        piece = FRONTIER // (FAN_OUT * FAN_OUT)
        for start in range(0, len(left), piece):
            stack.append((level - 1, left[start : start + piece], right[start : start + piece]))


def smallest_linked(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Merge links (i, j) into ``labels`` (each index's smallest known member). May be called again
    with further links: only roots are lowered, so earlier links hold."""
    while True:
        while not ((up := labels[labels]) == labels).all():
            labels = up
        a, b = labels[i], labels[j]
        apart = a != b
        if not apart.any():
            return labels
        labels = up
        np.minimum.at(labels, np.maximum(a, b)[apart], np.minimum(a, b)[apart])


def link_groups(groups: np.ndarray, values: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links (value, value) of the close pairs inside every group.

    ``groups`` numbers the group of each value; values are distinct inside a group.
    """
    order = np.lexsort((gray_rank(values), groups))
    groups, values = groups[order], values[order]
    starts = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]])
    sizes = np.diff(np.r_[starts, len(groups)])
    labels = np.arange(len(values))
    small = np.repeat(sizes <= FAN_OUT, sizes)
    for gap in range(1, FAN_OUT):  # a group of one leaf node is compared at once, with all others like it
        i = np.flatnonzero(small[:-gap] & (groups[gap:] == groups[:-gap]))
        i = i[np.bitwise_count(values[i] ^ values[i + gap]) <= limit]
        if len(i):
            labels = smallest_linked(labels, i, i + gap)
    for start, size in zip(starts[sizes > FAN_OUT], sizes[sizes > FAN_OUT], strict=True):
        part = np.arange(size)
        for i, j in close_pairs(values[start : start + size], limit):
            part = smallest_linked(part, i, j)
        labels[start : start + size] = start + part
    linked = np.flatnonzero(labels != np.arange(len(values)))
    return values[linked], values[labels[linked]]
