"""Groups of two token streams over one text, as fragments that compose associatively.

A byte range of a text holds the tokens of both streams that end in it. Where tokens of both streams end
at the same byte, a group closes. What lies before the first such byte is the open prefix of the
range, what lies after the last one its open suffix; between them are closed groups. Putting two
ranges side by side joins the suffix of the one with the prefix of the other to a group, in whatever order
ranges are put together.
"""

from __future__ import annotations

from operator import add
from typing import NamedTuple

import numpy as np

KEY_BITS = 20  # of the second id in the key of a pair
MANY = 4096  # links of a group above which equal ids are counted first


def pair_keys(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a.astype(np.int64) << KEY_BITS) | b.astype(np.int64)


class Stream(NamedTuple):
    ids: np.ndarray
    ends: np.ndarray  # byte behind each token


class Fragment(NamedTuple):
    closed: bool  # is there a byte at which a group closes
    head_a: np.ndarray
    head_b: np.ndarray
    text: bytes  # closed groups
    groups: int
    links: int
    keys: np.ndarray  # distinct pairs linked in closed groups
    times: np.ndarray
    tail_a: np.ndarray
    tail_b: np.ndarray
    n_a: int
    n_b: int


NO_IDS = np.zeros(0, np.int64)


def common_ends(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """What both ascending lists hold."""
    if not len(a) or not len(b):
        return NO_IDS
    return a[b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a]


def marked_ids(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> list[str]:
    """The ids of groups in order, each behind its mark: joined, they are the text of the groups and a
    semicolon before it."""
    first = np.cumsum(size_a + size_b) - size_a - size_b
    at_a = np.arange(len(a)) + np.repeat(first - np.cumsum(size_a) + size_a, size_a)
    at_b = np.arange(len(b)) + np.repeat(first + size_a - np.cumsum(size_b) + size_b, size_b)
    ids, marks = np.zeros(len(a) + len(b), np.int64), np.full(len(a) + len(b), ",")
    ids[at_a], ids[at_b] = a, b
    marks[first] = ";"
    marks[first + size_a] = "|"
    return list(map(add, marks.tolist(), map(str, ids.tolist())))


def groups_text(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> bytes:
    return "".join(marked_ids(a, b, size_a, size_b))[1:].encode()


def added(keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each key once, in order, with its times summed up."""
    if not len(keys):
        return NO_IDS, NO_IDS
    order = np.argsort(keys, kind="stable")
    keys, times = keys[order], times[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[first], np.add.reduceat(times, first)


def links(
    a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, key, times) of what is linked in groups that hold the next ``size`` ids of both streams."""
    first_a, first_b = np.cumsum(size_a) - size_a, np.cumsum(size_b) - size_b
    crowded = size_a * size_b > MANY
    own = ~np.repeat(crowded, size_a)
    group = np.repeat(np.arange(len(size_a)), size_a)[own]
    left, width = a[own], size_b[group]
    last = np.cumsum(width)
    total = int(last[-1]) if len(last) else 0
    right = b[np.arange(total) - np.repeat(last - width - first_b[group], width)]
    parts = [(np.repeat(group, width), pair_keys(np.repeat(left, width), right), np.ones(total, np.int64))]
    for g in np.flatnonzero(crowded).tolist():
        one, times = np.unique(a[first_a[g] : first_a[g] + size_a[g]], return_counts=True)
        other, others = np.unique(b[first_b[g] : first_b[g] + size_b[g]], return_counts=True)
        keys = pair_keys(one[:, None], other[None, :]).ravel()
        parts.append((np.full(len(keys), g), keys, (times[:, None] * others[None, :]).ravel()))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def fragment(a: Stream, b: Stream) -> Fragment:
    """The fragment of the tokens of one byte range."""
    common = common_ends(a.ends, b.ends)
    if not len(common):
        return Fragment(False, a.ids, b.ids, b"", 0, 0, NO_IDS, NO_IDS, NO_IDS, NO_IDS, len(a.ids), len(b.ids))
    at_a = np.searchsorted(a.ends, common, side="right")
    at_b = np.searchsorted(b.ends, common, side="right")
    inner_a, inner_b = a.ids[at_a[0] : at_a[-1]], b.ids[at_b[0] : at_b[-1]]
    size_a, size_b = np.diff(at_a), np.diff(at_b)
    _, keys, times = links(inner_a, inner_b, size_a, size_b)
    keys, times = added(keys, times)
    return Fragment(
        True,
        a.ids[: at_a[0]],
        b.ids[: at_b[0]],
        groups_text(inner_a, inner_b, size_a, size_b),
        len(size_a),
        int((size_a * size_b).sum()),
        keys,
        times,
        a.ids[at_a[-1] :],
        b.ids[at_b[-1] :],
        len(a.ids),
        len(b.ids),
    )


def compose(left: Fragment, right: Fragment) -> Fragment:
    """The fragment of two neighbouring ranges."""
    n_a, n_b = left.n_a + right.n_a, left.n_b + right.n_b
    if not left.closed:
        head_a, head_b = np.r_[left.head_a, right.head_a], np.r_[left.head_b, right.head_b]
        return right._replace(head_a=head_a, head_b=head_b, n_a=n_a, n_b=n_b)
    between_a, between_b = np.r_[left.tail_a, right.head_a], np.r_[left.tail_b, right.head_b]
    if not right.closed:
        return left._replace(tail_a=between_a, tail_b=between_b, n_a=n_a, n_b=n_b)
    sizes = np.array([len(between_a)]), np.array([len(between_b)])
    _, keys, times = links(between_a, between_b, *sizes)
    keys, times = added(np.r_[left.keys, keys, right.keys], np.r_[left.times, times, right.times])
    texts = [t for t in (left.text, groups_text(between_a, between_b, *sizes), right.text) if t]
    return Fragment(
        True,
        left.head_a,
        left.head_b,
        b";".join(texts),
        left.groups + 1 + right.groups,
        left.links + len(between_a) * len(between_b) + right.links,
        keys,
        times,
        right.tail_a,
        right.tail_b,
        n_a,
        n_b,
    )


EMPTY = Fragment(False, NO_IDS, NO_IDS, b"", 0, 0, NO_IDS, NO_IDS, NO_IDS, NO_IDS, 0, 0)
START = EMPTY._replace(closed=True)  # the byte before a text, where both streams have a border


def composed(parts: list[Fragment]) -> Fragment:
    """Neighbouring fragments in order, put together as a tree."""
    while len(parts) > 1:
        parts = [compose(*parts[k : k + 2]) if k + 1 < len(parts) else parts[k] for k in range(0, len(parts), 2)]
    return parts[0] if parts else EMPTY
