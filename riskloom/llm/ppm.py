"""Prediction by partial matching with frozen statistics, for several classes at once, in numpy.

A tree of byte contexts up to some order is shared by all classes; each node holds, per class, the
code length of its last symbol after the symbols before it (escape method C, without exclusion),
and, as a context, the code length of an escape. A symbol costs what the longest held
context says; contexts that lack it add their escapes, contexts a class never met cost it nothing.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

DIGIT, SPACE, MARK = ord("0"), ord(" "), ord(".")


def folding() -> np.ndarray:
    """Byte to byte: A-Z lower case, one digit, one white space, one mark; others stay."""
    fold = np.arange(256, dtype=np.uint8)
    fold[:128] = MARK
    fold[ord("A") : ord("Z") + 1] = fold[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
    fold[ord("0") : ord("9") + 1] = DIGIT
    fold[[0x20, *range(0x09, 0x0E)]] = SPACE
    return fold


FOLD = folding()


def gram_counts(text: np.ndarray, longest: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct grams of folded ``text`` and their numbers, for lengths 1 to ``longest``.

    A gram of length n is its bytes as one number; spaces stand before the text.
    """
    folded = np.r_[np.full(longest - 1, SPACE, np.uint8), FOLD[text]].astype(np.int64)
    code, out = np.zeros(len(text), np.int64), []
    for length in range(1, longest + 1):
        at = longest - length
        code = code | (folded[at : at + len(text)] << (8 * (length - 1)))
        out.append(np.unique(code, return_counts=True))
    return out


class Level(NamedTuple):
    child: np.ndarray  # (nodes one level up, symbols) to node; 0 is no node
    cost: np.ndarray  # (nodes, classes) bits of the last symbol
    escape: np.ndarray  # (nodes one level up, classes) bits of an escape from there


class Model(NamedTuple):
    symbols: np.ndarray  # folded byte to symbol, 0 for a byte no class has met
    unseen: float  # bits of a symbol below the root
    levels: list[Level]

    def bits(self, offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
        """Code length of each whole text under every class: (texts, classes)."""
        classes = self.levels[0].cost.shape[1]
        out = np.zeros((len(offsets) - 1, classes))
        n = len(data)
        if n == 0:
            return out
        symbol = self.symbols[data].astype(np.int64)
        space = int(self.symbols[SPACE])
        begins = offsets[:-1][np.diff(offsets) > 0]
        nodes = [np.zeros(n, np.int64)]  # the context of no symbols, node 0 one level above the first
        found = np.zeros(n, np.int8)
        above = [np.zeros(n, np.int64)]
        padded = 0
        for k, level in enumerate(self.levels, 1):
            context = np.empty(n, np.int64)
            if k == 1:
                context[:] = 0
            else:
                context[1:] = nodes[-1][:-1]
                context[begins] = padded  # k - 1 spaces before the text
            node = level.child[context, symbol]
            node = node.astype(np.int64)
            # Node 0 of the levels above the first stands for "not held": it has no children.
            found[node > 0] = k
            above.append(context)
            nodes.append(node)
            padded = int(level.child[padded if k > 1 else 0, space])
        for k, level in enumerate(self.levels, 1):
            at = np.flatnonzero(found == k)
            _add(out, offsets, at, level.cost[nodes[k][at]])
            at = np.flatnonzero(found < k)
            _add(out, offsets, at, level.escape[above[k][at]])
        out += self.unseen * np.diff(np.searchsorted(np.flatnonzero(found == 0), offsets))[:, None]
        return out


def _add(out: np.ndarray, offsets: np.ndarray, at: np.ndarray, rows: np.ndarray) -> None:
    """Add ``rows``, which belong to byte places ``at`` (ascending), to their texts."""
    first = np.searchsorted(at, offsets)
    some = np.flatnonzero(np.diff(first) > 0)
    if len(some):
        out[some] += np.add.reduceat(rows, first[some], axis=0, dtype=np.float64)


def _with_spaces(codes: np.ndarray, counts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The context before a text, ``length`` spaces, is held even where no text has it inside."""
    spaces = sum(SPACE << (8 * k) for k in range(length))
    at = int(np.searchsorted(codes, spaces))
    if at < len(codes) and codes[at] == spaces:
        return codes, counts
    return np.insert(codes, at, spaces), np.insert(counts, at, 0, axis=0)


def fit(grams: list[tuple[np.ndarray, np.ndarray]]) -> Model:
    """Model from, per length, ascending gram codes and their counts (grams, classes).

    Every gram's prefix and suffix must be there too, as they are when all are counted over
    the same texts and rare ones are left out by total count.
    """
    grams = [_with_spaces(*made, k) for k, made in enumerate(grams, 1)]
    used = (grams[0][0] & 0xFF).astype(np.int64)
    fold_symbol = np.zeros(256, np.uint8)
    fold_symbol[used] = np.arange(1, len(used) + 1)
    width = len(used) + 1
    classes = grams[0][1].shape[1]
    unseen = float(np.log2(256))
    levels, codes_above, cost_above = [], np.zeros(1, np.int64), np.full((1, classes), unseen)
    for k, (codes, counts) in enumerate(grams, 1):
        # A code has its last symbol in the lowest byte.
        parent = np.searchsorted(codes_above, codes >> 8) if k > 1 else np.zeros(len(codes), np.int64)
        suffix = np.searchsorted(codes_above, codes & ((1 << (8 * (k - 1))) - 1)) if k > 1 else parent
        parent, suffix = (parent + 1, suffix + 1) if k > 1 else (parent, suffix)
        nodes_above = len(codes_above) + (k > 1)
        total, kinds = np.zeros((nodes_above, classes)), np.zeros((nodes_above, classes))
        np.add.at(total, parent, counts)
        np.add.at(kinds, parent, counts > 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            escape = np.where(total > 0, np.log2(total + kinds) - np.log2(kinds), 0.0)
            own = np.log2((total + kinds)[parent]) - np.log2(counts)
        cost = np.where(counts > 0, own, escape[parent] + cost_above[suffix])
        cost = np.vstack([np.zeros((1, classes)), cost])
        child = np.zeros((nodes_above, width), np.int32)
        child[parent, fold_symbol[codes & 0xFF]] = np.arange(1, len(codes) + 1)
        levels.append(Level(child, cost.astype(np.float32), escape.astype(np.float32)))
        codes_above, cost_above = codes, cost
    return Model(fold_symbol[FOLD], unseen, levels)
