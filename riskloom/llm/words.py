"""Words of many texts at once: places and 64-bit hashes in numpy."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

from riskloom.llm.pretokens import lower_latin, span_hashes

WORD = np.zeros(256, bool)
WORD[[*range(ord("a"), ord("z") + 1), *range(ord("A"), ord("Z") + 1), *range(ord("0"), ord("9") + 1)]] = True
WORD[0x80:0xFF] = True


class Words(NamedTuple):
    hashes: np.ndarray
    starts: np.ndarray  # byte places in the joined texts
    ends: np.ndarray
    first: np.ndarray  # per text, index of its first word; one more at the end


def words_of(offsets: np.ndarray, data: np.ndarray) -> Words:
    """Runs of letters, digits and non-ASCII characters, lower-cased in ASCII and Latin-1."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return Words(none.astype(np.uint64), none, none, np.zeros(len(offsets), np.int64))
    data = lower_latin(data)
    inside = WORD[data]
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    borders = offsets[(offsets > 0) & (offsets < len(data))]
    begin[borders] = inside[borders]  # a text ends its last word
    end[borders - 1] = inside[borders - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return Words(span_hashes(data, starts, ends), starts, ends, np.searchsorted(starts, offsets))
