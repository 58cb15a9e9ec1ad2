"""Pre-tokens of many texts at once, as byte spans in numpy.

Texts are laid end to end with a border byte between them, each byte gets a class (letter, digit,
white space, other), and token starts follow from class changes. That covers ASCII and the
blocks of letters listed below; a text with any other character is cut by the pattern itself.
Spans are then told apart by a 64-bit hash and their bytes, so that each distinct pre-token is
worked on once.
"""

from __future__ import annotations

import re
import unicodedata
from typing import NamedTuple

import numpy as np
import regex
import xxhash

BORDER = 0xFF
EDGE, LETTER, DIGIT, WHITE, OTHER = range(5)
PIECE_BYTES = 1 << 20
LONG_SPAN = 64  # bytes above which the running sum alone tells spans apart too badly

CLASSES = np.full(256, OTHER, np.uint8)
CLASSES[[*range(ord("a"), ord("z") + 1), *range(ord("A"), ord("Z") + 1)]] = LETTER
CLASSES[0x80:0xFF] = LETTER
CLASSES[[*range(ord("0"), ord("9") + 1)]] = DIGIT
CLASSES[[0x20, *range(0x09, 0x0E)]] = WHITE
CLASSES[BORDER] = EDGE

# The two pre-token patterns.
SPACED_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class Style(NamedTuple):
    spaced: bool  # a token takes one space before it; else white space is dropped
    lead_bytes: frozenset[int]  # first bytes of blocks that hold letters only (and need no normalising)
    pattern: str
    specials: tuple[bytes, ...]


# U+00C0-U+027F, U+0400-U+047F, U+5000-U+8FFF; two signs among the first are taken out below.
SPACED = Style(True, frozenset([*range(0xC3, 0xCA), 0xD0, 0xD1, *range(0xE5, 0xE9)]), SPACED_PATTERN, (b"<|endoftext|>",))
WORDS = Style(False, frozenset([0xC3, *range(0xE5, 0xE9)]), WORD_PATTERN, (b"<|startoftext|>", b"<|endoftext|>"))


class Spans(NamedTuple):
    data: bytes
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray  # per text, index of its first span; one more at the end

    def hashes(self) -> np.ndarray:
        return span_hashes(np.frombuffer(self.data, np.uint8), self.starts, self.ends)

    def words(self, which: np.ndarray) -> list[bytes]:
        places = zip(self.starts[which].tolist(), self.ends[which].tolist(), strict=True)
        return [self.data[a:b] for a, b in places]


_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
_BASE = 0x9E3779B97F4A7C15


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2^64."""
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 2**64))):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS[0][:n], _POWERS[1]


def running_hash(data: np.ndarray) -> np.ndarray:
    """The running sum that all span hashes of ``data`` are taken from."""
    power, _ = _powers(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data + np.uint64(1)) * power, out=total[1:])
    return total


def span_hashes(
    data: np.ndarray, starts: np.ndarray, ends: np.ndarray, total: np.ndarray | None = None
) -> np.ndarray:
    """A 64-bit hash of every byte span: a polynomial from one running sum, XXH64 for long spans,
    where sums modulo a power of two meet for regular texts."""
    if total is None:
        total = running_hash(data)
    _, inverse = _powers(len(data))
    x = (total[ends] - total[starts]) * inverse[starts]
    long = np.flatnonzero(ends - starts > LONG_SPAN)
    if len(long):
        spans = zip(starts[long].tolist(), ends[long].tolist(), strict=True)
        x[long] = np.array([xxhash.xxh64_intdigest(data[a:b].tobytes()) for a, b in spans], np.uint64)
    x ^= (ends - starts).astype(np.uint64) << np.uint64(48)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(33))


def lower_latin(data: np.ndarray) -> np.ndarray:
    """A-Z and the capitals of U+00C0-U+00DE in lower case."""
    data = data.copy()
    data[(data >= 0x41) & (data <= 0x5A)] += 0x20
    after = np.flatnonzero(data[:-1] == 0xC3) + 1
    after = after[(data[after] <= 0x9E) & (data[after] != 0x97)]
    data[after] += 0x20
    return data


def _normal(text: str) -> str:
    text = regex.sub(r"\s+", " ", unicodedata.normalize("NFC", text))
    return "".join(c.lower() for c in text)


def _cuts(data: np.ndarray, size: int) -> list[int]:
    """Places to cut a very long text without changing its tokens: single spaces between words."""
    white = CLASSES[data] == WHITE
    at = np.flatnonzero((data[1:-1] == 0x20) & ~white[:-2] & ~white[2:]) + 1
    cuts, last = [], 0
    while last + size < len(data):
        k = int(np.searchsorted(at, last + size))
        if k == len(at):
            break
        last = int(at[k])
        cuts.append(last)
    return cuts


def _contractions(data: np.ndarray, kind: np.ndarray, start: np.ndarray) -> None:
    """'s 't 'm 'd 're 've 'll at a token start are tokens of their own."""
    q = np.flatnonzero((data == 0x27) & start)
    one, two = data[q + 1], data[np.minimum(q + 2, len(data) - 1)]  # a border ends the data
    single = np.isin(one, np.frombuffer(b"stmd", np.uint8))
    double = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
    hit = single | double
    q, ends = q[hit], q[hit] + np.where(single[hit], 2, 3)
    start[q + 1] = False
    ends = ends[(kind[ends] == LETTER)]
    start[ends] = True


def pretokenize(offsets: np.ndarray, data: np.ndarray, style: Style) -> Spans:
    """Spans of all texts. Strings of ``style.specials`` inside a text are spans of their own."""
    raw = data.tobytes()
    special = re.compile(b"|".join(map(re.escape, style.specials)))
    lead = np.zeros(256, bool)
    lead[[b for b in range(0xC0, 0x100) if b not in style.lead_bytes]] = True
    odd = lead[data]
    signs = np.flatnonzero((data == 0x97) | (data == 0xB7))
    signs = signs[signs > 0]
    odd[signs[data[signs - 1] == 0xC3]] = True
    # Bytes of U+0080-U+00BF and U+0250 and above are no lead bytes of the style, so they count as odd.
    odd_at = np.flatnonzero(odd)
    has_special = any(s in raw for s in style.specials)

    parts: list[bytes] = []
    explicit: list[tuple[int, list[int]]] = []  # spans that are given: place of the part and starts inside
    text_at = np.zeros(len(offsets), np.int64)
    place = 0

    def add(part: bytes, starts: list[int] | None) -> None:
        nonlocal place
        if starts is not None:
            explicit.append((place, starts))
        parts.append(part)
        place += len(part) + 1

    def add_text(a: int, b: int) -> None:
        k = int(np.searchsorted(odd_at, a))
        if k < len(odd_at) and odd_at[k] < b:
            text = raw[a:b].decode("utf-8", "replace")
            tokens = regex.findall(style.pattern, text if style.spaced else _normal(text))
            tokens = [t.encode() for t in tokens]
            lengths = np.cumsum([0, *(len(t) + 1 for t in tokens)])
            if tokens:
                add(bytes([BORDER]).join(tokens), lengths[:-1].tolist())
        elif b > a:
            cuts = [a, *(a + c for c in _cuts(data[a:b], PIECE_BYTES)), b] if b - a > 2 * PIECE_BYTES else [a, b]
            for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                add(raw[x:y], None)

    bounds = offsets.tolist()
    for k, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
        text_at[k] = place
        if has_special:
            for found in special.finditer(raw, a, b):
                add_text(a, found.start())
                add(found[0], [0])
                a = found.end()
        add_text(a, b)
    text_at[-1] = place
    joined = bytes([BORDER]).join([*parts, b""]) if parts else b""
    flat = np.frombuffer(joined, np.uint8)
    if not len(flat):
        none = np.zeros(0, np.int64)
        return Spans(b"", none, none, np.zeros(len(offsets), np.int64))
    if not style.spaced:
        flat = lower_latin(flat)
        for at, starts in explicit:  # given spans keep their bytes
            end = joined.find(bytes([BORDER]), at) if len(starts) == 1 else at + starts[-1]
            flat[at:end] = np.frombuffer(joined[at:end], np.uint8)
        joined = flat.tobytes()
    kind = CLASSES[flat]
    before = np.r_[np.uint8(EDGE), kind[:-1]]
    start = (kind != before) & (kind != EDGE)
    if style.spaced:
        after = np.r_[kind[1:], np.uint8(EDGE)]
        last = np.flatnonzero((kind == WHITE) & (after != WHITE) & (after != EDGE))
        start[last] = True
        start[last[flat[last] == 0x20] + 1] = False
        _contractions(flat, kind, start)
        stop = start | (kind == EDGE)
    else:
        start = (start & (kind != WHITE)) | (kind == DIGIT)
        _contractions(flat, kind, start)
        stop = start | (kind == EDGE) | ((kind == WHITE) & (before != WHITE))
    for at, starts in explicit:
        end = at + starts[-1]
        while flat[end] != BORDER:
            end += 1
        start[at:end], stop[at:end] = False, False
        places = at + np.array(starts)
        start[places], stop[places] = True, True
        stop[places[1:] - 1] = True
    bounds_at = np.flatnonzero(stop)
    begins = np.flatnonzero(start[bounds_at])
    starts_at = bounds_at[begins]
    return Spans(joined, starts_at, bounds_at[begins + 1], np.searchsorted(starts_at, text_at))


class HashIndex:
    """Open addressing over 64-bit hashes in numpy: hash to a number."""

    def __init__(self, bits: int = 16) -> None:
        self.keys, self.values, self.count = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32), 0

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each hash, -1 where it is not held."""
        mask = np.uint64(len(self.keys) - 1)
        slot = (hashes & mask).astype(np.int64)
        out = self.values[slot]
        open_at = np.flatnonzero((out >= 0) & (self.keys[slot] != hashes))
        slot = slot[open_at]
        while len(open_at):
            slot = (slot + 1) & int(mask)
            out[open_at] = self.values[slot]
            wrong = (out[open_at] >= 0) & (self.keys[slot] != hashes[open_at])
            open_at, slot = open_at[wrong], slot[wrong]
        return out

    def add(self, hashes: np.ndarray, values: np.ndarray) -> None:
        """New, distinct hashes."""
        self.count += len(hashes)
        if 2 * self.count > len(self.keys):
            held = self.values >= 0
            hashes, values = np.r_[self.keys[held], hashes], np.r_[self.values[held], values]
            size = 1 << int(4 * self.count - 1).bit_length()
            self.keys, self.values = np.zeros(size, np.uint64), np.full(size, -1, np.int32)
        mask = len(self.keys) - 1
        slot = (hashes & np.uint64(mask)).astype(np.int64)
        values = values.astype(np.int32)
        while len(hashes):
            free = self.values[slot] < 0
            self.keys[slot[free]], self.values[slot[free]] = hashes[free], values[free]
            left = ~(free & (self.keys[slot] == hashes))
            hashes, values, slot = hashes[left], values[left], (slot[left] + 1) & mask


class WordIndex:
    """Byte strings to numbers: the hash finds the place, the bytes decide."""

    def __init__(self) -> None:
        self.places = HashIndex()
        self.data, self.at = np.zeros(1 << 16, np.uint8), np.zeros(1, np.int64)

    def __len__(self) -> int:
        return len(self.at) - 1

    def find(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """The number of each span; -1 where its hash is not held, -2 where another string has it."""
        where = self.places.find(hashes).astype(np.int64)
        held = np.flatnonzero(where >= 0)
        own, size = self.at[where[held]], ends[held] - starts[held]
        same = self.at[where[held] + 1] - own == size
        where[held[~same]] = -2
        held, own, size = held[same], own[same], size[same]
        for k in range(0, len(held), 1 << 18):
            part, length = held[k : k + (1 << 18)], size[k : k + (1 << 18)]
            last = np.cumsum(length)
            step = np.arange(last[-1]) - np.repeat(last - length, length)
            theirs = self.data[np.repeat(own[k : k + (1 << 18)], length) + step]
            wrong = np.flatnonzero(theirs != data[np.repeat(starts[part], length) + step])
            if len(wrong):
                where[part[np.unique(np.searchsorted(last, wrong, side="right"))]] = -2
        return where

    def add(self, hashes: np.ndarray, words: list[bytes]) -> None:
        """New, distinct hashes and their strings; they get the next numbers."""
        self.places.add(hashes, len(self) + np.arange(len(hashes)))
        new = np.frombuffer(b"".join(words), np.uint8)
        used = int(self.at[-1])
        if used + len(new) > len(self.data):
            self.data = np.r_[self.data[:used], np.zeros(2 * (used + len(new)) - used, np.uint8)]
        self.data[used : used + len(new)] = new
        self.at = np.r_[self.at, used + np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))]
